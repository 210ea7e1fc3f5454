"""Each content is parsed once, over the files of a run and over runs.

What a parser finds in a file depends on its language and its content alone, so files meet by (language, SHA-256), one of each is parsed, and
its findings are handed to all. With a store, findings are kept in Parquet by the day of their last use: what a run uses of earlier days is
written again under today, and a day's folder goes when it's older than the store keeps things, so nothing is ever rewritten in place.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import language
from ..schemas import INSPECTED
from ..sources.cuts import cut, remove
from .units import inspect_files

#: Days that findings are kept after their last use.
KEEP_DAYS = 30
#: Findings of a content: the columns of INSPECTED but for the path.
_COLUMNS = [c.strip().split()[0] for c in INSPECTED.replace("array<struct<start_line:int,end_line:int>>", "ranges").split(",") if not c.strip().startswith("path ")]
_SCHEMA = f"lang string, hash string, found array<struct<{INSPECTED.removeprefix('path string, ').replace(' array<', ':array<').replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean')}>>, day string"


class Store:
    """Findings by content under a path."""

    def __init__(self, spark: SparkSession, path: str, keep_days: int = KEEP_DAYS) -> None:
        self.spark, self.path, self.keep_days = spark, path.rstrip("/"), keep_days

    def days(self) -> list[str]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/day=*")
        return sorted(f.getPath().getName().removeprefix("day=") for f in hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(hadoop) or [])

    def read(self) -> DataFrame:
        """(lang, hash, found, day): each content under the last day that it was used on."""
        if not self.days():
            return self.spark.createDataFrame([], _SCHEMA)
        stored = self.spark.read.schema(_SCHEMA).parquet(self.path)
        last = stored.groupBy("lang", "hash").agg(F.max("day").alias("day"))
        return stored.join(last, ["lang", "hash", "day"]).dropDuplicates(["lang", "hash"]).select("lang", "hash", "found", "day")

    def put(self, rows: DataFrame, today: date) -> None:
        """Appends findings (lang, hash, found) under today, and drops the days that are too old."""
        rows.write.mode("append").parquet(f"{self.path}/day={today.isoformat()}")
        for day in self.days():
            if day < (today - timedelta(days=self.keep_days)).isoformat():
                remove(self.spark, f"{self.path}/day={day}")


def inspect_once(files: DataFrame, store: Store | None = None, today: date | None = None) -> tuple[DataFrame, dict[str, int]]:
    """INSPECTED rows of (path, source), as ``inspect_files`` gives them, and counts: contents (distinct ones), parsed (those not in the store).

    Paths must be distinct. A null source is a content of its own, parsed as empty."""
    today = today or date.today()
    keyed = files.select("path", language(F.col("path")).alias("lang"), F.coalesce(F.sha2(F.col("source"), 256), F.lit("")).alias("hash"))
    seen, parsed_once = Observation(), Observation()
    first = cut(keyed.groupBy("lang", "hash").agg(F.min("path").alias("path")).observe(seen, F.count("*").alias("n")))
    known = cut(first.select("lang", "hash").join(store.read(), ["lang", "hash"])) if store else None
    missing = first.join(known, ["lang", "hash"], "left_anti") if store else first
    rows = inspect_files(files.join(missing.select("path"), "path", "left_semi")).join(missing, "path")
    parsed = cut(rows.groupBy("lang", "hash").agg(F.collect_list(F.struct(*_COLUMNS)).alias("found")).observe(parsed_once, F.count("*").alias("n")))
    both = parsed.unionByName(known.select("lang", "hash", "found")) if store else parsed
    if store:
        again = known.where(F.col("day") < today.isoformat()).select("lang", "hash", "found")
        store.put(parsed.unionByName(again), today)
    out = keyed.join(both, ["lang", "hash"]).select("path", F.explode("found").alias("f")).select("path", "f.*")
    return out, {"contents": seen.get["n"], "parsed": parsed_once.get["n"]}
