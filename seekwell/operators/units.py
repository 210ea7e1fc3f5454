"""The parsers as tables: units, comments and modes of files, in one pass of mapInPandas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import language
from ..functions.scanners import CHUNK_BYTES, inspect
from ..schemas import INSPECTED


def inspect_files(files: DataFrame) -> DataFrame:
    """INSPECTED rows of (path, source): kind unit (in order of unit_idx) or comment; a file without either has one row of kind mode."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, source, lang in zip(b["path"], b["source"], b["lang"], strict=True):
                found = inspect(lang, source or "")
                rows.append((path, "mode", None, None, None, None, None, None, [], None, found.mode))
                rows += [(path, "unit", i, u.name, u.start_line, u.end_line, u.byte_start, u.byte_end, [{"start_line": a, "end_line": z} for a, z in u.owner_headers], u.partial, found.mode) for i, u in enumerate(found.units)]
                rows += [(path, "comment", None, None, a, z, None, None, [], None, found.mode) for a, z in found.comments]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("path kind unit_idx name start_line end_line byte_start byte_end owner_headers partial mode").split()])

    return files.select("path", "source", language(F.col("path")).alias("lang")).mapInPandas(run, INSPECTED)


def units(inspected: DataFrame) -> DataFrame:
    return inspected.where("kind = 'unit'").drop("kind", "mode")


def comments(inspected: DataFrame) -> DataFrame:
    """Distinct comment ranges."""
    return inspected.where("kind = 'comment'").select("path", "start_line", "end_line").distinct()


def text_chunks(docs: DataFrame, id_col: str = "path", text_col: str = "source", most: int = CHUNK_BYTES) -> DataFrame:
    """U13 for a table of texts: (id, unit_idx, start_line, end_line, byte_start, byte_end): chunks of at most ``most`` bytes, extended to a
    character's end, cut back to the last line end where there is one behind the first byte. Null and empty texts have none.

    A fold over a text's lines with byte places alone: a chunk closes where a line begins whose end it can't hold; one line that's longer
    than a chunk is cut on and on.
    """
    rows = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.split(text_col, "\n").alias("lines"), F.encode(F.col(text_col), "UTF-8").alias("data"), F.octet_length(text_col).alias("size"))
    let = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  # evaluates value once
    inside = lambda at: F.hex(F.substring(F.col("data"), at + 1, F.lit(1))).between("80", "BF")  # noqa: E731  # of a character that began before
    whole = lambda at: at + most + F.when(~inside(at + most), 0).when(~inside(at + most + 1), 1).when(~inside(at + most + 2), 2).otherwise(3)

    def state(at: Column, line: Column, pos: Column, ended: Column, out: Column) -> Column:
        """Where the open chunk begins, its first line, where the lines so far end, how many line ends there were, the closed chunks."""
        return F.struct(at.alias("at"), line.alias("line"), pos.alias("pos"), ended.alias("ended"), out.alias("out"))

    def closed(a: Column, end: Column, last: Column) -> Column:
        chunk = F.struct(a["line"].alias("start_line"), F.greatest(a["line"], last).alias("end_line"), a["at"].alias("byte_start"), end.alias("byte_end"))
        return state(end, a["ended"] + 1, a["pos"], a["ended"], F.concat(a["out"], F.array(chunk)))

    def step(a: Column, x: Column) -> Column:
        def with_end(e: Column) -> Column:
            at_line = F.when((e > a["at"] + most) & (a["pos"] >= a["at"] + 2) & (whole(a["at"]) < F.col("size")), closed(a, a["pos"], a["ended"])).otherwise(a)
            cut_on = lambda b: F.aggregate(F.sequence(F.lit(0), F.floor((e - b["at"]) / most).cast("int")), b, lambda c, _: F.when(e > c["at"] + most, closed(c, whole(c["at"]), c["ended"] + 1)).otherwise(c))
            of_line = lambda b: F.when(e > b["at"] + most, cut_on(b)).otherwise(b)
            return let(let(at_line, of_line), lambda c: state(c["at"], c["line"], e, c["ended"] + 1, c["out"]))

        return let(F.least(a["pos"] + F.octet_length(x) + 1, F.col("size")), with_end)

    def finish(a: Column) -> Column:
        last = F.size("lines") - F.when(F.element_at("lines", -1) == "", 1).otherwise(0)
        return F.when(a["at"] < F.col("size"), closed(a, F.col("size"), last)["out"]).otherwise(a["out"])

    none = F.array().cast("array<struct<start_line:int,end_line:int,byte_start:int,byte_end:int>>")
    chunks = F.aggregate("lines", state(F.lit(0), F.lit(1), F.lit(0), F.lit(0), none), step, finish)
    return rows.select("id", F.posexplode(chunks).alias("unit_idx", "c")).select(F.col("id").alias(id_col), "unit_idx", "c.*")
