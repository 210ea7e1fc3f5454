"""The relevance judge and its cache of answers.

A judge answers boolean questions about a short state with probabilities. Requests are clamped, keyed, joined to the
cache; only distinct misses reach the judge, in Arrow batches inside mapInPandas, where a model would be loaded
once per worker on the first batch, so a fully cached run loads none. The default judge is a pure function of terms.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import TERM_CUTS, clamp_bytes, variants_of
from ..schemas import ANSWERS
from ..sources.cuts import cut

#: Bytes of a state, requests of a run; cache schema, days an answer lives, bytes of the cache and of an entry.
STATE_BYTES, MAX_REQUESTS = 1000, 6000
#: Requests that one job judges.
CHUNK_REQUESTS = 1000
SCHEMA, TTL_DAYS, CACHE_BYTES, ENTRY_BYTES = 1, 7, 256 << 20, 1 << 20


class Judge(Protocol):
    """Something that answers questions; it's sent to the workers, so it must pickle and should load models lazily."""

    name: str

    def predict(self, state: str, questions: dict[str, str]) -> dict[str, float]: ...


class TermJudge:
    """The default: the share of a question's distinct terms (with their variants) that the state holds."""

    name = "terms-1"

    def predict(self, state: str, questions: dict[str, str]) -> dict[str, float]:
        import re

        split = lambda text: [t.lower() for t in re.split(TERM_CUTS, text) if len(t) >= 2]
        held = {v for t in split(state) for v in variants_of(t)}
        out = {}
        for qid, text in questions.items():
            asked = set(split(text))
            out[qid] = sum(bool(variants_of(t) & held) for t in asked) / len(asked) if asked else 0.0
        return out


class KeywordJudge:
    """The test double: 0.95 where the state holds a keyword, else 0.05."""

    name = "keyword-1"

    def __init__(self, keyword: str) -> None:
        self.keyword = keyword

    def predict(self, state: str, questions: dict[str, str]) -> dict[str, float]:
        return dict.fromkeys(questions, 0.95 if self.keyword.lower() in state.lower() else 0.05)


def file_question(query: str) -> str:
    """P12."""
    return f"Does this file hold code or text that answers: {' '.join(query.split())}"


def unit_question(query: str, name: str) -> str:
    return f"Is {name} needed to answer: {' '.join(query.split())}"


def role_questions(query: str) -> dict[str, str]:
    asked = " ".join(query.split())
    return {
        "implementation": f"Does this file implement what is asked: {asked}", "caller": f"Does this file call what is asked about: {asked}",
        "test": f"Does this file test what is asked about: {asked}", "fixture": f"Does this file hold test data or fixtures for: {asked}",
        "helper": f"Does this file hold helpers used by: {asked}",
    }


def cache_key(namespace: str) -> Column:
    """K1: SHA-256 of schema, namespace and the request, its questions sorted."""
    request = F.struct(F.lit(SCHEMA).alias("schema"), F.lit(namespace).alias("namespace"), F.col("state").alias("state"), F.array_sort("questions").alias("questions"))
    return F.sha2(F.to_json(request), 256)


def valid(answers: Column, qids: Column) -> Column:
    """an answer for each question, finite and between 0 and 1."""
    return F.forall(qids, lambda q: F.coalesce(~F.isnan(F.try_element_at(answers, q)) & F.try_element_at(answers, q).between(0.0, 1.0), F.lit(False)))


def live(cache: DataFrame, now: Column) -> DataFrame:
    """K2: entries of this schema, younger than the limit, of an entry's size at most, all answers finite."""
    fresh = (F.col("created_at") > now - F.expr(f"INTERVAL {TTL_DAYS} DAYS")) & (F.col("schema") == SCHEMA) & (F.col("bytes") <= ENTRY_BYTES)
    return cache.where(fresh & F.forall(F.map_values("answers"), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))))


def trim(cache: DataFrame, most: int = CACHE_BYTES) -> DataFrame:
    """The newest entries whose bytes together stay within ``most``; ties by key."""
    # The running sum over whole hours of entries comes first, so no task orders the whole cache or a day of it.
    dated = cache.withColumn("hour", F.date_trunc("hour", "created_at"))
    hours = dated.groupBy("hour").agg(F.sum("bytes").alias("hour_bytes"))
    newer = hours.withColumn("newer", F.coalesce(F.sum("hour_bytes").over(Window.orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("hour").orderBy(F.desc("created_at"), "key").rowsBetween(Window.unboundedPreceding, 0)
    upto = dated.join(newer, "hour").withColumn("upto", F.col("newer") + F.sum("bytes").over(inside))
    return upto.where(F.col("upto") <= most).select(*cache.columns)


class AnswerCache:
    """Answers as Parquet under a path; ``clear`` empties it. What goes wrong with it never stops a search; ``warnings`` counts it by kind (K6, A2).

    Answers are appended. Trimming writes what stays as a whole next generation beside the path, and the ones before go only when Spark's
    writer has marked it complete; until then they are what's read, so a run that breaks off loses nothing.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.warnings = spark, path.rstrip("/"), {}

    def warn(self, kind: str, n: int = 1) -> None:
        self.warnings[kind] = self.warnings.get(kind, 0) + n

    def _files(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _generations(self) -> list[int]:
        """The complete ones, the newest last; the path itself, which is older than all of them, isn't among them."""
        system, at = self._files(f"{self.path}.generations/*/_SUCCESS")
        return sorted(int(f.getPath().getParent().getName()) for f in system.globStatus(at) or [])

    def current(self) -> str:
        """The folder that answers are read from and appended to."""
        found = self._generations()
        return f"{self.path}.generations/{found[-1]}" if found else self.path

    def read(self) -> DataFrame | None:
        """All entries, or None where nothing is stored. Files that aren't Parquet are left out with a warning."""
        try:
            path = self.current()
            system, at = self._files(path)
            if not system.exists(at):
                return None
        except Exception:  # of any file system
            self.warn("cache_unavailable")
            return None
        stored = self.spark.read.schema(ANSWERS)
        try:
            stored.parquet(path).count()  # of the footers
            return stored.parquet(path)
        except Exception:  # Spark's, by Py4J or Connect
            self.warn("cache_corrupt")
            return stored.option("ignoreCorruptFiles", "true").parquet(path)

    def put(self, answers: DataFrame, most: int = CACHE_BYTES) -> None:
        """K3, K4: appends the finite answers that fit an entry, then leaves the newest within the cache's bytes."""
        finite = F.forall(F.map_values("answers"), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
        seen = Observation()
        watched = answers.observe(seen, F.sum(F.when(F.col("bytes") > ENTRY_BYTES, 1).otherwise(0)).alias("over"))
        try:
            watched.where(finite & (F.col("bytes") <= ENTRY_BYTES)).write.mode("append").parquet(self.current())
        except Exception:
            self.warn("cache_unavailable")
            return
        if over := seen.get["over"]:
            self.warn("cache_limit", over)
        stored = self.read()
        if stored is not None and (stored.agg(F.sum("bytes").alias("n")).first()["n"] or 0) > most:
            self.trim(stored, most)

    def trim(self, stored: DataFrame, most: int = CACHE_BYTES) -> None:
        """K4: the next generation holds the newest of ``stored``; earlier ones go when it's complete."""
        before = self._generations()
        number = max(before, default=0) + 1
        trim(stored, most).write.mode("overwrite").parquet(f"{self.path}.generations/{number}")
        for old in [self.path, *(f"{self.path}.generations/{n}" for n in before)]:
            system, at = self._files(old)
            system.delete(at, True)

    def clear(self) -> None:
        for path in (self.path, f"{self.path}.generations"):
            system, at = self._files(path)
            system.delete(at, True)


class Stop:
    """A wish to end: calling it (from any thread) ends the judging that runs and keeps more from beginning; what's judged stays."""

    def __init__(self, spark: SparkSession) -> None:
        self.context, self.tag, self.asked = spark.sparkContext, f"seekwell-{uuid.uuid4().hex}", threading.Event()

    def __call__(self) -> None:
        self.asked.set()
        self.context.cancelJobsWithTag(self.tag)

    @contextmanager
    def watching(self) -> Iterator[None]:
        """Jobs that begin inside, in this thread, are ended by a call."""
        self.context.addJobTag(self.tag)
        try:
            yield
        finally:
            self.context.removeJobTag(self.tag)


def ask(requests: DataFrame, judge: Judge, workers: int | None = None) -> DataFrame:
    """M1, M4, M6, M7: (key, answers, error) for distinct requests (key, state, questions), by ``workers`` tasks if given. A judge that raises
    gives no answers but its message."""

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(state: str, questions: list) -> tuple[dict | None, str | None]:
            try:
                return {k: float(v) for k, v in judge.predict(state, {q["qid"]: q["instructions"] for q in questions}).items()}, None
            except Exception as e:  # whatever a model's library raises
                return None, f"{type(e).__name__}: {e}"

        for b in batches:
            found = [one(s, qs) for s, qs in zip(b["state"], b["questions"], strict=True)]
            yield pd.DataFrame({"key": b["key"], "answers": [a for a, _ in found], "error": [e for _, e in found]}, dtype=object)

    rows = requests.select("key", "state", "questions")
    return (rows.repartition(workers) if workers else rows).mapInPandas(predict, "key string, answers map<string,double>, error string")


def evaluate(requests: DataFrame, judge: Judge, cache: AnswerCache | None = None, now: Column | None = None, limit: int = MAX_REQUESTS, workers: int | None = None, stop: Stop | None = None, chunk: int = CHUNK_REQUESTS) -> tuple[DataFrame, dict]:
    """(req_id, answers or null), and counts: requests (distinct ones judged), cache_hits, refused (over the limit, or not judged
    because of ``stop``), invalid, and failure, the first message of the judge (A9).

    requests (req_id, state, questions). States are clamped; equal requests are judged once (D15); invalid answers are null. Where
    there are more than ``limit``, files nearer to the root go first, then by req_id (M10). Misses are judged in chunks in that order, a job
    each, and ``stop`` is looked at between them; the answers of a chunk that it ends are lost, those of the chunks before are kept and
    cached. Counts are observed as the tables are written (A12), without jobs of their own.
    """
    keyed = requests.withColumn("state", clamp_bytes(F.col("state"), STATE_BYTES)).withColumn("key", cache_key(judge.name))
    keyed = cut(keyed)
    stored = cache.read() if cache else None
    if stored is not None:
        hits = live(stored, now if now is not None else F.current_timestamp()).groupBy("key").agg(F.max_by("answers", "created_at").alias("answers"))
        hits = keyed.select("key", "questions").dropDuplicates(["key"]).join(hits, "key").where(valid(F.col("answers"), F.transform("questions", lambda q: q["qid"]))).select("key", "answers")
        hits = cut(hits)
        misses = keyed.join(hits, "key", "left_anti")
    else:
        hits, misses = None, keyed
    place = F.struct((F.length("req_id") - F.length(F.replace(F.col("req_id"), F.lit("/")))).alias("depth"), F.col("req_id").alias("id"))
    seen = Observation()
    distinct = misses.groupBy("key").agg(F.min(place).alias("place"), F.first("state").alias("state"), F.first("questions").alias("questions"))
    distinct = cut(distinct.observe(seen, F.count("*").alias("n")))
    n_keys = seen.get["n"]
    chosen = distinct.orderBy("place").limit(limit) if n_keys > limit else distinct
    n_chunks = -(-min(n_keys, limit) // chunk)
    if n_chunks > 1:  # at most ``limit`` rows are numbered
        chosen = cut(chosen.withColumn("chunk", F.floor((F.row_number().over(Window.orderBy("place")) - 1) / chunk)))
    fresh, n_fresh, failed = [], 0, []
    for k in range(n_chunks):
        if stop and stop.asked.is_set():
            break
        part = chosen.where(F.col("chunk") == k) if n_chunks > 1 else chosen
        seen = Observation()
        fault = F.min(F.when(F.col("error").isNotNull(), F.struct("place", "error")))
        judged = ask(part, judge, workers).join(part.select("key", "place"), "key").observe(seen, F.count("*").alias("n"), fault.alias("fault"))
        try:
            with stop.watching() if stop else nullcontext():
                rows = cut(judged)
        except Exception:  # Spark's, when its job is ended
            if stop and stop.asked.is_set():
                break
            raise
        fresh.append(rows.where("answers IS NOT NULL").select("key", "answers"))
        n_fresh += seen.get["n"]
        if seen.get["fault"]:
            failed.append(seen.get["fault"]["error"])
    known = [x.withColumn("cached", F.lit(False)) for x in fresh] + ([hits.withColumn("cached", F.lit(True))] if hits is not None else [])
    if cache and n_fresh:
        rows = reduce(DataFrame.unionByName, fresh)
        cache.put(rows.select("key", F.lit(SCHEMA).alias("schema"), (now if now is not None else F.current_timestamp()).alias("created_at"), "answers", F.octet_length(F.to_json("answers")).cast("long").alias("bytes")))
    if not known:
        known = [keyed.select("key", F.lit(None).cast("map<string,double>").alias("answers"), F.lit(False).alias("cached")).limit(0)]
    joined = keyed.join(reduce(DataFrame.unionByName, known), "key", "left")
    ok = F.coalesce(valid(F.col("answers"), F.transform("questions", lambda q: q["qid"])), F.lit(False))
    seen = Observation()
    good = joined.select("req_id", F.when(ok, F.col("answers")).alias("answers"), "cached")
    out = cut(good.observe(seen, F.coalesce(F.sum(F.when(F.col("cached"), 1)), F.lit(0)).alias("hits"), F.coalesce(F.sum(F.when(F.col("answers").isNull(), 1)), F.lit(0)).alias("invalid")).select("req_id", "answers"))
    counts = {"requests": n_fresh, "cache_hits": seen.get["hits"], "refused": n_keys - n_fresh, "invalid": seen.get["invalid"], "failure": next(iter(failed), None)}
    return out, counts


def judge_bool(judge: Judge, state: str, question: str) -> float:
    """M9."""
    return judge.predict(state, {"q": question})["q"]
