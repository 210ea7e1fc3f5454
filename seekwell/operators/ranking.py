"""Blending, gates, top-k, packing, budgets, presentation order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_test_path

#: Blend weights, gates, caps.
LEXICAL_WEIGHT, SEMANTIC_WEIGHT = 0.7, 0.3
SEMANTIC_FLOOR, SELECTION_FLOOR, SELECT_ABOVE, LEAD_ABOVE, ROLE_ABOVE = 0.3, 0.25, 0.5, 0.25, 0.65
MIN_LEXICAL, MAX_CANDIDATES, MAX_UNITS, MAX_WEAK_LEADS, MAX_ROLE_FILES = 0.06, 40, 14, 8, 25
GROUP_UNITS, GROUP_BYTES, UNIT_BYTES = 2, 380, 140
ROLES = ("implementation", "caller", "test", "fixture", "helper")


def blend(scores: DataFrame) -> DataFrame:
    """(id columns, lex, sem) -> with score, the gates applied; a file without a judgment counts as 0 and goes."""
    sem = F.coalesce(F.col("sem"), F.lit(0.0))
    gated = scores.where((F.col("lex") >= MIN_LEXICAL) & (sem >= SEMANTIC_FLOOR))
    return gated.withColumn("score", LEXICAL_WEIGHT * F.col("lex") + SEMANTIC_WEIGHT * sem)


def top(scores: DataFrame, key: str = "path", k: int = MAX_CANDIDATES) -> DataFrame:
    """R2: the best ``k`` by score, ties by key."""
    return scores.orderBy(F.desc("score"), F.asc(key)).limit(k)


def overflow(scores: DataFrame, k: int = MAX_CANDIDATES) -> DataFrame:
    """R2: one row (kind, n) if more than ``k`` candidates remained."""
    return scores.agg((F.count("*") - k).alias("n")).where("n > 0").select(F.lit("candidate_limit").alias("kind"), "n")


def is_strong(score: Column) -> Column:
    """F11."""
    return score >= SELECTION_FLOOR


def top_units(units: DataFrame, key: str = "path", k: int = MAX_UNITS) -> DataFrame:
    """Of each file the ``k`` units of the highest ``lex``, ties by index; in their original order."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("lex"), F.asc("unit_idx")))
    return units.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def pack_units(units: DataFrame, key: str = "path", group_units: int = GROUP_UNITS, group_bytes: int = GROUP_BYTES, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """(key, group_idx, unit_idx): units in order, greedily packed into groups of at most ``group_units`` units and
    ``group_bytes`` bytes, a unit costing its name's bytes and ``unit_bytes``. A fold, since each group begins where the one
    before ended; an array holds a file's judged units, 14 at most in a search."""
    rows = units.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("unit_idx", (F.octet_length("name") + unit_bytes).alias("bytes")))).alias("units"))
    start = F.struct(F.lit(0).alias("group"), F.lit(0).alias("n"), F.lit(0).alias("bytes"), F.array().cast("array<struct<group_idx:int,unit_idx:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        fits = (a["n"] == 0) | ((a["n"] < group_units) & (a["bytes"] + x["bytes"] <= group_bytes))
        group = F.when(fits, a["group"]).otherwise(a["group"] + 1)
        return F.struct(
            group.alias("group"), F.when(fits, a["n"] + 1).otherwise(1).alias("n"), F.when(fits, a["bytes"] + x["bytes"]).otherwise(x["bytes"]).alias("bytes"),
            F.concat(a["out"], F.array(F.struct(group.alias("group_idx"), x["unit_idx"].cast("int").alias("unit_idx")))).alias("out"),
        )

    return rows.select(key, F.explode(F.aggregate("units", start, step)["out"]).alias("u")).select(key, "u.group_idx", "u.unit_idx")


def distinct_leads(leads: DataFrame, key: str = "path") -> DataFrame:
    """One lead for each (key, name, range), with its highest score."""
    return leads.groupBy(key, "name", "start_line", "end_line").agg(F.max("score").alias("score"))


def nested_leads(leads: DataFrame, key: str = "path") -> DataFrame:
    """(key, leads): by start line, then name."""
    lead = F.struct("start_line", "name", "end_line", "score")
    out = F.transform(F.array_sort(F.collect_list(lead)), lambda x: F.struct(x["name"].alias("name"), x["start_line"].alias("start_line"), x["end_line"].alias("end_line"), x["score"].alias("score")))
    return leads.groupBy(key).agg(out.alias("leads"))


def weak_leads(units: DataFrame, key: str = "path", k: int = MAX_WEAK_LEADS) -> DataFrame:
    """Of each file its first ``k`` units that aren't contexts or plain source, with score 0."""
    named = units.where(~F.col("name").endswith(".context") & (F.col("name") != "source"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("unit_idx"))
    return named.withColumn("nth", nth).where(F.col("nth") <= k).select(key, "name", "start_line", "end_line", F.lit(0.0).alias("score"))


def role_labels(answers: dict[str, Column]) -> Column:
    """the roles whose answer is over the limit, in the fixed order."""
    return F.array_compact(F.array(*[F.when(answers[r] > ROLE_ABOVE, F.lit(r)) for r in ROLES if r in answers]))


def presentation_order(files: DataFrame, key: str = "path") -> DataFrame:
    """Adds is_test and nth: source files, then tests, each by score, ties by path. For results of at most 40 files."""
    flagged = files.withColumn("is_test", is_test_path(F.col(key)))
    return flagged.withColumn("nth", F.row_number().over(Window.orderBy("is_test", F.desc("score"), key)))


def byte_budget(excerpts: DataFrame, budget: int, order: str = "nth", size: str = "bytes") -> DataFrame:
    """Adds kept: in ``order``, an excerpt stays if it fits what is left of the budget (0: no limit); later ones are still
    tried. A fold over one result's excerpts (those of at most 40 files)."""
    if not budget:
        return excerpts.withColumn("kept", F.lit(True))
    rows = excerpts.agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("at"), F.col(size).cast("long").alias("bytes")))).alias("all"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<bigint>").alias("kept"))
    step = lambda a, x: F.struct(F.when(x["bytes"] <= a["left"], a["left"] - x["bytes"]).otherwise(a["left"]).alias("left"), F.when(x["bytes"] <= a["left"], F.concat(a["kept"], F.array(x["at"]))).otherwise(a["kept"]).alias("kept"))
    kept = rows.select(F.aggregate("all", start, step)["kept"].alias("fits"))
    return excerpts.crossJoin(F.broadcast(kept)).withColumn("kept", F.array_contains("fits", F.col(order).cast("long"))).drop("fits")  # kept is one row


def status(issues: Column, interrupted: Column) -> Column:
    """R15."""
    return F.when(interrupted, "interrupted").when(issues > 0, "incomplete").otherwise("complete")


def issue_counts(issues: DataFrame) -> DataFrame:
    """A1, A2: (kind, n) by kind."""
    return issues.groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind")
