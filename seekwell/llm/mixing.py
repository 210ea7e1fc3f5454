"""Operator 9, mixing sources to target weights: a time-varying curriculum, in DataFrame functions only.

Each source's documents form a stream in the order of a hash of their ids; its target T and size S say how much
of the endlessly repeated stream training demands. A document's words lie at [c, c + size) of each pass, c from
two-level prefix sums: totals of (source, bucket of the hash), then a window inside each bucket, so no source has
to fit one task. The copy of pass e is taken if its middle e * S + c + size / 2 lies below T. The weight schedule
of the source, a piecewise linear rate over training time, is integrated at its knots; inverting that integral at
the copy's share of the demand gives its training position, by which copies are range-sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, documents, partitions

WORD = r"[^\x20\x09-\x0D]+"
#: Production parameters: weights by the source's place, the most repeats, rates over training time by weight, documents of a bucket.
WEIGHTS, MOST = (1, 2, 3), 3
SCHEDULES = {1: ((0.0, 1.0), (1.0, 1.0)), 2: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)), 3: ((0.0, 1.5), (1.0, 0.5))}
BUCKET_ROWS = 2000


def position_at(u: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Training time in [0, 1] at which the integral of the rate given by ``knots`` reaches the share ``u`` of its total."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    total, before, out = sum(areas), 0.0, None
    for (t, w), (t2, w2), area in zip(knots, knots[1:], areas, strict=False):
        q = F.greatest(u * F.lit(total) - F.lit(before), F.lit(0.0))
        slope = (w2 - w) / (t2 - t)
        root = F.sqrt(F.greatest(F.lit(w * w) + q * F.lit(2 * slope), F.lit(0.0)))
        at = F.lit(t) + F.when(q > 0, q * F.lit(2.0) / (F.lit(w) + root)).otherwise(F.lit(0.0))
        out = F.when(u * F.lit(total) <= F.lit(before + area), at) if out is None else out.when(u * F.lit(total) <= F.lit(before + area), at)
        before += area
    return F.least(out.otherwise(F.lit(knots[-1][0])), F.lit(1.0))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (mix_source, mix_total) with mix_weight and mix_target.

    Weights go round over the sources in code-point order, null last; together the targets are the sum of all sizes.
    A target stops at ``most`` times its source's size; what is over goes to the others by weight. Capped are the
    sources of least size for their weight, so one pass in that order finds the level where none is above its cap.
    A row per source goes through one task here, so sources must number at most some millions.
    """
    by_name, by_room = Window.orderBy(F.col("mix_source").asc_nulls_last()), Window.orderBy("room", "place")
    everyone = Window.partitionBy()
    place = F.row_number().over(by_name) - 1
    rows = sizes.withColumn("place", place).withColumn("mix_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("room", F.lit(float(most)) * F.col("mix_total") / F.col("mix_weight"))
    upto = by_room.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("capped", F.coalesce(F.sum(F.col("mix_total") * most).over(upto), F.lit(0))).withColumn("weight_left", F.sum("mix_weight").over(everyone) - F.coalesce(F.sum("mix_weight").over(upto), F.lit(0)))
    rows = rows.withColumn("level", (F.sum("mix_total").over(everyone) - F.col("capped")) / F.col("weight_left"))
    level = F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "place", "level"))).over(everyone)["level"]
    return rows.withColumn("mix_target", F.least(F.lit(float(most)) * F.col("mix_total"), F.col("mix_weight") * level).cast("double")).select("mix_source", "mix_total", "mix_weight", "mix_target")


def mix(docs: DataFrame, keep: Sequence[str] = (), weights: Sequence[int] = WEIGHTS, most: int = MOST, schedules: dict = SCHEDULES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: mix_row (a struct of the columns ``keep``, if any), mix_id, mix_size (words), mix_total (of the source), mix_target, mix_copies and
    mix_positions (a training position for each copy, ascending).

    Null texts have size 0; a null source is a source of its own, the last; rows of null ids are dealt by their texts.
    Rows of one id follow by size; wholly equal rows are interchangeable, and all are kept. A source of size 0 keeps
    its documents once. An empty table gives an empty result. Names of other columns can't clash.
    """
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("-"), F.xxhash64(text_col).cast("string"))))
    row = [F.struct(*keep).alias("mix_row")] if keep else []
    rows = docs.select(*row, F.col(id_col).alias("mix_id"), F.col(source_col).alias("mix_source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("mix_size"), digest.alias("mix_hash"))
    rows = rows if keep else cut(rows, "sizes")  # without texts they are narrow, and words are counted once
    digits, n = 1, docs.count()
    while n > BUCKET_ROWS * 16**digits:
        digits += 1
    rows = rows.withColumn("mix_bucket", F.substring("mix_hash", 1, digits))
    buckets = cut(rows.groupBy("mix_source", "mix_bucket").agg(F.sum("mix_size").alias("bucket_size")), "buckets")
    targets = source_targets(buckets.groupBy("mix_source").agg(F.sum("bucket_size").alias("mix_total")), weights, most)
    before = Window.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = buckets.withColumn("base", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).join(targets.withColumnRenamed("mix_source", "s"), F.col("mix_source").eqNullSafe(F.col("s")))
    bases = cut(bases.select(F.col("mix_source").alias("s"), F.col("mix_bucket").alias("b"), "base", "mix_total", "mix_weight", "mix_target"), "bases")
    joined = rows.join(bases, F.col("mix_source").eqNullSafe(F.col("s")) & (F.col("mix_bucket") == F.col("b")))
    inside = Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_hash", F.col("mix_id").asc_nulls_first(), "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("base") + F.coalesce(F.sum("mix_size").over(inside), F.lit(0)) + F.col("mix_size") / F.lit(2.0)
    out = joined.withColumn("middle", middle)
    copies = F.when(F.col("mix_total") == 0, F.lit(1)).otherwise(F.greatest(F.ceil((F.col("mix_target") - F.col("middle")) / F.col("mix_total")), F.lit(0))).cast("int")
    out = out.withColumn("mix_copies", copies)
    share = lambda e: F.when(F.col("mix_target") > 0, (F.col("middle") + e * F.col("mix_total")) / F.col("mix_target")).otherwise(F.lit(0.5))
    place = lambda e: _by_weight(share(e), schedules)
    positions = F.when(F.col("mix_copies") > 0, F.transform(F.sequence(F.lit(0), F.col("mix_copies") - 1), place)).otherwise(F.array().cast("array<double>"))
    return out.withColumn("mix_positions", positions).select(*(["mix_row"] if keep else []), "mix_id", "mix_size", "mix_total", "mix_target", "mix_copies", "mix_positions")


def _by_weight(u: Column, schedules: dict) -> Column:
    out = None
    for weight, knots in schedules.items():
        at = position_at(u, knots)
        out = F.when(F.col("mix_weight") == weight, at) if out is None else out.when(F.col("mix_weight") == weight, at)
    return out.otherwise(F.least(u, F.lit(1.0)))


def training_order(mixed: DataFrame) -> DataFrame:
    """A row per copy: the columns kept by ``mix`` (at least one), range-sorted by training position (ties by id)."""
    copies = mixed.select("mix_row", "mix_id", F.explode("mix_positions").alias("mix_position"))
    return copies.repartitionByRange(partitions(mixed.sparkSession), "mix_position", "mix_id").sortWithinPartitions("mix_position", "mix_id").select("mix_row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir))
    rows = mixed.select(F.col("mix_id").alias("doc_id"), F.col("mix_size").alias("size"), F.col("mix_total").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).cast("long").alias("taken"), F.round(F.get("mix_positions", F.lit(0)), 6).alias("position"))
    return rows.repartitionByRange(partitions(spark), "position", "doc_id").sortWithinPartitions("position", "doc_id")


def _sql_position() -> str:
    cases = []
    for weight, knots in SCHEDULES.items():
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
        before = 0.0
        for (t, w), (t2, w2), area in zip(knots, knots[1:], areas, strict=False):
            q, slope = f"greatest(u * {sum(areas)!r} - {before!r}, 0)", (w2 - w) / (t2 - t)
            cases.append(f"WHEN weight = {weight} AND u * {sum(areas)!r} <= {before + area!r} THEN {t!r}::DOUBLE + CASE WHEN {q} > 0 THEN {q} * 2 / ({w!r}::DOUBLE + sqrt(greatest({w * w!r}::DOUBLE + {q} * {2 * slope!r}::DOUBLE, 0))) ELSE 0 END")
            before += area
    return "CASE " + " ".join(cases) + " ELSE 1 END"


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, md5(doc_id::VARCHAR) AS h,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
r AS (SELECT *, 3.0::DOUBLE * source_size / weight AS room FROM w),
c AS (
  SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left,
         sum(source_size) OVER () AS everything FROM r),
l AS (SELECT *, ((everything - capped)::DOUBLE / weight_left::DOUBLE) AS level FROM c),
t AS (
  SELECT source, source_size, weight, least(3.0::DOUBLE * source_size, weight * (SELECT level FROM l WHERE level <= room ORDER BY room, source NULLS LAST LIMIT 1))::DOUBLE AS target FROM l),
m AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.weight,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + d.size / 2.0::DOUBLE AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (
  SELECT *, CASE WHEN source_size = 0 THEN 1 ELSE greatest(ceil((target - middle) / source_size), 0) END::BIGINT AS copies,
         CASE WHEN target > 0 THEN middle / target ELSE 0.5 END AS u FROM m)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, CASE WHEN copies > 0 THEN round(least({_sql_position()}, 1), 6) END AS position FROM n
"""
