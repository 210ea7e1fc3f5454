"""Line ranges: merging, expanding, cutting to size, containment.

Merging is gaps and islands: a range begins an island where it starts past the furthest end before it. All
windows are partitioned by file, the largest group there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

#: Lines around a selected unit; bytes of an excerpt.
WINDOW_LINES, EXCERPT_BYTES = 3, 24_000


def merge(ranges: DataFrame, key: str = "path", gap: int = 1) -> DataFrame:
    """(key, start_line, end_line) with ranges joined that overlap or touch (up to ``gap`` lines apart); inverted ones go."""
    order = Window.partitionBy(key).orderBy("start_line", "end_line")
    rows = ranges.select(key, "start_line", "end_line").where("start_line <= end_line")
    furthest = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = rows.withColumn("opens", F.when(F.col("start_line") <= furthest + gap, 0).otherwise(1))
    island = flagged.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("island")


def expand(ranges: DataFrame, line_counts: DataFrame, comments: DataFrame | None = None, blanks: DataFrame | None = None, key: str = "path", around: int = WINDOW_LINES) -> DataFrame:
    """Each range with ``around`` lines on both sides, clamped to its file, then with the comments that touch it or are
    parted from it by blank lines only, however many follow one another (D6).

    line_counts (key, n_lines); comments (key, start_line, end_line); blanks (key, start_line, end_line), runs of blank lines.
    A comment and the blank runs next to it are bridges: what they join is one range, but bridges without a selected
    range are no part of the result, and a range doesn't end in a blank run.
    """
    wide = ranges.where("start_line <= end_line").join(line_counts, key).select(key, F.greatest(F.col("start_line") - around, F.lit(1)).alias("start_line"), F.least(F.col("end_line") + around, F.col("n_lines")).cast("int").alias("end_line"))
    if comments is None:
        return merge(wide, key)
    rows = wide.withColumn("kind", F.lit(0)).unionByName(comments.select(key, "start_line", "end_line").withColumn("kind", F.lit(1)))
    if blanks is not None:
        rows = rows.unionByName(blanks.select(key, "start_line", "end_line").withColumn("kind", F.lit(2)))
    order = Window.partitionBy(key).orderBy("start_line", "end_line", "kind")
    furthest = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = rows.withColumn("opens", F.when(F.col("start_line") <= furthest + 1, 0).otherwise(1)).withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    solid = lambda column: F.when(F.col("kind") < 2, F.col(column))
    merged = island.groupBy(key, "island").agg(F.min(solid("start_line")).alias("start_line"), F.max(solid("end_line")).alias("end_line"), F.min("kind").alias("kind"))
    return merged.where("kind = 0").select(key, "start_line", "end_line")


def excerpts(ranges: DataFrame, sources: DataFrame, key: str = "path", most: int = EXCERPT_BYTES) -> DataFrame:
    """(key, start_line, end_line, source, cut): the text of each range, cut after the last whole line that fits ``most`` bytes
    (one line at least). sources (key, source). A source meets all its ranges at once and is split into lines once."""
    files = ranges.groupBy(key).agg(F.collect_list(F.struct("start_line", "end_line")).alias("ranges")).join(sources.select(key, "source"), key)

    def step(a: Column, x: Column) -> Column:
        """Bytes so far after each line of a range, and how many lines stay."""
        size = a["bytes"] + F.octet_length(x) + 1
        fits = a["open"] & (size <= most)
        return F.struct(size.alias("bytes"), F.when(fits | (a["kept"] == 0), a["kept"] + 1).otherwise(a["kept"]).alias("kept"), fits.alias("open"))

    def shown(r: Column, lines: Column, kept: Column) -> Column:
        return F.struct(
            r["start_line"].alias("start_line"), (r["start_line"] + kept - 1).alias("end_line"), F.array_join(F.slice(lines, F.lit(1), kept), "\n").alias("source"),
            (kept < F.size(lines)).alias("cut"),
        )

    start = F.struct(F.lit(0).cast("long").alias("bytes"), F.lit(0).alias("kept"), F.lit(True).alias("open"))
    let = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  # evaluates value once
    of_range = lambda r, lines: let(F.slice(lines, r["start_line"], r["end_line"] - r["start_line"] + 1), lambda some: let(F.aggregate(some, start, step)["kept"], lambda kept: shown(r, some, kept)))
    every = let(F.split("source", "\n"), lambda lines: F.transform("ranges", lambda r: of_range(r, lines)))
    return files.select(key, F.explode(every).alias("e")).select(key, "e.*")


def innermost(points: DataFrame, units: DataFrame, key: str = "path") -> DataFrame:
    """Each point (key, line) with the name and index of the unit (key, unit_idx, name, start_line, end_line) that holds it and
    starts last, of those the last; null where none does.

    A sweep: beginnings of units and points are one stream of events in each file's order. Begun units lie on a stack, the one begun last
    on top; those that end before a point are taken off as it looks at the top, since no later point is theirs either. A task holds the units
    that are open at a place, not a file's events. Repeated points give a row each, as do points of a null key or line, which no unit holds.

    Events are dealt by a hash of the key: where both sides are already dealt by the key itself, Spark drops a deal by it above their union,
    and then merges small partitions of each side by itself, so that a file's units and points part.
    """
    begin = units.where("start_line <= end_line").select(
        F.col(key).alias("k"), F.col("start_line").cast("long").alias("at"), F.lit(0).alias("kind"), F.col("unit_idx").cast("long").alias("idx"), F.col("end_line").cast("long").alias("until"), "name", F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("point"),
    )
    look = points.select(F.col(key).alias("k"), F.col("line").cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("idx"), F.lit(None).cast("long").alias("until"), F.lit(None).cast("string").alias("name"), F.struct(*points.columns).alias("point"))
    events = begin.unionByName(look).repartition(F.xxhash64("k")).sortWithinPartitions("k", "at", "kind", "idx")
    named = StructType([*points.schema.fields, StructField("unit", StringType()), StructField("unit_idx", units.schema["unit_idx"].dataType)])
    plain = points.schema.names

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, stack = object(), []
        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            rows, found = [], []
            for i, (k, at, kind, idx, until, name) in enumerate(zip(batch.column("k").to_pylist(), batch.column("at").to_pylist(), kinds, batch.column("idx").to_pylist(), batch.column("until").to_pylist(), batch.column("name").to_pylist(), strict=True)):
                if k != file:
                    file, stack = k, []
                if not kind:
                    stack.append((until, name, idx))
                    continue
                while stack and at is not None and stack[-1][0] < at:
                    stack.pop()
                rows.append(i)
                found.append(stack[-1] if stack and k is not None and at is not None else (None, None, None))
            if rows:
                point = batch.column("point").take(pa.array(rows))
                columns = [point.field(c) for c in range(len(plain))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int64()).cast(index_type)], names=[*plain, "unit", "unit_idx"])

    index_type = to_arrow_type(units.schema["unit_idx"].dataType)
    return events.mapInArrow(sweep, named)


def contained(inner: DataFrame, outer: DataFrame, key: str = "path") -> DataFrame:
    """The rows of ``inner`` whose range lies in some range of ``outer``, left semi.

    In order of their starts, a range lies in an earlier one if the furthest end of an outer range so far isn't before its own end: one
    sort of both sides, no pairs. Rows travel as one struct, so names can't clash; those of a null key or bound lie in nothing.
    """
    rows = inner.where(F.col(key).isNotNull() & F.col("start_line").isNotNull()).select(F.col(key).alias("k"), F.col("start_line").alias("a"), F.col("end_line").alias("b"), F.struct(*inner.columns).alias("row"))
    whole = outer.where(F.col(key).isNotNull() & F.col("start_line").isNotNull()).select(F.col(key).alias("k"), F.col("start_line").alias("a"), F.col("end_line").alias("b"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"))
    order = Window.partitionBy("k").orderBy("a", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("row").isNull(), F.col("b"))).over(order)
    return rows.unionByName(whole).withColumn("reach", reach).where(F.col("row").isNotNull() & (F.col("b") <= F.col("reach"))).select("row.*")
