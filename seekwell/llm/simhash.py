"""Operator 7, SimHash near-dedup with BK-trees.

Distinct fingerprints are sharded by the pigeonhole principle: of k blocks of bits, two fingerprints within radius
r agree on at least k - r, so each goes to one shard for every choice of k - r blocks, and each link lies whole in
some shard; k grows with the number of fingerprints so that shards stay small. In a shard, a BK-tree (children
keyed by the integer Hamming distance to their parent) is searched along the edges within the radius, then takes
the fingerprint in. The fingerprints of shards over the limit, which are alike in many bits, are dealt anew by more and
narrower blocks. What is over the limit at the finest division is cut into parts of at most the limit: each part's tree is
sent to all chunks of the shard, so links between parts are found too and no task holds more than two of them.
A shard gives a shallow spanning tree of each group it sees, not its pairs; the groups are joined by contraction.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .shared import cut, documents, filled, partitions, sliced

#: Production parameters: words of a shingle, differing bits of a link, fingerprints of a tree, mean fingerprints of a shard.
WORDS, RADIUS, TREE_NODES, SHARD_MEAN = 4, 4, 4096, 256
#: Blocks of the finest division.
FINEST = 12


def fingerprint(text: str, words: int = WORDS) -> int:
    """The unsigned 64-bit fingerprint of one text; 0 without words."""
    w = text.encode().lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    lens = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(lens + 1) - 1
    k = min(words, len(w))
    begins = (ends - lens)[: len(w) - k + 1].tolist()
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in zip(begins, ends[k - 1 :].tolist(), strict=True)]), np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[i : i + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp: the fingerprint as a signed long, text_hash) of each row; a null text is empty."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps = [fingerprint(t, words) for t in filled(batch.column(1)).to_pylist()]
            yield pa.record_batch({"id": batch.column(0), "fp": pa.array(np.array(fps, np.uint64).view(np.int64)), "text_hash": batch.column(2)})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(make, "id long, fp long, text_hash long")


class BKTree:
    """Distinct integers; ``near`` follows only the edges whose distance is within the radius of the query's own."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        values, children, at = self.values, self.children, 0
        values.append(x)
        children.append({})
        if len(values) == 1:
            return
        while True:
            d = (values[at] ^ x).bit_count()
            if (below := children[at].get(d)) is None:
                children[at][d] = len(values) - 1
                return
            at = below

    def near(self, x: int, radius: int) -> list[int]:
        """Places of all values within ``radius`` of x."""
        if not self.values:
            return []
        values, children, out, open_ = self.values, self.children, [], [0]
        while open_:
            at = open_.pop()
            d = (values[at] ^ x).bit_count()
            if d <= radius:
                out.append(at)
            if below := children[at]:
                low, high = d - radius, d + radius
                open_ += [c for e, c in below.items() if low <= e <= high]
        return out


def _find(up: list[int], i: int) -> int:
    while up[i] != i:
        up[i] = i = up[up[i]]
    return i


def spanning(values: list[int], links: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges that join the linked ``values``: in each group, sorted, every value hangs on one of 32 times fewer before it."""
    up = list(range(len(values)))
    for i, k in links:
        i, k = _find(up, i), _find(up, k)
        if i != k:
            up[max(i, k)] = min(i, k)
    groups: dict[int, list[int]] = {}
    for i in range(len(values)):
        if (r := _find(up, i)) != i:
            groups.setdefault(r, [values[r]]).append(values[i])
    return [(g[i], g[(i - 1) // 32]) for g in map(sorted, groups.values()) for i in range(1, len(g))]


def _links(tree_values: list[int], probes: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges of one shard. Without probes, the values are searched for as they come; else each probe in the tree of all values."""
    tree, links = BKTree(), []
    for i, x in enumerate(tree_values):
        if not probes:
            links += [(i, k) for k in tree.near(x, radius)]
        tree.add(x)
    for i, x in enumerate(probes, len(tree_values)):
        links += [(i, k) for k in tree.near(x, radius)]
    return spanning([*tree_values, *probes], links)


def choices(k: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """All choices of k - radius of k blocks of the 64 bits, a block as (first bit, width)."""
    edges = [64 * i // k for i in range(k + 1)]
    blocks = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    out = [list(c) for c in combinations(blocks, k - radius)]
    assert len(out) == comb(k, radius)
    return out


def blocks_for(n: int, radius: int = RADIUS, mean: int = SHARD_MEAN) -> list[list[tuple[int, int]]]:
    """The shard choices for n fingerprints. Few choices while shards stay small."""
    k = radius + 1
    while k < FINEST and n > mean << (64 * (k - radius) // k):
        k += 1
    return choices(k, radius)


def shards(distinct: DataFrame, wanted: list[list[tuple[int, int]]]) -> DataFrame:
    """(fp, shard): a row for each choice of blocks, the shard a hash of the choice and of the fingerprint's bits in it."""
    masks = [sum(((1 << w) - 1) << a for a, w in blocks) for blocks in wanted]
    signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])
    return distinct.select("fp", F.posexplode(signed).alias("c", "mask")).select("fp", F.xxhash64("c", F.col("fp").bitwiseAND(F.col("mask"))).alias("shard"))


def link_edges(distinct: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES, mean: int = SHARD_MEAN) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of ``distinct`` (fp long) within ``radius`` bits."""
    spark, n = distinct.sparkSession, partitions(distinct.sparkSession)
    wanted, found = blocks_for(distinct.count(), radius, mean), None
    k = max((i for i in range(radius + 1, FINEST + 1) if comb(i, radius) <= len(wanted)), default=radius + 1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; a shard is small, so it's held whole."""
        now: list[np.ndarray] = []
        key = None
        out: list[tuple[int, int]] = []

        def close() -> None:
            values = np.concatenate(now).view(np.uint64).tolist() if now else []
            if len(values) > 1:
                out.extend(_links(values, [], radius))

        for batch in batches:
            shard, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]))
            for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                if a == b:
                    continue
                if key != shard[a]:
                    close()
                    now, key = [], shard[a]
                now.append(fp[a:b])
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        close()
        if out:
            yield _edges(out)

    while True:
        rows = shards(distinct, wanted)
        sizes = cut(rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > tree_nodes), "large-shards")
        large = sizes.take(1) != []
        small = rows.join(sizes, "shard", "left_anti") if large else rows
        edges = small.select("shard", "fp").repartition(n, "shard").sortWithinPartitions("shard", "fp").mapInArrow(search, "a long, b long")
        found = edges if found is None else found.unionByName(edges)
        if not large:
            return found
        if k >= FINEST:
            break
        # Two fingerprints of a large shard are both dealt anew, by more and narrower blocks, so they meet again.
        distinct = cut(rows.join(sizes.select("shard"), "shard", "left_semi").select("fp").distinct(), "crowded")
        k = min(FINEST, k + 3)
        wanted = choices(k, radius)
    parts = F.ceil(F.col("n") / tree_nodes).cast("int")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    big = rows.join(sizes, "shard").withColumn("parts", parts).withColumn("part", part)
    tree = big.select("shard", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("k"), "fp", F.lit(False).alias("probe"))
    probe = big.select("shard", F.explode(F.sequence(F.lit(0), F.col("part"))).alias("i"), F.col("part").alias("k"), "fp", F.lit(True).alias("probe")).where("i <> k")

    def search_parts(table: pa.Table) -> pa.Table:
        fp, is_probe = table.column("fp").to_numpy().view(np.uint64), table.column("probe").to_numpy()
        out = _links(sorted(fp[~is_probe].tolist()), sorted(fp[is_probe].tolist()), radius)
        return pa.Table.from_batches([_edges(out)])

    return found.unionByName(tree.unionByName(probe).groupBy("shard", "i", "k").applyInArrow(search_parts, "a long, b long"))


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.record_batch({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", tree_nodes: int = TREE_NODES, mean: int = SHARD_MEAN) -> DataFrame:
    """One row per row of ``docs``: id, fp (the fingerprint as a signed long), text_hash, root (the least fingerprint
    reachable over links of at most ``radius`` differing bits, which tells components apart), component (the least id reachable).

    Null, empty and wordless texts have fingerprint 0 and link as any other. Null ids are never a component's name
    unless all its ids are null (then null). Repeated rows and ids keep a row each. An empty table gives an empty
    result. Other columns are left out.
    """
    rows = cut(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = cut(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(link_edges(distinct.select("fp"), radius, tree_nodes, mean))
    rooted = cut(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = cut(rooted.join(names, "root").select("fp", "root", "component"), "components")
    return rows.join(named, "fp")


def keep_one(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, that of the least id (a null id last; of one id, the least text hash), with its columns.

    Survivors are chosen by ids and hashes alone; whole rows move once, to meet them. Of rows equal in id and text any one stays.
    Names of columns can't clash: rows travel as one struct.
    """
    found = near_duplicates(docs, radius, words, id_col, text_col)
    key = F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), F.col("text_hash").alias("hash"))
    first = cut(found.groupBy("root").agg(F.min(key).alias("k")).select("k.*").distinct(), "survivors")
    own = F.col(id_col).cast("long")
    rows = docs.select(own.isNull().alias("none"), F.coalesce(own, F.lit(0)).alias("id"), F.xxhash64(text_col).alias("hash"), F.struct(*docs.columns).alias("row"))
    nth = F.row_number().over(Window.partitionBy("none", "id", "hash").orderBy(F.lit(0)))  # dealt as for the join
    return rows.join(first, ["none", "id", "hash"]).withColumn("nth", nth).where("nth = 1").select("row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
