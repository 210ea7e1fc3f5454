"""Operator 10, line dedup: lines found in many documents stay only in the document of the largest id.

Distinct keys of each document are counted by their 128-bit hashes. The keys that reach the limit go to shards
by hash; each shard becomes one file in the shared folder: a minimal perfect hash (levels of bit arrays with
ranks) over its keys, then arrays in slot order: a 64-bit fingerprint, the number of documents, the largest id.
Documents memory-map the shards and probe them; lines are never joined. A shard has some 65,000 keys whatever
the corpus, and mapped pages aren't heap. A key outside the set is taken for a member with odds of 2**-64.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, documents, filled, mounted, partitions, shared_dir, sliced

#: Production parameters: code points of a key, documents that hold it, keys of a shard.
MIN_CHARS, MIN_DOCS, SHARD_KEYS = 20, 3, 1 << 16
_SPACE = " \t\n\v\f\r"
#: Stands for a null id: smaller than any other.
NO_ID = -(1 << 63)


def line_hashes(texts: pa.Array, min_chars: int = MIN_CHARS) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(all lines, ends: lines of text i are ends[i]:ends[i + 1], places of the lines with a key of ``min_chars``, their hashes as an n x 2 array)."""
    split = pc.split_pattern(texts, "\n")
    ends = split.offsets.to_numpy().astype(np.int64)
    lines = split.values.slice(ends[0], ends[-1] - ends[0])
    keys = pc.ascii_lower(pc.ascii_trim(lines, _SPACE))
    long = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False))
    digest = xxhash.xxh3_128_digest
    hashes = np.frombuffer(b"".join([digest(k) for k in keys.take(pa.array(long)).to_pylist()]), "<u8").reshape(-1, 2)
    return lines, ends - ends[0], long, hashes


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multipliers) of x with a seed."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: at each level, keys alone at their bit stay there; the others go on."""

    LEVELS = 32

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray, rest: np.ndarray) -> None:
        self.sizes, self.bits, self.ranks, self.rest = sizes, bits, ranks, rest
        self.begins = np.concatenate(([0], np.cumsum(sizes // 64)))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts, left = [], [], keys
        for level in range(cls.LEVELS):
            if not len(left):
                break
            size = -(-max(64, len(left) * 3 // 2) // 64) * 64
            at = (_mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        bits = np.concatenate(parts) if parts else np.zeros(0, "<u8")
        return cls(np.array(sizes, np.int64), bits, np.cumsum(np.bitwise_count(bits), dtype=np.int64), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; a key outside the set gets any slot, or -1."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            at = (_mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.begins[level] + at // 64, (at % 64).astype(np.uint64)
            bits = self.bits[word]
            hit = (bits >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(bits & ((np.uint64(1) << bit) - np.uint64(1)))
            rank = self.ranks[word] - np.bitwise_count(bits) + below
            out[open_[hit]] = rank[hit]
            open_ = open_[~hit]
            if not len(open_):
                return out
        if len(self.rest) and len(open_):
            i = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            found = self.rest[i] == keys[open_]
            out[open_[found]] = (int(self.ranks[-1]) if len(self.ranks) else 0) + i[found]
        return out


def write_shard(path: str, keys: np.ndarray, fingerprints: np.ndarray, counts: np.ndarray, largest: np.ndarray) -> None:
    """One shard's file. The whole content follows from the keys, so any attempt may write it; it appears at once."""
    mph = PerfectHash.build(keys)
    slot = mph.slots(keys)
    arrays = [np.empty(len(keys), t) for t in ("<u8", "<i8", "<u4")]
    for a, values in zip(arrays, (fingerprints, largest, counts), strict=True):
        a[slot] = values
    head = np.array([len(keys), len(mph.sizes), len(mph.bits), len(mph.rest)], "<i8")
    with open(tmp := f"{path}.{uuid.uuid4().hex}", "wb") as out:
        for a in (head, mph.sizes, mph.bits, mph.ranks, mph.rest, *arrays):
            out.write(np.ascontiguousarray(a).tobytes())
    os.replace(tmp, path)


class Shard:
    """A shard's memory-mapped file."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, np.uint8, "r")
        n, levels, words, rest = data[:32].view("<i8").tolist()
        at = 32

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            at += count * int(kind[-1])
            return data[at - count * int(kind[-1]) : at].view(kind)

        self.hash = PerfectHash(take(levels, "<i8"), take(words, "<u8"), take(words, "<i8"), take(rest, "<u8"))
        self.fingerprints, self.largest, self.counts = take(n, "<u8"), take(n, "<i8"), take(n, "<u4")

    def probe(self, keys: np.ndarray, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(is a member, number of documents, largest id) of each key."""
        slot = self.hash.slots(keys)
        at = np.maximum(slot, 0)
        return (slot >= 0) & (self.fingerprints[at] == fingerprints), self.counts[at], self.largest[at]


def _shards_of(first: np.ndarray, n: int) -> np.ndarray:
    return ((first >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def build_index(docs: DataFrame, folder: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> tuple[int, np.ndarray]:
    """Write the shards of all keys found in ``min_docs`` documents (distinct ids; null is one) and return their number and, by
    shard, whether it has a key and so a file."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            _, ends, places, hashes = line_hashes(filled(batch.column(1)), min_chars)
            doc = np.searchsorted(ends, places, side="right") - 1
            rows = np.unique(np.rec.fromarrays([hashes[:, 0], hashes[:, 1], doc], names="a,b,d")) if len(doc) else np.rec.fromarrays([[], [], []], dtype=[("a", "<u8"), ("b", "<u8"), ("d", "<i8")])
            ids = batch.column(0).take(pa.array(rows["d"].astype(np.int64))).cast(pa.int64()).fill_null(NO_ID)
            yield pa.record_batch({"a": pa.array(rows["a"].astype("<u8").view("<i8")), "b": pa.array(rows["b"].astype("<u8").view("<i8")), "id": ids})

    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = pairs.mapInArrow(keys, "a long, b long, id long").groupBy("a", "b").agg(F.count_distinct("id").alias("n"), F.max("id").alias("largest")).where(F.col("n") >= min_docs)
    found = cut(found, "keys")
    n = max(1, -(-found.count() // SHARD_KEYS))
    os.makedirs(folder, exist_ok=True)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(kept)
            a, b, c, largest = (t.column(k).to_numpy() for k in ("a", "b", "n", "largest"))
            write_shard(f"{folder}/{t.column('shard')[0].as_py():08d}.mph", a.astype("<i8").view("<u8"), b.astype("<i8").view("<u8"), np.minimum(c, (1 << 32) - 1), largest)
            return pa.record_batch({"shard": t.column("shard").combine_chunks()[:1], "n": pa.array([len(a)], pa.int64())})

        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for i, k in zip(cuts, cuts[1:], strict=False):
                if kept and k > i and kept[0].column(0)[0].as_py() != int(shard[i]):
                    yield flush()
                    kept = []
                if k > i:
                    kept.append(batch.slice(i, k - i))
        if kept:
            yield flush()

    shard = F.pmod(F.shiftrightunsigned("a", 32), F.lit(n))
    sharded = found.select(shard.cast("int").alias("shard"), "a", "b", "n", "largest").repartition(min(n, 4 * partitions(docs.sparkSession)), "shard").sortWithinPartitions("shard", "a", "b")
    written = np.zeros(n, bool)
    written[[r["shard"] for r in sharded.mapInArrow(build, "shard int, n long").collect()]] = True  # a row per 65,000 keys
    return n, written


def drop_lines(docs: DataFrame, folder: str, n_shards: int, written: np.ndarray, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that the index says dropped from the text; adds n_lines (before) and n_dropped. A shard that was
    ``written`` but can't be opened is an error."""
    rest =[c for c in docs.columns if c not in (id_col, text_col, "n_lines", "n_dropped")]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: OrderedDict[int, Shard | None] = OrderedDict()

        def shard(k: int) -> Shard | None:
            if k not in opened:
                opened[k] = Shard(f"{folder}/{k:08d}.mph") if written[k] else None
                if len(opened) > 512:
                    opened.popitem(last=False)
            return opened[k]

        for batch in sliced(batches):
            texts = filled(batch.column(1))
            lines, ends, places, hashes = line_hashes(texts, min_chars)
            doc = np.searchsorted(ends, places, side="right") - 1
            ids = batch.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)[doc]
            drop = np.zeros(len(places), bool)
            which = _shards_of(hashes[:, 0], n_shards)
            for k in np.unique(which).tolist():
                if s := shard(k):
                    at = np.flatnonzero(which == k)
                    member, _, largest = s.probe(hashes[at, 0], hashes[at, 1])
                    drop[at] = member & (largest != ids[at])
            dropped = np.bincount(doc[drop], minlength=len(texts))
            if drop.any():
                gone, out = set(places[drop].tolist()), texts.to_pylist()
                for i in np.flatnonzero(dropped).tolist():
                    a, b = int(ends[i]), int(ends[i + 1])
                    out[i] = "\n".join([x for j, x in enumerate(lines[a:b].to_pylist(), a) if j not in gone])
                texts = pa.array(out, pa.string())
            texts = pc.if_else(pa.array(dropped > 0), texts, batch.column(1).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, *batch.columns[2:], pa.array(np.diff(ends)), pa.array(dropped.astype(np.int64))], names=[id_col, text_col, *rest, "n_lines", "n_dropped"])

    picked = docs.select(id_col, text_col, *rest)
    schema = T.StructType([*picked.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return picked.mapInArrow(probe, schema)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines whose key (white space stripped, A-Z lowered) has ``min_chars`` code points and stands in
    ``min_docs`` documents, except in the largest id that holds it; adds n_lines and n_dropped (such columns are replaced).

    A null or empty text has one empty line, and null stays null. Documents are distinct ids; a null id counts as one
    document, the smallest. Repeated rows of an id are treated alike. An empty table gives an empty result.
    """
    folder = mounted(shared_dir(docs.sparkSession)) + "/lines"
    n, written = build_index(docs, folder, min_chars, min_docs, id_col, text_col)
    return drop_lines(docs, folder, n, written, min_chars, id_col, text_col)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.i, k.line, f.largest IS NOT NULL AND f.largest <> k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
