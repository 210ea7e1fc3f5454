"""Operator 8, media columns: content-defined chunks, stored once, from which verified media are rebuilt.

A text's payload (UTF-8, padded) is cut where a rolling gear hash of the last 32 bytes has its top bits zero. Each
task appends the chunks that are new to it to one *pack* in the shared folder, in compressed frames, and returns
their digests and places. Spark joins pick one place for each digest over all packs; a pack of which more than a
quarter isn't a picked copy is rewritten without the rest. A document's recipe is its ordered list of chunk digests and
places. Reading rebuilds each payload from the packs, by memory map, and verifies every chunk against its digest.
Bytes are never shuffled, only digests are. A pack's name is unique to an attempt, and only the packs that a
written row names are used, so lost or repeated attempts leave no trace in the result.

Stored form of a document: b"CDC1", chunk count, then for each chunk its size (both little-endian unsigned 32 bits)
and SHA-256 digest, then the payload's 8-bit samples.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SLICE_BYTES, cut, documents, filled, mounted, partitions, shared_dir, sliced

#: Production parameters: samples of a row, padding, least, mean (a power of two) and most bytes of a chunk, bytes of a frame, share of a pack that may be unpicked copies.
UNIT, PAD, LEAST, MEAN, MOST, FRAME, STALE = 576, 255, 512, 2048, 8192, 1 << 16, 0.25
WINDOW = 32


def _gears() -> np.ndarray:
    """A fixed random 32-bit number for each byte: the first four bytes of its SHA-256."""
    return np.array([struct.unpack("<I", hashlib.sha256(bytes([b])).digest()[:4])[0] for b in range(256)], np.uint32)


GEARS = _gears()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEARS[data[i - j]] << j for j < 32, modulo 2**32, by doubling the window."""
    h, width = GEARS[data], 1
    while width < WINDOW:
        shifted = h[:-width] << np.uint32(width) if len(h) > width else h[:0]
        h = h.copy()
        h[width:] += shifted
        width *= 2
    return h


def cuts(size: int, candidates: list[int], least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of a payload: the first candidate at ``least`` bytes or more, or ``most`` bytes."""
    ends, begin, k = [], 0, 0
    while begin < size:
        while k < len(candidates) and candidates[k] < begin + least:
            k += 1
        end = candidates[k] if k < len(candidates) else size
        end = min(end, begin + most, size)
        ends.append(end)
        begin = end
    return ends


def payloads(texts: pa.Array, unit: int = UNIT) -> Iterator[tuple[bytes, int, list[int]]]:
    """(payload, size unpadded, chunk ends) of each text. Cuts depend on the text alone: no window reaches past its start."""
    coded = [t.encode() for t in texts.to_pylist()]
    padded = [t + bytes([PAD]) * (-len(t) % unit or (unit if not t else 0)) for t in coded]
    data = np.frombuffer(b"".join(padded), np.uint8)
    at = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - (MEAN.bit_length() - 1)) == 0) + 1
    ends = np.cumsum([len(p) for p in padded])
    upto = np.searchsorted(at, np.concatenate(([0], ends)), side="right")
    for i, p in enumerate(padded):
        yield p, len(coded[i]), cuts(len(p), (at[upto[i] : upto[i + 1]] - (int(ends[i]) - len(p))).tolist())


class PackWriter:
    """Appends chunks to one file, a frame of up to FRAME bytes at a time; ``places`` of a chunk: frame's first byte, its size, place inside, size."""

    def __init__(self, folder: str) -> None:
        self.name = uuid.uuid4().hex
        self.file, self.at = open(f"{folder}/{self.name}.pack", "wb"), 0  # noqa: SIM115
        self.open, self.size, self.coder = [], 0, zstandard.ZstdCompressor(level=3)
        self.waiting: list[tuple[bytes, int, int]] = []
        self.places: list[tuple[bytes, int, int, int, int]] = []

    def add(self, digest: bytes, chunk: bytes) -> None:
        self.waiting.append((digest, self.size, len(chunk)))
        self.open.append(chunk)
        self.size += len(chunk)
        if self.size >= FRAME:
            self.flush()

    def flush(self) -> None:
        if self.open:
            frame = self.coder.compress(b"".join(self.open))
            self.file.write(frame)
            self.places += [(d, self.at, len(frame), inside, n) for d, inside, n in self.waiting]
            self.at += len(frame)
            self.open, self.waiting, self.size = [], [], 0

    def taken(self) -> pa.RecordBatch:
        """The places since the last call, as rows of the index."""
        rows, self.places = self.places, []
        d, at, n, inside, size = zip(*rows, strict=True) if rows else ([],) * 5
        return pa.record_batch({
            "digest": pa.array(d, pa.binary()), "pack": pa.array([self.name] * len(d), pa.string()), "frame": pa.array(at, pa.int64()),
            "frame_bytes": pa.array(n, pa.int32()), "inside": pa.array(inside, pa.int32()), "size": pa.array(size, pa.int32()),
        })

    def close(self) -> None:
        self.flush()
        self.file.close()


class PackReader:
    """Chunks from the packs of a folder; the last packs and frames stay open."""

    def __init__(self, folder: str) -> None:
        self.folder, self.packs, self.frames, self.coder = folder, OrderedDict(), OrderedDict(), zstandard.ZstdDecompressor()

    def frame(self, pack: str, at: int, n: int) -> bytes:
        key = (pack, at)
        if key in self.frames:
            self.frames.move_to_end(key)
            return self.frames[key]
        if pack not in self.packs:
            self.packs[pack] = np.memmap(f"{self.folder}/{pack}.pack", np.uint8, "r")
            if len(self.packs) > 256:
                self.packs.popitem(last=False)
        self.packs.move_to_end(pack)
        found = self.frames[key] = self.coder.decompress(self.packs[pack][at : at + n].tobytes())
        if len(self.frames) > 256:
            self.frames.popitem(last=False)
        return found

    def chunk(self, pack: str, at: int, n: int, inside: int, size: int) -> bytes:
        return self.frame(pack, at, n)[inside : inside + size]


_INDEX = "digest binary, pack string, frame long, frame_bytes int, inside int, size int"


def store_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> tuple[DataFrame, DataFrame]:
    """Store all payloads under ``folder`` (a mounted path). Returns (recipes, index): a recipe row per row of ``docs``
    (id, n_bytes, digests in order, recipe: their MD5), and a row per distinct chunk of where it lies."""
    os.makedirs(folder, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of two kinds: recipes (pack is null) and places."""
        pack, seen = PackWriter(folder), set()
        for batch in sliced(batches):
            ids, sizes, lists = batch.column(0), [], []
            for payload, n, ends in payloads(filled(batch.column(1)), unit):
                digests, begin = [], 0
                for end in ends:
                    chunk = payload[begin:end]
                    digests.append(d := hashlib.sha256(chunk).digest())
                    if d not in seen:
                        seen.add(d)
                        pack.add(d, chunk)
                    begin = end
                sizes.append(n)
                lists.append(b"".join(digests))
            pack.flush()
            places = pack.taken()
            if len(seen) > 200_000:  # a chunk may then be written again; the joins find it out
                seen.clear()
            recipes = pa.record_batch({"id": ids, "n_bytes": pa.array(sizes, pa.int64()), "digests": pa.array(lists, pa.binary())})
            for part, other in ((recipes, places.schema), (places, recipes.schema)):
                yield pa.record_batch({f.name: part.column(f.name) if f.name in part.schema.names else pa.nulls(part.num_rows, f.type) for f in [*recipes.schema, *places.schema]})
        pack.close()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    written = cut(rows.mapInArrow(write, f"id {kind}, n_bytes long, digests binary, {_INDEX}"), "written")
    recipes, places = written.where("pack IS NULL").select("id", "n_bytes", "digests", F.unhex(F.md5("digests")).alias("recipe")), written.where("pack IS NOT NULL").select(*[c.split()[0] for c in _INDEX.split(", ")])
    place = F.struct("pack", "frame", "inside", "frame_bytes", "size")
    picked = cut(places.groupBy("digest").agg(F.min(place).alias("place")), "picked")
    columns = [c.split()[0] for c in _INDEX.split(", ")]
    kept = picked.select("digest", "place.*").select(*columns)
    whole, live = (t.groupBy("pack").agg(F.sum("size").alias(name)) for t, name in ((places, "whole"), (kept, "live")))
    stale = cut(whole.join(live, "pack", "left").where(F.coalesce("live", F.lit(0)) < F.col("whole") * (1 - STALE)).select("pack"), "stale")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, now, pack = PackReader(folder), None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["pack"] != now:
                    if pack:
                        pack.flush()
                        yield pack.taken()
                    pack, now = pack or PackWriter(folder), r["pack"]
                pack.add(r["digest"], reader.chunk(r["pack"], r["frame"], r["frame_bytes"], r["inside"], r["size"]))
            if pack:
                yield pack.taken()
        if pack:
            pack.close()
            yield pack.taken()

    moved = cut(kept.join(stale, "pack").select(*columns).repartition(partitions(docs.sparkSession), "pack").sortWithinPartitions("pack", "frame", "inside").mapInArrow(rewrite, _INDEX), "moved")
    index = cut(kept.join(stale, "pack", "left_anti").select(*columns).unionByName(moved), "index")
    used = {r["pack"] for r in index.select("pack").distinct().collect()}  # a name per task
    for f in os.listdir(folder):
        if f.partition(".")[0] not in used:
            os.remove(f"{folder}/{f}")
    return recipes, index


_FACTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def facts(payload: bytes, stored: bytes) -> tuple:
    """The _FACTS of one payload; the feature has its number of chunks, mean sample, and entropy of samples in bits."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts[counts > 0] / len(payload)
    n = struct.unpack_from("<I", stored, 4)[0]
    feature = f"chunks={n};mean={float(counts @ np.arange(256)) / len(payload):.4f};entropy={float(-(p * np.log2(p)).sum()):.4f}"
    return len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def read_media(recipes: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """(recipe, payload, stored) of each distinct recipe (its digests in order): the payload rebuilt from the packs, each chunk
    verified, and the stored form. Read in the order of first chunks, so reads are sequential. A missing or changed
    chunk raises an error."""
    rebuilt = lambda payload, stored: (payload, stored)
    return _read(recipes, index, folder, rebuilt, "payload binary, stored binary")


def _read(recipes: DataFrame, index: DataFrame, folder: str, make, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = [types[c.split()[1]] for c in schema.split(", ")]
    asked = recipes.groupBy("recipe").agg(F.min("digests").alias("digests"))
    chunks = asked.select("recipe", F.posexplode(F.expr("transform(sequence(0, int(octet_length(digests) / 32) - 1), i -> substring(digests, i * 32 + 1, 32))")).alias("nth", "digest"))
    place = F.struct("nth", "pack", "frame", "frame_bytes", "inside", "size", "digest")
    placed = chunks.join(index, "digest", "left").groupBy("recipe").agg(F.array_sort(F.collect_list(place)).alias("places"))  # as many as the document has chunks
    first = [F.col("places")[0]["pack"], F.col("places")[0]["frame"], F.col("recipe")]
    ordered = placed.repartitionByRange(partitions(recipes.sparkSession), *first).sortWithinPartitions(*first)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = PackReader(folder)
        rows, size = [], 0

        def taken() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.binary(), *kinds], strict=True)], names=["recipe", *names])

        for batch in batches:
            for r in batch.to_pylist():
                head, parts = [b"CDC1", struct.pack("<I", len(r["places"]))], []
                for c in r["places"]:
                    if c["pack"] is None or hashlib.sha256(chunk := reader.chunk(c["pack"], c["frame"], c["frame_bytes"], c["inside"], c["size"])).digest() != c["digest"]:
                        raise RuntimeError(f"chunk {c['digest'].hex()} is missing or has changed")
                    parts.append(chunk)
                    head.append(struct.pack("<I", len(chunk)) + c["digest"])
                payload = b"".join(parts)
                rows.append((r["recipe"], *make(payload, b"".join(head) + payload)))
                size += sum(len(x) for x in rows[-1] if isinstance(x, bytes))
                if size >= SLICE_BYTES or len(rows) >= 500:
                    yield taken()
                    rows, size = [], 0
        if rows:
            yield taken()

    return ordered.mapInArrow(rebuild, f"recipe binary, {schema}")


def media_facts(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, then the _FACTS of its payload as stored and read back.

    A null text is empty (a payload of padding alone). Equal texts are stored and read once and give equal values; null
    and repeated ids keep a row each; an empty table gives an empty result. Other columns are left out.
    """
    recipes, index = store_media(docs, folder, id_col, text_col)
    found = _read(recipes, index, folder, facts, _FACTS)
    return recipes.select(F.col("id").alias(id_col), "n_bytes", "recipe").join(found, "recipe").drop("recipe")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_facts(documents(spark, sf_dir), mounted(shared_dir(spark)) + "/media")
