"""Operator 3, token-id files: flat unsigned integers and 64-bit document offsets, memory-mapped.

Documents are range-sorted by id; each partition writes one pair of files into the shared folder, under a
name of its attempt, and returns one row. The rows that come back are the manifest: a lost or repeated
attempt leaves at most a file that no manifest names. Bases of partitions are prefix sums of their totals.

``<name>.ids``: token ids, little-endian, 16 bits where the vocabulary has at most 65,536 ids, else 32.
``<name>.idx``: int64 little-endian; number of documents d; d + 1 token offsets from the file's start; d ids; d flags (1: the id is null).
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .pieces import coder
from .shared import documents, filled, mounted, partitions, shared_dir, sliced


def write_token_files(docs: DataFrame, vocab_path: str, folder: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[Row]:
    """Write all texts' ids under ``folder`` (a mounted path) in ascending order of id and return the manifest, a row
    per partition in order: part, name, n_docs, n_tokens, base, base_doc, width.

    Null texts are empty; each document ends with ``end_id`` if given. Null ids come first; rows of one id stand in
    the order of their texts' hashes; repeated rows are all kept. An empty table gives an empty manifest. Other
    columns are left out. ids must be integers.
    """
    os.makedirs(folder, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, name = coder(vocab_path), f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        dtype = codes.vocabulary.dtype
        offsets, ids, total = [np.zeros(1, np.int64)], [], 0
        with open(f"{folder}/{name}.ids", "wb") as out:
            for batch in sliced(batches):
                flat, ends = codes.ids(filled(batch.column(1)))
                if end_id is not None:
                    at = ends[1:]
                    flat = np.insert(flat, at, end_id)
                    ends = ends + np.arange(len(ends))
                out.write(flat.astype(dtype, copy=False).tobytes())
                offsets.append(total + ends[1:])
                total += int(ends[-1])
                ids.append(batch.column(0).cast(pa.int64()))
        n = sum(len(x) for x in ids)
        if not n:
            os.remove(f"{folder}/{name}.ids")
            return
        known = pa.chunked_array(ids)
        with open(f"{folder}/{name}.tmp", "wb") as out:
            for x in (np.array([n]), *offsets, known.fill_null(0).to_numpy(), known.is_null().to_numpy().astype(np.int64)):
                out.write(x.astype("<i8", copy=False).tobytes())
        os.replace(f"{folder}/{name}.tmp", f"{folder}/{name}.idx")
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "name": name, "n_docs": n, "n_tokens": total, "width": dtype.itemsize}], schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keys = ["id", F.xxhash64("text")]  # the hash splits rows of one id
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys)
    manifest = sorted(dealt.mapInArrow(write, "part int, name string, n_docs long, n_tokens long, width int").collect(), key=lambda r: r.part)
    kept = {r.name for r in manifest}
    for f in os.listdir(folder):  # what lost attempts left
        if f.rpartition(".")[0] not in kept:
            os.remove(f"{folder}/{f}")
    bases = accumulate([0, *(r.n_tokens for r in manifest)])
    base_docs = accumulate([0, *(r.n_docs for r in manifest)])
    return [Row(**r.asDict(), base=b, base_doc=d) for r, b, d in zip(manifest, bases, base_docs, strict=False)]


def open_part(folder: str, name: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Memory-mapped (ids, offsets, document ids, null flags) of one partition's files."""
    index = np.memmap(f"{folder}/{name}.idx", "<i8", "r")
    n = int(index[0])
    tokens = np.memmap(f"{folder}/{name}.ids", f"<u{width}", "r") if index[n + 1] else np.zeros(0, f"<u{width}")
    return tokens, index[1 : n + 2], index[n + 2 : 2 * n + 2], index[2 * n + 2 :]


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long, position long"


def read_token_files(spark: SparkSession, folder: str, manifest: list[Row]) -> DataFrame:
    """One row per document, from the files alone: doc_id, start (ids before it in all files), n_tokens, ids_crc32 (of the
    ids as little-endian unsigned 32-bit integers), position (documents before it)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                tokens, offsets, ids, null = open_part(folder, r["name"], r["width"])
                for k in range(0, len(ids), 20_000):
                    at = np.array(offsets[k : k + 20_001])
                    crc = [zlib.crc32(tokens[a:b].astype("<u4")) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    n = len(crc)
                    yield pa.record_batch({
                        "doc_id": pa.array(ids[k : k + n], mask=null[k : k + n] == 1), "start": pa.array(at[:-1] + r["base"]), "n_tokens": pa.array(np.diff(at)),
                        "ids_crc32": pa.array(crc, pa.int64()), "position": pa.array(np.arange(k, k + n) + r["base_doc"]),
                    })

    if not manifest:
        return spark.createDataFrame([], _READ)
    return spark.createDataFrame(manifest).repartition(len(manifest)).mapInArrow(read, _READ)


#: Production parameters.
VOCABULARY, END_ID = "word_bpe_49k.json", 1


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = mounted(shared_dir(spark)) + "/token-files"
    manifest = write_token_files(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), folder, END_ID)
    return read_token_files(spark, folder, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
