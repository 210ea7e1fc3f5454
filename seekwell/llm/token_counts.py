"""Operator 1, token counts: pieces are counted once per distinct pre-token, joined to the per-document
frequencies of pre-tokens, and summed; ids of documents are never made.

One (document, pre-token) row each would be several times the input, so both sides of the join travel
pre-aggregated. A *block* is a slice of a partition (some 8 MB of text). It sends its distinct pre-tokens, one
packed row for each class of their hashes, and its documents' frequencies as one packed row. The rows of a
class meet in one task, which counts each of its pre-tokens once and answers every block with packed counts;
counts and frequencies meet by block. No document and no pre-token gathers more than a value for each block. The number
of classes follows the input, and a task remembers so many counts at most; one that it has forgotten is counted again.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .pieces import Cache, Vocabulary, vocabulary
from .shared import documents, filled, partitions, sliced, text_bytes

#: Bytes of text for a class of pre-tokens; pre-tokens whose counts a worker remembers.
CLASS_BYTES, REMEMBERED = 128 << 20, 2_000_000


def _block(batch: pa.RecordBatch, v: Vocabulary, n_classes: int) -> tuple[int, list[list[str]], tuple[pa.RecordBatch, pa.RecordBatch]]:
    """(block id, distinct pre-tokens by class, (a row per document: id, n_bytes, special strings, numbers and frequencies of its units; a row per unit: its pre-tokens' numbers)). Pre-tokens are numbered class by class."""
    texts = filled(batch.column(1))
    code, ends, units, n_plain, slow = v.units(texts)
    n_special = np.zeros(len(texts), np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(ends))
    seen: dict[str, int] = {}
    parts = [[seen.setdefault(u, len(seen))] for u in units[:n_plain]] + [[seen.setdefault(p, len(seen)) for p in v.split(u)] for u in units[n_plain:]]
    if len(slow):  # a pre-token of an uncut text is a unit of its own
        own: dict[str, int] = {}
        extra, extra_doc = [], []
        for i in slow.tolist():
            pre, n_special[i] = v.pretokens(texts[i].as_py())
            extra += [own.setdefault(p, len(units) + len(own)) for p in pre]
            extra_doc += [i] * len(pre)
        code, doc = np.concatenate((code, np.array(extra, np.int64))), np.concatenate((doc, np.array(extra_doc, np.int64)))
        parts += [[seen.setdefault(p, len(seen))] for p in own]
    words = list(seen)
    of_class = np.array([crc32(w.encode()) % n_classes for w in words], np.int64)
    order = np.argsort(of_class, kind="stable")
    number = np.empty(len(words), np.int32)
    number[order] = np.arange(len(words))
    upto = np.searchsorted(of_class[order], np.arange(n_classes + 1))
    classes = [[words[i] for i in order[a:b].tolist()] for a, b in zip(upto, upto[1:], strict=False)]
    key, n = np.unique(doc * max(1, len(parts)) + code, return_counts=True)
    doc, code = np.divmod(key, max(1, len(parts)))
    upto = np.searchsorted(doc, np.arange(len(texts) + 1))
    lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
    rows = pa.record_batch({"id": batch.column(0), "n_bytes": pc.binary_length(texts).cast(pa.int64()), "special": pa.array(n_special), "unit": lists(upto, code), "n": lists(upto, n)})
    part_ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    of_units = pa.record_batch({"parts": lists(part_ends, number[[x for p in parts for x in p]] if len(words) else [])})
    digest = xxhash.xxh3_64()
    for a in (batch.column(0), texts):
        digest.update(_bytes(a))
    return digest.intdigest() - (1 << 63), classes, (rows, of_units)


def _squeezed(words: list[str]) -> tuple[int, bytes]:
    """(size before compression, the words compressed)."""
    coded = [w.encode() for w in words]
    raw = np.array([len(words), *map(len, coded)], "<u4").tobytes() + b"".join(coded)
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _words(size: int, data: bytes) -> list[str]:
    raw = pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4)) + 4 + 4 * n
    return [raw[a:b].decode() for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist(), strict=False)]


def _bytes(column: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("x", column.type)])) as w:
        w.write_batch(pa.record_batch({"x": pa.concat_arrays([column])}))
    return sink.getvalue().to_pybytes()


def _packed(batches: tuple[pa.RecordBatch, ...]) -> list[bytes]:
    out = []
    for b in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(b)
        out.append(sink.getvalue().to_pybytes())
    return out


def _unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def token_counts(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_bytes and n_tokens of its text by the vocabulary at ``vocab_path``.

    A null text counts as empty (0 bytes, 0 tokens); null or repeated ids and repeated rows keep a row each;
    an empty table gives an empty result; other columns, whatever their names, are left out. ``docs`` must be
    re-readable with the same rows in the same partitions (a table, a written cut): it's scanned three times, and
    a block that has changed between the last two raises an error instead of a wrong count. A long text is a block of its own.
    """
    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type, id_arrow = pairs.schema["id"].dataType.simpleString(), to_arrow_type(pairs.schema["id"].dataType)

    n = partitions(docs.sparkSession)
    n_classes = max(2 * n, text_bytes(pairs, "text") // CLASS_BYTES)

    def vocabulary_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab_path)
        for batch in sliced(batches):
            block, classes, _ = _block(batch, v, n_classes)
            some = [k for k, words in enumerate(classes) if words]
            packed = [_squeezed(classes[k]) for k in some]
            yield pa.record_batch({"block": pa.array([block] * len(some), pa.int64()), "class": pa.array(some, pa.int32()), "size": pa.array([k for k, _ in packed], pa.int32()), "words": pa.array([x for _, x in packed], pa.binary())})

    def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, counts = vocabulary(vocab_path), Cache(REMEMBERED)  # of the distinct pre-tokens of this task's classes
        for batch in batches:
            out = []
            for size, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = _words(size, data)
                counts.turn()
                found = counts.found(words)
                new = [i for i, n in enumerate(found) if n is None]
                for i, ids in zip(new, v.encode([words[i] for i in new]), strict=True):
                    found[i] = counts.young[words[i]] = len(ids)
                out.append(np.array(found, "<u4").tobytes())
            yield pa.record_batch({"block": batch.column(0), "class": batch.column(1), "n": pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in out], pa.binary()), "size": pa.array([len(x) for x in out], pa.int32())})

    def frequency_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab_path)
        for batch in sliced(batches):
            block, classes, both = _block(batch, v, n_classes)
            rows, units = _packed(both)
            yield pa.record_batch({"block": pa.array([block], pa.int64()), "n_pieces": pa.array([sum(map(len, classes))], pa.int32()), "docs": pa.array([rows], pa.binary()), "units": pa.array([units], pa.binary())})

    def sums(counts: pa.Table, packed: pa.Table) -> pa.Table:
        answered = {k: np.frombuffer(pa.decompress(x, decompressed_size=size, codec="zstd", asbytes=True), "<u4") for k, x, size in zip(*(counts.column(c).to_pylist() for c in ("class", "n", "size")), strict=True)}
        got = np.concatenate([answered[k] for k in sorted(answered)]).astype(np.int64) if answered else np.zeros(0, np.int64)
        out = []
        for n_pieces, rows, units in zip(*(packed.column(c).to_pylist() for c in ("n_pieces", "docs", "units")), strict=True):
            if len(got) != n_pieces:
                raise RuntimeError("the input changed between two scans; write it to a table first")
            rows, parts = _unpacked(rows), _unpacked(units).column("parts")
            of_unit = _sums(got[parts.values.to_numpy()], parts.offsets.to_numpy())
            unit, n = rows.column("unit"), rows.column("n").values.to_numpy()
            total = _sums(of_unit[unit.values.to_numpy()] * n, unit.offsets.to_numpy()) + rows.column("special").to_numpy()
            out.append(pa.table({"id": rows.column("id"), "n_bytes": rows.column("n_bytes"), "n_tokens": pa.array(total, pa.int64())}))
        return pa.concat_tables(out) if out else pa.table({"id": pa.array([], id_arrow), "n_bytes": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64())})

    counts = pairs.mapInArrow(vocabulary_rows, "block long, class int, size int, words binary").repartition(max(n, n_classes // 2), "class").sortWithinPartitions("class").mapInArrow(count_rows, "block long, class int, n binary, size int")
    packed = pairs.mapInArrow(frequency_rows, "block long, n_pieces int, docs binary, units binary")
    return counts.groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(sums, f"id {id_type}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values[ends[i]:ends[i + 1]] for each i."""
    upto = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return upto[ends[1:]] - upto[ends[:-1]]


#: Production parameters.
VOCABULARY, LIMIT = "byte_bpe_50k.json", 512


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts(documents(spark, sf_dir, stable=True), public_tokenizers.path(VOCABULARY))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
