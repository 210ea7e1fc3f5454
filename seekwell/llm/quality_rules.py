"""Operator 6, quality rules: what a public vocabulary makes of a text.

Beside the fixed rules on length and repetition, each document's tokeniser fertility is measured over its words:
characters per token, share of byte-fallback tokens, and token entropy relative to the logarithm of the number of
tokens. Per language (a null language is a group of its own) the exact quartiles of each measure over all
documents, from counts of binned values, give bands of so many robust deviations around the median; a document
outside any band is rejected. The bands are wide: they reject texts unlike nearly all of their language.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, documents, filled, sliced

#: Text bytes measured at a time; a token takes some 200 bytes of a worker's memory meanwhile.
QUALITY_BYTES = 3 << 20
#: Production parameters: the least words, percent of words in repeated windows, model.
MIN_WORDS, MAX_REPEAT_PERCENT, MODEL = 50, 50, "piece_bpe_32k.model"
#: measure: (width of a bin, deviations below and above the median, least deviation)
BANDS = {"chars_per_token": (0.01, 6.0, 15.0, 0.04), "byte_share": (0.005, 10.0, 10.0, 0.03), "entropy": (0.005, 2.5, 6.0, 0.07)}
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double"


class WordPieces:
    """Ids of single words by a sentencepiece model, through a cache of at most ``limit`` words."""

    def __init__(self, path: str, limit: int = 200_000) -> None:
        import sentencepiece

        self.model, self.limit, self.cache = sentencepiece.SentencePieceProcessor(model_file=path), limit, {}
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])

    def coded(self, words: list[str]) -> list[bytes]:
        if len(self.cache) > self.limit:
            self.cache.clear()
        out = list(map(self.cache.get, words))
        if missing := [i for i, c in enumerate(out) if c is None]:
            for i, ids in zip(missing, self.model.encode([words[i] for i in missing], num_threads=1), strict=True):
                self.cache[words[i]] = out[i] = np.array(ids, "<u4").tobytes()
        return out


@lru_cache(maxsize=1)
def word_pieces(path: str) -> WordPieces:
    """This worker's, kept from task to task."""
    return WordPieces(path)


def _pairs(doc: np.ndarray, code: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, code) with their counts."""
    key, n = np.unique(doc * max(1, n_codes) + code, return_counts=True)
    return key // max(1, n_codes), key % max(1, n_codes), n


def repeated_words(code: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document, the words that lie in 3-word windows found twice or more in it."""
    if len(code) < 3:
        return np.zeros(n_docs, np.int64)
    n = int(code.max()) + 1
    window = code[:-2] * n + code[1:-1]
    if n >= 1 << 21:  # keep the triple within 63 bits
        window = np.unique(window, return_inverse=True)[1].astype(np.int64)
    window = window * n + code[2:]
    inside = doc[:-2] == doc[2:]
    window, at = np.unique(window[inside], return_inverse=True)[1].astype(np.int64), np.flatnonzero(inside)
    _, where, counts = np.unique(doc[at] * (int(window.max()) + 1 if len(window) else 1) + window, return_inverse=True, return_counts=True)
    twice = at[counts[where] > 1]
    hit = np.zeros(len(code), bool)
    for k in range(3):
        hit[twice + k] = True
    return np.bincount(doc[hit], minlength=n_docs)


def measure(texts: pa.Array, pieces: WordPieces) -> dict[str, np.ndarray]:
    n_docs = len(texts)
    words = pc.split_pattern(pc.replace_substring_regex(texts, "[\t-\r]", " "), " ")
    ends = words.offsets.to_numpy().astype(np.int64)
    flat = words.values.slice(ends[0], ends[-1] - ends[0])
    doc = np.repeat(np.arange(n_docs), np.diff(ends))
    real = pc.not_equal(flat, "")
    encoded = flat.filter(real).dictionary_encode()
    doc, code, distinct = doc[real.to_numpy(zero_copy_only=False)], encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
    chars = pc.utf8_length(distinct).to_numpy().astype(np.int64)
    n_words = np.bincount(doc, minlength=n_docs)
    word_chars = np.bincount(doc, chars[code], n_docs).astype(np.int64) if len(code) else np.zeros(n_docs, np.int64)
    lines = pc.split_pattern(texts, "\n")
    line_ends = lines.offsets.to_numpy().astype(np.int64)
    line = lines.values.slice(line_ends[0], line_ends[-1] - line_ends[0])
    with_word = pc.match_substring_regex(line, r"[^ \t-\r]")
    line_doc = np.repeat(np.arange(n_docs), np.diff(line_ends))[with_word.to_numpy(zero_copy_only=False)]
    line_code = line.filter(with_word).dictionary_encode()
    d, _, n = _pairs(line_doc, line_code.indices.to_numpy().astype(np.int64), len(line_code.dictionary))
    n_dup_lines = np.bincount(d, n - 1, n_docs).astype(np.int64)

    coded = pieces.coded(distinct.to_pylist())
    ids, lens = np.frombuffer(b"".join(coded), "<u4").astype(np.int64), np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    begins = np.cumsum(lens) - lens
    d, c, n = _pairs(doc, code, len(distinct))
    m = lens[c]
    upto = np.cumsum(m)
    token = ids[np.repeat(begins[c] - (upto - m), m) + np.arange(upto[-1] if len(upto) else 0)]
    token_doc, weight = np.repeat(d, m), np.repeat(n, m)
    key, where = np.unique(token_doc * pieces.size + token, return_inverse=True)
    freq = np.bincount(where, weight, len(key))
    token_doc = key // pieces.size
    total = np.bincount(token_doc, freq, n_docs)
    of_bytes = np.bincount(token_doc, freq * pieces.is_byte[key % pieces.size], n_docs)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = freq / total[token_doc]
        bits = np.bincount(token_doc, -p * np.log2(p), n_docs)
        some = total > 0
        return {
            "n_words": n_words, "word_chars": word_chars, "n_symbols": pc.count_substring_regex(texts, r"[#*$%&|<>]").to_numpy().astype(np.int64), "n_dup_lines": n_dup_lines,
            "n_repeat_words": repeated_words(code, doc, n_docs), "n_tokens": total.astype(np.int64), "chars_per_token": np.where(some, word_chars / total, 0.0),
            "byte_share": np.where(some, of_bytes / total, 0.0), "entropy": np.where(total > 1, bits / np.log2(total), 0.0),
        }


def measured(docs: DataFrame, model_path: str, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and quality, a struct of the MEASURES, for each row."""
    rows = docs.select(F.struct(*keep).alias("kept_columns"), F.col(text_col).alias("text"))
    kinds = T._parse_datatype_string(MEASURES)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = word_pieces(model_path)
        for batch in sliced(batches, most=QUALITY_BYTES):
            found = measure(filled(batch.column(1)), pieces)
            arrays = [pa.array(found[f.name].astype(np.float64 if f.dataType == T.DoubleType() else np.int64)) for f in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.StructArray.from_arrays(arrays, names=kinds.fieldNames())], names=["kept_columns", "quality"])

    schema = T.StructType([rows.schema["kept_columns"], T.StructField("quality", kinds)])
    return rows.mapInArrow(make, schema).select("kept_columns.*", "quality")


def bands(quality: DataFrame, min_words: int = MIN_WORDS, spec: dict = BANDS) -> DataFrame:
    """(band_group, then low_ and high_ of each measure) from a table (band_group, quality), over its documents of ``min_words``."""
    long = quality.where(F.col("quality.n_words") >= min_words)
    bins = F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(f"quality.{m}") / width).cast("long").alias("bin")) for m, (width, *_) in spec.items()])
    counts = long.select("band_group", F.explode(bins).alias("b")).groupBy("band_group", "b.measure", "b.bin").agg(F.count("*").alias("n"))
    of = Window.partitionBy("band_group", "measure")
    upto = counts.withColumn("upto", F.sum("n").over(of.orderBy("bin"))).withColumn("all", F.sum("n").over(of))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin")))
    quartiles = upto.groupBy("band_group", "measure").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    out = []
    for m, (width, below, above, least) in spec.items():
        deviation = F.greatest((F.col("q3") - F.col("q1")) * width / 1.349, F.lit(least))
        here = F.col("measure") == m
        out += [F.max(F.when(here, F.col("q2") * width - deviation * below)).alias(f"low_{m}"), F.max(F.when(here, F.col("q2") * width + deviation * above)).alias(f"high_{m}")]
    return quartiles.groupBy("band_group").agg(*out)


def judged(quality: DataFrame, limits: DataFrame, group: str, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT, spec: dict = BANDS) -> DataFrame:
    """Adds base_failed and kept to a table with the columns ``group`` and quality."""
    q = lambda c: F.col(f"quality.{c}")
    failed = (q("n_words") < min_words) | (100 * q("n_repeat_words") > max_repeat * q("n_words"))
    inside = reduce(lambda a, b: a & b, [q(m).between(F.col(f"low_{m}"), F.col(f"high_{m}")) for m in spec])
    joined = quality.join(limits, F.col(group).eqNullSafe(F.col("band_group")), "left")
    return joined.select(*quality.columns, failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(True))).alias("kept"))


def quality_rules(docs: DataFrame, model_path: str, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and language, quality (the MEASURES), base_failed, kept.

    Null, empty and wordless texts have no words and fail the base rule; a null language is a group of its own, and
    repeated rows are judged alike; an empty table gives an empty result. Other columns are left out. A long text is measured
    whole, in a slice of its own, for which its worker needs some 200 bytes a token.
    """
    found = cut(measured(docs, model_path, [id_col, lang_col], text_col), "quality")
    return judged(found, cut(bands(found.withColumnRenamed(lang_col, "band_group")), "bands"), lang_col)


def kept_rows(docs: DataFrame, model_path: str, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns: texts are measured once and written with their measures, from which alone
    the bands come."""
    rows = docs.select(F.struct(*docs.columns).alias("seekwell_row"), F.col(lang_col).alias("band_group"), F.col(text_col).alias("text"))  # one struct: no name can clash
    found = cut(measured(rows, model_path, ["seekwell_row", "band_group"]), "measured")
    limits = cut(bands(found.select("band_group", "quality")), "bands")
    return judged(found.withColumnRenamed("band_group", "lang"), limits, "lang").where("kept").select("seekwell_row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = quality_rules(documents(spark, sf_dir), public_tokenizers.path(MODEL))
    return out.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept", *[F.round(f"quality.{c}", 6).alias(c) for c in BANDS])
