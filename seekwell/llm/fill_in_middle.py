"""Operator 11, fill-in-middle transformation: a text is cut in prefix, middle and suffix, which change places.

The units of a text are code points. Their offsets come from the tokenizers library: its Split pre-tokenizer, with
each match of "any character" isolated, gives an array of offsets, with nothing trained. The array's length is n, and the
offsets at two ranks are the places of the cuts. The library takes a microsecond for each character, so a text is taken in
windows of three, whose arrays follow one another, and a window met before in a task isn't asked for again. Where the unit of
some rank lies is found by the running sum of the arrays' lengths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, filled, sliced

#: Fixed values of the contract: the marks, the share of texts transformed and of these with the suffix first (in hundredths).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Code points of a window; of a slab, which is taken at once (a multiple of the window); windows that a task remembers.
WINDOW, SLAB, REMEMBERED = 3, 3 << 18, 200_000
_WINDOWS = re.compile(f".{{1,{WINDOW}}}", re.DOTALL)


class Units:
    """Offsets of the units of texts."""

    def __init__(self) -> None:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split = Split(Regex("(?m:.)"), behavior="isolated")  # of this regex library, m lets the dot match line ends
        self.known: dict[str, tuple[int, ...]] = {}
        self.sizes: dict[str, int] = {}

    def of(self, window: str) -> tuple[int, ...]:
        """Where each unit of a window begins."""
        found = self.known.get(window)
        if found is None:
            found = tuple(a for _, (a, _) in self.split.pre_tokenize_str(window))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
                self.sizes.clear()
            self.known[window], self.sizes[window] = found, len(found)
        return found

    def measure(self, text: str) -> Offsets:
        sizes = [np.zeros(1, np.int64)]
        for i in range(0, len(text), SLAB):
            windows = _WINDOWS.findall(text, i, i + SLAB)
            found = list(map(self.sizes.get, windows))
            if None in found:
                found = [len(self.of(w)) if n is None else n for w, n in zip(windows, found, strict=True)]
            sizes.append(np.array(found, np.int64))
        return Offsets(self, text, np.cumsum(np.concatenate(sizes)))


class Offsets:
    """The offset array of one text by its windows: ``upto`` has the units before each, and all at its end."""

    def __init__(self, units: Units, text: str, upto: np.ndarray) -> None:
        self.units, self.text, self.upto = units, text, upto

    def __len__(self) -> int:
        return int(self.upto[-1])

    def at(self, rank: int) -> int:
        """The offset of the unit of this rank; behind the last one, the text's end."""
        if rank >= len(self):
            return len(self.text)
        k = int(np.searchsorted(self.upto, rank, "right")) - 1
        return k * WINDOW + self.units.of(self.text[k * WINDOW : (k + 1) * WINDOW])[rank - int(self.upto[k])]


def arranged(text: str, offsets: Offsets, h: tuple[int, int, int, int]) -> tuple[str, int | None, int | None, str]:
    """(form, units of the prefix, units of the middle, output) of one text under four hash values."""
    n = len(offsets)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= TRANSFORMED:
        return "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y = offsets.at(a), offsets.at(b)
    prefix, middle, suffix = text[:x], text[x:y], text[y:]
    if h[3] % 100 < SUFFIX_FIRST:
        return "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No part holds a mark, and none can arise where a part meets one, so each is found where it is."""
    before_middle = F.substring_index(output, MIDDLE, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    skip = F.lit(len(PREFIX) + 1)
    prefix_first = F.concat(F.substring(F.substring_index(output, SUFFIX, 1), skip, F.length(output)), middle, F.substring_index(before_middle, SUFFIX, -1))
    suffix_first = F.concat(F.substring_index(before_middle, PREFIX, -1), middle, F.substring(F.substring_index(output, PREFIX, 1), skip, F.length(output)))
    return F.when(form == "plain", output).when(form == "psm", prefix_first).otherwise(suffix_first)


def hashes(id_col: str, seed: str = "1") -> list[Column]:
    """The first four groups of eight digits of the SHA-256 of ``seed:id``, as numbers; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n (code points of its text), form (plain, psm or spm), prefix_chars and middle_chars (null if
    plain), output.

    A null text is empty, and an empty text plain; texts that hold a mark stay plain; equal ids with equal texts give equal rows; a null
    id is hashed as an empty string; an empty table gives an empty result; other columns, whatever their names, are left out. A
    long text is a batch of its own. No row moves.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *hashes(id_col, seed))

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units()
        for batch in sliced(batches):
            texts = filled(batch.column(1)).to_pylist()
            some = [(len(o := units.measure(t)), *arranged(t, o, h)) for t, h in zip(texts, zip(*(batch.column(f"h{k}").to_pylist() for k in range(1, 5)), strict=True), strict=True)]
            n, form, prefix, middle, output = zip(*some, strict=True) if some else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    schema = f"id {rows.schema['id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(cut_texts, schema).withColumnRenamed("id", id_col)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(documents(spark, sf_dir))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


_H = [f"('0x' || substr(x, {8 * k + 1}, 8))::BIGINT" for k in range(4)]
ORACLE_SQL = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
    c AS (SELECT doc_id, t, length(t) AS n, {_H[0]} % (length(t) + 1) AS c1, {_H[1]} % (length(t) + 1) AS c2, {_H[2]} % 100 AS h3, {_H[3]} % 100 AS h4 FROM d),
    f AS (
      SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c),
    p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM p"""
