"""Vectorised use of public tokenizers: texts are cut into units that no token crosses, distinct units of a
slice are looked up in a bounded cache, and only new ones reach the tokenizers library.

Texts of Latin letters without doubled white space or contractions are cut straight into pre-tokens, by the
classes of their bytes. Others are cut at spaces: a unit of the byte-level vocabulary is then a word with the one
space before it, and of the lower-case word vocabulary, which drops white space, what stands between spaces.
Texts in which a run of white space makes that unsafe, or with special strings, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters and digits up to U+024F, whose classes are the same in every Unicode version.
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_KNOWN = re.compile("[\x20-\x7e\n¡-ɏ]*")
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_WORDS = re.compile(rf"{_CONTRACTIONS}| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_ASCII = re.compile("[\x20-\x7e\n]*")
_LOWER_WORDS = re.compile(rf"{_CONTRACTIONS}|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: RE2: a space between other white space, or before the end after other white space.
_UNSAFE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] ([\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)"
#: RE2: what keeps a text from being cut by the classes of its bytes, beside the vocabulary's special strings.
_UNUSUAL = {
    "byte": r"[^\t\n\r -~\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]|'(s|t|re|ve|m|ll|d)|[\t\n\r ][\t\n\r ]",
    "word": r"[^\t\n\r -~\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]|'(?i:s|t|re|ve|m|ll|d)",
}
_SPACE, _WHITE, _LETTER, _DIGIT, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[128:] = _LETTER
for _bytes, _class in ((b" ", _SPACE), (b"\t\n\r", _WHITE), (b"0123456789", _DIGIT), (bytes(range(65, 91)) + bytes(range(97, 123)), _LETTER)):
    _CLASS[list(_bytes)] = _class


def _by_class(texts: pa.StringArray, kind: str) -> tuple[pa.StringArray, np.ndarray]:
    """(pre-tokens of all texts, ends: those of text i are ends[i]:ends[i + 1]); no text may be unusual."""
    if kind == "word":
        texts = pc.utf8_lower(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kinds = _CLASS[data]
    start = np.ones(len(data), bool)
    start[1:] = kinds[1:] != kinds[:-1]
    if kind == "byte":
        start[1:] &= ~((kinds[:-1] == _SPACE) & (kinds[1:] > _WHITE))  # a space goes with what follows it
    else:
        start |= kinds == _DIGIT
    start[offsets[:-1][offsets[:-1] < len(data)]] = True
    if kind == "word":  # white space is dropped
        solid = kinds > _WHITE
        offsets = np.concatenate(([0], np.cumsum(solid)))[offsets]
        data, start = data[solid], start[solid]
    begins = np.flatnonzero(start)
    ends = np.searchsorted(begins, offsets)
    both = np.append(begins, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(begins), pa.py_buffer(both.tobytes()), pa.py_buffer(data.tobytes())), ends


class Vocabulary:
    """A tokenizers .json file with the cuts that suit it. kind: byte, word, or whole (no safe cut known)."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path) as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        before, plain = spec.get("pre_tokenizer") or {}, not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        self.kind = "whole"
        if plain and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer"):
            self.kind = "byte"
        elif plain and before.get("type") == "Sequence" and before["pretokenizers"][0].get("invert") and [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.kind = "word"
        self.unusual = "|".join([_UNUSUAL.get(self.kind, ""), *(re.sub(r"([^A-Za-z0-9\x80-\U0010ffff])", r"\\\1", s) for s in self.special)])
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")

    def slow(self, texts: pa.Array) -> np.ndarray:
        """Which texts can't be cut into units."""
        if self.kind == "whole":
            return np.ones(len(texts), bool)
        if self.kind == "word":
            return np.zeros(len(texts), bool)
        found = pc.match_substring_regex(texts, _UNSAFE)
        for s in self.special:
            found = pc.or_(found, pc.match_substring(texts, s))
        return found.to_numpy(zero_copy_only=False)

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], int, np.ndarray]:
        """(unit number of each place, ends: places of text i are ends[i]:ends[i + 1], the distinct units, how many of them, the first, are
        pre-tokens, numbers of the texts left out as slow)."""
        n = len(texts)
        if self.kind == "whole":
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64), [], 0, np.arange(n)
        odd = np.flatnonzero(pc.match_substring_regex(texts, self.unusual).to_numpy(zero_copy_only=False))
        if not len(odd):
            pieces, ends = _by_class(texts, self.kind)
            encoded = pieces.dictionary_encode()
            return encoded.indices.to_numpy().astype(np.int64), ends, encoded.dictionary.to_pylist(), len(encoded.dictionary), odd
        is_odd = np.zeros(n, bool)
        is_odd[odd] = True
        some = texts.take(pa.array(odd))
        slow = self.slow(some)
        cut = pc.split_pattern(pc.if_else(pa.array(slow), "", some), " ")
        if self.kind == "byte":  # all but a text's first word have a space before them
            first = np.zeros(len(cut.values), bool)
            first[cut.offsets.to_numpy()[:-1]] = True
            more = pc.binary_join_element_wise(pc.if_else(pa.array(first), "", " "), cut.values, "")
        else:
            more = cut.values
        pieces, ends = _by_class(texts.filter(pa.array(~is_odd)), self.kind)
        sizes = np.zeros(n, np.int64)
        sizes[~is_odd], sizes[odd] = np.diff(ends), np.diff(cut.offsets.to_numpy())
        encoded = pa.concat_arrays([pieces, more]).dictionary_encode()
        code = encoded.indices.to_numpy().astype(np.int64)
        n_plain = int(code[: len(pieces)].max()) + 1 if len(pieces) else 0  # units are numbered as they come
        doc = np.concatenate((np.repeat(np.flatnonzero(~is_odd), sizes[~is_odd]), np.repeat(odd, sizes[odd])))
        return code[np.argsort(doc, kind="stable")], np.concatenate(([0], np.cumsum(sizes))), encoded.dictionary.to_pylist(), n_plain, odd[slow]

    def split(self, unit: str) -> list[str]:
        """The pre-tokens of a unit (of the word vocabulary: parts whose ids, in order, are the unit's)."""
        if self.kind == "byte":
            if _KNOWN.fullmatch(unit):
                return _BYTE_WORDS.findall(unit)
            return [unit[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(unit)]
        if self.kind == "word" and "<|" not in unit and _ASCII.fullmatch(unit):
            return _LOWER_WORDS.findall(unit.lower())
        return [unit] if unit else []

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a whole text, and the number of special strings between them."""
        parts, special = [text], 0
        if self.special:
            found = re.split("|".join(map(re.escape, self.special)), text)
            parts, special = found, len(found) - 1
        out: list[str] = []
        for p in parts:
            out += [p[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(p)] if self.library.pre_tokenizer and not self.library.normalizer else [p] * bool(p)
        return out, special

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


class Cache:
    """Values by string, at most ``limit`` or so: when the young half is full it becomes the old half, and what is still used moves over."""

    def __init__(self, limit: int) -> None:
        self.limit, self.young, self.old = limit, {}, {}

    def turn(self) -> None:
        if len(self.young) > self.limit // 2:
            self.young, self.old = {}, self.young

    def found(self, keys: list[str]) -> list:
        young, old = self.young, self.old
        out = list(map(young.get, keys))
        if old:
            for i, x in enumerate(out):
                if x is None and (y := old.get(keys[i])) is not None:
                    out[i] = young[keys[i]] = y
        return out


class Coder:
    """Ids of texts, through a bounded cache of units and pre-tokens."""

    def __init__(self, path: str, limit: int = 800_000) -> None:
        self.vocabulary, self.cache = Vocabulary(path), Cache(limit)
        self.type = "H" if self.vocabulary.dtype.itemsize == 2 else "I"

    def coded(self, units: list[str], n_plain: int = 0) -> list[bytes]:
        """Each unit's ids as little-endian integers of the vocabulary's width; the first ``n_plain`` are pre-tokens."""
        self.cache.turn()
        young, v = self.cache.young, self.vocabulary
        out = self.cache.found(units)
        if missing := [i for i, c in enumerate(out) if c is None]:
            n = bisect_left(missing, n_plain)
            parts = [v.split(units[i]) for i in missing[n:]]
            pieces = list({p for ps in parts for p in ps})
            new = [units[i] for i in missing[:n]]
            new += set(p for p, c in zip(pieces, self.cache.found(pieces), strict=True) if c is None).difference(new) if pieces else ()
            for k in range(0, len(new), 20_000):
                for p, ids in zip(some := new[k : k + 20_000], v.encode(some), strict=True):
                    young[p] = array(self.type, ids).tobytes()
            for i in missing[:n]:
                out[i] = young[units[i]]
            for i, ps in zip(missing[n:], parts, strict=True):
                young[units[i]] = out[i] = young[ps[0]] if len(ps) == 1 else b"".join([young[p] for p in ps])
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ends: those of text i are ends[i]:ends[i + 1])."""
        code, ends, units, n_plain, slow = self.vocabulary.units(texts)
        coded, dtype = self.coded(units, n_plain), self.vocabulary.dtype
        flat = np.frombuffer(b"".join(coded), dtype)
        lens = np.fromiter(map(len, coded), np.int64, len(coded)) // dtype.itemsize
        begins = np.cumsum(lens) - lens
        n = lens[code]
        upto = np.concatenate(([0], np.cumsum(n)))
        flat = flat[np.repeat(begins[code] - upto[:-1], n) + np.arange(upto[-1])]
        ends = upto[ends]
        if len(slow):
            parts = np.split(flat, ends[1:-1])
            for i, ids in zip(slow.tolist(), self.vocabulary.encode([texts[i].as_py() for i in slow.tolist()]), strict=True):
                parts[i] = np.array(ids, dtype)
            flat, ends = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return flat, ends


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """This worker's coder of a vocabulary; Spark's Python workers live on from task to task, and so does its cache."""
    return Coder(path)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
