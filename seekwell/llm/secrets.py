"""Operator 5, secret scans: fixed patterns, and automata inferred from labelled credentials.

Labelled credentials of each kind give a prefix tree; ALERGIA merges its states whose symbol and end frequencies are
compatible by the Hoeffding bound, folding their subtrees together, into a probabilistic automaton. What is scanned follows
from the labelled credentials: runs of the characters that they are made of, as long as the shortest of them. Candidates begin
where an automaton's first symbols stand, behind letters and digits too, are as long as the kind's labelled credentials can be, and
end beside a character that is no letter or digit; the automaton walks on from each beginning, so its own states say where a
credential can end. Each candidate is scored by the mean log-likelihood of its symbols
under each automaton against that under the frequencies of an ordinary word's symbols. It's a secret if an automaton accepts it
with a score over the kind's limit, the least score of its labelled credentials less a margin. Of each beginning and kind the longest
counts, and of candidates that overlap the longest, then the first, then that of the highest score over its limit, then that of the first kind by name.
Symbols: a string's first four characters as they are, then classes (upper, lower, digit, others as they are) with the
number of dots before, and an end with the number of all dots, so that merged states don't lose count of the parts.
"""

from __future__ import annotations

import json
import random
import re
import string
from base64 import urlsafe_b64encode
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import inf, log, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, filled, sliced

#: The base patterns, and lengths that their matches need.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough
ASSIGN_CHARS, ACCESS_CHARS = 6, 20
#: RE2: texts without a match have no base span.
_BASE = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
#: Beside these a candidate may end.
_BETWEEN = re.compile(r"[^A-Za-z0-9]")
#: Heads of a kind that are looked for anywhere; starts that walk at once; starts of a run taken together, in characters.
HEADS, STARTS, SLAB = 64, 1 << 15, 1 << 20

_UPPER, _LOWER, _DIGIT = string.ascii_uppercase, string.ascii_lowercase, string.digits
_CLASSES = dict.fromkeys(_UPPER, "A") | dict.fromkeys(_LOWER, "a") | dict.fromkeys(_DIGIT, "9")
#: Public formats of credentials, as (prefixes, characters of the rest, least and most of them).
FORMATS = {
    "github": (("ghp_", "gho_", "ghs_", "ghu_"), _UPPER + _LOWER + _DIGIT, 36, 36),
    "google": (("AIza",), _UPPER + _LOWER + _DIGIT + "_-", 35, 35),
    "npm": (("npm_",), _UPPER + _LOWER + _DIGIT, 36, 36),
    "slack": (("xoxb-", "xoxp-"), _DIGIT + "-" + _UPPER + _LOWER, 40, 60),
    "stripe": (("sk_live_", "rk_live_", "sk_test_"), _UPPER + _LOWER + _DIGIT, 24, 34),
}
#: Bytes of a signature by the algorithm that a JWT's header names.
JWT_ALGORITHMS = {"HS256": 32, "HS384": 48, "HS512": 64, "RS256": 256, "RS384": 256, "RS512": 256, "PS256": 256, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}


def _base64url(data: bytes) -> str:
    return urlsafe_b64encode(data).rstrip(b"=").decode()


def _jwt(rng: random.Random) -> str:
    """An invented JWT, header.payload.signature, with some of the usual fields in any order."""
    word = lambda: "".join(rng.choices(_LOWER, k=rng.randint(3, 10)))
    time = lambda: rng.randint(1_400_000_000, 1_900_000_000)
    part = lambda fields: _base64url(json.dumps(fields, separators=(",", ":")).encode())
    alg = rng.choice(list(JWT_ALGORITHMS))
    header = [("alg", alg)]
    if rng.random() < 0.8:
        header.append(("typ", rng.choice(("JWT", "JWT", "JWT", "at+jwt", "jwt"))))
    if rng.random() < 0.5:
        header.append(("kid", rng.choice((rng.randbytes(rng.randint(2, 20)).hex(), _base64url(rng.randbytes(rng.randint(6, 32))), f"{word()}-{rng.randint(1, 9999)}", word()))))
    for name, value in (("cty", word()), ("x5t", _base64url(rng.randbytes(20))), ("jku", f"https://{word()}.com/{word()}")):
        if rng.random() < 0.15:
            header.append((name, value))
    rng.shuffle(header)
    claims = {
        "sub": str(rng.randint(1, 10**10)), "name": f"{word().title()} {word().title()}", "iat": time(), "exp": time(), "iss": f"https://{word()}.com/", "aud": word(),
        "scope": " ".join(word() for _ in range(rng.randint(1, 4))), "admin": rng.random() < 0.5, "jti": rng.randbytes(16).hex(),
    }
    payload = {k: claims[k] for k in rng.sample(list(claims), rng.randint(1, len(claims)))}
    return f"{part(dict(header))}.{part(payload)}.{_base64url(rng.randbytes(JWT_ALGORITHMS[alg]))}"


def labelled_credentials(seed: int = 7, n: int = 300) -> dict[str, list[str]]:
    """Invented credentials of each public format, the labelled examples used where a caller has none of their own; of JWTs, which vary most, eight times ``n``."""
    rng = random.Random(seed)
    out = {kind: [rng.choice(prefixes) + "".join(rng.choices(chars, k=rng.randint(least, most))) for _ in range(n)] for kind, (prefixes, chars, least, most) in FORMATS.items()}
    return out | {"jwt": [_jwt(rng) for _ in range(8 * n)]}


def symbols(s: str) -> list[str]:
    """A string's symbols."""
    out, dots = [], 0
    for i, c in enumerate(s):
        out.append(_symbol(i, c, dots))
        dots += c == "."
    return [*out, f"$:{dots}"]


def _symbol(i: int, c: str, dots: int) -> str:
    return f"^{c}" if i < 4 else f"{_CLASSES.get(c, c)}:{dots}"


class Automaton:
    """A probabilistic automaton: counts of ends and of moves by symbol for each state. State 0 begins."""

    def __init__(self) -> None:
        self.ends: list[int] = [0]
        self.moves: list[dict[str, int]] = [{}]
        self.counts: list[dict[str, int]] = [{}]

    def total(self, q: int) -> int:
        return self.ends[q] + sum(self.counts[q].values())

    @classmethod
    def prefix_tree(cls, words: list[list[str]]) -> Automaton:
        a = cls()
        for w in words:
            q = 0
            for s in w:
                a.counts[q][s] = a.counts[q].get(s, 0) + 1
                if s not in a.moves[q]:
                    a.moves[q][s] = len(a.ends)
                    a.ends.append(0)
                    a.moves.append({})
                    a.counts.append({})
                q = a.moves[q][s]
            a.ends[q] += 1
        return a

    @classmethod
    def infer(cls, words: list[list[str]], alpha: float = 0.01) -> Automaton:
        """ALERGIA: states are taken in breadth-first order; each is merged into the first compatible one before it, or kept."""
        a = cls.prefix_tree(words)
        bound = sqrt(0.5 * log(2 / alpha))
        kept = [0]
        while True:
            fringe = sorted({m for q in kept for m in a.moves[q].values()} - set(kept))
            if not fringe:
                return a._only(kept)
            q = fringe[0]
            for r in kept:
                if a._compatible(r, q, bound):
                    up, s = next((p, s) for p in kept for s, m in a.moves[p].items() if m == q)
                    a.moves[up][s] = r
                    a._fold(r, q)
                    break
            else:
                kept.append(q)

    def _only(self, kept: list[int]) -> Automaton:
        """The same automaton with these states alone."""
        number = {q: i for i, q in enumerate(kept)}
        out = Automaton()
        out.ends, out.counts = [self.ends[q] for q in kept], [self.counts[q] for q in kept]
        out.moves = [{s: number[m] for s, m in self.moves[q].items()} for q in kept]
        return out

    def _compatible(self, r: int, q: int, bound: float) -> bool:
        """Whether no frequency of an end or symbol tells r from q, the root of a tree, nor their successors."""
        open_ = [(r, q)]
        while open_:
            r, q = open_.pop()
            n, m = self.total(r), self.total(q)
            if not n or m <= bound * bound:  # so rare that no difference counts, nor any in the tree below
                continue
            most = bound * (1 / sqrt(n) + 1 / sqrt(m))
            if most < 1:
                if abs(self.ends[r] / n - self.ends[q] / m) > most:
                    return False
                for s in self.counts[r].keys() | self.counts[q].keys():
                    if abs(self.counts[r].get(s, 0) / n - self.counts[q].get(s, 0) / m) > most:
                        return False
            open_ += [(self.moves[r][s], k) for s, k in self.moves[q].items() if s in self.moves[r] and self.moves[r][s] != k]
        return True

    def _fold(self, r: int, q: int) -> None:
        """Adds the tree below q to what is below r."""
        open_ = [(r, q)]
        while open_:
            r, q = open_.pop()
            self.ends[r] += self.ends[q]
            for s, m in self.moves[q].items():
                self.counts[r][s] = self.counts[r].get(s, 0) + self.counts[q][s]
                if s in self.moves[r]:
                    open_.append((self.moves[r][s], m))
                else:
                    self.moves[r][s] = m

    def score(self, word: list[str]) -> float:
        """Mean log-likelihood of the symbols and the end; minus infinity if the automaton has no such path or end."""
        q, total = 0, 0.0
        for s in word:
            if s not in self.moves[q]:
                return -inf
            total += log(self.counts[q][s] / self.total(q))
            q = self.moves[q][s]
        return (total + log(self.ends[q] / self.total(q))) / (len(word) + 1) if self.ends[q] else -inf


#: Rough frequencies of a symbol in ordinary words, for the ratio.
_ORDINARY = defaultdict(lambda: log(0.002), {"a": log(0.9), "A": log(0.05), "9": log(0.03)})


class Walker:
    """An automaton as tables, which walks on from many starts at once, a symbol a step."""

    def __init__(self, a: Automaton, limit: float, shortest: int, longest: int, chars: str) -> None:
        self.limit, self.shortest, self.longest = limit, shortest, longest
        symbols = sorted({s for moves in a.moves for s in moves})
        code = {s: i for i, s in enumerate(symbols)}
        self.next = np.full((len(a.ends), len(symbols) + 1), -1, np.int32)  # the last column is for symbols that it doesn't know
        self.log = np.zeros(self.next.shape)
        for q, moves in enumerate(a.moves):
            for s, to in moves.items():
                self.next[q, code[s]], self.log[q, code[s]] = to, log(a.counts[q][s] / a.total(q))
        dots = [int(s[2:]) for s in symbols if s.startswith("$:")]
        self.least_dots, most = min(dots, default=0), max(dots, default=0)
        none = len(symbols)
        self.first = np.array([code.get(f"^{c}", none) for c in chars] + [none])
        self.rest = np.array([[code.get(f"{_CLASSES.get(c, c)}:{d}", none) for d in range(most + 1)] + [none] for c in chars] + [[none] * (most + 2)])
        self.end = np.full((len(a.ends), most + 2), -inf)
        for q, moves in enumerate(a.moves):
            for d in range(most + 1):
                if (z := f"$:{d}") in moves and a.ends[last := moves[z]]:
                    self.end[q, d] = log(a.counts[q][z] / a.total(q)) + log(a.ends[last] / a.total(last))
        self.most = most + 1
        heads, open_ = set(), [("", 0)]
        while open_:
            head, q = open_.pop()
            on = [(s[1], m) for s, m in a.moves[q].items() if s.startswith("^")]
            open_ += [(head + c, m) for c, m in on]
            if head and len(on) < len(a.moves[q]) or not on:  # of four symbols, or where one of fewer can end
                heads.add(head)
        self.heads = sorted(h for h in heads if h)

    def walk(self, chars: np.ndarray, ordinary: np.ndarray, dots: np.ndarray, beside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each start the end of the longest string that is accepted (0: none) and its score over the limit."""
        end, over = np.zeros(len(starts), np.int64), np.zeros(len(starts))
        at = np.flatnonzero(dots[np.minimum(starts + self.longest, len(chars))] - dots[starts] >= self.least_dots)
        begin, q, total = starts[at], np.zeros(len(at), np.int64), np.zeros(len(at))
        for i in range(self.longest):
            pos = begin + i
            if len(pos) and pos[-1] >= len(chars):
                inside = pos < len(chars)
                at, begin, q, total, pos = at[inside], begin[inside], q[inside], total[inside], pos[inside]
            d = np.minimum(dots[pos] - dots[begin], self.most)
            s = self.first[chars[pos]] if i < 4 else self.rest[chars[pos], d]
            total, q = total + self.log[q, s], self.next[q, s].astype(np.int64)
            alive = q >= 0
            if not alive.all():
                at, begin, q, total, pos = at[alive], begin[alive], q[alive], total[alive], pos[alive]
            if not len(at):
                break
            if i + 1 >= self.shortest:
                z = pos + 1
                score = (total + self.end[q, np.minimum(dots[z] - dots[begin], self.most)]) / (i + 3) - (ordinary[z] - ordinary[begin]) / (i + 1) - self.limit
                good = beside[z] & (score > 0)
                end[at[good]], over[at[good]] = z[good], score[good]
        return end, over


class Formats:
    """Automata of all kinds with their limits and lengths, the length of the shortest labelled credential, and the pattern of the runs to scan.

    A kind's candidates are as long as its labelled ones, or shorter or longer by as much as these differ among themselves.
    """

    def __init__(self, labelled: dict[str, list[str]], margin: float = 0.15) -> None:
        known = [w for examples in labelled.values() for w in examples if w]
        self.chars = "".join(sorted(set("".join(known)) | set(_CLASSES) | {"."}))
        self.points = np.array([ord(c) for c in self.chars], np.uint32)
        self.ordinary = np.array([_ORDINARY[_CLASSES.get(c, c)] for c in self.chars] + [_ORDINARY[" "]])
        self.kinds, self.walkers = {}, {}
        for kind, examples in sorted(labelled.items()):
            held = examples[::5]
            a = Automaton.infer([symbols(w) for i, w in enumerate(examples) if i % 5])
            scores = [x for x in (self.ratio(a, w) for w in held) if x > -inf]
            lengths = [len(w) for w in examples if w] or [0]
            apart = max(lengths) - min(lengths)
            limit, least, most = (min(scores) if scores else 0.0) - margin, max(1, min(lengths) - apart), max(lengths) + apart
            self.kinds[kind] = (a, limit, least, most)
            self.walkers[kind] = Walker(a, limit, least, most, self.chars)
        self.least = min((least for _, _, least, _ in self.kinds.values()), default=0)
        self.longest = max((most for _, _, _, most in self.kinds.values()), default=0)
        shortest = min(map(len, known), default=0)
        #: None without labelled credentials. RE2 reads it too.
        self.runs = "[" + "".join(re.sub(r"[^A-Za-z0-9\x80-\U0010ffff]", r"\\\g<0>", c) for c in sorted(set("".join(known)))) + f"]{{{min(shortest, 1000)},}}" if known else None

    @staticmethod
    def ratio(a: Automaton, s: str) -> float:
        """Log-likelihood a symbol under the automaton over that under ordinary words."""
        word = symbols(s)
        return a.score(word) - sum(_ORDINARY[_CLASSES.get(c, c)] for c in s) / len(s)

    def best(self, s: str) -> tuple[str, float] | None:
        found = [(x - limit, kind) for kind, (a, limit, least, most) in self.kinds.items() if least <= len(s) <= most and (x := self.ratio(a, s)) > limit]
        return max(found)[::-1] if found else None

    def starts(self, kind: str, run: str, beside: np.ndarray) -> np.ndarray:
        """Where the kind's first symbols stand in a run: anywhere, if they are a few heads; else beside a character that's no letter or digit."""
        heads = self.walkers[kind].heads
        if len(heads) > HEADS:
            some = set(heads)
            return np.array([i for i in np.flatnonzero(beside).tolist() if any(run[i : i + n] in some for n in range(1, 5))], np.int64)
        found = set()
        for h in heads:
            i = run.find(h)
            while i >= 0:
                found.add(i)
                i = run.find(h, i + 1)
        return np.array(sorted(found), np.int64)

    def accepted(self, run: str, blocked: Iterable[tuple[int, int]] = (), edge: bool = True) -> list[tuple[int, int, float, str]]:
        """(start, end, score over the limit, kind): of each start and kind the longest candidate that its format accepts, scored as ``best``
        does, ending beside a character that's no letter or digit and free of the ``blocked`` spans. edge: whether nothing that is a letter or digit stands before the run."""
        if not any(len(w.heads) > HEADS or any(h in run for h in w.heads) for w in self.walkers.values()):
            return []
        points = np.frombuffer(run.encode("utf-32-le", "surrogatepass"), np.uint32)
        between = np.ones(len(run) + 2, bool)
        between[1:-1] = ~(((points >= 48) & (points <= 57)) | ((points >= 65) & (points <= 90)) | ((points >= 97) & (points <= 122)))
        between[0] = edge
        beside = between[:-1] | between[1:]
        starts = {kind: self.starts(kind, run, beside) for kind in self.kinds}
        chars = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        chars[self.points[chars] != points] = len(self.points)
        ordinary = np.concatenate(([0.0], np.cumsum(self.ordinary[chars])))
        dots = np.concatenate(([0], np.cumsum(points == ord("."))))
        for a, b in blocked:
            chars[max(a, 0) : max(b, 0)] = len(self.points)
        out = []
        for kind, walker in self.walkers.items():
            for i in range(0, len(starts[kind]), STARTS):
                some = starts[kind][i : i + STARTS]
                end, over = walker.walk(chars, ordinary, dots, beside, some)
                out += [(a, b, x, kind) for a, b, x in zip(some.tolist(), end.tolist(), over.tolist()) if b]
        return out


@lru_cache(1)
def default_formats() -> Formats:
    return Formats(labelled_credentials())


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The fixed patterns' spans, leftmost and not overlapping for each kind."""
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS],
        "access": [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS],
        "hex": [m.span() for m in HEX.finditer(text)],
    }


def added_spans(text: str, formats: Formats, base: dict[str, list[tuple[int, int]]]) -> list[tuple[int, str, int]]:
    """(start, kind, end) of candidates outside all base spans that some format accepts. A run is taken in slabs of starts; what begins in one
    counts before what begins in the next."""
    if not formats.runs:
        return []
    known, out = sorted(s for spans in base.values() for s in spans), []
    begins, longest = [a for a, _ in known], max((b - a for a, b in known), default=0)
    for m in re.finditer(formats.runs, text):
        taken = bytearray(len(m[0]))
        for at in range(0, len(m[0]), SLAB):
            first = m.start() + at
            piece = m[0][at : at + SLAB + formats.longest]
            near = known[bisect_left(begins, first - longest) : bisect_left(begins, first + len(piece))]
            found = formats.accepted(piece, [(a - first, b - first) for a, b in near], at == 0 or bool(_BETWEEN.match(m[0], at - 1)))
            for a, b, _, kind in sorted((x for x in found if x[0] < SLAB), key=lambda x: (x[0] - x[1], x[0], -x[2], x[3])):
                if taken.find(1, at + a, at + b) < 0:
                    taken[at + a : at + b] = b"\1" * (b - a)
                    out.append((first + a, kind, first + b))
    return sorted(out)


def secret_scan(docs: DataFrame, labelled: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, n_format (added spans), base_spans and spans ("kind:start:end" in code
    points, by start, then assign, access, hex, and added kinds by name, comma-joined).

    A null text is empty and has none; repeated rows give equal rows; an empty table gives an empty result. Other columns
    are left out. ``labelled``, credentials by kind, is held in memory by each task; without any there are no added spans. Whole
    texts are scanned, however long, a slab at a time; a start is followed no further than a kind's credentials are long, so a text that
    begins like one over and over takes time in proportion to its length too (a megabyte of such takes some seconds).
    """
    formats = Formats(labelled) if labelled is not None else default_formats()
    maybe_any = _BASE + (f"|{formats.runs}" if formats.runs else "")
    place = {"assign": 0, "access": 1, "hex": 2}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = filled(batch.column(1))
            maybe = pc.match_substring_regex(texts, maybe_any).to_numpy(zero_copy_only=False)
            rows = [(0, 0, 0, 0, "", "")] * len(texts)
            for i in maybe.nonzero()[0].tolist():
                text = texts[i].as_py()
                base = base_spans(text)
                more = added_spans(text, formats, base)
                spans = sorted((a, place[k], k, b) for k, found in base.items() for a, b in found)
                every = sorted([*spans, *((a, 3, k, b) for a, k, b in more)])
                joined = [",".join(f"{k}:{a}:{b}" for a, _, k, b in x) for x in (spans, every)]
                rows[i] = (*(len(base[k]) for k in place), len(more), *joined)
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]], names=["id", "n_assign", "n_access", "n_hex", "n_format", "base_spans", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_format long, base_spans string, spans string").withColumnRenamed("id", id_col)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_format")
