"""Operator 12, n-gram Jaccard join by grouped prefixes.

A document is the set of its word shingles, as 64-bit hashes. Sets that are equal are one. The shingles of all sets have one
order, the rarest first, and two sets of a similarity of t share a shingle in their *prefixes*, the first
n - ceil(t n) + 1 of n. Sets of equal prefix and size form a group; groups that share a shingle of their prefixes meet, pairs of
groups that can't reach t by their sizes or by the places of their first common shingle go, and the members of what is
left are compared whole.

1. Frequencies. One row for each shingle of a document would be several times the input, so shingles travel packed: a *block* (some
   8 MB of text) sends its sorted keys, a packed row for each class of keys; the rows of a class meet in one task, which answers each block
   with packed frequencies; the answers meet the block's packed sets. A key is the leading bits of a hash, as many as the
   input's size asks for; shingles that share a key share its frequency, so the order stays one order.
2. A set whose prefix holds shingles of its own alone can't meet another: most stop here. The others become groups.
3. Groups that share shingles of their prefixes, in however many steps, form a *bundle*. A bundle is searched in one task, which holds its sets once.
   Bundles over a limit are taken apart by bands of sizes, and bands that are still over it in parts, each pair of which is a task, or by
   shingle and then in parts, whichever copies a set less often; so no task holds more than the limit, or a set with the limit. That is
   exact, and its work grows with the square of the sets of like size that share a shingle.
4. In a bundle, members that are known to be in one component aren't compared again. Each bundle gives a star for each of its
   components; the stars are joined by contraction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import cut, documents, filled, partitions, sliced, text_bytes

#: Production parameters: words of a shingle, the similarity that links (in hundredths).
WORDS, PERCENT = 4, 85
#: Bytes of text for a class of keys; shingles that a task of bundles holds; sets compared at once.
CLASS_BYTES, BUNDLE, CHUNK = 32 << 20, 4_000_000, 256

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def least_overlap(n: np.ndarray | int, m: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """The least intersection of sets of n and m elements with 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n + (-percent * n // 100) + 1


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for w in columns:
        h ^= w
        for k in range(2):
            h *= np.uint64(_MIX[2 * (len(columns) % 2) + k])
            h ^= h >> np.uint64(29 + 3 * k)
    return h


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles: A-Z in lower case, words between ASCII white space; fewer words make one."""
    found = [t.encode().lower().split() for t in texts.to_pylist()]
    every = [w for ws in found for w in ws]
    code = {w: xxhash.xxh3_64_intdigest(w) for w in set(every)}
    h = np.fromiter(map(code.__getitem__, every), np.uint64, len(every))
    whole = _mixed([h[k : len(h) - words + 1 + k] for k in range(words)]) if len(h) >= words else h[:0]
    out, begin = [], 0
    for ws in found:
        n = len(ws)
        if n >= words:
            out.append(np.unique(whole[begin : begin + n - words + 1]))
        else:
            out.append(_mixed([h[begin + k : begin + k + 1] for k in range(n)]) if n else h[:0])
        begin += n
    return out


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers packed: their bytes by place, compressed."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _opened(data: bytes, n: int, kind: str) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    raw = pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).reshape(-1).view(kind)


def _block(batch: pa.RecordBatch, words: int) -> tuple[int, list[np.ndarray]]:
    """(block id, sets)."""
    sets = shingle_sets(filled(batch.column(1)), words)
    digest = xxhash.xxh3_64()
    for s in sets:
        digest.update(len(s).to_bytes(8, "little"))
        digest.update(s.tobytes())
    digest.update(repr(batch.column(0).to_pylist()).encode())
    return digest.intdigest() - (1 << 63), sets


def prefixes(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, digest, grp, tokens, places, hashes) of each row: the size of its set; the set's and the group's names; and, null but for sets
    that can meet another, the shingles of its prefix that other documents hold, their places, and all its hashes."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size, n_parts = text_bytes(rows, "text"), partitions(docs.sparkSession)
    n_classes = max(2 * n_parts, size // CLASS_BYTES)
    shift = np.uint64(64 - min(64, 10 + max(1, size).bit_length()))  # a shingle shares its key by chance once in some 10,000 times
    bounds = [((k << 64) // n_classes) >> int(shift) for k in range(1, n_classes)]  # keys of a class follow one another

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto = np.array(bounds, np.uint64)
        for batch in sliced(batches):
            block, sets = _block(batch, words)
            keys, n = np.unique(np.concatenate([np.unique(s >> shift) for s in sets]), return_counts=True)
            ends = [0, *np.searchsorted(keys, upto).tolist(), len(keys)]
            some = [(k, a, b) for k, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]
            yield pa.record_batch({
                "block": pa.array([block] * len(some), pa.int64()), "class": pa.array([k for k, _, _ in some], pa.int32()), "n": pa.array([b - a for _, a, b in some], pa.int32()),
                "keys": pa.array([_squeezed(np.diff(keys[a:b], prepend=np.uint64(0))) for _, a, b in some], pa.binary()), "docs": pa.array([_squeezed(n[a:b].astype("<u4")) for _, a, b in some], pa.binary()),
            })

    def count(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        keys = np.concatenate([np.cumsum(_opened(x, n, "<u8"), dtype=np.uint64) for x, n in zip(table.column("keys").to_pylist(), sizes, strict=True)])
        n_docs = np.concatenate([_opened(x, n, "<u4") for x, n in zip(table.column("docs").to_pylist(), sizes, strict=True)])
        _, at = np.unique(keys, return_inverse=True)
        total = np.minimum(np.bincount(at, n_docs), 0xFFFFFFFF).astype("<u4")[at]
        ends = np.cumsum([0, *sizes])
        return pa.table({"block": table.column("block"), "class": table.column("class"), "n": table.column("n"), "docs": pa.array([_squeezed(total[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())})

    def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            block, sets = _block(batch, words)
            sizes, ids = np.array(list(map(len, sets)), "<u4"), batch.column(0)
            yield pa.record_batch({
                "block": pa.array([block], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays([ids])),
                "sizes": pa.array([sizes.tobytes()], pa.binary()), "hashes": pa.array([_squeezed(np.concatenate(sets))], pa.binary()),
            })

    def prefix_rows(answers: pa.Table, packed: pa.Table) -> pa.Table:
        by_class = dict(zip(answers.column("class").to_pylist(), zip(answers.column("docs").to_pylist(), answers.column("n").to_pylist(), strict=True), strict=True))
        total = np.concatenate([_opened(*by_class[k], "<u4") for k in sorted(by_class)]) if by_class else np.zeros(0, "<u4")
        out: dict[str, list] = {c: [] for c in ("id", "n", "digest", "grp", "tokens", "places", "hashes")}
        for ids, sizes, hashes in zip(packed.column("ids").to_pylist(), packed.column("sizes").to_pylist(), packed.column("hashes").to_pylist(), strict=True):
            ends = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64))))
            every = _opened(hashes, int(ends[-1]), "<u8")
            keys = np.unique(every >> shift)
            if len(keys) != len(total):
                raise RuntimeError("the input changed between two scans; write it to a table first")
            n_docs = total[np.searchsorted(keys, every >> shift)]
            for i, a, b in zip(ids, ends, ends[1:]):
                some = [None] * 4
                s, held = every[a:b], n_docs[a:b]
                if n := int(b - a):
                    p = prefix_length(n, percent)
                    if np.count_nonzero(held < 2) < p:
                        order = np.lexsort((s, held))[:p]
                        shared = np.flatnonzero(held[order] > 1)
                        name = xxhash.xxh3_64_intdigest(s[order].tobytes(), n) - (1 << 63)
                        some = [name, s[order[shared]].view(np.int64), shared.astype(np.int32), s.tobytes()]
                for c, x in zip(out, (i, n, xxhash.xxh3_128_digest(s.tobytes()) if n else None, *some), strict=True):
                    out[c].append(x)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
        return pa.table({c: pa.array(x, kind) for (c, x), kind in zip(out.items(), kinds, strict=True)})

    keys = rows.mapInArrow(key_rows, "block long, class int, n int, keys binary, docs binary")
    answers = keys.groupBy("class").applyInArrow(count, "block long, class int, n int, docs binary")
    sets = rows.mapInArrow(set_rows, "block long, ids array<long>, sizes binary, hashes binary")
    return answers.groupBy("block").cogroup(sets.groupBy("block")).applyInArrow(prefix_rows, "id long, n long, digest binary, grp long, tokens array<long>, places array<int>, hashes binary")


class Bundle:
    """Sets that are searched together: links by groups, prefixes and whole comparison."""

    def __init__(self, names: list[int], groups: list[int], sizes: list[int], tokens: list[np.ndarray], places: list[np.ndarray], hashes: list[np.ndarray], percent: int = PERCENT) -> None:
        first: dict[int, int] = {}
        order = sorted(range(len(names)), key=lambda i: (sizes[i], groups[i], names[i]))
        self.names, self.percent = [names[i] for i in order], percent
        self.sizes = np.array([sizes[i] for i in order], np.int64)
        of = [first.setdefault(groups[i], len(first)) for i in order]  # groups are numbered by size
        self.begins = np.searchsorted(of, np.arange(len(first) + 1))  # members of group g: begins[g] to begins[g + 1]
        lead = [order[b] for b in self.begins[:-1].tolist()]
        self.tokens, self.places = [tokens[i] for i in lead], [places[i] for i in lead]
        _, code = np.unique(np.concatenate([hashes[i] for i in order]), return_inverse=True)
        self.code, self.upto = code, np.concatenate(([0], np.cumsum(self.sizes)))
        self.mark = np.zeros(int(code.max()) + 1 if len(code) else 1, bool)
        known, at = np.unique(np.concatenate(self.tokens), return_inverse=True)
        of_token = np.repeat(np.arange(len(first)), list(map(len, self.tokens)))
        by = np.argsort(at, kind="stable")  # inverted index: of each token its groups, by size, with the token's place in them
        self.index, self.index_place, self.index_ends = of_token[by], np.concatenate(self.places)[by], np.searchsorted(at[by], np.arange(len(known) + 1))
        self.token_at = np.split(at, np.cumsum(list(map(len, self.tokens)))[:-1])
        self.root = np.arange(len(self.names))
        self.members: dict[int, list[int]] = {}

    def join(self, i: int, k: int) -> None:
        a, b = int(self.root[i]), int(self.root[k])
        if a != b:
            big, small = self.members.setdefault(a, [a]), self.members.setdefault(b, [b])
            if len(big) < len(small):
                a, b, big, small = b, a, small, big
            self.root[small] = a
            big += self.members.pop(b)

    def candidates(self, g: int) -> np.ndarray:
        """Groups before g that share a token of its prefix and pass by size and by the places of the first common one."""
        size = int(self.sizes[self.begins[g]])
        groups, theirs, mine = [], [], []
        for at, place in zip(self.token_at[g].tolist(), self.places[g].tolist(), strict=True):
            a = int(self.index_ends[at])
            b = a + int(np.searchsorted(self.index[a : self.index_ends[at + 1]], g))
            if a < b:
                groups.append(self.index[a:b])
                theirs.append(self.index_place[a:b])
                mine.append(np.full(b - a, place))
        if not groups:
            return np.zeros(0, np.int64)
        found, at = np.unique(np.concatenate(groups), return_index=True)  # the first time, since tokens come in their order
        other = self.sizes[self.begins[found]]
        most = np.minimum(size - np.concatenate(mine)[at], other - np.concatenate(theirs)[at])  # the common one and all behind it
        return found[(100 * other >= self.percent * size) & (most >= least_overlap(size, other, self.percent))]

    def compare(self, i: int, others: np.ndarray) -> None:
        """Member i with other members, but for those already in its component."""
        own = self.code[self.upto[i] : self.upto[i + 1]]
        self.mark[own] = True
        while len(others := others[self.root[others] != self.root[i]]):
            now, others = others[:CHUNK], others[CHUNK:]
            lengths = self.sizes[now]
            ends = np.cumsum(lengths)
            flat = np.arange(int(ends[-1])) + np.repeat(self.upto[now] - (ends - lengths), lengths)
            common = np.add.reduceat(self.mark[self.code[flat]], ends - lengths, dtype=np.int64)
            for k in now[100 * common >= self.percent * (lengths + len(own) - common)].tolist():
                self.join(i, k)
        self.mark[own] = False

    def links(self) -> list[tuple[int, int]]:
        """A star of names for each component of two or more."""
        for g in range(len(self.begins) - 1):
            found = self.candidates(g)
            expanded = [np.arange(self.begins[c], self.begins[c + 1]) for c in found.tolist()]
            for i in range(int(self.begins[g]), int(self.begins[g + 1])):
                self.compare(i, np.concatenate([np.arange(self.begins[g], i), *expanded[::-1]]))
        groups = [sorted(self.names[i] for i in m) for m in self.members.values() if len(m) > 1]
        return [(m[0], x) for m in groups for x in m[1:]]


def link_edges(sets: DataFrame, percent: int = PERCENT, bundle: int = BUNDLE) -> DataFrame:
    """(a, b): edges between names of sets whose components are those of all links. sets: (name, n, grp, tokens, places, hashes), each set once."""
    n_parts = partitions(sets.sparkSession)
    groups = cut(sets.groupBy("grp").agg(F.count("*").alias("members"), F.sum("n").alias("n"), F.first("tokens").alias("tokens")), "groups")
    postings = groups.select("grp", F.explode("tokens").alias("token"))
    heads = postings.groupBy("token").agg(F.min("grp").alias("head"), F.count("*").alias("k")).where("k > 1")
    near = cut(components(postings.join(heads, "token").where("grp <> head").select(F.col("head").alias("a"), F.col("grp").alias("b"))), "bundles")
    bundled = cut(groups.join(near.withColumnRenamed("node", "grp"), "grp", "left").where("root IS NOT NULL OR members > 1").select("grp", "n", F.coalesce("root", "grp").alias("bundle")), "bundled")
    sizes = bundled.groupBy("bundle").agg(F.sum("n").alias("total"))
    placed = cut(bundled.join(sizes, "bundle").select("grp", "bundle", (F.col("total") > bundle).alias("large")), "placed")
    rows = sets.join(placed, "grp")  # a set goes once to its bundle
    small = rows.where("NOT large").select("bundle", "name", "grp", "n", "tokens", "places", "hashes")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bundle; a bundle is held whole."""
        key, held = None, []
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if key != keys[a]:
                    yield from _linked(held, percent)
                    key, held = keys[a], []
                held.append(batch.slice(a, b - a))
        yield from _linked(held, percent)

    sort = ["bundle", "name"]
    edges = small.repartition(n_parts, "bundle").sortWithinPartitions(*sort).mapInArrow(search, "a long, b long")
    if not placed.where("large").take(1):
        return edges
    large = rows.where("large")
    # By size: sets that link lie in one band of sizes or in neighbouring ones, so each goes to its own and to the next.
    cols = ["name", "grp", "n", "tokens", "places", "hashes"]
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log((percent - 1) / 100))).cast("int")
    banded = large.withColumn("band", band).select("bundle", F.explode(F.array("band", F.col("band") + 1)).alias("band"), *cols)
    parts = F.least(F.ceil(2 * F.col("total") / bundle), F.col("k")).cast("int")
    of_band = banded.groupBy("bundle", "band").agg(F.sum("n").alias("total"), F.count("*").alias("k"), F.avg(F.size("tokens")).alias("own")).where("k > 1")
    of_band = cut(of_band.select("bundle", "band", parts.alias("parts"), "own"), "bands")
    dealt = banded.join(of_band, ["bundle", "band"])
    # In parts, each pair of which is a task, or by shingle first: whichever copies a set less often.
    token = F.lit(None).cast("long").alias("token")
    by_band = dealt.where("parts <= own").select("bundle", "band", token, "parts", *cols)
    by_token = dealt.where("parts > own").select("bundle", "band", F.explode("tokens").alias("token"), *cols)
    of_token = by_token.groupBy("bundle", "band", "token").agg(F.sum("n").alias("total"), F.count("*").alias("k")).where("k > 1")
    by_token = by_token.join(cut(of_token.select("bundle", "band", "token", parts.alias("parts")), "tokens"), ["bundle", "band", "token"])
    every = by_band.unionByName(by_token.select(*by_band.columns))
    part = F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, part).alias("i"), F.greatest(k, part).alias("k")))
    met = every.select(F.explode(pairs).alias("pair"), "bundle", "band", "token", *cols)
    named = met.select(F.xxhash64("bundle", "band", "token", "pair.i", "pair.k").alias("bundle"), *cols)
    return edges.unionByName(named.repartition(n_parts, "bundle").sortWithinPartitions(*sort).mapInArrow(search, "a long, b long"))


def _linked(held: list[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held) if held else None
    if table is None or table.num_rows < 2:
        return
    lists = lambda c: [x.values.to_numpy() for x in table.column(c)]
    hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    found = Bundle(table.column("name").to_pylist(), table.column("grp").to_pylist(), table.column("n").to_pylist(), lists("tokens"), lists("places"), hashes, percent).links()
    both = np.array(found, np.int64).reshape(-1, 2)
    yield pa.record_batch({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})


def jaccard_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", bundle: int = BUNDLE) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles (distinct shingles of ``words`` words), component (the least id reachable over links of a
    similarity of ``percent`` hundredths or more, its own included).

    Null and wordless texts have no shingles, link with nothing and are components of their own, repeated ids too; repeated rows and ids keep a
    row each; null ids name a component only where it has no other (then null); an empty table gives an empty result; other
    columns, whatever their names, are left out. ``docs`` must give the same rows in the same order each time it's read (a table, a written cut): a block that
    changed between the two scans is an error. Sets are of 64-bit hashes: of a pair of texts with 1,000 shingles each, two unlike ones agree with odds of 1 in 10^13;
    sets are named by 64 bits of a 128-bit digest.
    """
    found = cut(prefixes(docs, percent, words, id_col, text_col), "prefixes")
    name = F.xxhash64("digest").alias("name")
    rows = found.select("id", "n", F.when(F.col("n") > 0, name).alias("name"))
    sets = cut(found.where("grp IS NOT NULL").select(name, "n", "grp", "tokens", "places", "hashes").dropDuplicates(["name"]), "sets")
    roots = components(link_edges(sets, percent, bundle))
    distinct = rows.where("name IS NOT NULL").groupBy("name").agg(F.min("id").alias("least"))
    rooted = cut(distinct.join(roots.withColumnRenamed("node", "name"), "name", "left").select("name", "least", F.coalesce("root", "name").alias("root")), "rooted")
    named = cut(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("name", "component"), "components")
    with_words = rows.where("name IS NOT NULL").join(named, "name").select("id", F.col("n").alias("n_shingles"), "component")
    return with_words.unionByName(rows.where("name IS NULL").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component")))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(documents(spark, sf_dir, stable=True))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
