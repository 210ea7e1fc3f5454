"""Operator 4, best-fit packing by a grouping genetic algorithm.

Pieces of full length are bins as they are. The others are dealt by a hash of their keys into shards of some
thousand, each a packing problem of its own (a random sample of all lengths). A shard lives on several islands. An
island evolves a population of packings; pieces of one length are interchangeable, so a bin is a tuple of lengths.
Crossover injects the best-filled bins of both parents while their lengths last, which leaves out duplicates, and
best-fits the displaced lengths; mutation empties the worst bins and best-fits their content. Between rounds each
island's elite migrates to the next island of its shard, by a shuffle of packed islands.

Shards stand on levels. A shard's best packing is dealt out to its pieces in the order of their keys, but the pieces of
its loosest bins (a sixteenth of its pieces) go up to the next level, where they are dealt into as many fewer shards, until
one shard is left; so what every shard would waste is packed together. A shard that has no more than one bin over the
fewest that its lengths allow leaves the rest to the level above after the least rounds; one that has more, and the last shard
of all, evolves until many generations in a row brought no better packing and a round with new elites saved no bin.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import coder
from .shared import cut, documents, filled, partitions, sliced

#: Production parameters: tokens of a sequence, mean pieces of a shard, islands of a shard, packings of an island, least rounds, least generations of a round.
CAPACITY, SHARD_PIECES, ISLANDS, POPULATION, ROUNDS, GENERATIONS = 2048, 4096, 2, 4, 2, 4
#: A round of an island ends once so many generations in a row brought no better packing; pieces of a shard for one that goes up a level.
PATIENCE, RISING = 100, 16

Bins = list[tuple[int, ...]]


class OpenBins:
    """Bins by free room; the fullest bin that takes a length is found in a bit set of the rooms in use."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.by_room, self.rooms = capacity, {}, 0

    def put(self, content: list[int], room: int) -> None:
        self.by_room.setdefault(room, []).append(content)
        self.rooms |= 1 << room

    def add(self, length: int) -> None:
        fits = self.rooms >> length
        if not fits:
            self.put([length], self.capacity - length)
            return
        room = length + (fits & -fits).bit_length() - 1
        same = self.by_room[room]
        content = same.pop()
        if not same:
            self.rooms ^= 1 << room
        content.append(length)
        self.put(content, room - length)

    def bins(self) -> Bins:
        return [tuple(sorted(c, reverse=True)) for same in self.by_room.values() for c in same]


def best_fit(lengths: list[int], capacity: int, bins: Bins = ()) -> Bins:
    """``bins`` and then each of ``lengths``, in order, in the fullest bin that takes it."""
    state = OpenBins(capacity)
    for b in bins:
        state.put(list(b), capacity - sum(b))
    for n in lengths:
        state.add(n)
    return state.bins()


def fitness(bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then more uneven filling."""
    return -len(bins), sum((sum(b) / capacity) ** 2 for b in bins)


def cross(a: Bins, b: Bins, lengths: Counter, capacity: int) -> Bins:
    """The best-filled bins of both parents as far as their lengths last; the rest by best fit."""
    left, child, keep = lengths.copy(), [], capacity * 49 // 50
    for x in sorted(chain(a, b), key=sum, reverse=True):
        if sum(x) < keep:
            break
        if all(left[n] >= x.count(n) for n in x):
            for n in x:
                left[n] -= 1
            child.append(x)
    return best_fit(sorted(left.elements(), reverse=True), capacity, child)


def swap(bins: Bins, loose: list[int], capacity: int) -> tuple[Bins, list[int]]:
    """(``bins`` in which a length gave way to the greatest loose one that fits its place better, for each in turn; what is loose then)."""
    have, known, out = Counter(loose), sum(1 << n for n in set(loose)), []
    for b in bins:
        room = capacity - sum(b)
        if room:
            content = list(b)
            for i, x in enumerate(content):
                y = (known & ((2 << (x + room)) - 1)).bit_length() - 1
                if y > x:
                    have[y] -= 1
                    have[x] += 1
                    known ^= (not have[y]) << y
                    known |= 1 << x
                    content[i], room = y, room - y + x
            b = tuple(sorted(content, reverse=True))
        out.append(b)
    return out, list(have.elements())


def mutate(bins: Bins, capacity: int, rng: random.Random, share: float = 0.02) -> Bins:
    """Empties the worst-filled bins and some others, swaps what was in them into the rest where it fits better, and best-fits
    what is left, now and then not by falling length."""
    ordered = sorted(bins, key=sum)
    n = max(2, int(len(ordered) * share))
    gone, rest = ordered[:n], ordered[n:]
    picked = set(rng.sample(range(len(rest)), min(len(rest), n)))
    loose = [x for b in gone for x in b] + [x for i in picked for x in rest[i]]
    kept, loose = swap([b for i, b in enumerate(rest) if i not in picked], loose, capacity)
    noise = rng.choice((0.0, 0.1, 0.3))
    loose.sort(key=lambda x: x * (1 + noise * rng.random()), reverse=True)
    return best_fit(loose, capacity, kept)


def least_bins(lengths: list[int], capacity: int) -> int:
    """No packing has fewer bins: by the total length, and by the lengths of which no two share a bin."""
    return max(-(-sum(lengths) // capacity), sum(2 * n > capacity for n in lengths), min(1, len(lengths)))


def evolve(lengths: list[int], population: list[Bins], capacity: int, rng: random.Random, generations: int, size: int, patience: int = 0, slack: int = 0) -> list[Bins]:
    """The best ``size`` packings, best first, after ``generations`` at least and then, with more than ``slack`` bins over the least, until
    ``patience`` in a row brought no better one; stops where no packing can use fewer bins."""
    counts, least = Counter(lengths), least_bins(lengths, capacity)
    population = list(population)
    down = sorted(lengths, reverse=True)
    while len(population) < size:
        noise = 0.15 * len(population)
        population.append(best_fit(sorted(down, key=lambda x, k=noise: x * (1 + k * rng.random()), reverse=True) if noise else down, capacity))
        if len(population[-1]) <= least:
            break  # no packing has fewer bins, so it needs no others to cross with
    rated = sorted(((fitness(p, capacity), p) for p in population), key=lambda x: x[0], reverse=True)[:size]
    done, idle = 0, 0
    while len(rated[0][1]) > least and (done < generations or (idle < patience and len(rated[0][1]) > least + slack)):
        best = rated[0][0]
        a, b = rng.choice(rated)[1], rng.choice(rated[: max(2, size // 2)])[1]
        child = mutate(cross(a, b, counts, capacity), capacity, rng)
        rated = sorted([*rated, (fitness(child, capacity), child)], key=lambda x: x[0], reverse=True)[:size]
        done, idle = done + 1, 0 if rated[0][0] > best else idle + 1
    return [p for _, p in rated]


def _packed(bins: Bins) -> bytes:
    """Lengths bin by bin; a bin's first is negative less one."""
    return np.array([-n - 1 if i == 0 else n for b in bins for i, n in enumerate(b)], "<i4").tobytes()


def _bins(data: bytes) -> Bins:
    flat = np.frombuffer(data, "<i4").tolist()
    out: list[list[int]] = []
    for n in flat:
        if n < 0:
            out.append([-n - 1])
        else:
            out[-1].append(n)
    return [tuple(b) for b in out]


def rising_bins(bins: Bins, capacity: int, most: int) -> list[bool]:
    """Which bins' pieces go up a level: the loosest of those that aren't full, together at most ``most`` pieces."""
    up, left = [False] * len(bins), most
    for i in sorted(range(len(bins)), key=lambda i: (sum(bins[i]), bins[i])):
        if sum(bins[i]) < capacity and len(bins[i]) <= left:
            up[i], left = True, left - len(bins[i])
    return up


_ISLAND = "shard long, island int, lengths binary, packings array<binary>, bins int, least int, going boolean"
_ISLAND_ARROW = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("lengths", pa.binary()), ("packings", pa.list_(pa.binary())), ("bins", pa.int32()), ("least", pa.int32()), ("going", pa.bool_())])


def _evolved(parts: DataFrame, n_shards: int, capacity: int, islands: int, rounds: int, generations: int, population: int, patience: int, slack: int, level: int) -> DataFrame:
    """The islands (_ISLAND) of all shards of ``parts`` (shard, key, length) after all their rounds."""
    tasks = min(n_shards * islands, partitions(parts.sparkSession))  # a number, or a few tasks would get all of these small rows

    def step(number: int, shard: int, island: int, lengths: list[int], found: list[Bins], before: int | None) -> dict:
        rng = random.Random(((level * (1 << 32) + shard) * islands + island) * 1000 + number)
        found = evolve(lengths, found, capacity, rng, generations, population, patience, slack)
        least = least_bins(lengths, capacity)
        more = patience > 0 and len(found[0]) > least + slack and (before is None or len(found[0]) < before)
        return {
            "shard": shard, "island": island, "lengths": np.array(lengths, "<i4").tobytes(), "packings": [_packed(p) for p in found], "bins": len(found[0]), "least": least,
            "going": number < rounds or more,
        }

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([step(1, r["shard"], r["island"], r["lengths"], [], None)], _ISLAND_ARROW)

    def again(number: int) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            own = sorted(table.to_pylist(), key=lambda r: not r["own"])  # an island's own row, then the elite that came
            lengths = np.frombuffer(own[0]["lengths"], "<i4").tolist()
            return pa.Table.from_pylist([step(number, own[0]["shard"], own[0]["island"], lengths, [_bins(p) for r in own for p in r["packings"]], min(r["bins"] for r in own))], _ISLAND_ARROW)

        return run

    gathered = parts.groupBy("shard").agg(F.array_sort(F.collect_list("length")).alias("lengths"))  # a shard has some shard_pieces
    each = gathered.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths")
    state = cut(each.repartition(tasks, "shard", "island").mapInArrow(first, _ISLAND), "islands")
    resting: list[DataFrame] = []
    for number in count(2):
        going = state.groupBy("shard").agg(F.max("going").alias("going"), F.min("bins").alias("bins"), F.first("least").alias("least")).where("going AND bins > least").select("shard")
        if not going.take(1):
            break
        resting.append(state.join(going, "shard", "left_anti"))
        state = state.join(going, "shard", "left_semi").withColumn("own", F.lit(True))
        elite = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), "lengths", F.slice("packings", 1, 1).alias("packings"), "bins", "least", "going", F.lit(False).alias("own"))
        moved = state.unionByName(elite) if islands > 1 else state
        state = cut(moved.repartition(tasks, "shard", "island").groupBy("shard", "island").applyInArrow(again(number), _ISLAND), "islands")
    for done in resting:
        state = state.unionByName(done)
    return state


def _dealer(capacity: int, rising: int, level: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Deals a shard's best packing out to its pieces; pieces that go up a level (one of ``rising``, none for 0) get no sequence."""

    def deal(pieces: pa.Table, found: pa.Table) -> pa.Table:
        pieces = pieces.sort_by([("length", "ascending"), ("key", "ascending")])
        best = max((_bins(r["packings"][0]) for r in sorted(found.to_pylist(), key=lambda r: r["island"])), key=lambda p: fitness(p, capacity))
        sizes, content = [len(b) for b in best], np.array([n for b in best for n in b], np.int64)
        bin_of = np.repeat(np.arange(len(best)), sizes)
        ends = np.cumsum(content)
        begins = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        offset = ends - content - (ends - content)[begins][bin_of]
        order = np.argsort(content, kind="stable")  # places by length meet the pieces by length
        up = np.array(rising_bins(best, capacity, len(content) // rising if rising else 0))
        shard = found.column("shard")[0].as_py()
        ids = pa.array((level << 56) + (shard << 24) + bin_of[order], mask=up[bin_of[order]])
        return pa.table({"key": pieces.column("key"), "length": pieces.column("length"), "sequence_id": ids, "offset": pa.array(offset[order])})

    return deal


def pack(items: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS, rounds: int = ROUNDS, generations: int = GENERATIONS, population: int = POPULATION, patience: int = PATIENCE, rising: int = RISING) -> DataFrame:
    """(key, sequence_id, offset) for each row of ``items`` (key long, distinct; length int between 0 and ``capacity``).

    Reruns on the same rows agree. ``items`` should be a table or a written cut. An empty table gives an empty result.
    """
    spark = items.sparkSession
    out = items.where(F.col("length") >= capacity).select("key", (-F.col("key") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, n = items.where(F.col("length") < capacity).select("key", F.col("length").cast("int").alias("length")), items.count()
    for level in count():
        n_shards = max(1, round(n / shard_pieces))
        last = n_shards == 1
        parts = left.select(F.pmod(F.xxhash64(F.lit(level), "key"), F.lit(n_shards)).alias("shard"), "key", "length")
        state = _evolved(parts, n_shards, capacity, islands, rounds, generations, population, patience, 0 if last else 1, level)

        tasks = min(n_shards, partitions(spark))
        dealt = parts.repartition(tasks, "shard").groupBy("shard").cogroup(state.repartition(tasks, "shard").groupBy("shard")).applyInArrow(_dealer(capacity, 0 if last else rising, level), "key long, length int, sequence_id long, offset long")
        if last:
            return out.unionByName(dealt.select("key", "sequence_id", "offset"))
        dealt = cut(dealt, "dealt")
        out = out.unionByName(dealt.where("sequence_id IS NOT NULL").select("key", "sequence_id", "offset"))
        left = dealt.where("sequence_id IS NULL").select("key", "length")
        n = left.count()


def token_pieces(docs: DataFrame, vocab_path: str, end_id: int | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """The pieces of each row of ``docs``: doc_id, key (new in each evaluation: write the table before it's used twice), piece, start,
    length, ids_crc32 (of little-endian unsigned 32-bit ids) and with ``ids`` also the ids.

    Documents of more than ``capacity`` ids (with ``end_id``) are cut so that the first piece takes what is over a multiple
    of it. Null texts are empty; without an end id, empty documents have one piece of length 0. Repeated rows are all kept.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counter = coder(vocab_path), TaskContext.get().partitionId() << 33
        for batch in sliced(batches):
            flat, ends = codes.ids(filled(batch.column(1)))
            if end_id is not None:
                flat, ends = np.insert(flat, ends[1:], end_id), ends + np.arange(len(ends))
            sizes = np.diff(ends)
            n_pieces = np.maximum(1, -(-sizes // capacity))
            doc = np.repeat(np.arange(len(sizes)), n_pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            first = sizes - (n_pieces - 1) * capacity
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            a = ends[:-1][doc] + start
            wide = flat.astype("<u4")
            crc = [crc32(wide[i:k]) for i, k in zip(a.tolist(), (a + length).tolist(), strict=True)]
            out = {
                "doc_id": batch.column(0).take(pa.array(doc)), "key": pa.array(counter + np.arange(len(doc))), "piece": pa.array(piece, pa.int32()), "start": pa.array(start),
                "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()),
            }
            if ids:
                out["ids"] = pa.array([wide[i:k].tolist() for i, k in zip(a.tolist(), (a + length).tolist(), strict=True)], pa.list_(pa.int64()))
            counter += len(doc)
            yield pa.record_batch(out)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(make, f"doc_id {kind}, key long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * ids)


def pack_documents(docs: DataFrame, vocab_path: str, end_id: int | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, **how: int) -> DataFrame:
    """token_pieces with the place of each: sequence_id and offset. An empty table gives an empty result."""
    pieces = cut(token_pieces(docs, vocab_path, end_id, capacity, id_col, text_col, ids), "pieces")
    placed = pack(pieces.select("key", "length"), capacity, **how)
    return pieces.join(placed, "key").drop("key")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pack_documents with ids: sequence_id, ids. A sequence holds at most its capacity."""
    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("parts"))
    return whole.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


#: Production parameters.
VOCABULARY, END_ID = "byte_bpe_50k.json", 0


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), END_ID).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
