"""Operator 2, quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(w.x - t_k) with one weight vector w over hashed text features, shared by all grades, and
ordered thresholds t_0 < t_1 < ... The expected grade is the sum of those tails. Features of a text are the hashes
of its distinct lower-cased words (punctuation at the ends off), of its words' shapes, and of immediate repeats,
the last two by the logarithm of their frequency. The fit takes at most FIT_ROWS labelled rows, those with the
least hashes of their ids, and of these as many whole rows as have FIT_ROWS * FIT_FEATURES features together. Fit,
limit and scoring take all features of a row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, documents, filled, sliced

#: Production parameters: bits of a feature's place, rows of the fit and their mean features at most, steps, penalty, share of held-out good rows that must be kept.
BITS, FIT_ROWS, FIT_FEATURES, STEPS, PENALTY, KEEP_SHARE = 18, 10_000, 1024, 150, 5e-4, 0.995
_SHAPES = [(re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "9")]
_ENDS = ".,;:!?\"'()[]{}|*$%&#<>-"


class Hashed:
    """Places and values of a text's features, with a bounded cache of words."""

    def __init__(self, bits: int = BITS, limit: int = 300_000) -> None:
        self.size, self.limit, self.cache = 1 << bits, limit, {}

    def _word(self, w: str) -> tuple[int, int]:
        shape = w
        for pattern, sign in _SHAPES:
            shape = pattern.sub(sign, shape)
        case = "U" if len(w) > 2 and w.isupper() else ""
        at = lambda s: xxhash.xxh3_64_intdigest(s) % self.size
        found = self.cache[w] = (at("w:" + w.lower().strip(_ENDS)), at("s:" + case + shape))
        return found

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if len(self.cache) > self.limit:
            self.cache.clear()
        words, cache = text.split(), self.cache
        both = [cache.get(w) or self._word(w) for w in words]
        present = {a for a, _ in both}
        shapes = Counter([b for _, b in both])
        repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
        n = max(1, len(words))
        at = [*present, *shapes, xxhash.xxh3_64_intdigest("r:") % self.size]
        value = [1.0] * len(present) + [float(np.log1p(100 * c / n)) for c in shapes.values()] + [float(np.log1p(100 * repeats / n))]
        return np.array(at, np.int64), np.array(value)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def thresholds(x: np.ndarray, n_tails: int) -> np.ndarray:
    """The last ``n_tails`` parameters are a first threshold and the logarithms of the gaps to the others."""
    return x[len(x) - n_tails] + np.concatenate(([0], np.cumsum(np.exp(x[len(x) - n_tails + 1 :]))))


def loss(x: np.ndarray, at: np.ndarray, value: np.ndarray, row: np.ndarray, grades: np.ndarray, weight: np.ndarray, n_tails: int, penalty: float) -> tuple[float, np.ndarray]:
    """(negative log-likelihood of the ``grades`` by row ``weight`` plus the L2 penalty, its gradient) at the parameters x: feature weights, then
    thresholds. A feature is (its place among the weights, value, row)."""
    n, rows = len(x) - n_tails, np.arange(len(grades))
    w, gaps = x[:n], np.exp(x[n + 1 :])
    s = np.bincount(row, value * w[at], len(grades))
    tail = np.hstack([np.ones((len(s), 1)), _sigmoid(s[:, None] - thresholds(x, n_tails)), np.zeros((len(s), 1))])
    p = np.maximum(tail[rows, grades] - tail[rows, grades + 1], 1e-9)
    slope = tail * (1 - tail)
    d_t = np.zeros((len(s), n_tails))
    up, low = grades > 0, grades < n_tails
    d_t[rows[up], grades[up] - 1] += slope[rows[up], grades[up]] / p[up]
    d_t[rows[low], grades[low]] -= slope[rows[low], grades[low] + 1] / p[low]
    d_t *= weight[:, None]  # of the negative log-likelihood by each threshold
    by_t = d_t.sum(0)
    g = np.concatenate((np.bincount(at, -value * d_t.sum(1)[row], n) + penalty * w, [by_t.sum()], [by_t[k + 1 :].sum() * gaps[k] for k in range(n_tails - 1)]))
    return float(-(weight * np.log(p)).sum() + penalty * (w @ w) / 2), g


class Ordinal:
    """The fitted model."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and k."""
        return _sigmoid(np.asarray(score, np.float64)[:, None] - self.thresholds)

    @classmethod
    def fit(cls, places: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, size: int, steps: int = STEPS, penalty: float = PENALTY) -> Ordinal:
        """Adam on the mean negative log-likelihood with an L2 penalty; thresholds are a first one and the logarithms of the gaps."""
        n_tails = max(1, int(grades.max()) if len(grades) else 1)
        used, at = np.unique(np.concatenate(places), return_inverse=True)
        value, row = np.concatenate(values), np.repeat(np.arange(len(places)), [len(p) for p in places])
        share = np.bincount(grades, minlength=n_tails + 1) / len(grades)
        weight = (1 / np.maximum(share, 1e-3)) ** 0.5
        weight = weight[grades] / weight[grades].sum()
        x = np.zeros(len(used) + n_tails)
        above = np.clip(1 - np.cumsum(share)[:n_tails], 1e-3, 1 - 1e-3)
        start = -np.log(above / (1 - above))
        x[len(used)] = start[0]
        x[len(used) + 1 :] = np.log(np.maximum(np.diff(start), 0.1))
        m, v = np.zeros_like(x), np.zeros_like(x)
        for step in range(1, steps + 1):
            _, g = loss(x, at, value, row, grades, weight, n_tails, penalty)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            x -= 0.1 * min(1, 4 * (1 - step / (steps + 1))) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights = np.zeros(size, np.float32)
        weights[used] = x[: len(used)]
        return cls(weights, thresholds(x, n_tails))


def fit_classifier(docs: DataFrame, labels: DataFrame, grade: Column, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, bits: int = BITS, fit_features: int = FIT_ROWS * FIT_FEATURES) -> tuple[Ordinal, float]:
    """(model, the tail probability of the best grade from which a document is kept), from at most ``fit_rows`` rows of
    ``labels`` with a ``grade`` (0, 1, ...; null is left out), the first by the hash of their ids that have ``fit_features``
    together. A fifth of them, held out of the fit, sets the limit: it keeps KEEP_SHARE of the held-out rows of the best grade (at
    most 0.5).

    Null ids and grades are left out; of an id's grades the least counts; each row of ``docs`` with a rated id is a row of the fit, repeats
    too. Texts go in whole, however long. Without labelled rows the model is all zeros and the limit 0."""
    rated = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("k"), grade.cast("int").alias("grade")).where("grade IS NOT NULL").groupBy("k").agg(F.min("grade").alias("grade"))
    sample = cut(rated.orderBy(F.xxhash64("k"), "k").limit(fit_rows), "sample")
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text")).join(F.broadcast(sample), "k")  # the sample has fit_rows rows at most
    rows = rows.select("grade", "text", F.xxhash64("k").alias("order"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed(bits)
        for batch in sliced(batches):
            found = [hashed(t) for t in filled(batch.column(1)).to_pylist()]
            yield pa.record_batch({"grade": batch.column(0), "order": batch.column(2), "places": pa.array([a.tolist() for a, _ in found], pa.list_(pa.int32())), "values": pa.array([b.tolist() for _, b in found], pa.list_(pa.float32()))})

    found = cut(rows.mapInArrow(features, "grade int, order long, places array<int>, values array<float>"), "features")
    sizes = found.select("order", F.size("places").alias("n")).toArrow().sort_by("order")
    fits = np.cumsum(sizes.column("n").to_numpy()) <= fit_features
    if not fits.all():  # whole rows, and all rows of an id or none; the first id in any case
        order = sizes.column("order").to_numpy()
        last = order[np.argmin(fits)]
        found = found.where(F.col("order") < int(last) if last > order[0] else F.col("order") == int(last))
    got = found.toArrow().sort_by("order")
    if not len(got):
        return Ordinal(np.zeros(1 << bits, np.float32), np.zeros(1)), 0.0
    grades = got.column("grade").to_numpy()
    places, values = ([np.array(x.values) for x in got.column(c)] for c in ("places", "values"))
    held = np.arange(len(grades)) % 5 == 4
    pick = lambda rows, mask: [r for r, m in zip(rows, mask, strict=True) if m]
    model = Ordinal.fit(pick(places, ~held), pick(values, ~held), grades[~held], 1 << bits)
    best = [(p, v) for p, v, g, h in zip(places, values, grades, held, strict=True) if h and g == grades.max()]
    if not best:
        return model, 0.5
    tail = model.tails(np.array([model.weights[p] @ v for p, v in best]))[:, -1]
    return model, float(min(0.5, np.quantile(tail, 1 - KEEP_SHARE)))


def classify(docs: DataFrame, model: Ordinal, limit: float, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: id, score, expected_grade, tails (P(grade > k) for each k), kept.

    A null text is empty and gets the model's score for no words; repeated rows score alike; an empty table gives an
    empty result; a long text is scored whole. Without labelled rows every score is 0 and all is kept. Other columns are left out.
    """
    weights, thresholds = model.weights, model.thresholds

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, fitted = Hashed(bits), Ordinal(weights, thresholds)
        for batch in sliced(batches):
            s = np.array([float(weights[at] @ value) for at, value in map(hashed, filled(batch.column(1)).to_pylist())])
            tails = fitted.tails(s)
            yield pa.record_batch({"id": batch.column(0), "score": pa.array(s), "expected_grade": pa.array(tails.sum(1)), "tails": pa.array(tails.tolist(), pa.list_(pa.float64())), "kept": pa.array(tails[:, -1] >= limit)})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, score double, expected_grade double, tails array<double>, kept boolean").withColumnRenamed("id", id_col)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 toxic, 1 poor, 2 good."""
    docs = documents(spark, sf_dir)
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    model, limit = fit_classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), grade)
    out = classify(docs, model, limit)
    return out.select("doc_id", "score", "expected_grade", F.get("tails", F.lit(0)).alias("p_not_toxic"), F.element_at("tails", -1).alias("p_good"), "kept")
