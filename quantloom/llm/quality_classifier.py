"""A naive Bayes support-vector classifier of text quality (Wang and Manning 2012).

The features of a text are the set of its hashed words and word pairs, the punctuation runs that end its
words, and runs of one word by their length in powers of two. The count ratio of each feature
between the classes gives r = log((p / |p|) / (q / |q|)); indicators are scaled by r and a linear
hinge-loss model is fitted by dual coordinate descent (Hsieh et al. 2008, the squared hinge). A
logistic curve over rows that the model did not see turns margins into scores.

The fit uses a bounded sample of labelled rows, the least by hash of doc_id: FIT_ROWS of them, and no more than
have FIT_FEATURES features together, which bounds the driver's memory whatever the corpus and the lengths of
its texts. A row that takes part does so with its whole text. Only the texts of the sample reach Python in the
first scan. The scan that scores all rows has no exchange; the weights have 2^DIM_BITS numbers."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, map_arrow

DIM_BITS = 18
#: Labelled rows that the fit uses at most, and features of all these rows together (16 bytes each in the fit).
FIT_ROWS, FIT_FEATURES = 8_000, 30_000_000
#: Every CALIBRATE-th row of the fit is kept from the model and used for the logistic curve.
CALIBRATE = 5
SMOOTHING, COST, ROUNDS = 1.0, 1.0, 12
THRESHOLD, FOLDS = 0.3, 5


#: Characters that close a word; their run is a character n-gram.
_CLOSING = bytes(b for b in range(33, 127) if not chr(b).isalnum())


class Features:
    """The sorted distinct features of texts."""

    def __init__(self, dim_bits: int = DIM_BITS):
        self.shift = np.uint64(64 - dim_bits)
        self.known: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        if len(self.known) > 500_000:
            self.known.clear()
        h = self.known[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        get = self.known.get
        h = np.fromiter((get(w) or self._hash(w) for w in words), np.uint64, len(words))
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xD6E8FEB86659FD93)
        endings = [b"\0" + x for x in {w[len(w.rstrip(_CLOSING)) :] for w in set(words)} if x]
        # a word 2, 4, 8, ... times in a row is an n-gram of its own, whatever the word
        breaks = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True]))) if len(h) else np.zeros(1, np.int64)
        longest = int(np.diff(breaks).max(initial=1))
        runs = [b"\0\0%d" % (1 << k) for k in range(1, longest.bit_length())]
        more = np.array([get(x) or self._hash(x) for x in endings + runs], np.uint64)
        return np.unique(np.concatenate((h, pairs, more)) >> self.shift).astype(np.int64)


def log_ratios(rows: list[np.ndarray], labels: np.ndarray, dim: int, smoothing: float = SMOOTHING) -> np.ndarray:
    p, q = (smoothing + np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y == side] or [np.zeros(0, np.int64)]), minlength=dim) for side in (1, 0))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = COST, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Weights of the squared-hinge model over rows scaled to length 1, by dual coordinate descent."""
    values = []
    for r in rows:
        x = ratios[r]
        values.append(x / max(np.sqrt(x @ x), 1e-12))
    y = np.where(labels == 1, 1.0, -1.0)
    weights, alpha = np.zeros(len(ratios)), np.zeros(len(rows))
    # both classes weigh the same
    costs = cost * len(y) / (2.0 * np.where(y > 0, max((y > 0).sum(), 1), max((y < 0).sum(), 1)))
    draw = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in draw.permutation(len(rows)):
            x, at = values[i], rows[i]
            slope = y[i] * (weights[at] @ x) - 1 + alpha[i] / (2 * costs[i])
            new = max(alpha[i] - slope / (x @ x + 1 / (2 * costs[i])), 0.0) if len(at) else 0.0
            if new != alpha[i]:
                weights[at] += (new - alpha[i]) * y[i] * x
                alpha[i] = new
    return weights


def logistic(margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a margin + b))), by Newton steps with a small ridge."""
    x, t = np.stack((margins, np.ones_like(margins)), 1), np.zeros(2)
    n1, n0 = labels.sum(), (1 - labels).sum()
    y = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(steps):
        s = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        grad, hess = x.T @ (s - y) + 1e-3 * t, (x * (s * (1 - s))[:, None]).T @ x + 1e-3 * np.eye(2)
        t = t - np.linalg.solve(hess, grad)
    return float(t[0]), float(t[1])


class Model:
    """Weights in the order of features, and the logistic curve."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, dim_bits: int = DIM_BITS):
        dim = 1 << dim_bits
        self.weights, self.ratios, self.curve = np.zeros(dim), np.zeros(dim), (0.0, 0.0)
        if not len(rows):
            return
        held = np.arange(len(rows)) % CALIBRATE == 0 if len(rows) >= 10 * CALIBRATE else np.zeros(len(rows), bool)
        fit = [r for r, h in zip(rows, held, strict=True) if not h]
        self.ratios = log_ratios(fit, labels[~held], dim)
        self.weights = descend(fit, labels[~held], self.ratios)
        seen = held if held.any() else ~held
        self.curve = logistic(np.array([self.margin(r) for r, s in zip(rows, seen, strict=True) if s]), labels[seen])

    def margin(self, features: np.ndarray) -> float:
        x = self.ratios[features]
        return float(self.weights[features] @ x / max(np.sqrt(x @ x), 1e-12))

    def score(self, features: np.ndarray) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a * self.margin(features) + b, -30, 30))))


def fold_of(doc_id: str) -> Column:
    """crc32 of the doc_id's digits, modulo FOLDS."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, dim_bits: int = DIM_BITS, fit_features: int = FIT_FEATURES) -> Model:
    """The model of labels(doc_id, quality) outside fold 0; only the text of docs is an input.

    The sample's ids (fit_rows at most) are broadcast to the scan. Its rows are written with their features
    and taken in the order of the ids' hashes while their features add up to fit_features at most; those come
    to the driver. Of rows that repeat a doc_id the one with the least features as bytes counts."""
    chosen = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where((fold_of("doc_id") != 0) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("y"))
    taken = cut_lineage(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(taken), "doc_id")

    def extract(batches):
        features = Features(dim_bits)
        for batch in batches:
            found = [features.of(t).astype("<i4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], names=["doc_id", "y", "features"])

    found = cut_lineage(map_arrow(rows.select("doc_id", "text", "y"), extract, "doc_id long, y int, features binary").groupBy("doc_id", "y").agg(F.min("features").alias("features")))
    # at most fit_rows rows, so one window over them all is small
    total = F.sum(F.length("features") / 4).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    got = sorted(found.withColumn("total", total).where(F.col("total") <= fit_features).drop("total").toLocalIterator(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    return Model([np.frombuffer(r.features, "<i4") for r in got], np.array([r.y for r in got], np.int64), dim_bits)


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, dim_bits: int = DIM_BITS) -> DataFrame:
    """A score for each row of documents(doc_id, text, ...).

    Returns doc_id, held_out (crc32 of the doc_id's digits modulo 5 is 0; false for null), score (0
    to 1, higher: label 1 likelier) and predicted (1 if score >= 0.3). Null and empty texts have no
    features; their score is the curve at margin 0. Labels that are no 0 or 1 are ignored; of
    repeated labels of a doc_id the greatest counts; without labels every score is 0.5. Rows that repeat a doc_id each
    get a row; of those one is used in the fit. Other columns are ignored."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows, dim_bits))

    def score(batches):
        features, m = Features(dim_bits), model.value
        for batch in batches:
            scores = [m.score(features.of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), score, "doc_id long, score double")
    held = F.coalesce(fold_of("doc_id") == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
