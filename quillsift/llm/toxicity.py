"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

Features are the distinct character n-grams of a text (lower case, hashed), each
scaled by the log ratio of its share in toxic and in other training texts; a
logistic regression with L2 weights them.  Scores use the text only.  The threshold
is set on texts that the fit has not seen (two halves, each scored by the other's fit).

Training fits on at most ``TRAIN_ROWS`` labelled texts of each class, taken by a
hash of the id; what of them reaches the driver has a bound for texts of bounded
length.  All n-grams in MIN_TEXTS of those texts or more are features; there are
2 ** BITS hashes of n-grams, so the model has a fixed size (4 MB) whatever the corpus
and goes to the executors by broadcast.  Scoring is one scan.

Edge cases: a null text counts as empty and gets the score of a text without
n-grams; very long texts count with all their n-grams, in training and in scores;
n-grams of one hash are one feature; ties of the sample go by the id; columns of the
table with clashing names stay as they are, inside the row; rows whose labels are null are not learned from; without labels of both
classes every score is the share of toxic labels (0.5 if there are none);
repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsift.llm.common import crc32_mod, release, table, whole_text, written

#: Labelled texts of each class that are fitted at most (the documented bound of the sample).
TRAIN_ROWS = 1000
SIZES = (3, 4, 5, 6)
BITS = 20
#: Steps at most, the share of the first slope that ends them, and the moves that a step remembers.
STEPS, TOLERANCE, MOVES = 200, 1e-3, 8
#: Entries of the training texts that are worked on at once.
PIECE = 1_000_000
#: Least training texts that hold a feature; smoothing of counts; L2 strength.
MIN_TEXTS, SMOOTH, L2 = 3, 0.5, 100.0
#: Weight of recall against precision in the choice of the threshold.
BETA = 0.5
FOLDS = 5


def ngrams(text: str) -> np.ndarray:
    """Hashed character n-grams of the lower-cased text, with repeats."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = []
    h = c * np.uint64(0x9E3779B97F4A7C15)
    for n in range(2, max(SIZES) + 1):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] ^ (h[: len(c) - n + 1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c[n - 1 :]
        if n in SIZES:
            out.append(((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.empty(0, np.int32)


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(toxic, grams) of at most ``rows`` training texts of each class, the first by a hash of the id."""
    ids = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc32_mod("doc_id", FOLDS) != 0))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    some = ids.where("toxic = 1").orderBy(order, "doc_id").limit(rows).unionByName(ids.where("toxic = 0").orderBy(order, "doc_id").limit(rows))
    chosen = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(some), "doc_id")  # 2 * rows ids at most
    # a repeated id counts once
    one = chosen.groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("x")).select(F.col("x.toxic").alias("toxic"), F.col("x.text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [np.unique(ngrams(t.as_py())).astype("<i4").tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grams, pa.binary())], ["toxic", "grams"])

    return one.mapInArrow(run, "toxic int, grams binary")


def pick(p: np.ndarray, n: np.ndarray, n_pos: int, n_neg: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams that are features, their log-count ratios) from the texts of each class that hold them."""
    keep = np.flatnonzero(p + n >= MIN_TEXTS)
    return keep, np.log((p[keep] + SMOOTH) / (n_pos + 2 * SMOOTH)) - np.log((n[keep] + SMOOTH) / (n_neg + 2 * SMOOTH))


class Fit:
    """Logistic regression with classes of equal weight over texts with 0/1 features, each scaled by its ratio."""

    def __init__(self, y: np.ndarray, features: list[np.ndarray], ratio: np.ndarray):
        self.y, self.ratio = y, ratio
        n_pos, n_neg = y.sum(), len(y) - y.sum()
        self.weight = np.where(y == 1, 0.5 / max(1, n_pos), 0.5 / max(1, n_neg)) * len(y)
        # texts in pieces, so that only the numbers of their features are held for all of them
        self.pieces, held, size = [], [], 0
        for k, f in enumerate(features):
            held.append(k)
            size += len(f)
            if size >= PIECE or k + 1 == len(features):
                lengths = np.array([len(features[i]) for i in held])
                self.pieces.append((held[0], held[-1] + 1, np.concatenate([features[i] for i in held]), np.repeat(np.arange(len(held)), lengths).astype(np.int32)))
                held, size = [], 0

    def value(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """The loss with its penalty at (weights, intercept), and its slope."""
        d = len(self.ratio)
        u, slope, total = self.ratio * x[:d], np.zeros(d), 0.0
        loss = 0.5 * L2 * (x[:d] @ x[:d])
        for a, b, at, row in self.pieces:
            z = np.bincount(row, u[at], b - a) + x[d]
            w, y = self.weight[a:b], self.y[a:b]
            loss += (w * (np.logaddexp(0, z) - y * z)).sum()
            g = w * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            slope += np.bincount(at, g[row], d)
            total += g.sum()
        return loss, np.append(self.ratio * slope + L2 * x[:d], total)

    def solve(self) -> tuple[np.ndarray, float]:
        """(weight of each feature, intercept), by limited-memory quasi-Newton steps until the slope is TOLERANCE of the first one."""
        x = np.zeros(len(self.ratio) + 1)
        loss, slope = self.value(x)
        first, moves = np.linalg.norm(slope), []
        for _ in range(STEPS):
            if np.linalg.norm(slope) <= TOLERANCE * first:
                break
            step, shares = slope.copy(), []
            for s, t in reversed(moves):
                shares.append((s @ step) / (s @ t))
                step -= shares[-1] * t
            step *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / first
            for (s, t), c in zip(moves, reversed(shares)):
                step += s * (c - (t @ step) / (s @ t))
            size = 1.0
            while True:
                new, after = self.value(x - size * step)
                if new <= loss - 1e-4 * size * (slope @ step) or size < 1e-8:
                    break
                size /= 2
            s, t = -size * step, after - slope
            if s @ t > 0:
                moves = [*moves[1 - MOVES :], (s, t)]
            x, loss, slope = x + s, new, after
        return x[:-1] * self.ratio, float(x[-1])


def threshold(y: np.ndarray, features: list[np.ndarray], ratio: np.ndarray) -> float:
    """The logit that tells the classes best on texts that the fit has not seen: each half is scored by the other's.

    Best is the largest F measure of BETA: below 1, clean texts that are left alone count more than toxic ones that are found.
    """
    z = np.zeros(len(y))
    for half in (0, 1):
        seen, rest = np.flatnonzero(np.arange(len(y)) % 2 != half), np.flatnonzero(np.arange(len(y)) % 2 == half)
        if not len(seen) or y[seen].min() == y[seen].max():
            return 0.0
        w, bias = Fit(y[seen], [features[i] for i in seen], ratio).solve()
        z[rest] = [w[features[i]].sum() + bias for i in rest]
    order = np.argsort(-z, kind="stable")
    f = (1 + BETA**2) * np.cumsum(y[order]) / (np.arange(1, len(y) + 1) + BETA**2 * y.sum())
    k = int(f.argmax())
    return float(z[order[k]] + z[order[min(k + 1, len(y) - 1)]]) / 2


def regress(y: np.ndarray, features: list[np.ndarray], ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """(weight of each feature, intercept), with the intercept moved so that the best threshold is 1/2."""
    middle = threshold(y, features, ratio)
    w, bias = Fit(y, features, ratio).solve()
    return w, bias - middle


def counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Texts of each class per hashed n-gram, and of each class, over a sample of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts = np.zeros((2, 1 << BITS), np.int32), [0, 0]
        for b in batches:
            for label, grams in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[label][np.frombuffer(grams, "<i4")] += 1  # a text's n-grams are distinct
                texts[label] += 1
        if any(texts):
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(seen.tobytes(), 1)], pa.binary()), pa.array([texts], pa.list_(pa.int64()))], ["seen", "texts"])

    total, texts = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
    for r in rows.mapInArrow(run, "seen binary, texts array<long>").toLocalIterator():
        total += np.frombuffer(zlib.decompress(bytes(r.seen)), np.int32).reshape(2, -1)
        texts += r.texts
    return total[1], total[0], int(texts[1]), int(texts[0])


def kept_features(rows: DataFrame, keep: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(labels, the places in ``keep`` of each text's n-grams, rising)."""
    shared = rows.sparkSession.sparkContext.broadcast(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[shared.value] = np.arange(len(shared.value), dtype=np.int32)
        for b in batches:
            out = [place[np.frombuffer(g, "<i4")] for g in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zlib.compress(np.diff(np.sort(o[o >= 0]), prepend=np.int32(0)).astype("<i4").tobytes(), 1) for o in out], pa.binary())], ["toxic", "at"])

    # in an order that does not depend on how tasks finish
    got = sorted((r.toxic, bytes(r["at"])) for r in rows.mapInArrow(run, "toxic int, at binary").toLocalIterator())
    return np.array([x for x, _ in got], np.float64), [np.cumsum(np.frombuffer(zlib.decompress(x), "<i4"), dtype=np.int32) for _, x in got]


def score_text(text: str, w: np.ndarray, last: np.ndarray, bias: float) -> float:
    """The score of a text; last: any numbers, one for each hash, which are written over."""
    g = ngrams(text)
    # each distinct n-gram counts once: where it comes last
    place = np.arange(len(g), dtype=np.int32)
    last[g] = place
    return float(1 / (1 + np.exp(-np.clip(w[g[last[g] == place]].sum(dtype=np.float64) + bias, -50, 50))))


def score_rows(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """(row, score) for each row of ``docs``; row is a struct of all its columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    rows = docs.select(F.struct(*docs.columns).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        last = np.empty(len(w), np.int32)
        for b in batches:
            texts = b.column(0).field(at)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score_text(t.as_py() or "", w, last, bias) for t in texts], pa.float64())], ["row", "score"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """(weight of each hashed n-gram, intercept); the driver holds counts per n-gram and the kept n-grams of 2 * rows texts."""
    some = written(sample(docs, labels, rows), "sample")
    w = np.zeros(1 << BITS, np.float32)
    p, n, n_pos, n_neg = counts(some)
    if not n_pos or not n_neg:
        share = float(np.clip(n_pos / (n_pos + n_neg), 0.01, 0.99)) if n_pos + n_neg else 0.5
        return w, float(np.log(share / (1 - share)))
    keep, ratio = pick(p, n, n_pos, n_neg)
    if not len(keep):
        return w, 0.0
    w[keep], bias = regress(*kept_features(some, keep), ratio)
    del p, n
    release()
    return w, bias


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_rows(docs.select("doc_id", "text"), model).select("row.doc_id", "score").select(
        "doc_id", (crc32_mod("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
