"""Probes for shortcuts: can a label be told from what it should not depend on?

A decision tree over few binned features and a linear classifier over vectors.
Rows are only ever summed: each level of the tree, and each step of the linear
fit, is one grouped aggregate whose result has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillsift.operators.components import written


class Trees:
    """Trees of one depth, one for each fold (learned without it) and a last one for all rows.

    splits: (model, node) -> (feature, threshold); nodes are paths of L and R.
    """

    def __init__(self, features: list[str], models: int):
        self.features, self.models, self.splits = features, models, {}
        self.leaves: dict[tuple[int, str], int] = {}

    def node(self, depth: int):
        """The node of a row after ``depth`` levels, an expression over model and the features."""
        path = F.lit("")
        for d in range(depth):
            now, here = F.lit(""), path
            for (model, node), (feature, threshold) in self.splits.items():
                if len(node) == d:
                    side = F.when(F.col(self.features[feature]) <= threshold, "L").otherwise("R")
                    now = F.when((F.col("model") == model) & (here == node), side).otherwise(now)
            # named by a lambda over one element, so that each level is computed once
            path = F.concat(here, now)
        return path

    def rules(self, model: int, node: str = "", indent: str = "") -> list[str]:
        """The model's rule, a line for each branch."""
        if (model, node) not in self.splits:
            return [f"{indent}|--- class: {self.leaves[model, node]}"]
        feature, threshold = self.splits[model, node]
        name, out = self.features[feature], []
        for side, sign in (("L", "<="), ("R", "> ")):
            out += [f"{indent}|--- {name} {sign} {threshold:.2f}", *self.rules(model, node + side, indent + "|   ")]
        return out


def grown_trees(df: DataFrame, features: list[str], label: str, fold: str, folds: int, depth: int = 3) -> tuple[Trees, DataFrame]:
    """(trees, cells): trees over numeric features with few values, label 0 or 1, and the rows counted by features, label and fold.

    A node is split where the children are purest (least Gini impurity), at the
    middle between two values; ties go to the first feature, then the least
    threshold; pure nodes and nodes without two values are leaves.  Rows with a
    null in any of these columns are left out.  Values per feature should be few
    (bins): those of a node are ranked together.
    """
    d = df.dropna(subset=[*features, label, fold]).select(*(F.col(f).cast("double").alias(f) for f in features), F.col(label).cast("int").alias("y"), F.col(fold).cast("int").alias("fold"))
    cells = written(d.groupBy(*features, "y", "fold").agg(F.count(F.lit(1)).alias("n")), "cells")
    trees = Trees(features, folds + 1)
    train = cells.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(folds)))).where("fold != model")
    values = F.array(*(F.struct(F.lit(i).alias("feature"), F.col(f).alias("value")) for i, f in enumerate(features)))
    for level in range(depth):
        at = train.withColumn("node", trees.node(level)).where(F.length("node") == level)
        g = at.select("model", "node", "n", "y", F.explode(values).alias("v")).groupBy("model", "node", "v.feature", "v.value").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("p"))
        whole, upto = W.partitionBy("model", "node", "feature"), W.partitionBy("model", "node", "feature").orderBy("value")
        g = g.select("model", "node", "feature", ((F.col("value") + F.lead("value").over(upto)) / 2).alias("threshold"), F.sum("n").over(upto).alias("nl"), F.sum("p").over(upto).alias("pl"), F.sum("n").over(whole).alias("nt"), F.sum("p").over(whole).alias("pt"))
        g = g.where("threshold IS NOT NULL AND pt > 0 AND pt < nt").withColumn("nr", F.col("nt") - F.col("nl")).withColumn("pr", F.col("pt") - F.col("pl"))
        pure = lambda n, p: (F.col(p) * F.col(p) + (F.col(n) - F.col(p)) * (F.col(n) - F.col(p))).cast("double") / F.col(n).cast("double")
        best = g.groupBy("model", "node").agg(F.min(F.struct((-(pure("nl", "pl") + pure("nr", "pr"))).alias("s"), "feature", "threshold")).alias("b"))
        found = best.collect()  # at most (folds + 1) * 2 ** level rows
        for r in found:
            trees.splits[r.model, r.node] = (r.b.feature, r.b.threshold)
        if not found:
            break
    ends = train.withColumn("node", trees.node(depth)).groupBy("model", "node").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("p"))
    trees.leaves = {(r.model, r.node): int(2 * r.p > r.n) for r in ends.collect()}  # at most (folds + 1) * 2 ** depth rows
    return trees, cells


def pooled(trees: Trees, cells: DataFrame, depth: int = 3) -> DataFrame:
    """(y, predicted, n): counts over all rows, each predicted by the tree that has not seen its fold."""
    leaf = F.create_map(*(F.lit(x) for (model, node), y in trees.leaves.items() for x in (f"{model}:{node}", y))) if trees.leaves else F.create_map()
    d = cells.withColumn("model", F.col("fold")).withColumn("predicted", F.try_element_at(leaf, F.concat_ws(":", F.col("model").cast("string"), trees.node(depth))))
    return d.groupBy("y", "predicted").agg(F.sum("n").alias("n"))


def _sums(rows: DataFrame, run, size: int) -> np.ndarray:
    """The sum over all rows of a vector of ``size`` numbers; ``run`` adds up a batch.  Each task sends one vector's entries, which are summed before they reach the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                x = np.stack([np.asarray(v, float) for v in b.column(0).to_numpy(zero_copy_only=False)])
                total += run(np.column_stack([x, np.ones(len(x))]), b.column(1).to_numpy()).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "v"])

    out = np.zeros(size)
    for r in rows.mapInArrow(task, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r.i] = r.v
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def linear_weights(df: DataFrame, vector: str, label: str, classes: int, size: int, l2: float = 1.0, steps: int = 60, tolerance: float = 1e-4) -> np.ndarray:
    """(classes, size + 1) weights and intercepts of a multi-class logistic regression over all rows of ``df``.

    Steps go by a fixed bound of the curvature (half the sum of outer products),
    so they never overshoot, and stop when no weight moves by ``tolerance``.  Rows
    whose vector has another size or a null, or whose label is null, are left out.
    Only sums reach the driver: (size + 1) squared numbers once, then classes *
    (size + 1) a step.
    """
    d = df.where((F.size(vector) == size) & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v)) & F.col(label).between(0, classes - 1)).select(F.col(vector).alias("x"), F.col(label).cast("int").alias("y")).persist()
    n = size + 1
    outer = _sums(d, lambda x, y: x.T @ x, n * n).reshape(n, n)
    penalty = l2 * np.eye(n)
    penalty[size, size] = 1e-9  # the intercept is free
    inverse = np.linalg.inv(outer / 2 + penalty)
    w = np.zeros((classes, n))
    for _ in range(steps):
        slope = _sums(d, lambda x, y: (softmax(x @ w.T) - np.eye(classes)[y]).T @ x, classes * n).reshape(classes, n) + w @ penalty  # noqa: B023
        step = slope @ inverse
        w = w - step
        if np.abs(step).max() < tolerance:
            break
    d.unpersist()
    return w


def linear_predictions(df: DataFrame, vector: str, w: np.ndarray) -> DataFrame:
    """``df`` with ``predicted``, the class of the largest score (ties: the first); null for vectors of another size."""
    classes, n = w.shape
    rows = F.array(*(F.array(*map(F.lit, map(float, r))) for r in w))
    scores = F.transform(rows, lambda r: F.aggregate(F.zip_with(F.slice(r, 1, n - 1), F.col(vector).cast("array<double>"), lambda a, b: a * b), F.element_at(r, n), lambda s, v: s + v))
    return df.withColumn("predicted", F.when(F.size(vector) == n - 1, F.array_position(scores, F.array_max(scores)) - 1).cast("int"))
