"""Matrices between photos from point matches: seeded random consensus, then a least-squares fit.

A pair's matches are one bounded array, so nothing is moved.  The draws are made
by md5 of seed, key and number: the same on every engine, whatever the partitions.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions.scalars import implausible
from quillsift.params import PARAMS

_FIT = "h:array<array<double>>,n_inliers:int,reproj_error:double,inliers:array<int>"
#: Rounds of the least-squares fit, each a linear solve.
ROUNDS = 5
#: Draws go on until a better matrix has been missed with this chance at most, up to so many draws for a pair.
MISSED, MOST_DRAWS = 1e-12, 1 << 14


def draws(key, n: int, count: int, seed: int, first: int = 0) -> np.ndarray:
    """(count, 4): four different numbers below n for each draw, from draw number ``first``."""
    raw = np.frombuffer(b"".join(hashlib.md5(f"{seed}:{key}:{i}".encode()).digest() for i in range(first, first + count)), ">u4").reshape(count, 4).astype(np.int64)
    out = np.empty((count, 4), np.int64)
    for k in range(4):
        x = raw[:, k] % (n - k)
        # the x-th of the numbers not yet taken
        for taken in np.sort(out[:, :k], axis=1).T:
            x += x >= taken
        out[:, k] = x
    return out


def project(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Points (n, 2) under matrices (..., 3, 3); points on the horizon are infinitely far."""
    q = p @ np.swapaxes(h[..., :2], -1, -2) + h[..., None, :, 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = q[..., :2] / q[..., 2:]
    return np.where(np.isfinite(out), out, np.inf)


def through_four(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrices that take four points a (draws, 4, 2) to b, which draws have one): no three points of either lie on a line."""
    ok = np.ones(len(a), bool)
    for p in (a, b):
        for i, j, k in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)):
            u, v = p[:, j] - p[:, i], p[:, k] - p[:, i]
            ok &= np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]) > 1e-9 * (1 + np.abs(u).sum(1) * np.abs(v).sum(1))
    return solved(a[ok], b[ok]), ok


def solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrices of four matches each, by a linear system with the last element 1."""
    x, y, u, v = (c[..., None] for c in (a[..., 0], a[..., 1], b[..., 0], b[..., 1]))
    one, zero = np.ones_like(x), np.zeros_like(x)
    rows = np.concatenate([np.concatenate([x, y, one, zero, zero, zero, -u * x, -u * y], -1), np.concatenate([zero, zero, zero, x, y, one, -v * x, -v * y], -1)], -2)
    k = np.linalg.solve(rows, np.concatenate([u, v], -2))[..., 0]
    return np.concatenate([k, np.ones_like(k[..., :1])], -1).reshape(*k.shape[:-1], 3, 3)


def refined(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix near ``h`` with the least sum of squared distances between projected a and b."""
    for _ in range(ROUNDS):
        q = np.column_stack([a, np.ones(len(a))]) @ h.T
        w = q[:, 2:]
        p = q[:, :2] / w
        m, z = np.column_stack([a, np.ones(len(a))]) / w, np.zeros((len(a), 3))
        slope = np.vstack([np.hstack([m, z, -p[:, :1] * m[:, :2]]), np.hstack([z, m, -p[:, 1:] * m[:, :2]])])
        step = np.linalg.lstsq(slope, np.concatenate([b[:, 0] - p[:, 0], b[:, 1] - p[:, 1]]), rcond=None)[0]
        h = h + np.append(step, 0.0).reshape(3, 3)
    return h


def missed(agree: int, n: int, count: int) -> float:
    """The chance that none of ``count`` draws lies wholly within one more than ``agree`` of n matches: that a larger consensus was missed."""
    more = max(4, min(agree + 1, n))
    return (1 - math.comb(more, 4) / math.comb(n, 4)) ** count


def fit(key, matches: np.ndarray, count: int, limit: float, seed: int) -> dict:
    """The matrix from the second to the first points of ``matches`` (x1, y1, x2, y2) that most of them agree with."""
    none = {"h": None, "n_inliers": 0, "reproj_error": None, "inliers": []}
    if len(matches) < 4:
        return none
    # centred and scaled, so that the systems are well conditioned
    first, second = matches[:, :2], matches[:, 2:]
    scale = [(p.mean(0), max(1e-12, np.abs(p - p.mean(0)).mean())) for p in (first, second)]
    b, a = ((p - m) / s for p, (m, s) in zip((first, second), scale))
    start, inside, done = None, np.zeros(len(matches), bool), 0
    while done < count or (done < MOST_DRAWS and missed(int(inside.sum()), len(matches), done) > MISSED):
        chosen = draws(key, len(matches), count, seed, done)
        done += count
        found, ok = through_four(a[chosen], b[chosen])
        if ok.any():
            agree = np.linalg.norm(project(found, a) - b, axis=2) * scale[0][1] <= limit
            best = int(agree.sum(1).argmax())  # the first of equal draws
            if start is None or agree[best].sum() > inside.sum():
                start, inside = found[best], agree[best]
    if start is None:
        return none
    h = refined(start, a[inside], b[inside])
    (mb, sb), (ma, sa) = scale
    h = np.array([[sb, 0, mb[0]], [0, sb, mb[1]], [0, 0, 1]]) @ h @ np.array([[1 / sa, 0, -ma[0] / sa], [0, 1 / sa, -ma[1] / sa], [0, 0, 1]])
    if not np.isfinite(h).all() or abs(h[2, 2]) < 1e-12:
        return none
    h = h / h[2, 2]
    error = np.linalg.norm(project(h, second[inside]) - first[inside], axis=1).mean()
    return {"h": h.tolist(), "n_inliers": int(inside.sum()), "reproj_error": float(error), "inliers": np.flatnonzero(inside).tolist()}


def consensus(df: DataFrame, key: str, matches: str, count: int = 512, limit: float = 4.0, least: int = 15, seed: int = 42) -> DataFrame:
    """``df`` with h, n_matches, n_inliers, inlier_ratio, reproj_error, inliers, reason for its matches, an array of (x1, y1, x2, y2).

    h takes the second photo's points to the first's; it is null wherever there is
    a reason against it.  Rounds of ``count`` draws of four matches each go on until
    a larger consensus is unlikely to have been missed (``MISSED``); matches within
    ``limit`` of their projection agree.  Matches with a null count as absent, a
    null array as no matches.
    """

    def run(keys: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for k, m in zip(keys, values):
            p = np.array([[x["x1"], x["y1"], x["x2"], x["y2"]] for x in m], float).reshape(-1, 4)
            out.append([fit(k, p, count, limit, seed)])
        return pd.Series(out, dtype=object)

    full = F.filter(F.coalesce(matches, F.array()), lambda m: m.isNotNull() & m["x1"].isNotNull() & m["y1"].isNotNull() & m["x2"].isNotNull() & m["y2"].isNotNull())
    d = df.withColumn("_m", full).withColumn("_f", F.get(F.pandas_udf(run, f"array<struct<{_FIT}>>")(F.col(key).cast("string"), "_m"), 0))
    n = F.size("_m")
    reason = (
        F.when(n < 4, "too few matches").when(F.col("_f.h").isNull(), "no matrix").when(F.col("_f.n_inliers") < least, "too few inliers").otherwise(implausible("_f.h", PARAMS))
    )
    d = d.withColumn("reason", reason)
    return d.select(
        *df.columns, F.when(F.col("reason").isNull(), F.col("_f.h")).alias("h"), n.alias("n_matches"), F.col("_f.n_inliers").alias("n_inliers"),
        (F.col("_f.n_inliers") / F.greatest(n, F.lit(1))).alias("inlier_ratio"), F.col("_f.reproj_error").alias("reproj_error"), F.col("_f.inliers").alias("inliers"), "reason",
    )


def valid_cells(h: Column, width, height, width2, height2) -> Column:
    """Cell numbers of the first frame that the second frame covers: those whose nearest cell under the inverse matrix lies in it.

    Null for a matrix without inverse; a null matrix gives null.
    """

    def run(hs: pd.Series, w: pd.Series, t: pd.Series, w2: pd.Series, t2: pd.Series) -> pd.Series:
        out = []
        for m, *frame in zip(hs, w, t, w2, t2):
            m = None if m is None else np.array([list(r) for r in m], float)
            if m is None or any(pd.isna(x) for x in frame) or not np.isfinite(m).all() or abs(np.linalg.det(m)) < 1e-12:
                out.append(None)
                continue
            a, b, a2, b2 = map(int, frame)
            y, x = np.divmod(np.arange(a * b), a)
            q = np.column_stack([x, y, np.ones(len(x))]) @ np.linalg.inv(m).T
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.rint(q[:, :2] / q[:, 2:])
            out.append(np.flatnonzero((p[:, 0] >= 0) & (p[:, 0] < a2) & (p[:, 1] >= 0) & (p[:, 1] < b2)).tolist())
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<int>")(h, width, height, width2, height2)


def valid_region(frame_cells: Column, mask_cells: Column, source: str = "frame_intersection") -> tuple[Column, Column]:
    """(cells where two photos may be compared, where that comes from).

    source: frame_intersection, mask or mask_and_frame; where there is no mask it
    falls back to the frame and says so.
    """
    if source not in ("frame_intersection", "mask", "mask_and_frame"):
        raise ValueError(f"unknown source {source!r}")
    if source == "frame_intersection":
        return frame_cells, F.lit(source)
    both = mask_cells if source == "mask" else F.array_sort(F.array_intersect(mask_cells, frame_cells))
    missing = mask_cells.isNull() | (F.size(mask_cells) == 0)
    return F.when(missing, frame_cells).otherwise(both), F.when(missing, "frame_intersection (no mask)").otherwise(source)
