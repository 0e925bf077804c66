"""Joins that the evaluation flows need, on equi-keys throughout."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first in ``order``, by a grouped minimum that combines before the shuffle.

    ``order`` names columns, or ("column", "desc") for numbers; rows equal in it
    are decided by the remaining columns.
    """
    flipped = [(-F.col(o[0])) if isinstance(o, tuple) else F.col(o) for o in order]
    names = [c for c in df.columns if c not in keys]
    row = F.struct(*(x.alias(f"_o{i}") for i, x in enumerate(flipped)), *names)
    return df.groupBy(*keys).agg(F.min(row).alias("_r")).select(*keys, *(F.col(f"_r.{n}").alias(n) for n in names))


def join_first(left: DataFrame, right: DataFrame, keys: list[str], order: list, how: str = "inner") -> DataFrame:
    """Join to the first matching row of ``right`` in ``order``."""
    return left.join(first_of(right, keys, order), keys, how)


def with_fallback(left: DataFrame, right: DataFrame, left_keys: tuple[str, str], right_keys: tuple[str, str], value: str, order: list) -> DataFrame:
    """``value`` of the row of ``right`` that matches on the first key, else on the second: two joins, not an OR."""
    one = first_of(right.select(F.col(right_keys[0]).alias("_k1"), value, *_names(order, value)), ["_k1"], order).select("_k1", F.col(value).alias("_v1"))
    two = first_of(right.select(F.col(right_keys[1]).alias("_k2"), value, *_names(order, value)), ["_k2"], order).select("_k2", F.col(value).alias("_v2"))
    d = left.join(one, left[left_keys[0]] == one["_k1"], "left").join(two, left[left_keys[1]] == two["_k2"], "left")
    return d.withColumn(value, F.coalesce("_v1", "_v2")).withColumn("resolved", F.col(value).isNotNull()).drop("_k1", "_k2", "_v1", "_v2")


def _names(order: list, value: str) -> list[str]:
    return [n for n in dict.fromkeys(o[0] if isinstance(o, tuple) else o for o in order) if n != value]


def exists_in(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys).distinct(), keys, "left_semi")


def not_in(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def shared_between(df: DataFrame, group: str, key: str) -> DataFrame:
    """(group_a, group_b, shared): keys that two groups share, with group_a < group_b.

    Groups per key are gathered as a set, whose size is bounded by the number of
    groups, so no pair of rows is made.
    """
    sets = df.select(group, key).distinct().groupBy(key).agg(F.sort_array(F.collect_set(group)).alias("g")).where(F.size("g") > 1)
    pair = F.flatten(F.transform("g", lambda x, i: F.transform(F.slice("g", i + 2, F.size("g")), lambda y: F.struct(x.alias("group_a"), y.alias("group_b")))))
    return sets.select(F.explode(pair).alias("p")).groupBy("p.group_a", "p.group_b").agg(F.count(F.lit(1)).alias("shared"))


def coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys of both, only of a, only of b, and the share of each side that the other covers."""
    left, right = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    d = left.join(right, key, "full_outer").agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"),
        F.count_if(F.col("_b").isNull()).alias("only_a"),
        F.count_if(F.col("_a").isNull()).alias("only_b"),
    )
    return d.select("*", F.expr("try_divide(100.0D * n_both, n_both + only_a)").alias("pct_of_a"), F.expr("try_divide(100.0D * n_both, n_both + only_b)").alias("pct_of_b"))


def ordered_pairs(df: DataFrame, keys: list[str], time: str, tie: str, values: list[str], piece: Column | None = None) -> DataFrame:
    """Each row with the one before it in its group: columns older_* and newer_*.

    ``piece`` cuts a group by time (a day, say), in order: rows are then paired
    within pieces, and the first row of a piece with the last one of the piece
    before, so that a hot key is spread over as many tasks as it has pieces.
    """
    cols = [time, tie, *values]
    d = df.select(*keys, *cols, (F.lit(0) if piece is None else piece).alias("_piece"))
    w = W.partitionBy(*keys, "_piece").orderBy(time, tie)
    row = F.struct(*cols)
    d = d.withColumn("_older", F.lag(row).over(w))
    if piece is not None:
        last = d.groupBy(*keys, "_piece").agg(F.max(row).alias("_last"))
        last = last.withColumn("_last", F.lag("_last").over(W.partitionBy(*keys).orderBy("_piece")))
        last = last.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_piece").alias("_pk"), "_last")
        same = F.col("_piece") == F.col("_pk")
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        d = d.join(last, same, "left").withColumn("_older", F.coalesce("_older", "_last"))
    return d.where(F.col("_older").isNotNull()).select(*keys, *(F.col(x).alias(f"newer_{x}") for x in cols), *(F.col(f"_older.{x}").alias(f"older_{x}") for x in cols))


def nearest_within(pairs: DataFrame, left: str, right: str, distance: str, limit: int) -> DataFrame:
    """Nearest right row of each left row among given pairs, up to a distance; ties take the least right key."""
    near = pairs.where(F.col(distance) <= limit)
    return near.groupBy(left).agg(F.min(F.struct(distance, right)).alias("_m")).select(left, F.col(f"_m.{right}").alias(right), F.col(f"_m.{distance}").alias(distance))


def verified(candidates: DataFrame, measures: DataFrame, keys: list[str], check: Column) -> DataFrame:
    """Candidate pairs with ``confirmed``: the check on their measures; pairs that were not measured are not confirmed."""
    return candidates.join(measures, keys, "left").withColumn("confirmed", F.coalesce(check, F.lit(False)))


def restricted_matches(files: DataFrame, near: DataFrame, names: list[str], path: str = "path") -> DataFrame:
    """(path, dataset, distance, why): files whose path names a restricted data set, case aside, and files near one of its members.

    near: path, dataset, distance of the nearest member within the limit; a file
    has a row for each data set and each reason.
    """
    hit = F.filter(F.array(*map(F.lit, names)), lambda x: F.contains(F.lower("path"), x)) if names else F.array().cast("array<string>")
    named = files.select(F.col(path).alias("path")).select("path", F.explode(hit).alias("dataset")).select("*", F.lit(0).alias("distance"), F.lit("named").alias("why"))
    return named.unionByName(near.select(F.col(path).alias("path"), "dataset", F.col("distance").cast("int").alias("distance"), F.lit("alike").alias("why")))


def nearest_two(queries: DataFrame, rows: DataFrame, query: str, key: str, vector: str) -> DataFrame:
    """(query, key, distance): at least the two nearest rows of each query by squared Euclidean distance, never itself.

    Exact: blocks of queries meet parts of all rows, and each such group gives its
    two nearest; ties take the least key.  Within a group a matrix product shows
    which rows can be among them, and only these are measured, one coordinate
    after the other.  Coordinates that are null or missing on a side are left out,
    rows without a common one have no distance.
    """
    n, m = rows.count(), queries.count()
    parts, blocks = max(16, -(-n // 16384)), max(1, -(-m // 4096))
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    deal = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k).cast("long"))
    whole = F.col(vector).cast("array<double>")
    values = [F.transform(whole, lambda x: F.coalesce(x, F.lit(0.0))).alias("v"), F.when(F.exists(whole, lambda x: x.isNull()), F.transform(whole, lambda x: x.isNotNull())).alias("there")]
    q = queries.select(F.lit(True).alias("asks"), F.col(query).cast("long").alias("k"), *values, deal(query, blocks).alias("block"), each(parts).alias("part"))
    r = rows.select(F.lit(False).alias("asks"), F.col(key).cast("long").alias("k"), *values, deal(key, parts).alias("part"), each(blocks).alias("block"))
    d = q.unionByName(r).where("k IS NOT NULL AND v IS NOT NULL").repartition(min(parts * blocks, 4000), "block", "part")

    def run(x: pd.DataFrame) -> pd.DataFrame:
        asks, width = x["asks"].to_numpy(bool), max(map(len, x["v"]))
        keys = x["k"].to_numpy(np.int64)
        v, there = _padded(x["v"], x["there"], width)
        found = list(_two_of_each(keys[asks], v[asks], there[asks], keys[~asks], v[~asks], there[~asks]))
        kinds = {query: np.int64, key: np.int64, "distance": float}
        return pd.DataFrame({c: np.concatenate([f[i] for f in found]) if found else np.array([], kind) for i, (c, kind) in enumerate(kinds.items())})

    d = d.groupBy("block", "part").applyInPandas(run, f"`{query}` long, `{key}` long, distance double")
    return d.withColumn("distance", F.coalesce("distance", F.lit(float("nan"))))  # NaN comes back as null, which would sort first


def _padded(vectors: pd.Series, marks: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, which are there), a row for each vector; ``marks`` has what is there where not all is."""
    v, there = np.zeros((len(vectors), width)), np.zeros((len(vectors), width), bool)
    for i, (x, m) in enumerate(zip(vectors, marks)):
        v[i, : len(x)] = x
        there[i, : len(x)] = True if m is None else m
    return v, there


def _two_of_each(a, x, x_there, b, y, y_there):
    """Arrays (a, b, distance) of the two nearest rows (key b, numbers y) of each query (key a, numbers x), for some queries at a time."""
    if not len(a) or not len(b):
        return
    plain = lambda v, there: there.all(1) & (np.abs(v) < 1e100).all(1)
    px, py = plain(x, x_there), plain(y, y_there)
    xs, ys = np.where(px[:, None], x, 0.0), np.where(py[:, None], y, 0.0)
    x2, y2 = (xs * xs).sum(1), (ys * ys).sum(1)
    step = max(1, (1 << 21) // len(b))
    for s in range(0, len(a), step):
        e = slice(s, s + step)
        own = a[e, None] == b
        rough = x2[e, None] + y2 - 2 * (xs[e] @ ys.T)
        rough[own | ~py] = np.inf
        # the product's error is far below the margin
        near = np.partition(rough, 1, axis=1)[:, 1] + 1e-11 * (x2[e] + y2.max()) if len(b) > 1 else np.full(len(rough), np.inf)
        i, j = np.nonzero(((rough <= near[:, None]) | ~py | ~px[e, None]) & ~own)
        i += s
        d, some = np.zeros(len(i)), np.zeros(len(i), bool)
        for t in range(0, len(i), 1 << 15):
            p, q = i[t : t + (1 << 15)], j[t : t + (1 << 15)]
            for k in range(x.shape[1]):
                both = x_there[p, k] & y_there[q, k]
                gap = x[p, k] - y[q, k]
                with np.errstate(over="ignore"):
                    d[t : t + len(p)] += np.where(both, gap * gap, 0.0)
                some[t : t + len(p)] |= both
        i, j, d = i[some], j[some], d[some]
        order = np.lexsort((b[j], d, i))
        i, j, d = i[order], j[order], d[order]
        third = np.r_[False, False, i[2:] == i[:-2]][: len(i)]
        yield a[i][~third], b[j][~third], d[~third]


def ratio_test(pairs: DataFrame, left: str, right: str, distance: str, ratio: float) -> DataFrame:
    """Left rows whose nearest pair is closer than ``ratio`` times the second nearest (strictly); fewer than two drop out."""
    w = W.partitionBy(left).orderBy(distance, right)
    ranked = pairs.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    d = ranked.groupBy(left).agg(
        F.max(F.when(F.col("_r") == 1, F.col(right))).alias(right),
        F.max(F.when(F.col("_r") == 1, F.col(distance))).alias("d1"),
        F.max(F.when(F.col("_r") == 2, F.col(distance))).alias("d2"),
    )
    return d.where(F.col("d2").isNotNull() & (F.col("d1") < F.lit(ratio) * F.col("d2")))


def with_default(left: DataFrame, right: DataFrame, keys: list[str], value: str, default) -> DataFrame:
    """Left join with a default for what is missing; ``right`` must have one row a key."""
    return left.join(right.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def flagged(condition: Column) -> Column:
    """A condition as 0 or 1, null as null."""
    return condition.cast("int")
