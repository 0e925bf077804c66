"""Deduplication, capping, sampling and leakage-free splitting of groups.

Random choice is by md5 of a seed and the key: the same on every engine and
cluster, whatever the partitioning.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def draw(key, seed: int = 42) -> Column:
    """Order of a seeded draw: md5 of "seed:key"."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def duplicate_groups(df: DataFrame, digest: str, key: str) -> DataFrame:
    """Digests that occur more than once: rows, redundant rows, first key."""
    g = df.groupBy(digest).agg(F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("first_key"))
    return g.where("n_rows > 1").withColumn("n_redundant", F.col("n_rows") - 1)


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order; rows with a null key stay out.

    A grouped minimum: each task keeps one row a key before anything is shuffled.
    """
    rest = [c for c in df.columns if c not in order and c != key]
    d = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return d.select(key, *(F.col(f"_r.{c}").alias(c) for c in df.columns if c != key))


def cap_per_group(df: DataFrame, group: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """At most k rows of each group, by seeded draw.

    Rows are first cut to k within salts of a group, so a hot group is ranked in
    many tasks and only k rows of each salt meet.
    """
    d = df.withColumn("_d", draw(key, seed)).withColumn("_s", F.pmod(F.xxhash64(key), F.lit(64)))
    inner = W.partitionBy(group, "_s").orderBy("_d", key)
    d = d.withColumn("_r", F.row_number().over(inner)).where(F.col("_r") <= k)
    outer = W.partitionBy(group).orderBy("_d", key)
    return d.withColumn("_r", F.row_number().over(outer)).where(F.col("_r") <= k).drop("_d", "_s", "_r")


def rebalance(df: DataFrame, label: str, family: str, key: str, cap: int, seed: int = 42) -> DataFrame:
    """Whole families in drawn order until a class has ``cap`` rows; the last family is cut.

    Families are counted and placed first (a running sum over families, not rows);
    only a family's own rows are then ranked.
    """
    sizes = df.groupBy(label, family).agg(F.count(F.lit(1)).alias("_n")).withColumn("_d", draw(family, seed))
    before = F.sum("_n").over(W.partitionBy(label).orderBy("_d", family).rowsBetween(W.unboundedPreceding, -1))
    room = sizes.withColumn("_room", F.lit(cap) - F.coalesce(before, F.lit(0))).where("_room > 0").select(label, family, "_n", "_room")
    d = df.join(room, [label, family])
    # a family is cut to ``cap`` rows within salts first, so that a hot one is ranked in many tasks
    d = d.withColumn("_s", F.pmod(F.xxhash64(key), F.lit(64)))
    for parts in ((label, family, "_s"), (label, family)):
        d = d.withColumn("_r", F.row_number().over(W.partitionBy(*parts).orderBy(key))).where("_r <= _room")
    return d.drop("_n", "_room", "_r", "_s")


def round_robin(df: DataFrame, label: str, category: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows of each class, taken in turn from its categories."""
    d = cap_per_group(df.withColumn("_g", F.struct(label, category)), "_g", key, k, seed).drop("_g").withColumn("_d", draw(key, seed))
    d = d.withColumn("_turn", F.row_number().over(W.partitionBy(label, category).orderBy("_d", key)))
    d = d.withColumn("place", F.row_number().over(W.partitionBy(label).orderBy("_turn", category)))
    return d.where(F.col("place") <= k).drop("_d", "_turn")


def bucketed_sample(df: DataFrame, bucket: str, key: str, each: int, total: int, seed: int = 42) -> DataFrame:
    """``each`` rows of every bucket in order, then more until there are ``total``; a top-k report."""
    d = cap_per_group(df, bucket, key, total, seed).withColumn("_d", draw(key, seed))
    d = d.withColumn("_r", F.row_number().over(W.partitionBy(bucket).orderBy("_d", key)))
    d = d.withColumn("topped_up", F.col("_r") > each)
    return d.orderBy("topped_up", bucket, "_r", key).limit(total).drop("_d", "_r")


def dealt_rank(df: DataFrame, by: list[str], key: str, seed: int = 42, name: str = "rank") -> DataFrame:
    """Rank from 0 of each row in drawn order within its group.

    The rank is made of the rows before a part of the draw (its first three hex
    digits, 4096 parts a group) and the rank within the part, so that a hot group
    is ranked in many tasks.
    """
    d = df.withColumn("_d", draw(key, seed)).withColumn("_p", F.substring("_d", 1, 3))
    sizes = d.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*(F.col(b).alias(f"_b{i}") for i, b in enumerate(by)), F.col("_p").alias("_q"), before.alias("_before"))
    rank = F.row_number().over(W.partitionBy(*by, "_p").orderBy("_d", key))
    same = F.col("_p") == F.col("_q")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_b{i}"))
    return d.withColumn("_r", rank).join(sizes, same).select(*df.columns, (F.col("_before") + F.col("_r") - 1).alias(name))


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """A fold for each row, dealt in drawn order within its class: fold sizes differ by one row at most."""
    return dealt_rank(df, [label], key, seed, "_rank").withColumn("fold", (F.col("_rank") % folds).cast("int")).drop("_rank")


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by seeded draw, without replacement."""
    return df.withColumn("_d", draw(key, seed)).orderBy("_d", key).limit(n).drop("_d")


def recycled_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """(pick, key): n picks by seeded draw; if there are fewer rows, they are taken again in turn."""
    few = sample(df.select(key), key, n, seed).withColumn("_d", draw(key, seed))
    ranked = few.withColumn("_r", F.row_number().over(W.orderBy("_d", key)) - 1)  # n rows at most
    size = few.agg(F.count(F.lit(1)).alias("_n"))
    picks = ranked.crossJoin(F.broadcast(size)).select(F.explode(F.sequence(F.col("_r"), F.lit(n - 1), F.col("_n").cast("int"))).alias("pick"), key)
    return picks


def majority_class(df: DataFrame, group: str, label: str, order: str) -> DataFrame:
    """(group, majority, n_rows): most frequent class of a group; of equal ones the first met in ``order``."""
    n = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "first", label))
    return n.groupBy(group).agg(best.alias("_b"), F.sum("n").alias("n_rows")).select(group, F.col(f"_b.{label}").alias("majority"), "n_rows")


SPLITS = (("train", 0.70), ("val", 0.15), ("test", 0.15))


def greedy_shares(k: int, step: int, filled: list[int], total: int, fractions=SPLITS) -> list[int]:
    """How many of k groups with ``step`` rows of a class each split gets if each goes where the class lacks most.

    filled: the class's rows in each split so far; total: all its rows.  The
    same counts as by k single choices (ties to the earlier split), but the
    choices up to the level that the shortages reach are taken at once, so the
    cost does not grow with k.
    """
    short = sorted((f - n / total for (_, f), n in zip(fractions, filled)), reverse=True)
    level = short[0]
    for m in range(1, len(short) + 1):
        at = (sum(short[:m]) - k * step / total) / m
        if m == len(short) or short[m] <= at:
            level = at
            break
    # one below the whole part is never too many, whatever the last bits of the level
    share = [max(0, int((f - n / total - level) * total / step) - 1) for (_, f), n in zip(fractions, filled)]
    for _ in range(k - sum(share)):
        i = max(range(len(share)), key=lambda x: fractions[x][1] - (filled[x] + share[x] * step) / total)
        share[i] += 1
    return share


def greedy_split(df: DataFrame, group: str, label: str, order: str, fractions=SPLITS, seed: int = 42) -> DataFrame:
    """(group, split): whole groups, largest first, to the split that lacks most of the group's majority class.

    Of equally large groups those with the same class counts (a pattern) follow
    each other, patterns by the least draw of their groups.  A group's majority
    class is its most frequent one, of equal ones the first in ``order``; ties
    between splits go to the earlier.  Rows with a null group form one group.

    The choice depends on all choices before it, so one task walks over the
    patterns (not the groups); it streams and keeps a number for each split and
    class.  The groups of a pattern are then dealt by their drawn rank.
    """
    totals = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one number a class
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    profile = counts.groupBy(group).agg(
        F.sum("n").alias("size"),
        F.min(F.struct((-F.col("n")).alias("n"), "first", label)).alias("m"),
        F.sort_array(F.collect_list(F.struct(F.col(label).alias("label"), "n"))).alias("classes"),
    ).select(group, "size", F.col(f"m.{label}").alias("majority"), "classes")
    pattern = ["size", "majority", "classes"]
    patterns = profile.withColumn("_d", F.coalesce(draw(group, seed), F.lit(""))).groupBy(*pattern).agg(F.count(F.lit(1)).alias("k"), F.min("_d").alias("first"))

    def walk(batches):
        placed = [dict.fromkeys(totals, 0) for _ in fractions]
        for batch in batches:
            out = []
            for at, p in enumerate(batch.to_pylist()):
                inside = {x["label"]: x["n"] for x in p["classes"]}
                major, low = p["majority"], 0
                share = greedy_shares(p["k"], inside[major], [s[major] for s in placed], totals[major], fractions)
                for s, (name, _), n in zip(placed, fractions, share):
                    for x, rows in inside.items():
                        s[x] += rows * n
                    if n:
                        out.append((at, low, low + n, name))
                        low += n
            where, low, high, split = zip(*out) if out else ((), (), (), ())
            taken = batch.select(pattern).take(pa.array(where, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(split, pa.string())], ["_size", "_majority", "_classes", "low", "high", "split"])

    kinds = dict(profile.dtypes)
    deal = patterns.repartition(1).sortWithinPartitions(F.desc("size"), "first").mapInArrow(walk, f"_size long, _majority {kinds['majority']}, _classes {kinds['classes']}, low long, high long, split string")
    ranked = dealt_rank(profile, pattern, group, seed, "_r")
    same = (F.col("size") == F.col("_size")) & F.col("majority").eqNullSafe(F.col("_majority")) & (F.col("classes") == F.col("_classes"))
    return ranked.join(deal, same).where("_r >= low AND _r < high").select(group, "split")


def leaks(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that stand in more than one split, with those splits; empty if nothing leaks."""
    return df.groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def split_shares(df: DataFrame, split: str) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select(split, "n", (F.col("n") / F.col("_t")).alias("share"))
