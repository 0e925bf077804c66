"""Evaluation aggregates: rates that carry their denominators, intervals, confusion, correlation.

A rate without a denominator is null.  Medians and percentiles are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillsift.functions.scalars import c
from quillsift.operators.components import written

Z95 = 1.96


def rate(k, n) -> Column:
    return F.try_divide(c(k).cast("double"), c(n).cast("double"))


def rate_where(flag, condition=None) -> Column:
    """Share of true flags among the rows that meet the condition; null if there are none."""
    x = c(flag).cast("int")
    return F.avg(x if condition is None else F.when(condition, x))


def wilson(k, n, z: float = Z95) -> tuple[Column, Column, Column]:
    """(share, low, high) of the Wilson interval, clamped to [0, 1]; zeros where n is 0."""
    k, n = c(k).cast("double"), c(n).cast("double")
    safe = F.when(n > 0, n)
    p = k / safe
    d = 1 + F.lit(z * z) / safe
    mid = (p + F.lit(z * z) / (2 * safe)) / d
    half = F.lit(z) * F.sqrt(p * (1 - p) / safe + F.lit(z * z) / (4 * safe * safe)) / d
    zero = F.lit(0.0)
    known = lambda x: F.when(n > 0, x).otherwise(zero)  # noqa: E731  (greatest and least pass over nulls)
    return known(p), known(F.greatest(mid - half, zero)), known(F.least(mid + half, F.lit(1.0)))


def confusion_counts(truth, predicted) -> list[Column]:
    """tp, fp, fn, tn of 0/1 columns; rows with a null in either count nowhere."""
    t, p = c(truth).cast("int"), c(predicted).cast("int")
    cell = lambda a, b, name: F.count_if((t == a) & (p == b)).alias(name)
    return [cell(1, 1, "tp"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(0, 0, "tn")]


def binary_rates(df: DataFrame) -> DataFrame:
    """Sensitivity, specificity, predictive values and accuracy from tp, fp, fn, tn."""
    e = F.expr
    return df.select(
        "*",
        e("try_divide(CAST(tp AS DOUBLE), tp + fn)").alias("sensitivity"),
        e("try_divide(CAST(tn AS DOUBLE), tn + fp)").alias("specificity"),
        e("try_divide(CAST(tp AS DOUBLE), tp + fp)").alias("ppv"),
        e("try_divide(CAST(tn AS DOUBLE), tn + fn)").alias("npv"),
        e("try_divide(CAST(tp + tn AS DOUBLE), tp + fp + fn + tn)").alias("accuracy"),
    )


def per_class(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One-vs-rest counts, precision, recall, specificity and F1 of each class; 0 where undefined.

    The rows are first counted per (truth, predicted), so what follows has the
    size of the confusion matrix.
    """
    cells = df.groupBy(F.col(truth).alias("_t"), F.col(predicted).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    long = cells.select(F.explode(F.array_distinct(F.array("_t", "_p"))).alias("class"), "_t", "_p", "_n").where("class IS NOT NULL")
    total = cells.agg(F.sum("_n").alias("n"))
    s = long.groupBy("class").agg(
        F.sum(F.when((F.col("_t") == F.col("class")) & (F.col("_p") == F.col("class")), F.col("_n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("_p") == F.col("class")) & ~F.col("_t").eqNullSafe(F.col("class")), F.col("_n")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("_t") == F.col("class")) & ~F.col("_p").eqNullSafe(F.col("class")), F.col("_n")).otherwise(0)).alias("fn"),
    )
    s = s.join(F.broadcast(total)).withColumn("tn", F.col("n") - F.col("tp") - F.col("fp") - F.col("fn"))  # one row
    e = F.expr
    return s.select(
        "class", "tp", "fp", "fn", "tn",
        e("coalesce(try_divide(CAST(tp AS DOUBLE), tp + fp), 0D)").alias("precision"),
        e("coalesce(try_divide(CAST(tp AS DOUBLE), tp + fn), 0D)").alias("recall"),
        e("coalesce(try_divide(CAST(tn AS DOUBLE), tn + fp), 0D)").alias("specificity"),
        e("coalesce(try_divide(2D * tp, 2 * tp + fp + fn), 0D)").alias("f1"),
    )


def pearson(a, b) -> Column:
    """Correlation; null under two rows or where a side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def upper_median(x: str) -> Column:
    """The element at n // 2 of the sorted values: not interpolated, the upper one of two.

    For groups of few distinct values: it is the discrete percentile just above
    one half (for under 1e11 rows), kept as counts of distinct values.
    ``quantiles`` has no such bound.
    """
    return F.expr(f"percentile_disc(0.500000000001D) WITHIN GROUP (ORDER BY {x})")


def running_counts(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, x, n, upto, total): how often each value occurs in its group, and how many of the group's rows have it or a smaller one.

    Distinct values are dealt by ranges of (group, value), so that a hot group
    lies in many tasks; each task's sums are then added to those before it.
    Nulls are left out.
    """
    counted = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("n"))
    d = written(counted.repartitionByRange(*by, x).withColumn("_task", F.spark_partition_id()), "counts")
    sums = d.groupBy(*by, "_task").agg(F.sum("n").alias("_n"))
    upto = W.partitionBy(*by).orderBy("_task")
    sums = sums.select(*(F.col(b).alias(f"_{b}") for b in by), F.col("_task").alias("_t"), (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy(*by)).alias("total"))
    same = F.col("_task") == F.col("_t")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    within = F.sum("n").over(W.partitionBy(*by, "_task").orderBy(x))
    return d.withColumn("_in", within).join(sums, same).select(*by, x, "n", (F.col("_before") + F.col("_in")).alias("upto"), "total")


def quantiles(df: DataFrame, by: list[str], x: str, **at: float | None) -> DataFrame:
    """(by, one column for each name): exact quantiles of ``x``, between two values by their distance.

    A share of None is the upper median: the element at n // 2 of the sorted
    values, not interpolated.  No group's values meet in one task.
    """
    d = running_counts(df, by, x)
    out = []
    for name, q in at.items():
        place = F.floor(F.col("total") / 2).cast("double") if q is None else (F.col("total") - 1) * F.lit(float(q))
        low, share = F.floor(place), place - F.floor(place)
        value = lambda rank: F.min(F.when(F.col("upto") > rank, F.col(x))).cast("double")
        a, b = value(low), value(F.ceil(place))
        out.append((a * (1 - F.max(share)) + b * F.max(share)).alias(name))
    return d.groupBy(*by).agg(*out)


def beside(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``a`` with the columns of ``b`` for the same key; nulls are one key."""
    return a.join(b.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def class_weights(counts: DataFrame, classes: list[str], label: str = "label", n: str = "n") -> DataFrame:
    """n / (k * max(n_c, 1)) of each listed class, also of those without rows."""
    spark = counts.sparkSession
    listed = spark.createDataFrame([(x,) for x in classes], f"{label} string")
    d = listed.join(counts.select(label, n), label, "left").withColumn(n, F.coalesce(n, F.lit(0)))
    total = counts.where(F.col(label).isin(*classes)).agg(F.coalesce(F.sum(n), F.lit(0)).alias("_total"))
    return d.join(F.broadcast(total)).select(label, n, (F.col("_total") / (F.lit(float(len(classes))) * F.greatest(F.col(n), F.lit(1)))).alias("weight"))


def effective_cap(smallest, ratio: float, most: int) -> Column:
    """The least of a fixed cap and a multiple of the smallest class, rounded half to even."""
    return F.least(F.lit(most), F.bround(F.lit(ratio) * c(smallest)).cast("int"))


def dice(intersection, a, b) -> Column:
    """2 i / (a + b); null if both sides are empty."""
    return F.try_divide(F.lit(2.0) * c(intersection), (c(a) + c(b)).cast("double"))


def iou(intersection, a, b) -> Column:
    return F.try_divide(c(intersection).cast("double"), (c(a) + c(b) - c(intersection)).cast("double"))


def bootstrap_interval(df: DataFrame, key: str, value: str, resamples: int = 2000, seed: int = 20251006) -> DataFrame:
    """(key, n, mean, low, high): percentile interval of resampled means.

    Values are first counted, so a group is its distinct values with their
    counts, and a resample is one multinomial draw over them: memory follows the
    distinct values of a group, not its rows.  Nulls are left out; low and high
    are null under two values.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    kind = dict(df.dtypes)[key]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("_v")
        v, n = t.column("_v").to_numpy(), t.column("_n").to_numpy()
        total = int(n.sum())
        low = high = None
        if total >= 2:
            draws = np.random.default_rng(seed).multinomial(total, n / total, resamples) @ v / total
            low, high = (float(x) for x in np.percentile(draws, (2.5, 97.5)))
        return pa.table({key: t.column(key).slice(0, 1), "n": pa.array([total], pa.int64()), "mean": pa.array([float(v @ n / total)]), "low": pa.array([low], pa.float64()), "high": pa.array([high], pa.float64())})

    return counted.groupBy(key).applyInArrow(run, f"{key} {kind}, n long, mean double, low double, high double")


#: Chances that a Poisson draw of mean 1 is at most 0, 1, 2 ...; beyond the last one 32 bits tell nothing more.
POISSON = tuple(np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 10)])).tolist())


def drawn_interval(df: DataFrame, key: str, id_col: str, value: str, resamples: int = 400, seed: int = 42) -> DataFrame:
    """(key, n, mean, low, high): percentile interval of resampled means, each row weighted by draws of its own.

    In each resample a row counts as often as a Poisson draw of mean 1 says, made by
    md5 of seed, id and resample (four from one digest).  Weights and weighted values
    are summed before anything is shuffled, so a group is ``resamples`` pairs of
    numbers, however many rows it has.  Null values are left out; low and high are
    null under two values.
    """
    d = df.where(F.col(value).isNotNull()).select(key, F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.col(value).cast("double").alias("_v"))
    blocks = F.sequence(F.lit(0), F.lit(-(-resamples // 4) - 1))
    digest = lambda g: F.md5(F.concat(F.lit(f"{seed}:"), F.col("_id"), F.lit(":"), g.cast("string")).cast("binary"))
    d = d.select(key, "_v", F.explode(F.transform(blocks, lambda g: F.struct(g.alias("g"), digest(g).alias("h")))).alias("_b"))

    def weight(k: int) -> Column:
        u = F.conv(F.substring("_b.h", 8 * k + 1, 8), 16, 10).cast("double") / 2.0**32
        return sum((F.when(u >= t, 1).otherwise(0) for t in POISSON), F.lit(0))

    sums = d.groupBy(key, "_b.g").agg(*(x for k in range(4) for x in (F.sum(weight(k)).alias(f"_w{k}"), F.sum(weight(k) * F.col("_v")).alias(f"_s{k}"))))
    means = sums.select(key, F.explode(F.array(*(F.struct((F.col("g") * 4 + k).alias("i"), F.try_divide(f"_s{k}", f"_w{k}").alias("m")) for k in range(4)))).alias("_r")).where(F.col("_r.i") < resamples)
    ends = means.groupBy(key).agg(F.percentile("_r.m", F.lit(0.025)).alias("low"), F.percentile("_r.m", F.lit(0.975)).alias("high"))
    whole = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(value).cast("double")).alias("mean"))
    many = F.col("n") >= 2
    return beside(whole, ends, key).select(key, "n", "mean", F.when(many, F.col("low")).alias("low"), F.when(many, F.col("high")).alias("high"))


def compared(old, new, higher_is_better: bool) -> Column:
    """same, better or WORSE of a metric in two arms."""
    d = (c(new) - c(old)) * (1 if higher_is_better else -1)
    return F.when(c(old).isNull() | c(new).isNull(), F.lit(None)).when(F.abs(d) < 1e-9, "same").when(d > 0, "better").otherwise("WORSE")
