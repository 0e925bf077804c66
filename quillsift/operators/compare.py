"""Comparison of two visits: greedy one-to-one matching and change of measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.functions.scalars import angle_delta, magnitude, percent_change
from quillsift.operators.components import written
from quillsift.operators.filters import reliability
from quillsift.params import PARAMS


def interval_overlaps(a: DataFrame, b: DataFrame, pair: str, width: float) -> DataFrame:
    """(pair, i, j, iou) of overlapping intervals [lo, hi) of both sides; columns pair, idx, lo, hi.

    Intervals are cut into cells of ``width`` and joined on (pair, cell), so only
    neighbours meet; a pair of intervals counts in the first cell they share.
    """
    cells = lambda d, n: d.select(pair, F.col("idx").alias(n), F.col("lo").alias(f"{n}_lo"), F.col("hi").alias(f"{n}_hi"), F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("cell"))
    j = cells(a, "i").join(cells(b, "j"), [pair, "cell"])
    j = j.where(F.col("cell") == F.floor(F.greatest("i_lo", "j_lo") / width))
    inter = F.least("i_hi", "j_hi") - F.greatest("i_lo", "j_lo")
    union = F.greatest("i_hi", "j_hi") - F.least("i_lo", "j_lo")
    return j.select(pair, "i", "j", F.try_divide(inter, union).alias("iou"), inter.alias("inter")).where("inter > 0").drop("inter")


def cell_overlaps(a: DataFrame, b: DataFrame, pair: str) -> DataFrame:
    """(pair, i, j, iou) of regions of both sides that share cells; columns pair, idx, area, cells (an array of cell numbers)."""
    cells = lambda d, n: d.select(pair, F.col("idx").alias(n), F.col("area").alias(f"{n}_area"), F.explode("cells").alias("cell"))
    n = cells(a, "i").join(cells(b, "j"), [pair, "cell"]).groupBy(pair, "i", "j").agg(F.count(F.lit(1)).alias("n"), F.max("i_area").alias("i_area"), F.max("j_area").alias("j_area"))
    return n.select(pair, "i", "j", (F.col("n") / (F.col("i_area") + F.col("j_area") - F.col("n"))).alias("iou"))


def greedy_match(overlaps: DataFrame, pair: str, limit: float = PARAMS["delta.match_iou"]) -> DataFrame:
    """One-to-one matches (pair, i, j, iou) of the largest overlaps first; of equal ones the larger i, then j.

    An overlap that is the best of both its ends is taken, whatever is taken
    elsewhere; those it shares an end with go, and the next round looks at the
    rest.  So the matches are those of one walk over all overlaps in order, and
    a pair with very many lies in many tasks.  Each round's rest is written.
    """
    rest = written(overlaps.where(F.col("iou") >= limit).select(pair, "i", "j", "iou"), "overlaps")
    best = lambda end: rest.groupBy(pair, end).agg(F.max(F.struct("iou", "i", "j")).alias("b")).select(pair, "b.*")
    out = rest.limit(0)
    while not rest.isEmpty():
        taken = written(best("i").intersect(best("j")).select(pair, "i", "j", "iou"), "matches")
        out = out.unionByName(taken)
        rest = written(rest.join(taken.select(pair, "i"), [pair, "i"], "left_anti").join(taken.select(pair, "j"), [pair, "j"], "left_anti").select(pair, "i", "j", "iou"), "overlaps")
    return out


def match_states(a: DataFrame, b: DataFrame, matches: DataFrame, pair: str) -> DataFrame:
    """(pair, i, j, iou, state): persistent, resolved (only in a) or new (only in b)."""
    left = a.select(pair, F.col("idx").alias("i")).join(matches, [pair, "i"], "left_anti").select(pair, "i", F.lit(None).cast("long").alias("j"), F.lit(None).cast("double").alias("iou"), F.lit("resolved").alias("state"))
    right = b.select(pair, F.col("idx").alias("j")).join(matches, [pair, "j"], "left_anti").select(pair, F.lit(None).cast("long").alias("i"), "j", F.lit(None).cast("double").alias("iou"), F.lit("new").alias("state"))
    return matches.select(pair, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "iou", F.lit("persistent").alias("state")).unionByName(left).unionByName(right)


def changes(df: DataFrame) -> DataFrame:
    """Change columns of pairs with older_value, newer_value, confidence.

    A refused pair (confidence under the floor) carries no measured figure at all.
    """
    ok = F.col("confidence") >= PARAMS["delta.confidence_floor"]
    pct = percent_change("older_value", "newer_value")
    return df.select(
        "*",
        F.when(ok, "ok").otherwise("unreliable").alias("status"),
        F.when(ok, pct).alias("area_change_pct"),
        F.coalesce(F.when(ok, F.abs(pct) >= 100 * PARAMS["delta.area_change"]), F.lit(False)).alias("notable_area"),
        F.when(ok, reliability("confidence")).alias("reliability"),
    )


def colour_shift(df: DataFrame, hue: tuple[str, str], sat: tuple[str, str], val: tuple[str, str], measurable: str) -> DataFrame:
    """Colour shift between visits, null where it cannot be measured."""
    m = magnitude(angle_delta(hue[1], hue[0]), F.col(sat[1]) - F.col(sat[0]), F.col(val[1]) - F.col(val[0]))
    d = df.withColumn("colour_magnitude", F.when(F.col(measurable), m))
    return d.withColumn("notable_colour", F.coalesce(F.col("colour_magnitude") >= PARAMS["delta.relative_color"], F.lit(False)))
