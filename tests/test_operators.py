"""Operators on hand-made inputs: planted positives, boundaries, nulls and ties."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pandas as pd
import pytest
from helpers import rows
from pyspark.sql import functions as F

from quillsift.functions import scalars as S
from quillsift.operators import compare, filters, groups, hamming, joins, metrics, rules
from quillsift.operators.components import connected_components
from quillsift.params import PARAMS


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_banded_join_finds_every_pair(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(60)]
    fps = base + [b ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for b in base[:30]] + base[:5]
    d = spark.createDataFrame([(i, f) for i, f in enumerate(fps)] + [(999, None)], "id int, fp long")
    for limit in (0, 3, 6, 12, 30):
        got = {(r.fp_a, r.fp_b): r.distance for r in hamming.hamming_pairs(d, "fp", limit).collect()}
        uniq = sorted(set(fps))
        want = {(a, b): (a ^ b).bit_count() for i, a in enumerate(uniq) for b in uniq[i + 1 :] if (a ^ b).bit_count() <= limit}
        assert got == want
        assert hamming.hamming_pairs(d, "fp", limit).count() == len(want)


def within(fps, limit):
    fps = np.unique(fps)
    out = set()
    for i in range(0, len(fps), 64):
        d = np.bitwise_count((fps[i : i + 64, None] ^ fps[i:]).view(np.uint64))
        a, b = np.nonzero(d <= limit)
        out.update((int(fps[i + x]), int(fps[i + y])) for x, y in zip(a, b) if x < y)
    return out


def test_many_forms_meet_at_a_limit_of_12(spark):
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**63, 80000, dtype=np.int64)
    fps[:300] = fps[300:600] ^ (np.int64(1) << rng.integers(0, 63, (300, 12))).sum(axis=1)
    fps[600:700] &= (1 << 50) - 1  # one bucket of the last bands
    d = spark.createDataFrame(pd.DataFrame({"owner": np.arange(80000) // 8, "fp": fps})).groupBy("owner").agg(F.collect_list("fp").alias("forms"))
    began = time.time()
    got = {(r.owner_a, r.owner_b) for r in hamming.owner_pairs(d, "owner", "forms", 12).collect()}
    assert time.time() - began < 60  # a row for each two strangers with a like band took minutes
    at = {int(f): i // 8 for i, f in enumerate(fps)}
    assert got == {tuple(sorted((at[a], at[b]))) for a, b in within(fps, 12) if at[a] != at[b]} and len(got) >= 250


def test_many_fingerprints_meet_at_a_limit_of_20(spark):
    fps = np.random.default_rng(6).integers(0, 2**63, 60000, dtype=np.int64)
    d = spark.createDataFrame(pd.DataFrame({"fp": fps}))
    began = time.time()
    got = hamming.hamming_pairs(d, "fp", 20).agg(F.count("*"), F.count_distinct("fp_a", "fp_b"), F.count_if(F.col("fp_a") >= F.col("fp_b")), F.count_if(F.col("distance") != F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b")))), F.max("distance")).first()
    assert time.time() - began < 60  # half of all pairs were rows
    n = sum(int((np.bitwise_count((f ^ fps[i + 1 :]).view(np.uint64)) <= 20).sum()) for i, f in enumerate(fps))
    assert tuple(got) == (n, n, 0, 0, 20)


def test_two_nearest_of_many_rows(spark, tmp_path):
    rng = np.random.default_rng(7)
    v = rng.normal(0, 0.1, (60000, 64)).astype(np.float32)
    v[1:40] = v[0]  # copies: the least keys count
    pd.DataFrame({"id": np.arange(60000), "v": list(v)}).to_parquet(tmp_path / "v.parquet")
    table = spark.read.parquet(str(tmp_path / "v.parquet"))
    began = time.time()
    j = joins.nearest_two(table.where("id % 100 = 0").withColumnRenamed("id", "a"), table.withColumnRenamed("id", "b"), "a", "b", "v")
    got = {(r.a, r.b, r.d1, r.d2) for r in joins.ratio_test(j, "a", "b", "distance", 2.0).collect()}
    assert time.time() - began < 60  # 36 million distances as expressions took minutes
    want = set()
    for a in range(0, 60000, 100):
        d = ((v[a].astype(float) - v.astype(float)) ** 2).cumsum(axis=1)[:, -1]
        d[a] = np.inf
        b, second = np.lexsort((np.arange(60000), d))[:2]
        want |= {(a, int(b), float(d[b]), float(d[second]))} if d[b] < 2 * d[second] else set()
    assert got == want and len(got) == 599


def test_two_nearest_with_gaps(spark):
    nan = float("nan")
    table = [(0, [0.0, 0.0]), (1, [1.0, None]), (2, [3.0]), (3, None), (4, [None, 2.0]), (5, [nan, 0.0]), (6, []), (7, [1e200, 0.0]), (None, [0.0, 0.0])]
    d = spark.createDataFrame(table, "id long, v array<double>")
    j = joins.nearest_two(d.where("id = 0").withColumnRenamed("id", "a"), d.withColumnRenamed("id", "b"), "a", "b", "v")
    assert {(1, 1.0), (4, 4.0)} <= {(r.b, r.distance) for r in j.collect()}
    r = joins.ratio_test(j, "a", "b", "distance", 0.95).first()
    assert (r.a, r.b, r.d1, r.d2) == (0, 1, 1.0, 4.0)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(2, 50)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    d = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(d).collect()}
    assert {got[i] for i in range(100, 161)} == {100}
    assert {got[i] for i in range(1, 50)} == {1}
    assert got[200] == got[201] == 200
    assert connected_components(d.limit(0)).count() == 0


def test_keep_first_and_caps(spark):
    d = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z"), (None, 1, "n")], "k string, o int, v string")
    assert rows(groups.keep_first(d, "k", ["o"])) == [("a", 1, "y"), ("b", 5, "z")]
    big = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    capped = groups.cap_per_group(big, "g", "id", 5)
    assert [r["count"] for r in capped.groupBy("g").count().collect()] == [5, 5, 5]
    assert rows(capped) == rows(groups.cap_per_group(big.repartition(7), "g", "id", 5))


def test_folds_are_even_and_stable(spark):
    d = spark.range(1003).select("id", F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("y"))
    f = groups.stratified_folds(d, "y", "id")
    sizes = {(r.y, r.fold): r["count"] for r in f.groupBy("y", "fold").count().collect()}
    for y in (0, 1):
        n = [sizes[y, k] for k in range(5)]
        assert max(n) - min(n) <= 1
    assert f.count() == 1003


def test_greedy_split_leaks_nothing(spark):
    rng = random.Random(3)
    data = [(i, rng.choice("ab"), g) for g in range(300) for i in range(g * 100, g * 100 + rng.randrange(1, 6))]
    d = spark.createDataFrame(data, "id int, label string, grp int")
    s = d.join(groups.greedy_split(d, "grp", "label", "id"), "grp")
    assert s.count() == len(data)
    assert groups.leaks(s, "grp", "split").count() == 0
    share = {r.split: r.share for r in groups.split_shares(s, "split").collect()}
    assert abs(share["train"] - 0.7) < 0.04 and abs(share["val"] - 0.15) < 0.04
    # a planted leak is found
    assert groups.leaks(s.unionByName(s.limit(1).withColumn("split", F.lit("other"))), "grp", "split").count() == 1


def _split_by_loop(sizes, total, filled, k, step):
    share = [0] * len(sizes)
    for _ in range(k):
        i = max(range(len(sizes)), key=lambda x: sizes[x][1] - (filled[x] + share[x] * step) / total)
        share[i] += 1
    return share


def test_greedy_shares_are_those_of_single_choices():
    rng = random.Random(5)
    for _ in range(3000):
        step, k = rng.randint(1, 9), rng.randint(1, 300)
        filled = [rng.randint(0, 400) for _ in range(3)]
        total = sum(filled) + step * k + rng.randint(0, 300)
        cut = rng.choice(((0.7, 0.15, 0.15), (0.5, 0.25, 0.25), (1.0, 0.0, 0.0), (0.34, 0.33, 0.33)))
        fractions = list(zip("abc", cut))
        assert groups.greedy_shares(k, step, filled, total, fractions) == _split_by_loop(fractions, total, filled, k, step)
    assert sum(groups.greedy_shares(10**12, 1, [0, 0, 0], 10**12)) == 10**12


def test_greedy_split_against_a_loop_over_groups(spark):
    rng = random.Random(9)
    data, at = [], 0
    for grp in range(900):
        major = rng.choice(("x", "y", "z", None))
        for _ in range(1 if rng.random() < 0.7 else rng.randint(2, 12)):
            data.append((at, grp, major if rng.random() < 0.8 else "y"))
            at += 1
    got = {r.grp: r.split for r in groups.greedy_split(spark.createDataFrame(data, "id int, grp int, label string"), "grp", "label", "id").collect()}
    members = {}
    for _, grp, label in data:
        members.setdefault(grp, []).append(label)
    assert got.keys() == members.keys()
    totals = {x: sum(r[2] == x for r in data) for x in ("x", "y", "z", None)}
    kind = {}
    for grp, labels in members.items():
        counts = {x: labels.count(x) for x in dict.fromkeys(labels)}
        kind[grp] = (len(labels), max(counts, key=counts.get), tuple(sorted(counts.items(), key=repr)))
    drawn = {grp: hashlib.md5(f"42:{grp}".encode()).hexdigest() for grp in members}
    first = {}
    for grp, k in kind.items():
        first[k] = min(first.get(k, "~"), drawn[grp])
    placed = {s: dict.fromkeys(totals, 0) for s, _ in groups.SPLITS}
    want, chosen = {}, {}
    for grp in sorted(members, key=lambda g: (-len(members[g]), first[kind[g]], drawn[g])):
        major = kind[grp][1]
        best = max(groups.SPLITS, key=lambda s: s[1] - placed[s[0]][major] / totals[major])[0]
        chosen.setdefault(kind[grp], []).append(best)
        for x, n in kind[grp][2]:
            placed[best][x] += n
    for k, picks in chosen.items():
        equal = sorted((g for g in members if kind[g] == k), key=drawn.get)
        want.update(zip(equal, sorted(picks, key=[s for s, _ in groups.SPLITS].index)))
    assert got == want
    assert groups.greedy_split(spark.createDataFrame([], "id int, grp int, label string"), "grp", "label", "id").collect() == []


def test_greedy_match_against_a_loop(spark):
    rng = random.Random(5)
    data = [(p, i, j, rng.choice([0.05, 0.1, 0.3, 0.3, 0.7])) for p in range(20) for i in range(6) for j in range(6) if rng.random() < 0.5]
    d = spark.createDataFrame(data, "pair int, i int, j int, iou double")
    want = set()
    for p in range(20):
        left, right = set(), set()
        for iou, i, j in sorted(((v, i, j) for q, i, j, v in data if q == p and v >= 0.1), reverse=True):
            if i not in left and j not in right:
                want.add((p, i, j, iou))
                left.add(i)
                right.add(j)
    assert {tuple(r) for r in compare.greedy_match(d, "pair").collect()} == want


def test_wilson_and_undefined_rates(spark):
    share, low, high = metrics.wilson(F.lit(15), F.lit(18))
    r = one(spark, share.alias("p"), low.alias("l"), high.alias("h"))
    assert (round(r.p, 3), round(r.l, 3), round(r.h, 3)) == (0.833, 0.608, 0.942)
    assert tuple(one(spark, *(c.alias(f"c{i}") for i, c in enumerate(metrics.wilson(F.lit(0), F.lit(0)))))) == (0.0, 0.0, 0.0)
    assert one(spark, metrics.dice(F.lit(0), F.lit(0), F.lit(0)).alias("d")).d is None
    assert one(spark, metrics.dice(F.lit(0), F.lit(5), F.lit(0)).alias("d")).d == 0.0


def test_correlation_of_a_constant_is_null(spark):
    d = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert d.agg(metrics.pearson("a", "b").alias("r")).first().r is None
    assert d.agg(metrics.upper_median("b").alias("m")).first().m == 3.0


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    table = [("hot", float(v)) for v in rng.integers(0, 40, 3000)] + [("b", float(v)) for v in rng.normal(size=11)] + [(None, 5.0), (None, 7.0), ("one", 3.0), ("none", None)]
    df = spark.createDataFrame(table, "g string, x double").repartition(6)
    got = {r.g: tuple(r[1:]) for r in metrics.quantiles(df, ["g"], "x", low=0.0, q=0.25, median=0.5, p95=0.95, high=1.0, upper=None).collect()}
    assert set(got) == {"hot", "b", None, "one"}
    for g, values in got.items():
        x = np.array([v for k, v in table if k == g])
        assert values == pytest.approx((x.min(), *np.percentile(x, (25, 50, 95)), x.max(), np.sort(x)[len(x) // 2]))
    assert metrics.quantiles(df, [], "x", median=0.5).first().median == np.percentile([v for _, v in table if v is not None], 50)
    assert metrics.beside(df.select("g").distinct(), metrics.quantiles(df, ["g"], "x", median=0.5), "g").count() == 4
    assert metrics.quantiles(df.limit(0), ["g"], "x", median=0.5).count() == 0


def test_bootstrap_covers_the_mean(spark):
    d = spark.createDataFrame([("a", i % 2) for i in range(200)] + [("b", 1), ("c", None)], "k string, v int")
    got = {r.k: r for r in metrics.bootstrap_interval(d, "k", "v").collect()}
    assert got["a"].low < 0.5 < got["a"].high and 0.1 < got["a"].high - got["a"].low < 0.2
    assert got["b"].low is None and "c" not in got
    draws = np.random.default_rng(20251006).multinomial(200, [0.5, 0.5], 2000) @ np.array([0.0, 1.0]) / 200
    assert got["a"].low == pytest.approx(np.percentile(draws, 2.5))


def lesion(**k):
    base = dict(report=1, lesion_id=1, status="ok", comparability="full", state="persistent", area_change_pct=0.0, colour_measurable=False, notable_colour=False, persistent_condition=False)
    return base | k


@pytest.mark.parametrize(
    "change,band",
    [
        (dict(), "Low"),
        (dict(area_change_pct=9.99), "Low"),
        (dict(area_change_pct=10.0), "Moderate"),
        (dict(area_change_pct=30.0), "Elevated"),
        (dict(area_change_pct=30.0, comparability="partial"), "Low"),
        (dict(state="new"), "Moderate"),
        (dict(state="new", area_change_pct=12.0), "Elevated"),
        (dict(notable_colour=True), "Low"),
        (dict(notable_colour=True, colour_measurable=True), "Moderate"),
        (dict(persistent_condition=True), "Low"),
        (dict(status="unreliable", area_change_pct=80.0), "Not assessed"),
        (dict(area_change_pct=None), "Low"),
    ],
)
def test_band_truth_table(spark, change, band):
    schema = "report int, lesion_id int, status string, comparability string, state string, area_change_pct double, colour_measurable boolean, notable_colour boolean, persistent_condition boolean"
    r = rules.assess(spark.createDataFrame([lesion(**change)], schema), "report").first()
    assert r.band == band
    if r.band == "Not assessed":
        assert r.n_rules == 0 and r.least_margin is None


def test_a_counterfactual_applied_lowers_the_band(spark):
    schema = "report int, lesion_id int, status string, comparability string, state string, area_change_pct double, colour_measurable boolean, notable_colour boolean, persistent_condition boolean"
    d = spark.createDataFrame([lesion(area_change_pct=71.48)], schema)
    c = rules.counterfactuals(d, "report").first()
    assert (c.rule_id, round(c.margin, 2)) == ("AREA_GROWTH_LARGE", 41.48)
    lower = d.withColumn("area_change_pct", F.col("area_change_pct") - c.margin - 0.01)
    assert rules.assess(lower, "report").first().band == "Moderate"
    on = PARAMS | {"risk.allow_classifier_rules": True}
    assert rules.assess(spark.createDataFrame([lesion(persistent_condition=True)], schema), "report", on).first().band == "Moderate"


def test_guards_fail_on_a_planted_row(spark):
    d = spark.createDataFrame([("02. Annotated/x.png",), ("01. Unannotated/y.png",), ("a/notes.json",), ("a/z.png",)], "path string")
    kept = [r.path for r in d.where(~filters.blocked_path("path")).collect()]
    assert kept == ["01. Unannotated/y.png", "a/z.png"]
    with pytest.raises(Exception, match="a blocked path"):
        filters.guarded(d, filters.blocked_path("path"), "a blocked path passed").collect()


def test_scalar_traps(spark):
    r = one(
        spark,
        S.angle_delta(F.lit(5.0), F.lit(170.0)).alias("angle"), S.ramp(F.lit(5.0), 1.0, 1.0).alias("flat"), S.half_life(F.lit(float("inf")), 2.0).alias("inf"),
        S.percent_change(F.lit(1599.0), F.lit(2742.0)).alias("pct"), S.percent_change(F.lit(0.0), F.lit(1.0)).alias("undefined"), S.stem_of(F.lit("a\\b.c/.hidden")).alias("stem"),
        S.suffix_of(F.lit("x/Y.JPEG")).alias("suffix"), S.shoelace(S.ring_points(F.array(*map(F.lit, [0.0, 0.0, 4.0, 0.0, 4.0, 3.0, 0.0, 3.0])))).alias("area"),
        S.ring_points(F.array(F.lit(1.0), F.lit(2.0))).alias("short"), S.power_of_two_sample(F.lit(0), 100).alias("zero"), S.entropy(F.array(F.lit(1), F.lit(1))).alias("bits"),
        F.size(S.ellipse_points(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))).alias("gon"),
    )
    assert (r.angle, r.flat, r.inf, round(r.pct, 2), r.undefined) == (15.0, 0.0, 0.0, 71.48, None)
    assert (r.stem, r.suffix, r.area, r.short, r.zero, r.bits, r.gon) == (".hidden", ".jpeg", 12.0, None, 1, 1.0, 48)


def test_sign_bits(spark):
    v = [0.0] + [float(i) for i in range(63)]
    fp = one(spark, S.sign_bits(F.array(*map(F.lit, v))).alias("f")).f
    assert fp == int("0" * 32 + "1" * 31, 2)


def test_joins_on_ties_and_nulls(spark):
    left = spark.createDataFrame([("A", "x"), ("B", "y"), (None, "z")], "n string, s string")
    right = spark.createDataFrame([("A", "q", 3), ("A", "q", 1), ("Z", "y", 7), (None, "z", 9)], "n string, s string, v int")
    got = {r.s: r.v for r in joins.with_fallback(left.withColumnRenamed("n", "n1").withColumnRenamed("s", "s"), right.select(F.col("n").alias("rn"), F.col("s").alias("rs"), "v"), ("n1", "s"), ("rn", "rs"), "v", ["v"]).collect()}
    assert got == {"x": 1, "y": 7, "z": 9}
    d = spark.createDataFrame([("k", 1, 10), ("k", 2, 10), ("k", 3, 5)], "k string, i int, n int")
    assert rows(joins.first_of(d, ["k"], [("n", "desc"), "i"])) == [("k", 1, 10)]


def test_refused_changes_carry_nothing(spark):
    d = spark.createDataFrame([(10.0, 20.0, 0.29), (10.0, 20.0, 0.3), (0.0, 5.0, 0.9)], "older_value double, newer_value double, confidence double")
    got = [(r.status, r.area_change_pct, r.notable_area, r.reliability) for r in compare.changes(d).collect()]
    assert got == [("unreliable", None, False, None), ("ok", 100.0, True, "low"), ("ok", None, False, "high")]


def test_pieces_do_not_change_pairs(spark):
    rng = random.Random(4)
    d = spark.createDataFrame([(rng.choice("ab") if i % 9 else None, rng.randrange(50), i, float(i)) for i in range(300)], "k string, t int, id int, v double")
    whole = joins.ordered_pairs(d, ["k"], "t", "id", ["v"])
    cut = joins.ordered_pairs(d, ["k"], "t", "id", ["v"], F.floor(F.col("t") / 7))
    assert whole.columns == cut.columns and rows(whole) == rows(cut) and whole.count() == 297


def test_dealt_rank_is_a_rank(spark):
    d = spark.range(500).select((F.col("id") % 2).alias("g"), "id")
    got = groups.dealt_rank(d, ["g"], "id")
    for g in (0, 1):
        assert sorted(r["rank"] for r in got.where(F.col("g") == g).collect()) == list(range(250))


def test_frame_overlap_against_points(spark):
    rng = np.random.default_rng(3)
    mats = []
    for i in range(40):
        a, s = rng.uniform(-1, 1), rng.uniform(0.5, 1.8)
        mats.append((i, [[s * np.cos(a), -s * np.sin(a), rng.uniform(-40, 40)], [s * np.sin(a), s * np.cos(a), rng.uniform(-40, 40)], [rng.uniform(-1e-3, 1e-3), rng.uniform(-1e-3, 1e-3), 1.0]]))
    mats += [(40, [[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]]), (41, [[1.0, 0, 500], [0, 1.0, 0], [0, 0, 1.0]]), (42, [[1.0, 0, 0], [0, 1.0, 0], [-0.1, 0, 1.0]]), (43, None)]
    d = spark.createDataFrame([(i, None if m is None else [[float(x) for x in r] for r in m]) for i, m in mats], "i int, h array<array<double>>")
    got = {r.i: r.v for r in d.select("i", S.frame_overlap("h", F.lit(100), F.lit(80), F.lit(90), F.lit(70)).alias("v")).collect()}
    y, x = np.mgrid[0.5:160:1, 0.5:200:1] / 2
    at = np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    for i, m in mats[:40]:
        back = np.linalg.inv(np.array(m)) @ at
        u, v = back[0] / back[2], back[1] / back[2]
        assert got[i] == pytest.approx(((u >= 0) & (u <= 90) & (v >= 0) & (v <= 70)).mean(), abs=0.01)
    assert got[40] == pytest.approx(90 * 70 / 8000) and got[41] == 0.0 and got[42] is None and got[43] is None


def test_drawn_homography_moves_corners_as_drawn(spark):
    d = spark.range(200).select("id", S.drawn_homography("id", F.lit(101), F.lit(81), 15.0, (0.9, 1.1), 0.1, 0.02).alias("h"))
    hs = {r.id: np.array(r.h) for r in d.collect()}
    assert len({h.tobytes() for h in hs.values()}) == 200
    for h in hs.values():
        for x, y in ((0, 0), (100, 0), (100, 80), (0, 80)):
            px, py, k = h @ (x, y, 1)
            # the farthest a corner may go: scale, turn, shift and jitter together
            assert np.hypot(px / k - x, py / k - y) < 0.1 * 66 + 0.27 * 71 + 0.12 * 131
    still = spark.range(1).select(S.drawn_homography("id", F.lit(101), F.lit(81), 0.0, (1.0, 1.0), 0.0, 0.0).alias("h")).first().h
    assert np.allclose(still, np.eye(3))


def test_grid_hashes_turn_with_the_grid(spark):
    rng = np.random.default_rng(4)
    g = rng.uniform(0, 255, (32, 32))
    d = spark.createDataFrame([(0, g.ravel().tolist()), (1, np.rot90(g).ravel().tolist()), (2, np.fliplr(g).ravel().tolist()), (3, [1.0]), (4, None)], "i int, g array<double>")
    h = {r.i: r.h for r in d.select("i", hamming.grid_hashes("g").alias("h")).collect()}
    assert len(h[0]) == 8 and set(h[0]) == set(h[1]) == set(h[2]) and h[1][0] == h[0][1] and h[2][0] == h[0][4] and h[3] is None and h[4] is None
    n = np.arange(32)
    low = [[sum(g[y, x] * np.cos(np.pi * (2 * x + 1) * u / 64) * np.cos(np.pi * (2 * y + 1) * v / 64) for y in n for x in n) * (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) for u in range(8)] for v in range(8)]
    flat = np.ravel(low)[1:]
    assert h[0][0] == int("".join("1" if b else "0" for b in flat > np.median(flat)), 2)


def test_small_functions(spark):
    r = one(spark, S.file_stamp(F.lit(1700000000123)).alias("a"), S.zero_to(F.lit(0), F.lit(7)).alias("b"), S.zero_to(F.lit(None).cast("int"), F.lit(7)).alias("c"), S.zero_to(F.lit(3), F.lit(7)).alias("d"),
            filters.masked(F.lit(5), F.lit(True)).alias("e"), filters.masked(F.lit(5), F.lit(False)).alias("f"), (S.today() == F.current_date().cast("string")).alias("g"),
            filters.naming_scheme(F.lit("x/12 - a.png"), [("id", r"(?i)ID\d+"), ("old", r"^\d+\s*-")], "new").alias("h"), filters.same_scene(F.lit(0.9), F.lit(50)).alias("i"), filters.same_scene(F.lit(0.91), F.lit(30)).alias("j"),
            filters.same_scene(F.lit(None).cast("double"), F.lit(30)).alias("k"))
    assert tuple(r) == ("visit_20231114_221320_123.jpg", 7, 7, 3, None, 5, True, "old", False, True, False)
    d = spark.createDataFrame([(1, 2)], "Image_Name int, b int")
    assert filters.pick_column(d, "id", "imagename") == "Image_Name" and filters.pick_column(d, "id") is None


def test_recycled_sample_and_restricted_matches(spark):
    d = spark.createDataFrame([(x,) for x in "abcde"], "k string")
    got = [r.k for r in groups.recycled_sample(d, "k", 12).orderBy("pick").collect()]
    assert len(got) == 12 and set(got) == set("abcde") and got[:5] == got[5:10] and got[10:] == got[:2]
    assert sorted(r.pick for r in groups.recycled_sample(d, "k", 3).collect()) == [0, 1, 2]
    assert groups.recycled_sample(d.limit(0), "k", 3).count() == 0
    files = spark.createDataFrame([("out/SetOne/a.png",), ("out/b.png",)], "path string")
    near = spark.createDataFrame([("out/b.png", "setone", 3)], "path string, dataset string, distance int")
    assert rows(joins.restricted_matches(files, near, ["setone", "settwo"])) == [("out/SetOne/a.png", "setone", 0, "named"), ("out/b.png", "setone", 3, "alike")]
    assert rows(joins.exists_in(files, near, ["path"])) == [("out/b.png",)]


def test_drawn_interval_covers_the_mean(spark):
    df = spark.createDataFrame([("a", i, i % 2) for i in range(400)] + [("b", 1, 1), ("c", 2, None), (None, 3, 4), (None, None, 6)], "k string, id long, v int")
    got = {r.k: r for r in metrics.drawn_interval(df, "k", "id", "v", resamples=403).collect()}
    # the deviation of a mean of 400 draws of 0 or 1 is 1/40
    assert set(got) == {"a", "b", None} and got["a"].mean == 0.5 and abs(got["a"].low - 0.451) < 0.02 and abs(got["a"].high - 0.549) < 0.02
    assert (got["b"].n, got["b"].low, got[None].n, got[None].mean) == (1, None, 2, 5.0)
    assert abs(metrics.POISSON[0] - np.exp(-1)) < 1e-12 and abs(metrics.POISSON[2] - 2.5 * np.exp(-1)) < 1e-12
    assert metrics.drawn_interval(df.limit(0), "k", "id", "v").count() == 0


def test_the_shared_folder_is_named_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from quillsift.operators import components

    def session(**settings):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: settings.get(k, d), set=settings.__setitem__))

    assert components.shared_dir(session(**{"spark.checkpoint.dir": "x:/y", "spark.master": "yarn"})) == "x:/y"
    for master in ("yarn", "spark://a:1", "local-cluster[2,1,900]"):
        with pytest.raises(RuntimeError):
            components.shared_dir(session(**{"spark.master": master}))
    monkeypatch.setattr(components.tempfile, "mkdtemp", lambda prefix: prefix)
    assert components.shared_dir(session(**{"spark.master": "local[4]"})) == "quillsift-"
