"""Grids, point matches and probes against plain loops."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsift.operators import compare, consensus, grids, probes
from quillsift.plans import images
from tests.helpers import rows

AWKWARD = [(90, None, 3), (91, [], 3), (92, [1.0, 2.0], 3), (93, [1.0, None, 3.0], 3), (94, [1.0, float("inf"), 3.0], 3), (95, [1.0, 2.0, 3.0], None), (96, [1.0, 2.0, 3.0], 0)]


def grids_table(spark, shapes, seed, low=0, high=1):
    rng = np.random.default_rng(seed)
    table = [(i, [float(v) for v in rng.integers(low, high + 1, h * w)], w) for i, (h, w) in enumerate(shapes)]
    table += [(100, table[0][1], table[0][2])]
    return table, spark.createDataFrame(table + AWKWARD, "id int, v array<double>, w int")


def flood(cells, steps):
    todo, found = [min(cells)], set()
    while todo:
        c = todo.pop()
        if c not in found:
            found.add(c)
            todo += [n for y, x in steps if (n := (c[0] + y, c[1] + x)) in cells]
    return found


AROUND = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)]
CROSS = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def test_components_equal_a_flood(spark):
    table, df = grids_table(spark, [(5, 7), (9, 4), (1, 6), (6, 1), (12, 12), (3, 3)], 1)
    valid = {i: [float(k % 5 != 0) for k in range(len(v))] for i, v, _ in table}
    full = spark.createDataFrame([(i, v, [float(k) for k in range(len(v))], valid[i], w) for i, v, w in table] + [(i, v, v, v, w) for i, v, w in AWKWARD], "id int, m array<double>, g array<double>, ok array<double>, w int")
    got = {r.id: r.c for r in full.select("id", grids.components("m", "g", "ok", "w", min_area=2, edge=2, ring=3, least_ring=2).alias("c")).collect()}
    assert all(got[i] is None for i, *_ in AWKWARD)
    disc = lambda r: [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if abs(x) <= round(math.sqrt(r * r - y * y))]
    for i, v, w in table:
        at = lambda k: (k // w, k % w)  # noqa: E731, B023
        left, safe, want, label = {at(k) for k, x in enumerate(v) if x}, {at(k) for k, x in enumerate(valid[i]) if x}, [], 0
        mask, everything = set(left), {at(k) for k in range(len(v))}
        while left:
            c = flood(left, AROUND)
            left -= c
            label += 1
            if len(c) < 2:
                continue
            ys, xs = [y for y, _ in c], [x for _, x in c]
            ring = {(y + a, x + b) for y, x in c for a, b in disc(3)} & safe - mask
            touches = any((y + a, x + b) in everything - safe for y, x in c for a, b in disc(2))
            mean = lambda s: sum(y * w + x for y, x in s) / len(s)  # noqa: E731, B023
            enough = len(ring) >= 2
            want.append((label, len(c), min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, touches, len(ring), mean(c) if enough else None, mean(ring) if enough else None, sorted(y * w + x for y, x in c)))
        assert [(*(r[k] for k in range(8)), r.inside and pytest.approx(r.inside), r.around and pytest.approx(r.around), r.cells) for r in got[i]] == want


@pytest.mark.parametrize("shape, length, area", [(["1"], 0, 0), (["11"], 2, 0), (["11", "11"], 4, 1), (["111", "101", "111"], 8, 4), (["010", "111", "010"], 4 * 2**0.5, 2), (["100", "010", "001"], 4 * 2**0.5, 0), (["0110", "1111", "0110"], 2 + 4 * 2**0.5, 4)])
def test_outlines(shape, length, area):
    got = grids.outline(np.array([[c == "1" for c in r] for r in shape]))
    assert got == (pytest.approx(length), pytest.approx(area))


def test_border_share_equals_a_flood(spark):
    table, df = grids_table(spark, [(5, 7), (9, 4), (6, 6), (12, 12), (1, 5)], 2)
    ring = [float(c) for c in "0000000" "0111110" "0100010" "0101010" "0100010" "0111110" "0000000"]
    more = [(200, ring, 7), (201, [0.0] * 9, 3), (202, [1.0] * 9, 3)]
    df = df.unionByName(spark.createDataFrame(more, df.schema))
    got = {r.id: r.s for r in df.select("id", grids.border_share("v", "w", margin=1).alias("s")).collect()}
    assert got[201] is got[202] is None and got[200] == 0.0 and all(got[i] is None for i, *_ in AWKWARD)
    for i, v, w in table:
        h = len(v) // w
        mask = {(k // w, k % w) for k, x in enumerate(v) if x}
        outside = flood({(y, x) for y in range(-1, h + 1) for x in range(-1, w + 1)} - mask, CROSS)
        line = [c for c in mask if any((c[0] + y, c[1] + x) in outside for y, x in CROSS)]
        on = [c for c in line if c[0] in (0, h - 1) or c[1] in (0, w - 1)]
        assert got[i] == (pytest.approx(len(on) / len(line)) if 0 < len(mask) < h * w else None)


def test_texture_equals_a_loop(spark):
    rng = random.Random(5)
    table = []
    for i, (h, w) in enumerate([(9, 8), (4, 5), (8, 8), (3, 3), (2, 2), (8, 16)]):
        table.append((i, [rng.choice((0, 3, 120, 121, rng.randrange(256))) if i else 100 for _ in range(h * w * 3)], 3 * w))
    df = spark.createDataFrame(table, "id int, v array<int>, w int")
    got = {r.id: r.t for r in df.select("id", grids.texture("v", "w", channels=3, block=4, least=8).alias("t")).collect()}
    mirror = lambda k, n: 0 if n == 1 else -k if k < 0 else 2 * (n - 1) - k if k >= n else k
    for i, v, w3 in table:
        w, h = w3 // 3, len(v) // w3
        cell = {(y, x): tuple(v[y * w3 + 3 * x : y * w3 + 3 * x + 3]) for y in range(h) for x in range(w)}
        keep = {c for c, p in cell.items() if all(6 < q < 249 for q in p)}
        grey = {c: (1868 * b + 9617 * g + 4899 * r + 8192) >> 14 for c, (b, g, r) in cell.items()}
        near = lambda y, x: grey[mirror(y, h), mirror(x, w)]  # noqa: E731, B023
        kernel = lambda y, x, k: sum(k[a][b] * near(y + a - 1, x + b - 1) for a in range(3) for b in range(3))  # noqa: E731, B023
        flat = {c: math.hypot(kernel(*c, [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]), kernel(*c, [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])) < 2 for c in cell}
        inner = [c for c in cell if 0 < c[0] < h - 1 and 0 < c[1] < w - 1]
        used = [c for c in inner if c in keep] or inner
        noise = math.sqrt(math.pi / 2) * sum(abs(kernel(*c, [[1, -2, 1], [-2, 4, -2], [1, -2, 1]])) for c in used) / len(used) / 6 if used else 0.0
        bits = []
        for y in range(0, h - 3, 4):
            for x in range(0, w - 3, 4):
                part = [grey[c] * 32 // 256 for c in keep if y <= c[0] < y + 4 and x <= c[1] < x + 4]
                if len(part) >= 9.6:
                    bits.append(-sum(part.count(k) / len(part) * math.log2(part.count(k) / len(part)) for k in set(part)))
        colours = [tuple(q >> 3 for q in p) for p in cell.values()]
        top = sorted((colours.count(c) for c in set(colours)), reverse=True)
        lap = [kernel(*c, [[0, 1, 0], [1, -4, 1], [0, 1, 0]]) for c in cell]
        mean = sum(lap) / len(lap)
        kept = keep or set(cell)
        want = (noise, sum(bits) / len(bits) if bits else None, sum(flat[c] for c in kept) / len(kept), sum(top[:16]) / (h * w), len(top) / (h * w), 1 - len(keep) / (h * w), sum((x - mean) ** 2 for x in lap) / len(lap))
        assert tuple(got[i]) == pytest.approx(want)
    _, odd = grids_table(spark, [(3, 3)], 1)
    assert all(r.t is None for r in odd.where("id BETWEEN 90 AND 99").select(grids.texture("v", "w").alias("t")).collect())


def test_resized_equals_areas(spark):
    table, df = grids_table(spark, [(5, 7), (4, 4), (9, 2), (3, 8)], 3, 0, 255)
    got = {r.id: r.a for r in df.select("id", grids.resized("v", "w", 3, 5).alias("a")).collect()}
    assert all(got[i] is None for i, *_ in AWKWARD)
    for i, v, w in table:
        h = len(v) // w
        overlap = lambda k, n, j, m: max(0.0, min((k + 1) / n, (j + 1) / m) - max(k / n, j / m)) * m
        want = [sum(v[y * w + x] * overlap(y, h, a, 3) * overlap(x, w, b, 5) for y in range(h) for x in range(w)) for a in range(3) for b in range(5)]
        assert got[i] == pytest.approx(want)
    same = df.where("id = 1").select(grids.resized("v", "w", 8, 8).alias("a")).first().a
    assert same == [table[1][1][(y // 2) * 4 + x // 2] for y in range(8) for x in range(8)]
    half = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "v array<double>").select(grids.resized("v", F.lit(2), 1, 2, whole=True).alias("a"))
    assert half.first().a == [2.0, 3.0]


def loop_equalised(v, w, clip, tiles):
    h = len(v) // w
    ph, pw = (tiles - h % tiles, tiles - w % tiles) if h % tiles or w % tiles else (0, 0)
    mirror = lambda k, n: k if k < n else 2 * (n - 1) - k
    th, tw = (h + ph) // tiles, (w + pw) // tiles
    curves = {}
    for ty in range(tiles):
        for tx in range(tiles):
            hist = [0] * 256
            for y in range(ty * th, ty * th + th):
                for x in range(tx * tw, tx * tw + tw):
                    hist[int(v[mirror(y, h) * w + mirror(x, w)])] += 1
            limit = max(int(clip * th * tw / 256), 1)
            excess = sum(max(0, n - limit) for n in hist)
            hist = [min(n, limit) + excess // 256 for n in hist]
            left = excess % 256
            if left:
                k = 0
                for _ in range(left):
                    if k > 255:
                        break
                    hist[k] += 1
                    k += max(256 // left, 1)
            total, curve = 0, []
            for n in hist:
                total += n
                curve.append(round(total * (255 / (th * tw))))
            curves[ty, tx] = curve
    out = []
    for y in range(h):
        for x in range(w):
            fy, fx = y / th - 0.5, x / tw - 0.5
            y1, x1 = math.floor(fy), math.floor(fx)
            c = lambda a, b: curves[min(max(a, 0), tiles - 1), min(max(b, 0), tiles - 1)][int(v[y * w + x])]  # noqa: E731, B023
            up = c(y1, x1) * (1 - (fx - x1)) + c(y1, x1 + 1) * (fx - x1)
            low = c(y1 + 1, x1) * (1 - (fx - x1)) + c(y1 + 1, x1 + 1) * (fx - x1)
            out.append(round(up * (1 - (fy - y1)) + low * (fy - y1)))
    return out


def test_equalised_equals_a_loop(spark):
    table, df = grids_table(spark, [(8, 8), (7, 9), (8, 6), (20, 21), (4, 4)], 4, 0, 255)
    for clip, tiles in ((2.0, 2), (40.0, 4)):
        got = {r.id: r.a for r in df.select("id", grids.equalised("v", "w", clip, tiles).alias("a")).collect()}
        assert all(got[i] is None for i, *_ in AWKWARD)
        for i, v, w in table:
            assert got[i] == loop_equalised(v, w, clip, tiles)


def test_query_of_equalised_levels(spark):
    sf = "/root/testdata/sf0.001"
    v = {r.vec_id: [float(max(0, min(255, math.floor((x + 0.5) * 256)))) for x in r.embedding] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = {r.vec_id: r.levels for r in images.equalised_levels(spark, sf).collect()}
    assert got == {i: loop_equalised(x, 8, 2.0, 2) for i, x in v.items()}


def test_rasters_equal_point_in_polygon(spark):
    rng = random.Random(8)
    table = [(i, [[rng.uniform(-5, 45) for _ in range(2 * rng.randrange(3, 8))] for _ in range(rng.randrange(1, 4))], 40.0, 30.0) for i in range(30)]
    table += [(50, None, 40.0, 30.0), (51, [[0.0, 0.0, 10.0, 10.0]], 40.0, 30.0), (52, [[0.0, 0.0, 10.0, 10.0, 20.0, 20.0], None, [1.0]], 40.0, 30.0), (53, [], 0.0, 30.0), (54, [], 40.0, 30.0)]
    df = spark.createDataFrame(table, "id int, rings array<array<double>>, w double, h double")
    got = {r.id: r.c for r in df.select("id", grids.rasterised("rings", "w", "h", 12).alias("c")).collect()}
    assert got[50] is got[53] is None and got[51] == got[52] == got[54] == []
    for i, rings, w, h in table[:30]:
        want = set()
        polygons = []
        for r in rings:
            p = list(zip(r[::2], r[1::2]))
            if abs(sum(a * d - c * b for (a, b), (c, d) in zip(p, p[1:] + p[:1]))) / 2 >= 1:
                polygons.append([(round(x * (12 / w)), round(y * (12 / h))) for x, y in p])
        for y in range(12):
            for x in range(12):
                odd, on = False, False
                for p in polygons:
                    for (a, b), (c, d) in zip(p, p[1:] + p[:1]):
                        if (b > y) != (d > y) and x < a + (c - a) * (y - b) / (d - b):
                            odd = not odd
                        on |= (c - a) * (y - b) == (x - a) * (d - b) and min(a, c) <= x <= max(a, c) and min(b, d) <= y <= max(b, d)
                if odd or on:
                    want.add(y * 12 + x)
        assert set(got[i]) == want


def test_draws_are_different_numbers_by_md5():
    got = consensus.draws("k", 9, 200, 42)
    for i, row in enumerate(got):
        raw = hashlib.md5(f"42:k:{i}".encode()).digest()
        left, want = list(range(9)), []
        for k in range(4):
            want.append(left.pop(int.from_bytes(raw[4 * k : 4 * k + 4], "big") % len(left)))
        assert row.tolist() == want


def test_consensus_draws_until_it_is_found(spark):
    rng, wrong = random.Random(8), [(7 * i + 30978) % 10 < 6 for i in range(32)]
    assert not any(not any(wrong[i] for i in draw) for draw in consensus.draws("30978", 32, 512, 42))  # none of the first draws is all true
    m = []
    for i in range(32):
        x, y = rng.gauss(320, 100), rng.gauss(240, 75)
        m.append((1.1 * x - 0.1 * y + 5 + (60.0 + i * 37 % 97 if wrong[i] else 0), 0.1 * x + 0.9 * y - 3 - (40.0 + i * 53 % 89 if wrong[i] else 0), x, y))
    df = spark.createDataFrame([("30978", m)], "key string, m array<struct<x1:double,y1:double,x2:double,y2:double>>")
    got = consensus.consensus(df, "key", "m", least=10).first()
    assert got.inliers == [i for i in range(32) if not wrong[i]] and got.reason is None and abs(got.h[0][2] - 5) < 1e-6
    hopeless = np.random.default_rng(9).uniform(0, 500, (30, 4))
    assert 4 <= consensus.fit("k", hopeless, 512, 4.0, 42)["n_inliers"] < 10  # ends all the same


def test_consensus_agrees_with_a_loop(spark):
    rng = random.Random(3)
    true = np.array([[1.05, 0.04, 12.0], [-0.03, 0.97, -7.0], [1e-5, -2e-5, 1.0]])
    move = lambda x, y: (lambda q: (float(q[0] / q[2]), float(q[1] / q[2])))(true @ (x, y, 1))
    table = []
    for k in range(6):
        m = []
        for i in range(40):
            x, y = rng.uniform(0, 640), rng.uniform(0, 480)
            u, v = move(x, y)
            wrong = i % 10 < k
            m.append((u + rng.gauss(0, 0.5) + (rng.uniform(30, 200) if wrong else 0), v + rng.gauss(0, 0.5), x, y))
        table.append((f"p{k}", m))
    mirrored = [(-x, y, x, y) for _, _, x, y in table[0][1]]
    table += [("few", table[0][1][:3]), ("none", None), ("mirrored", mirrored), ("line", [(float(i), 2.0 * i, float(i), 2.0 * i) for i in range(20)]), ("nulls", [(None, 1.0, 1.0, 1.0), None, *table[0][1][:15]])]
    df = spark.createDataFrame(table, "key string, m array<struct<x1:double,y1:double,x2:double,y2:double>>")
    got = {r.key: r for r in consensus.consensus(df, "key", "m", count=200).collect()}
    assert {k: got[k].reason for k in ("few", "none", "mirrored", "line")} == {"few": "too few matches", "none": "too few matches", "mirrored": "mirrored", "line": "no matrix"}
    assert all(got[k].h is None for k in ("few", "none", "mirrored", "line")) and got["nulls"].n_matches == 15
    for key, m in table[:6]:
        p = np.array(m)
        best = 0
        for draw in consensus.draws(key, len(m), 200, 42):
            a = []
            for x1, y1, x2, y2 in p[draw]:
                a += [[x2, y2, 1, 0, 0, 0, -x1 * x2, -x1 * y2, -x1], [0, 0, 0, x2, y2, 1, -y1 * x2, -y1 * y2, -y1]]
            h = np.linalg.svd(np.array(a))[2][-1].reshape(3, 3)
            q = np.column_stack([p[:, 2:], np.ones(len(p))]) @ h.T
            best = max(best, int((np.linalg.norm(q[:, :2] / q[:, 2:] - p[:, :2], axis=1) <= 4.0).sum()))
        assert got[key].reason is None and abs(got[key].n_inliers - best) <= 1 and got[key].inliers == sorted(got[key].inliers)
        assert np.abs(np.array(got[key].h) - true)[:2].max() < 2 and got[key].reproj_error < 1.5


def test_valid_cells_equal_a_loop(spark):
    hs = [[[1.1, 0.0, 3.0], [0.1, 0.9, -2.0], [0.01, 0.0, 1.0]], [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [[0.0] * 3] * 3, None]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hs)], "id int, h array<array<double>>")
    got = {r.id: r.c for r in df.select("id", consensus.valid_cells(F.col("h"), *map(F.lit, (9, 7, 8, 6))).alias("c")).collect()}
    assert got[2] is got[3] is None
    for i in (0, 1):
        inverse, want = np.linalg.inv(np.array(hs[i])), []
        for y in range(7):
            for x in range(9):
                q = inverse @ (x, y, 1)
                u, v = np.rint(q[:2] / q[2])
                want += [y * 9 + x] if 0 <= u < 8 and 0 <= v < 6 else []
        assert got[i] == want
    with pytest.raises(ValueError):
        consensus.valid_region(F.lit(1), F.lit(2), "cavity of something")


def loop_tree(data, depth, path=""):
    """data: (features, y); gives {path: (feature, threshold)} and {path: class}."""
    ones = sum(y for _, y in data)
    best = None
    if len(path) < depth and 0 < ones < len(data):
        for f in range(len(data[0][0])):
            values = sorted({x[f] for x, _ in data})
            for a, b in zip(values, values[1:]):
                parts = [[y for x, y in data if (x[f] <= (a + b) / 2) == side] for side in (True, False)]
                pure = sum((sum(p) ** 2 + (len(p) - sum(p)) ** 2) / len(p) for p in parts)
                if best is None or pure > best[0] + 1e-9:
                    best = (pure, f, (a + b) / 2)
    if best is None:
        return {}, {path: int(2 * ones > len(data))}
    _, f, cut = best
    splits, leaves = {path: (f, cut)}, {}
    for side, name in ((True, "L"), (False, "R")):
        s, e = loop_tree([(x, y) for x, y in data if (x[f] <= cut) == side], depth, path + name)
        splits |= s
        leaves |= e
    return splits, leaves


def test_trees_equal_a_loop(spark):
    rng = random.Random(11)
    data = [(rng.randrange(2), rng.randrange(6), rng.randrange(3), int(rng.random() < 0.3), i % 3) for i in range(300)]
    data = [(a, b, c, y | (b > 3 and a), fold) for a, b, c, y, fold in data]
    df = spark.createDataFrame([*data, (None, 1, 1, 1, 0), (1, 1, 1, None, 0)], "a int, b int, c int, y int, fold int")
    trees, cells = probes.grown_trees(df, ["a", "b", "c"], "y", "fold", 3, 3)
    counts = {}
    for model in range(4):
        splits, leaves = loop_tree([(r[:3], r[3]) for r in data if r[4] != model], 3)
        assert {n: s for (m, n), s in trees.splits.items() if m == model} == splits
        assert {n: s for (m, n), s in trees.leaves.items() if m == model} == leaves
        for r in data:
            if r[4] == model:
                node = ""
                while node in splits:
                    node += "L" if r[splits[node][0]] <= splits[node][1] else "R"
                counts[r[3], leaves[node]] = counts.get((r[3], leaves[node]), 0) + 1
    assert {(r.y, r.predicted): r.n for r in probes.pooled(trees, cells).collect()} == counts
    lines = trees.rules(3)
    assert lines[0].startswith("|--- ") and sum("class" in x for x in lines) == len([1 for m, _ in trees.leaves if m == 3])


def test_tree_without_rows_or_without_choice(spark):
    df = spark.createDataFrame([(1, 1, 0)] * 4, "a int, y int, fold int")
    trees, cells = probes.grown_trees(df, ["a"], "y", "fold", 2, 3)
    assert trees.rules(2) == ["|--- class: 1"] and not trees.splits
    trees, cells = probes.grown_trees(df.limit(0), ["a"], "y", "fold", 2, 3)
    assert not trees.leaves and rows(probes.pooled(trees, cells)) == []


def test_linear_probe_equals_one_process(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    y = (x[:, :3] + rng.normal(size=(400, 3)) * 0.5).argmax(1)
    df = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y)] + [([1.0], 1), (None, 1), ([1.0, None, 1.0, 1.0, 1.0], 1), ([1.0] * 5, None), ([1.0] * 5, 7)], "v array<double>, y int").repartition(5)
    w = probes.linear_weights(df, "v", "y", 3, 5, steps=15, tolerance=0.0)
    design, penalty, want = np.column_stack([x, np.ones(400)]), np.diag([1.0] * 5 + [1e-9]), np.zeros((3, 6))
    losses = []
    for _ in range(15):
        e = np.exp(design @ want.T)
        p = e / e.sum(1, keepdims=True)
        losses.append(-np.log(p[np.arange(400), y]).sum() + (want[:, :5] ** 2).sum() / 2)
        want = want - ((p - np.eye(3)[y]).T @ design + want @ penalty) @ np.linalg.inv(design.T @ design / 2 + penalty)
    assert np.allclose(w, want) and losses == sorted(losses, reverse=True)  # no step overshoots
    got = probes.linear_predictions(df.where("y < 3"), "v", w).collect()
    assert [r.predicted for r in got if r.v and len(r.v) == 5 and None not in r.v] == [int((np.append(r.v, 1) @ w.T).argmax()) for r in got if r.v and len(r.v) == 5 and None not in r.v]
    assert [r.predicted for r in got if r.v is None or len(r.v) != 5] == [None, None]
    assert sum(r.predicted == r.y for r in got) > 300


def test_query_of_the_source_probe(spark):
    r = images.source_probe(spark, "/root/testdata/sf0.001").collect()
    assert sum(x.n for x in r) > 100 and r[0].accuracy == round(sum(x.n for x in r if x.label == x.predicted) / sum(x.n for x in r), 6) and r[0].chance == 0.1


def test_cell_overlaps(spark):
    a = spark.createDataFrame([(1, 1, 2, [0, 1]), (1, 2, 2, [5, 6]), (2, 1, 1, [0])], "pair int, idx long, area int, cells array<int>")
    b = spark.createDataFrame([(1, 1, 3, [1, 2, 5]), (2, 1, 1, [3])], "pair int, idx long, area int, cells array<int>")
    assert rows(compare.cell_overlaps(a, b, "pair")) == [(1, 1, 1, 0.25), (1, 2, 1, 0.25)]
