"""Queries over grids, point matches and probes; ``embeddings`` gives grids of 8 x 8 numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsift.functions import scalars as S
from quillsift.operators import compare, consensus, filters, grids, groups, hamming, metrics, probes
from quillsift.operators.components import written
from quillsift.plans.base import query, r6, t
from quillsift.sources import scans

_SIDE = 8
#: A cell is in the mask above the first number, and valid above the second.
_MASK, _VALID = 0.1, -0.2

_CELLS_SQL = f"""
cells AS (SELECT vec_id, i - 1 AS i, (i - 1) // {_SIDE} AS y, (i - 1) % {_SIDE} AS x, embedding[i]::DOUBLE AS v, embedding[i]::DOUBLE > {_MASK} AS m, embedding[i]::DOUBLE > {_VALID} AS ok
          FROM embeddings, (SELECT unnest(range(1, {_SIDE * _SIDE + 1})) AS i) AS n)"""


def _numbers(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _masks(spark, sf_dir):
    over = lambda limit: F.transform("v", lambda x: (x > limit).cast("int"))
    return _numbers(spark, sf_dir).select("vec_id", "label", "v", over(_MASK).alias("mask"), over(_VALID).alias("valid"))


def _offsets(radius):
    return ", ".join(map(str, grids.disc(radius)))


_REACH_SQL = f"""
WITH RECURSIVE {_CELLS_SQL},
reach(vec_id, root, i, y, x) AS (
  SELECT vec_id, i, i, y, x FROM cells WHERE m
  UNION SELECT r.vec_id, r.root, c.i, c.y, c.x FROM reach AS r JOIN cells AS c ON c.vec_id = r.vec_id AND c.m AND abs(c.y - r.y) <= 1 AND abs(c.x - r.x) <= 1),
member AS (SELECT vec_id, i, y, x, min(root) AS root FROM reach GROUP BY ALL)"""


@query(f"""{_REACH_SQL},
near(dy, dx) AS (VALUES {_offsets(1)}), wide(dy, dx) AS (VALUES {_offsets(2)}),
touch AS (SELECT DISTINCT m.vec_id, root FROM member AS m, near JOIN cells AS c ON c.vec_id = m.vec_id AND c.y = m.y + dy AND c.x = m.x + dx WHERE NOT c.ok),
ring AS (SELECT DISTINCT m.vec_id, root, c.i, c.v FROM member AS m, wide JOIN cells AS c ON c.vec_id = m.vec_id AND c.y = m.y + dy AND c.x = m.x + dx WHERE NOT c.m AND c.ok),
ringed AS (SELECT vec_id, root, count(*) AS ring, avg(v) AS around FROM ring GROUP BY ALL),
found AS (SELECT vec_id, root, count(*) AS area, min(m.x) AS l, min(m.y) AS t, max(m.x) AS r, max(m.y) AS b, avg(v) AS inside FROM member AS m JOIN cells USING (vec_id, i) GROUP BY ALL)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY root)::INT AS label, area::INT AS area, l::INT AS "left", t::INT AS top, (r - l + 1)::INT AS width, (b - t + 1)::INT AS height,
       touch.root IS NOT NULL AS touches, coalesce(ring, 0)::INT AS ring, CASE WHEN ring >= 3 THEN round(inside - around, 6) END AS contrast
FROM found LEFT JOIN ringed USING (vec_id, root) LEFT JOIN touch USING (vec_id, root)""")
def mask_components(spark, sf_dir):
    """Every component of each thresholded grid with its box, its contact with what is not comparable, and its contrast to the ring around it."""
    c = grids.components("mask", "v", "valid", F.lit(_SIDE), edge=1, ring=2, least_ring=3)
    d = _masks(spark, sf_dir).select("vec_id", F.explode(c).alias("c"))
    return d.select("vec_id", *(f"c.{x}" for x in ("label", "area", "left", "top", "width", "height", "touches", "ring")), r6(F.col("c.inside") - F.col("c.around")).alias("contrast"))


@query(f"""WITH RECURSIVE {_CELLS_SQL},
frame AS (SELECT vec_id, y, x FROM (SELECT DISTINCT vec_id FROM cells), (SELECT unnest(range(-1, {_SIDE + 1})) AS y), (SELECT unnest(range(-1, {_SIDE + 1})) AS x)),
back AS (SELECT vec_id, f.y, f.x FROM frame AS f LEFT JOIN cells AS c USING (vec_id, y, x) WHERE NOT coalesce(c.m, false)),
outside(vec_id, y, x) AS (
  SELECT vec_id, y, x FROM back WHERE y = -1 AND x = -1
  UNION SELECT b.vec_id, b.y, b.x FROM outside AS o JOIN back AS b ON b.vec_id = o.vec_id AND abs(b.y - o.y) + abs(b.x - o.x) = 1),
line AS (SELECT DISTINCT c.vec_id, c.y, c.x FROM cells AS c JOIN outside AS o ON o.vec_id = c.vec_id AND abs(c.y - o.y) + abs(c.x - o.x) = 1 WHERE c.m),
share AS (SELECT vec_id, avg((y < 1 OR y >= {_SIDE - 1} OR x < 1 OR x >= {_SIDE - 1})::INT) AS share FROM line GROUP BY vec_id),
size AS (SELECT vec_id, count(*) FILTER (m) AS n FROM cells GROUP BY vec_id)
SELECT vec_id, CASE WHEN n BETWEEN 1 AND {_SIDE * _SIDE - 1} THEN round(share, 6) END AS share, CASE WHEN n BETWEEN 1 AND {_SIDE * _SIDE - 1} THEN share >= 0.5 END AS clipped FROM size LEFT JOIN share USING (vec_id)""")
def mask_on_border(spark, sf_dir):
    """Share of each mask's outline that lies on the frame, and whether the region runs off it; null for empty and full masks."""
    d = _masks(spark, sf_dir).select("vec_id", grids.border_share("mask", F.lit(_SIDE), margin=1).alias("share"))
    return d.select("vec_id", r6(F.col("share")).alias("share"), (F.col("share") >= 0.5).alias("clipped"))


@query(f"""{_REACH_SQL},
labelled AS (SELECT vec_id // 2 AS pair, vec_id % 2 AS visit, i, row_number, area FROM (
  SELECT vec_id, i, dense_rank() OVER (PARTITION BY vec_id ORDER BY root) AS row_number, count(*) OVER (PARTITION BY vec_id, root) AS area FROM member)),
o AS (SELECT a.pair, a.row_number AS i, b.row_number AS j, count(*) / (max(a.area) + max(b.area) - count(*)) AS iou FROM labelled AS a JOIN labelled AS b USING (pair, i) WHERE a.visit = 0 AND b.visit = 1 GROUP BY ALL),
e AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY iou DESC, i DESC, j DESC) AS n FROM o WHERE iou >= 0.1),
walk(pair, n, i, j, iou, used_i, used_j, take) AS (
  SELECT pair, n, i, j, iou, [i], [j], true FROM e WHERE n = 1
  UNION ALL SELECT e.pair, e.n, e.i, e.j, e.iou, CASE WHEN free THEN used_i || [e.i] ELSE used_i END, CASE WHEN free THEN used_j || [e.j] ELSE used_j END, free
  FROM (SELECT w.*, NOT list_contains(used_i, e.i) AND NOT list_contains(used_j, e.j) AS free FROM walk AS w JOIN e ON e.pair = w.pair AND e.n = w.n + 1) AS w JOIN e ON e.pair = w.pair AND e.n = w.n + 1)
SELECT pair, i::BIGINT AS i, j::BIGINT AS j, round(iou, 6) AS iou, 'persistent' AS state FROM walk WHERE take
UNION ALL SELECT DISTINCT pair, row_number, NULL, NULL, 'resolved' FROM labelled AS l WHERE visit = 0 AND NOT EXISTS (SELECT 1 FROM walk AS w WHERE take AND w.pair = l.pair AND w.i = l.row_number)
UNION ALL SELECT DISTINCT pair, NULL, row_number, NULL, 'new' FROM labelled AS l WHERE visit = 1 AND NOT EXISTS (SELECT 1 FROM walk AS w WHERE take AND w.pair = l.pair AND w.j = l.row_number)""")
def component_matches(spark, sf_dir):
    """Components of two masks matched one to one by overlap, largest first: persistent, resolved and new ones of each pair of grids."""
    c = grids.components("mask", "v", "valid", F.lit(_SIDE), edge=1, ring=2)
    d = _masks(spark, sf_dir).select((F.floor(F.col("vec_id") / 2)).alias("pair"), (F.col("vec_id") % 2).alias("visit"), F.explode(c).alias("c"))
    d = written(d.select("pair", "visit", F.col("c.label").cast("long").alias("idx"), F.col("c.area").alias("area"), F.col("c.cells").alias("cells")), "components")
    a, b = d.where("visit = 0"), d.where("visit = 1")
    m = compare.greedy_match(compare.cell_overlaps(a, b, "pair"), "pair")
    return compare.match_states(a, b, m, "pair").withColumn("iou", r6(F.col("iou")))


#: Grey levels of a vector's numbers.
_LEVELS_SQL = "greatest(0, least(255, floor((v + 0.5) * 256)))::INT"


def _levels():
    return F.transform("v", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x + 0.5) * 256))).cast("int"))


#: Score ramps of drawn pictures: (value that scores 0, value that scores 1), and their weights. Fixed values.
RAMPS = {"entropy": (3.4, 1.5, 0.40), "flat": (0.02, 0.25, 0.35), "noise": (2.0, 0.25, 0.15), "distinct_share": (0.12, 0.01, 0.10)}


def _ramp_sql(name):
    low, high, weight = RAMPS[name]
    return f"{weight} * coalesce(greatest(0, least(1, ({name} - {low}) / ({high} - {low}))), 0)"


_MIRROR_SQL = f"CASE WHEN {{0}} < 0 THEN -{{0}} WHEN {{0}} > {_SIDE - 1} THEN {2 * (_SIDE - 1)} - {{0}} ELSE {{0}} END"


@query(f"""
WITH {_CELLS_SQL},
g AS (SELECT vec_id, y, x, {_LEVELS_SQL} AS g FROM cells),
k AS (SELECT *, g > 6 AND g < 249 AS keep FROM g),
o AS (SELECT unnest(range(-1, 2)) AS dy), p AS (SELECT unnest(range(-1, 2)) AS dx),
s AS (SELECT k.vec_id, k.y, k.x, any_value(k.keep) AS keep, any_value(k.g) AS g,
    sum(n.g * (CASE WHEN dy = 0 THEN 2 ELSE -1 END) * (CASE WHEN dx = 0 THEN 2 ELSE -1 END)) AS second, sum(n.g * CASE WHEN dy = 0 AND dx = 0 THEN -4 WHEN dy = 0 OR dx = 0 THEN 1 ELSE 0 END) AS laplace,
    sum(n.g * dy * (2 - abs(dx))) AS down, sum(n.g * dx * (2 - abs(dy))) AS across
  FROM k, o, p JOIN g AS n ON n.vec_id = k.vec_id AND n.y = ({_MIRROR_SQL.format("(k.y + dy)")}) AND n.x = ({_MIRROR_SQL.format("(k.x + dx)")}) GROUP BY k.vec_id, k.y, k.x),
h AS (SELECT vec_id, count(*) AS n FROM k WHERE keep GROUP BY vec_id, g * 32 // 256),
e AS (SELECT vec_id, sum(n) AS n, -sum(n / t * log2(n / t)) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY vec_id) AS t FROM h) GROUP BY vec_id),
c AS (SELECT vec_id, count(*) AS n, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC) AS r FROM g GROUP BY vec_id, g >> 3),
d AS (SELECT vec_id, sum(n) FILTER (r <= 16) / 64 AS top_share, count(*) / 64 AS distinct_share FROM c GROUP BY vec_id),
f AS (SELECT vec_id, sqrt(pi() / 2) * coalesce(avg(abs(second)) FILTER (keep AND inner_cell), avg(abs(second)) FILTER (inner_cell)) / 6 AS noise, coalesce(avg(flat) FILTER (keep), avg(flat)) AS flat, avg((NOT keep)::INT) AS clipped, stddev_pop(laplace) AS sharpness
  FROM (SELECT *, y BETWEEN 1 AND {_SIDE - 2} AND x BETWEEN 1 AND {_SIDE - 2} AS inner_cell, (sqrt(down * down + across * across) < 2)::INT AS flat FROM s) GROUP BY vec_id),
a AS (SELECT vec_id, noise, CASE WHEN e.n >= 38.4 THEN entropy END AS entropy, flat, top_share, distinct_share, clipped, sharpness FROM f JOIN d USING (vec_id) LEFT JOIN e USING (vec_id)),
q AS (SELECT *, {" + ".join(map(_ramp_sql, RAMPS))} AS score FROM a)
SELECT vec_id, round(noise, 6) AS noise, round(entropy, 6) AS entropy, round(flat, 6) AS flat, round(top_share, 6) AS top_share, round(distinct_share, 6) AS distinct_share, round(clipped, 6) AS clipped, round(sharpness, 6) AS sharpness,
       round(score, 4) AS score, CASE WHEN round(clipped, 4) >= 0.6 THEN 'clipped' WHEN round(score, 4) >= 0.7 THEN 'synthetic' ELSE 'photo' END AS proposed_label FROM q""")
def grid_texture(spark, sf_dir):
    """Noise, block entropy, flat and palette shares and sharpness of each grid, and the quality score and label made of them."""
    d = _numbers(spark, sf_dir).select("vec_id", grids.texture(_levels(), F.lit(_SIDE), block=_SIDE).alias("m")).select("vec_id", "m.*")
    score = sum((F.lit(w) * F.coalesce(S.ramp(F.col(x), low, high), F.lit(0.0)) for x, (low, high, w) in RAMPS.items()), F.lit(0.0))
    d = d.withColumn("score", F.round(score, 4)).withColumn("clip_frac", F.round("clipped", 4))
    d = d.withColumn("proposed_label", filters.quality_label("clip_frac", "score"))
    return d.select("vec_id", *(r6(F.col(x)).alias(x) for x in ("noise", "entropy", "flat", "top_share", "distinct_share", "clipped")), r6(F.sqrt("sharpness")).alias("sharpness"), "score", "proposed_label")


_HASH_SQL = f"""{_CELLS_SQL},
basis AS (SELECT u, r, sum(cos(pi() * (2 * x + 1) * u / 64)) * sqrt(CASE WHEN u = 0 THEN 1 ELSE 2 END / 32.0::DOUBLE) AS w
          FROM (SELECT unnest(range(0, 8)) AS u), (SELECT unnest(range(0, 32)) AS x), (SELECT unnest(range(0, {_SIDE})) AS r) WHERE x // 4 = r GROUP BY u, r),
turns AS (SELECT unnest(range(0, 8)) AS form),
turned AS (SELECT vec_id, form, v,
    CASE form WHEN 0 THEN y WHEN 1 THEN 7 - x WHEN 2 THEN 7 - y WHEN 3 THEN x WHEN 4 THEN y WHEN 5 THEN x WHEN 6 THEN 7 - y WHEN 7 THEN 7 - x END AS y,
    CASE form WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 7 - x WHEN 3 THEN 7 - y WHEN 4 THEN 7 - x WHEN 5 THEN y WHEN 6 THEN x WHEN 7 THEN 7 - y END AS x FROM cells, turns),
half AS (SELECT vec_id, form, b.u, t.x, sum(b.w * v) AS s FROM turned AS t JOIN basis AS b ON b.r = t.y GROUP BY ALL),
low AS (SELECT vec_id, form, h.u * 8 + b.u AS place, sum(b.w * s) AS c FROM half AS h JOIN basis AS b ON b.r = h.x GROUP BY ALL),
bits AS (SELECT vec_id, form, place, c > median(c) OVER (PARTITION BY vec_id, form) AS bit FROM low WHERE place > 0),
hashes AS (SELECT vec_id, form, sum(CASE WHEN bit THEN 1::BIGINT << (63 - place) ELSE 0 END)::BIGINT AS fp FROM bits GROUP BY vec_id, form)"""


def _hashes(spark, sf_dir):
    d = _numbers(spark, sf_dir).where(F.size("v") == _SIDE * _SIDE)
    return d.select("vec_id", "label", hamming.grid_hashes(grids.resized("v", F.lit(_SIDE))).alias("forms"))


@query(f"""WITH {_HASH_SQL} SELECT vec_id, form::INT AS form, fp FROM hashes""")
def resized_hashes(spark, sf_dir):
    """Each grid at 32 x 32 and its hashes in all eight turned and mirrored forms."""
    return _hashes(spark, sf_dir).select("vec_id", F.posexplode("forms").alias("form", "fp"))


@query(f"""WITH {_HASH_SQL}, d AS (SELECT DISTINCT vec_id, fp FROM hashes)
SELECT DISTINCT a.vec_id AS owner_a, b.vec_id AS owner_b FROM d AS a JOIN d AS b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.fp, b.fp)) <= 12""")
def turned_alike(spark, sf_dir):
    """Pairs of grids that are near copies of each other in any turned or mirrored form."""
    d = written(_hashes(spark, sf_dir).select("vec_id", "forms"), "forms")
    return hamming.owner_pairs(d, "vec_id", "forms", 12)


#: Matches of a pair: 32 points of a vector, moved by the pair's drawn matrix; some are false.
_WIDTH, _HEIGHT = 640.0, 480.0


def _matches(spark, sf_dir):
    d = _numbers(spark, sf_dir).where(F.size("v") == 64).withColumn("h_true", S.drawn_homography("vec_id", F.lit(_WIDTH), F.lit(_HEIGHT), 10.0, (0.9, 1.1), 0.05, 0.02))
    share = F.when(F.col("vec_id") % 9 == 0, 6).otherwise(3)  # false ones of ten
    n = F.when(F.col("vec_id") % 50 == 0, 3).otherwise(32)

    def match(i):
        x, y = F.element_at("v", (2 * i + 1).cast("int")) * 800 + 320, F.element_at("v", (2 * i + 2).cast("int")) * 600 + 240
        p = S.project("h_true", x, y)
        wrong = (i * 7 + F.col("vec_id")) % 10 < share
        return F.struct((p["x"] + F.when(wrong, 60.0 + (i * 37) % 97).otherwise(0.0)).alias("x1"), (p["y"] - F.when(wrong, 40.0 + (i * 53) % 89).otherwise(0.0)).alias("y1"), x.alias("x2"), y.alias("y2"))

    return d.select("vec_id", "h_true", F.transform(F.sequence(F.lit(0), n - 1), match).alias("matches"))


@query("""
WITH m AS (SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN 3 ELSE 32 END AS n, CASE WHEN vec_id % 9 = 0 THEN 6 ELSE 3 END AS share FROM embeddings),
i AS (SELECT vec_id, any_value(n)::INT AS n_matches, count(*) FILTER ((i * 7 + vec_id) % 10 >= share)::INT AS n FROM (SELECT *, unnest(range(0, n)) AS i FROM m) GROUP BY vec_id),
r AS (SELECT vec_id, n_matches, CASE WHEN n_matches < 4 THEN 0 ELSE n END AS n_inliers, CASE WHEN n_matches < 4 THEN 'too few matches' WHEN n < 15 THEN 'too few inliers' END AS reason FROM i)
SELECT vec_id, n_matches, n_inliers, round(n_inliers / n_matches, 6) AS inlier_ratio, reason, CASE WHEN reason IS NULL THEN 0.0::DOUBLE END AS corner_error FROM r""")
def consensus_matrices(spark, sf_dir):
    """The matrix of each pair of photos, found among false matches: those that agree, and how far its corners are from the planted matrix."""
    d = consensus.consensus(_matches(spark, sf_dir), "vec_id", "matches")
    return d.select("vec_id", "n_matches", "n_inliers", r6(F.col("inlier_ratio")).alias("inlier_ratio"), "reason", F.round(S.corner_error("h_true", "h", F.lit(_WIDTH), F.lit(_HEIGHT)), 4).alias("corner_error"))


#: A frame of 12 x 9 cells, a second one of 10 x 8, and a matrix with scale, shift and a perspective term of the vector's numbers.
_FRAME, _SECOND = (12, 9), (10, 8)


@query(f"""
WITH {_CELLS_SQL},
h AS (SELECT vec_id, 1.0::DOUBLE + embedding[1] AS sx, 1.0::DOUBLE + embedding[2] AS sy, 8.0::DOUBLE * embedding[3] AS tx, 8.0::DOUBLE * embedding[4] AS ty, 0.05::DOUBLE * embedding[5] AS g FROM embeddings),
f AS (SELECT h.*, x, y, (x - tx) / (sx - g * (x - tx)) AS u FROM h, (SELECT unnest(range(0, {_FRAME[0]})) AS x) AS a, (SELECT unnest(range(0, {_FRAME[1]})) AS y) AS b),
p AS (SELECT *, (y * (g * u + 1) - ty) / sy AS w FROM f),
c AS (SELECT p.vec_id, count(*) FILTER (inside) AS n_frame, count(*) FILTER (coalesce(m, false)) AS n_mask, count(*) FILTER (inside AND coalesce(m, false)) AS n_both
  FROM (SELECT *, round_even(u, 0) BETWEEN 0 AND {_SECOND[0] - 1} AND round_even(w, 0) BETWEEN 0 AND {_SECOND[1] - 1} AS inside FROM p) AS p LEFT JOIN (SELECT * FROM cells WHERE vec_id % 3 <> 0) AS k USING (vec_id, y, x) GROUP BY p.vec_id)
SELECT vec_id, n_frame::INT AS n_frame, n_mask::INT AS n_mask, (CASE WHEN n_mask = 0 THEN n_frame ELSE n_both END)::INT AS n_valid, CASE WHEN n_mask = 0 THEN 'frame_intersection (no mask)' ELSE 'mask_and_frame' END AS source FROM c""")
def valid_regions(spark, sf_dir):
    """Cells where two photos may be compared: in both frames and in the mask; without a mask the frames alone, and why."""
    v = lambda i: F.col("v")[i]
    row = lambda *x: F.array(*(F.lit(c) if isinstance(c, float) else c for c in x))
    shift, slant = (8.0 * v(2), 8.0 * v(3)), 0.05 * v(4)
    h = row(row(1.0 + v(0) + shift[0] * slant, 0.0, shift[0]), row(0.0, 1.0 + v(1), shift[1]), row(slant, 0.0, 1.0))
    # the mask's cells in the frame's numbering; every third photo has none
    mask = F.filter(F.transform("mask", lambda m, i: F.when(m == 1, F.floor(i / _SIDE).cast("int") * _FRAME[0] + i % _SIDE)), lambda i: i.isNotNull())
    d = _masks(spark, sf_dir).withColumn("frame", consensus.valid_cells(h, *map(F.lit, (*_FRAME, *_SECOND)))).withColumn("cells", F.when(F.col("vec_id") % 3 != 0, mask).otherwise(F.array().cast("array<int>")))
    both, source = consensus.valid_region(F.col("frame"), F.col("cells"), "mask_and_frame")
    return d.select("vec_id", F.size("frame").alias("n_frame"), F.size("cells").alias("n_mask"), F.size(both).alias("n_valid"), source.alias("source"))


#: Rings of a photo of 100 x 80: six and four points of a vector; drawn into 16 x 16 cells.
_PHOTO, _RASTER = (100.0, 80.0), 16
_RINGS = ((0, 6), (6, 4))


def _rasters(spark, sf_dir):
    point = lambda i: F.array((F.get("v", F.lit(2 * i)) + 0.5) * _PHOTO[0], (F.get("v", F.lit(2 * i + 1)) + 0.5) * _PHOTO[1])
    rings = F.array(*(F.concat(*(point(first + i) for i in range(n))) for first, n in _RINGS))
    return _numbers(spark, sf_dir).where(F.size("v") == 64).select("vec_id", grids.rasterised(rings, F.lit(_PHOTO[0]), F.lit(_PHOTO[1]), _RASTER).alias("cells"))


_RASTER_SQL = f"""
pts AS (SELECT vec_id, ring, k, n, (embedding[2 * (first + k) + 1]::DOUBLE + 0.5) * {_PHOTO[0]} AS x, (embedding[2 * (first + k) + 2]::DOUBLE + 0.5) * {_PHOTO[1]} AS y
        FROM embeddings, (SELECT *, unnest(range(0, n)) AS k FROM (VALUES {", ".join(f"({i}, {a}, {n})" for i, (a, n) in enumerate(_RINGS))}) AS r(ring, first, n)) AS k),
sides AS (SELECT a.vec_id, a.ring, a.x AS x, a.y AS y, b.x AS x2, b.y AS y2 FROM pts AS a JOIN pts AS b ON a.vec_id = b.vec_id AND a.ring = b.ring AND b.k = (a.k + 1) % a.n),
large AS (SELECT vec_id, ring FROM sides GROUP BY ALL HAVING abs(sum(x * y2 - x2 * y)) / 2 >= 1),
s AS (SELECT vec_id, round_even(x * ({_RASTER} / {_PHOTO[0]}::DOUBLE), 0)::INT AS xa, round_even(y * ({_RASTER} / {_PHOTO[1]}::DOUBLE), 0)::INT AS ya, round_even(x2 * ({_RASTER} / {_PHOTO[0]}::DOUBLE), 0)::INT AS xb, round_even(y2 * ({_RASTER} / {_PHOTO[1]}::DOUBLE), 0)::INT AS yb FROM sides JOIN large USING (vec_id, ring)),
grid AS (SELECT gx, gy FROM (SELECT unnest(range(0, {_RASTER})) AS gx) AS a, (SELECT unnest(range(0, {_RASTER})) AS gy) AS b),
c AS (SELECT vec_id, gy * {_RASTER} + gx AS cell FROM s, grid GROUP BY vec_id, gx, gy
  HAVING count(*) FILTER ((ya > gy) <> (yb > gy) AND gx < xa + (xb - xa) * (gy - ya)::DOUBLE / nullif(yb - ya, 0)) % 2 = 1
    OR bool_or((xb - xa) * (gy - ya) = (gx - xa) * (yb - ya) AND gx BETWEEN least(xa, xb) AND greatest(xa, xb) AND gy BETWEEN least(ya, yb) AND greatest(ya, yb)))"""


@query(f"""WITH {_RASTER_SQL} SELECT vec_id, list(cell ORDER BY cell)::INT[] AS cells FROM c GROUP BY vec_id""")
def drawn_rings(spark, sf_dir):
    """The cells that each photo's rings fill."""
    return _rasters(spark, sf_dir).where(F.size("cells") > 0)


@query(f"""WITH {_RASTER_SQL},
n AS (SELECT vec_id, count(*) AS n FROM c GROUP BY vec_id), p AS (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0),
b AS (SELECT x.vec_id, count(*) AS shared FROM c AS x JOIN c AS y ON y.vec_id = x.vec_id + 1 AND y.cell = x.cell WHERE x.vec_id % 2 = 0 GROUP BY x.vec_id),
j AS (SELECT p.vec_id, coalesce(u.n, 0) AS truth, coalesce(v.n, 0) AS found, coalesce(shared, 0) AS shared FROM p LEFT JOIN n AS u USING (vec_id) LEFT JOIN n AS v ON v.vec_id = p.vec_id + 1 LEFT JOIN b ON b.vec_id = p.vec_id)
SELECT vec_id AS image, truth::INT AS truth, found::INT AS found, round(2.0::DOUBLE * shared / nullif(truth + found, 0), 6) AS dice, round(shared::DOUBLE / nullif(truth + found - shared, 0), 6) AS iou FROM j""")
def raster_overlap(spark, sf_dir):
    """Overlap of two readers' rasters of an image: grids 2k and 2k + 1."""
    d = _rasters(spark, sf_dir)
    a, b = d.where("vec_id % 2 = 0").select(F.col("vec_id").alias("image"), F.col("cells").alias("a")), d.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("image"), F.col("cells").alias("b"))
    none = F.array().cast("array<int>")
    d = a.join(b, "image", "left").select("image", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return d.select("image", F.size("a").alias("truth"), F.size("b").alias("found"), r6(metrics.dice(both, F.size("a"), F.size("b"))).alias("dice"), r6(metrics.iou(both, F.size("a"), F.size("b"))).alias("iou"))


@query(f"""
WITH {_CELLS_SQL},
g AS (SELECT vec_id, i, y, x, {_LEVELS_SQL} AS g FROM cells),
levels AS (SELECT vec_id, y // 4 AS ty, x // 4 AS tx, g AS level, count(*) AS n FROM g GROUP BY ALL),
excess AS (SELECT vec_id, ty, tx, sum(n - 1) AS excess FROM levels GROUP BY ALL),
spot AS (SELECT *, floor(y / 4.0::DOUBLE - 0.5) AS y1, floor(x / 4.0::DOUBLE - 0.5) AS x1, y / 4.0::DOUBLE - 0.5 - floor(y / 4.0::DOUBLE - 0.5) AS fy, x / 4.0::DOUBLE - 0.5 - floor(x / 4.0::DOUBLE - 0.5) AS fx FROM g),
corners AS (SELECT spot.*, dy, dx, greatest(0, least(1, y1 + dy))::BIGINT AS ty, greatest(0, least(1, x1 + dx))::BIGINT AS tx FROM spot, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS d(dy, dx)),
looked AS (
  SELECT c.vec_id, c.i, dy, dx, any_value(fy) AS fy, any_value(fx) AS fx, any_value(c.g) AS g, any_value(excess) AS excess,
         count(l.level) + any_value(CASE WHEN excess > 0 THEN least(excess, c.g // (256 // excess) + 1) ELSE 0 END) AS rows_below
  FROM corners AS c JOIN excess AS e ON e.vec_id = c.vec_id AND e.ty = c.ty AND e.tx = c.tx LEFT JOIN levels AS l ON l.vec_id = c.vec_id AND l.ty = c.ty AND l.tx = c.tx AND l.level <= c.g GROUP BY c.vec_id, c.i, dy, dx),
curve AS (SELECT *, least(255, round_even(rows_below * (255 / 16.0::DOUBLE), 0)) AS v FROM looked),
f AS (SELECT vec_id, i, any_value(fy) AS fy, any_value(fx) AS fx, max(v) FILTER (dy = 0 AND dx = 0) AS a, max(v) FILTER (dy = 0 AND dx = 1) AS b, max(v) FILTER (dy = 1 AND dx = 0) AS c, max(v) FILTER (dy = 1 AND dx = 1) AS d FROM curve GROUP BY vec_id, i)
SELECT vec_id, list(round_even((a * (1 - fx) + b * fx) * (1 - fy) + (c * (1 - fx) + d * fx) * fy, 0)::INT ORDER BY i) AS levels FROM f GROUP BY vec_id""")
def equalised_levels(spark, sf_dir):
    """Each grid's levels with local contrast equalised, in 2 x 2 tiles."""
    return _numbers(spark, sf_dir).select("vec_id", grids.equalised(_levels(), F.lit(_SIDE), clip=2.0, tiles=2).cast("array<int>").alias("levels"))


_DEPTH, _FOLDS = 3, 5
_FEATURES = ["is_en", "is_fr", "source_number", "length_bin"]


def _labelled(spark, sf_dir):
    """Labelled documents by what a probe may see: language, source and length."""
    folds = groups.stratified_folds(t(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic", "doc_id", _FOLDS)
    d = t(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce((F.col("lang") == "en").cast("int"), F.lit(0)).alias("is_en"), F.coalesce((F.col("lang") == "fr").cast("int"), F.lit(0)).alias("is_fr"),
        F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("int"), F.lit(-1)).alias("source_number"), F.length(F.bin(F.length(F.coalesce("text", F.lit(""))).cast("long"))).alias("length_bin"),
    )
    return folds.join(d, "doc_id").select(*_FEATURES, "toxic", "fold")


def _tree_sql():
    names = ", ".join(_FEATURES)
    nodes = lambda d: f"cells{d}.model = b{d}.model AND cells{d}.node = b{d}.node"
    out = f"""
folds AS (SELECT doc_id, toxic, CAST((row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || doc_id), doc_id) - 1) % {_FOLDS} AS INT) AS fold FROM labels),
d AS (SELECT coalesce((lang = 'en')::INT, 0) AS is_en, coalesce((lang = 'fr')::INT, 0) AS is_fr, coalesce(TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS INT), -1) AS source_number,
             length(bin(length(coalesce(text, '')))) AS length_bin, toxic AS y, fold FROM folds JOIN documents USING (doc_id) WHERE toxic IS NOT NULL),
cells0 AS (SELECT [{names}]::DOUBLE[] AS f, y, fold, model, count(*) AS n, '' AS node FROM d, (SELECT unnest(range(0, {_FOLDS + 1})) AS model) AS m GROUP BY ALL),"""
    for k in range(_DEPTH):
        out += f"""
v{k} AS (SELECT model, node, feature, f[feature + 1] AS value, sum(n) AS n, sum(n * y) AS p FROM cells{k}, (SELECT unnest(range(0, {len(_FEATURES)})) AS feature) AS x WHERE fold <> model AND length(node) = {k} GROUP BY ALL),
w{k} AS (SELECT model, node, feature, (value + lead(value) OVER u) / 2 AS threshold, sum(n) OVER u AS nl, sum(p) OVER u AS pl, sum(n) OVER a AS nt, sum(p) OVER a AS pt
  FROM v{k} WINDOW u AS (PARTITION BY model, node, feature ORDER BY value), a AS (PARTITION BY model, node, feature)),
s{k} AS (SELECT *, ((pl * pl + (nl - pl) * (nl - pl))::DOUBLE / nl) + (((pt - pl) * (pt - pl) + (nt - nl - pt + pl) * (nt - nl - pt + pl))::DOUBLE / (nt - nl)) AS score FROM w{k} WHERE threshold IS NOT NULL AND pt > 0 AND pt < nt),
b{k} AS (SELECT * FROM s{k} QUALIFY row_number() OVER (PARTITION BY model, node ORDER BY score DESC, feature, threshold) = 1),
cells{k + 1} AS (SELECT f, y, fold, cells{k}.model, n, cells{k}.node || CASE WHEN b{k}.feature IS NULL THEN '' WHEN f[b{k}.feature + 1] <= threshold THEN 'L' ELSE 'R' END AS node FROM cells{k} LEFT JOIN b{k} ON {nodes(k)}),"""
    return out + f"""
leaves AS (SELECT model, node, (2 * sum(n * y) > sum(n))::INT AS predicted FROM cells{_DEPTH} WHERE fold <> model GROUP BY ALL)"""


_TREE_SQL = _tree_sql()


@query(f"""WITH {_TREE_SQL},
p AS (SELECT y, predicted, n FROM cells{_DEPTH} JOIN leaves USING (model, node) WHERE fold = model),
c AS (SELECT sum(n) AS n, coalesce(sum(n) FILTER (y = 1 AND predicted = 1), 0) AS tp, coalesce(sum(n) FILTER (y = 0 AND predicted = 1), 0) AS fp, coalesce(sum(n) FILTER (y = 1 AND predicted = 0), 0) AS fn, coalesce(sum(n) FILTER (y = 0 AND predicted = 0), 0) AS tn FROM p)
SELECT n::BIGINT AS n, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round((tp + tn) / nullif(n, 0), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
       round((tn + fp) / nullif(n, 0), 6) AS always_no FROM c""")
def tree_probe(spark, sf_dir):
    """Can toxicity be told from language, source and length alone?  Pooled over held-out folds, beside always saying no."""
    trees, cells = probes.grown_trees(_labelled(spark, sf_dir), _FEATURES, "toxic", "fold", _FOLDS, _DEPTH)
    of = lambda y, p: F.coalesce(F.sum(F.when((F.col("y") == y) & (F.col("predicted") == p), F.col("n"))), F.lit(0))
    c = probes.pooled(trees, cells, _DEPTH).agg(F.sum("n").alias("n"), of(1, 1).alias("tp"), of(0, 1).alias("fp"), of(1, 0).alias("fn"), of(0, 0).alias("tn"))
    share = lambda a, b: r6(metrics.rate(a, b))
    return c.select("*", share(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"), share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), share(F.col("tn") + F.col("fp"), F.col("n")).alias("always_no"))


@query(f"""WITH {_TREE_SQL},
names AS (SELECT {_FEATURES!r}::VARCHAR[] AS names),
splits AS ({" UNION ALL ".join(f"SELECT node, feature, threshold FROM b{k} WHERE model = {_FOLDS}" for k in range(_DEPTH))}),
lines AS (
  SELECT node || 'L' AS path, repeat('|   ', length(node)) || '|--- ' || names[feature + 1] || ' <= ' || format('{{:.2f}}', threshold) AS line, 0 AS inner_line FROM splits, names
  UNION ALL SELECT node || 'R', repeat('|   ', length(node)) || '|--- ' || names[feature + 1] || ' >  ' || format('{{:.2f}}', threshold), 0 FROM splits, names
  UNION ALL SELECT node, repeat('|   ', length(node)) || '|--- class: ' || predicted, 1 FROM leaves WHERE model = {_FOLDS})
SELECT row_number() OVER (ORDER BY path, inner_line) AS line_number, line FROM lines""")
def tree_rules(spark, sf_dir):
    """The rule that the tree over all rows learns, line by line."""
    trees, _ = probes.grown_trees(_labelled(spark, sf_dir), _FEATURES, "toxic", "fold", _FOLDS, _DEPTH)
    lines = trees.rules(_FOLDS) if trees.leaves else []
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines, 1)], "line_number long, line string")


@query()
def source_probe(spark, sf_dir):
    """Can a vector's label be told by a linear classifier?  Confusion counts of the held-out fold, and chance; tests hold it against one process."""
    d = _numbers(spark, sf_dir).where("label IS NOT NULL AND vec_id IS NOT NULL")
    d = groups.stratified_folds(d.select("vec_id", "label"), "label", "vec_id", 4).withColumnRenamed("label", "_label").join(d, "vec_id")
    classes = (d.agg(F.max("label")).first()[0] or 0) + 1  # one number
    w = probes.linear_weights(d.where("fold != 0"), "v", "label", classes, 64)
    out = probes.linear_predictions(d.where("fold = 0"), "v", w).groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    total = out.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n"))).alias("right"))
    return out.join(F.broadcast(total)).select("label", "predicted", "n", r6(metrics.rate(F.coalesce("right", F.lit(0)), "total")).alias("accuracy"), F.lit(round(1 / classes, 6)).alias("chance"))  # one row


@query(f"""WITH {_CELLS_SQL}
SELECT vec_id, round(24 * 10.0::DOUBLE * (1 + max(v) FILTER (i = 0)) * 5 * (2 + max(v) FILTER (i = 1)) * sin(2 * pi() / 48), 6) AS area, round(10 * (1 + max(v) FILTER (i = 0)), 6) AS right_end FROM cells GROUP BY vec_id""")
def ellipse_areas(spark, sf_dir):
    """Outlines drawn around ellipses of two of a vector's numbers: their areas and where they reach to the right."""
    ring = S.ellipse_points(F.lit(0.0), F.lit(3.0), 10.0 * (1 + F.col("v")[0]), 5.0 * (2 + F.col("v")[1]))
    d = _numbers(spark, sf_dir).select("vec_id", ring.alias("ring"))
    return d.select("vec_id", r6(S.shoelace("ring")).alias("area"), r6(F.array_max(F.transform("ring", lambda p: p["x"]))).alias("right_end"))


@query("""
WITH n AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)
SELECT lang, round(-sum(n / t * log2(n / t)), 6) AS bits FROM (SELECT lang, n, sum(n) OVER (PARTITION BY lang) AS t FROM n) GROUP BY lang""")
def source_entropy(spark, sf_dir):
    """How evenly a language's texts come from the sources, in bits; the column names are looked up, not assumed."""
    d = t(spark, sf_dir, "documents")
    lang, source = filters.pick_column(d, "language", "Lang"), filters.pick_column(d, "origin", "SOURCE")
    n = d.groupBy(F.col(lang).alias("lang"), F.col(source).alias("source")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return n.groupBy("lang").agg(r6(S.entropy(F.collect_list("n"))).alias("bits"))  # one number a source


@query(f"""
WITH {_RASTER_SQL},
area AS (SELECT vec_id, ring, abs(sum(x * y2 - x2 * y)) / 2 AS area FROM sides GROUP BY ALL),
e AS (SELECT label, vec_id % 100 AS image, vec_id, max(area) AS area FROM area JOIN embeddings USING (vec_id) GROUP BY ALL)
SELECT label, image, count(*) AS n_annotations, round(sum(area), 6) AS area FROM e GROUP BY label, image""")
def largest_ring_areas(spark, sf_dir):
    """The largest ring of each annotation, summed for each image and channel."""
    point = lambda i: F.array((F.col("v")[2 * i] + 0.5) * _PHOTO[0], (F.col("v")[2 * i + 1] + 0.5) * _PHOTO[1])
    rings = F.array(*(F.concat(*(point(first + i) for i in range(n))) for first, n in _RINGS))
    d = _numbers(spark, sf_dir).select((F.col("vec_id") % 100).alias("stem"), F.col("label").alias("channel"), F.col("vec_id").alias("annotation"), F.explode(rings).alias("flat"))
    d = scans.max_area_per_image(d.withColumn("area", S.shoelace(S.ring_points("flat"))))
    return d.select(F.col("channel").alias("label"), F.col("stem").alias("image"), "n_annotations", r6(F.col("area")).alias("area"))
