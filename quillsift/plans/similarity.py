"""Queries over fingerprints: near-duplicate pairs, nearest neighbours, components, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsift.functions import scalars as S
from quillsift.operators import groups, hamming, joins
from quillsift.operators.components import connected_components, written
from quillsift.params import PARAMS
from quillsift.plans.base import query, r6, t

#: SimHash of a text: its words in lower case, distinct 3-word shingles, the first 60 bits of each md5, majority per bit.
_FP_SQL = """
w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [array_to_string(w, ' ')] END) AS g FROM w WHERE len(w) > 0),
h AS (SELECT doc_id, list_transform(g, lambda x: ('0x' || substr(md5(x), 1, 15))::BIGINT) AS h FROM s),
fp AS (SELECT doc_id AS id, list_sum(list_transform(range(0, 60), lambda k: CASE WHEN 2 * list_sum(list_transform(h, lambda x: (x >> k) & 1)) > len(h) THEN 1::BIGINT << k ELSE 0::BIGINT END))::BIGINT AS fp FROM h)"""

_EMB_SQL = """
e AS (SELECT vec_id, label, list_transform(embedding[2:64], lambda x: x::DOUBLE) AS v FROM embeddings),
m AS (SELECT vec_id, label, v, list_sort(v)[32] AS m FROM e),
fp AS (SELECT vec_id AS id, label, list_sum(list_transform(range(1, 64), lambda k: CASE WHEN v[k] > m THEN 1::BIGINT << (63 - k) ELSE 0::BIGINT END))::BIGINT AS fp FROM m)"""


def _docs(spark, sf_dir):
    return written(hamming.text_fingerprints(t(spark, sf_dir, "documents"), "doc_id", "text"), "fingerprints")


def _vectors(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", S.sign_bits("embedding").alias("fp"))


@query(f"WITH {_EMB_SQL} SELECT id, label, fp FROM fp")
def fingerprint_vectors(spark, sf_dir):
    return _vectors(spark, sf_dir)


@query(f"WITH {_FP_SQL} SELECT id, fp FROM fp")
def fingerprint_texts(spark, sf_dir):
    return hamming.text_fingerprints(t(spark, sf_dir, "documents"), "doc_id", "text").where("fp IS NOT NULL")


def _pairs_sql(fp: str, limit: int) -> str:
    return f"""WITH {fp}, d AS (SELECT DISTINCT fp FROM fp)
SELECT a.fp AS fp_a, b.fp AS fp_b, bit_count(xor(a.fp, b.fp))::INT AS distance FROM d a JOIN d b ON a.fp < b.fp WHERE bit_count(xor(a.fp, b.fp)) <= {limit}"""


@query(_pairs_sql(_FP_SQL, PARAMS["audit.cluster_hamming"]))
def hamming_pairs_texts(spark, sf_dir):
    return hamming.hamming_pairs(_docs(spark, sf_dir), "fp", PARAMS["audit.cluster_hamming"])


@query(_pairs_sql(_EMB_SQL, 20))
def hamming_pairs_vectors(spark, sf_dir):
    return hamming.hamming_pairs(_vectors(spark, sf_dir), "fp", 20)


@query(f"""WITH {_FP_SQL}, p AS (SELECT a.id AS a, b.id AS b FROM fp a JOIN fp b ON a.id < b.id WHERE bit_count(xor(a.fp, b.fp)) <= 4)
SELECT least(x.source, y.source) AS owner_a, greatest(x.source, y.source) AS owner_b FROM p JOIN documents x ON p.a = x.doc_id JOIN documents y ON p.b = y.doc_id WHERE x.source <> y.source GROUP BY 1, 2""")
def owners_alike(spark, sf_dir):
    """Sources that hold near copies of each other's texts: an owner has many hash forms, any two may meet."""
    d = _docs(spark, sf_dir).join(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return hamming.owner_pairs(d.where("fp IS NOT NULL").select("source", F.array("fp").alias("forms")), "source", "forms", 4)


@query(f"""WITH {_FP_SQL}, q AS (SELECT id, fp FROM fp WHERE id % 100 = 0), j AS (SELECT q.id, bit_count(xor(q.fp, o.fp))::INT AS distance, o.fp AS other FROM q, (SELECT DISTINCT fp FROM fp) o WHERE o.fp <> q.fp)
SELECT id, min(distance) AS distance, arg_min(other, {{'d': distance, 'o': other}}) AS nearest FROM j WHERE distance <= 8 GROUP BY id""")
def nearest_texts(spark, sf_dir):
    """Nearest other fingerprint of the stated query set (ids divisible by 100) among all rows."""
    d = _docs(spark, sf_dir)
    q, b = hamming.banded(d.where("id % 100 = 0 AND fp IS NOT NULL"), "fp", 8, flipped=True), hamming.banded(d.where("fp IS NOT NULL").select(F.col("fp").alias("other")).distinct(), "other", 8)
    j = q.join(b, ["band", "bits"]).where("fp != other").select("id", "other", S.hamming("fp", "other").cast("int").alias("distance"))
    return joins.nearest_within(j, "id", "other", "distance", 8).select("id", "distance", F.col("other").alias("nearest"))


@query("""WITH q AS (SELECT vec_id AS a, embedding AS x FROM embeddings WHERE vec_id % 100 = 0), j AS (
  SELECT a, vec_id AS b, list_sum(list_transform(list_zip(x, embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS d FROM q, embeddings WHERE vec_id <> a),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM j)
SELECT a, max(b) FILTER (r = 1) AS b, round(max(d) FILTER (r = 1), 6) AS d1, round(max(d) FILTER (r = 2), 6) AS d2 FROM r WHERE r <= 2 GROUP BY a HAVING count(*) = 2 AND max(d) FILTER (r = 1) < 0.95 * max(d) FILTER (r = 2)""")
def ratio_test(spark, sf_dir):
    """Two nearest vectors of the stated query set (ids divisible by 100) against all rows, in tiles."""
    e = t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    j = joins.nearest_two(q, e.withColumnRenamed("vec_id", "b").withColumnRenamed("embedding", "x"), "a", "b", "x").withColumnRenamed("distance", "d")
    return joins.ratio_test(j, "a", "b", "d", 0.95).select("a", "b", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"))


@query(f"""WITH RECURSIVE {_FP_SQL}, d AS (SELECT DISTINCT fp FROM fp), p AS (SELECT a.fp AS a, b.fp AS b FROM d a, d b WHERE bit_count(xor(a.fp, b.fp)) <= 6),
r(n, c) AS (SELECT a, b FROM p UNION SELECT r.n, p.b FROM r JOIN p ON r.c = p.a), k AS (SELECT n, min(c) AS component FROM r GROUP BY n)
SELECT f.id, k.component FROM fp f JOIN k ON f.fp = k.n""")
def near_dup_components(spark, sf_dir):
    d = _docs(spark, sf_dir).where("fp IS NOT NULL")
    parts = connected_components(hamming.hamming_pairs(d, "fp", 6), "fp_a", "fp_b")
    return d.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left").select("id", F.coalesce("component", "fp").alias("component"))


@query(f"""WITH {_FP_SQL}, d AS (SELECT DISTINCT fp FROM fp), p AS (SELECT bit_count(xor(a.fp, b.fp)) AS distance FROM d a JOIN d b ON a.fp < b.fp WHERE bit_count(xor(a.fp, b.fp)) <= 8)
SELECT k.hamming_limit, count(*) FILTER (distance <= k.hamming_limit) AS n_pairs FROM (VALUES (0), (2), (4), (6), (8)) k(hamming_limit), p GROUP BY 1""")
def threshold_sweep(spark, sf_dir):
    """Pairs at each limit of a grid, from one join at the largest."""
    p = hamming.hamming_pairs(_docs(spark, sf_dir), "fp", 8).groupBy("distance").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame([(x,) for x in (0, 2, 4, 6, 8)], "hamming_limit int")
    # nine rows at most on one side and five on the other
    return grid.join(F.broadcast(p), F.col("distance") <= F.col("hamming_limit"), "left").groupBy("hamming_limit").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))


@query("""
SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 3""")
def cap_per_family(spark, sf_dir):
    return groups.cap_per_group(t(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", PARAMS["dedup.max_per_family"])


@query("""
WITH f AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2),
b AS (SELECT *, 60 - coalesce(sum(n) OVER (PARTITION BY lang ORDER BY md5('42:' || source), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM f)
SELECT lang, source, doc_id FROM (SELECT d.*, room, row_number() OVER (PARTITION BY d.lang, d.source ORDER BY doc_id) AS r FROM documents d JOIN b ON d.lang = b.lang AND d.source = b.source WHERE room > 0) WHERE r <= room""")
def rebalance(spark, sf_dir):
    return groups.rebalance(t(spark, sf_dir, "documents").select("lang", "source", "doc_id"), "lang", "source", "doc_id", 60)


@query("""
SELECT doc_id, toxic, CAST((row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || doc_id), doc_id) - 1) % 5 AS INT) AS fold FROM labels""")
def stratified_folds(spark, sf_dir):
    return groups.stratified_folds(t(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic", "doc_id")


@query("""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5('42:' || doc_id), doc_id) AS turn FROM documents)
SELECT lang, source, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn, source) AS place FROM a) WHERE place <= 10""")
def round_robin(spark, sf_dir):
    """Ten documents of each language, taken in turn from its sources (a sampling operator)."""
    return groups.round_robin(t(spark, sf_dir, "documents").select("lang", "source", "doc_id"), "lang", "source", "doc_id", 10).select("lang", "source", "doc_id", F.col("place").cast("long").alias("place"))


@query("""
WITH a AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents)
SELECT lang, doc_id, r > 3 AS topped_up FROM a ORDER BY r > 3, lang, r, doc_id LIMIT 15""")
def bucketed_sample(spark, sf_dir):
    """Three of each bucket, topped up to fifteen (a sampling operator)."""
    return groups.bucketed_sample(t(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 3, 15)


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 20")
def seeded_sample(spark, sf_dir):
    """Twenty documents by seeded draw (a sampling operator)."""
    return groups.sample(t(spark, sf_dir, "documents").select("doc_id"), "doc_id", 20)


_SPLIT_SQL = f"""WITH RECURSIVE {_FP_SQL}, d AS (SELECT DISTINCT fp FROM fp), p AS (SELECT a.fp AS a, b.fp AS b FROM d a, d b WHERE bit_count(xor(a.fp, b.fp)) <= 6),
r(n, c) AS (SELECT a, b FROM p UNION SELECT r.n, p.b FROM r JOIN p ON r.c = p.a), k AS (SELECT n, min(c) AS component FROM r GROUP BY n),
members AS MATERIALIZED (SELECT f.id, k.component, o.lang FROM fp f JOIN k ON f.fp = k.n JOIN documents o ON f.id = o.doc_id),
n AS (SELECT component, lang, count(*) AS n, min(id) AS first FROM members GROUP BY 1, 2),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang) AS i, sum(n)::BIGINT AS total FROM n GROUP BY lang),
g AS (SELECT component, sum(n)::BIGINT AS size, arg_min(lang, {{'n': -n, 'f': first}}) AS majority, md5('42:' || component) AS drawn FROM n GROUP BY component),
v AS (SELECT g.component, list(coalesce(n.n, 0) ORDER BY l.i) AS vec FROM g CROSS JOIN langs l LEFT JOIN n ON n.component = g.component AND n.lang = l.lang GROUP BY g.component),
o AS (SELECT g.*, v.vec, min(drawn) OVER (PARTITION BY size, majority, vec) AS pattern FROM g JOIN v USING (component)),
steps AS MATERIALIZED (SELECT o.*, l.i AS m, l.total, row_number() OVER (ORDER BY size DESC, pattern, drawn) AS turn FROM o JOIN langs l ON o.majority = l.lang),
walk(turn, a, b, c, pick) AS (
  SELECT 0::BIGINT, list(0::BIGINT), list(0::BIGINT), list(0::BIGINT), 0 FROM langs
  UNION ALL
  SELECT turn, CASE WHEN pick = 1 THEN list_transform(range(1, len(a) + 1), lambda x: a[x] + vec[x]) ELSE a END, CASE WHEN pick = 2 THEN list_transform(range(1, len(b) + 1), lambda x: b[x] + vec[x]) ELSE b END,
         CASE WHEN pick = 3 THEN list_transform(range(1, len(c) + 1), lambda x: c[x] + vec[x]) ELSE c END, pick
  FROM (SELECT *, CASE WHEN pa >= pb AND pa >= pc THEN 1 WHEN pb >= pc THEN 2 ELSE 3 END AS pick FROM (
    SELECT s.turn, s.vec, w.a, w.b, w.c, 0.7::DOUBLE - w.a[m]::DOUBLE / total AS pa, 0.15::DOUBLE - w.b[m]::DOUBLE / total AS pb, 0.15::DOUBLE - w.c[m]::DOUBLE / total AS pc
    FROM walk w JOIN steps s ON s.turn = w.turn + 1))),
picks AS (SELECT pattern, pick, row_number() OVER (PARTITION BY pattern ORDER BY pick, turn) AS place FROM walk JOIN steps USING (turn)),
dealt AS (SELECT component, pattern, row_number() OVER (PARTITION BY pattern ORDER BY drawn, component) AS place FROM steps),
result AS (SELECT members.id, members.component, ['train', 'val', 'test'][pick] AS split FROM members JOIN dealt USING (component) JOIN picks USING (pattern, place))"""


@query(f"{_SPLIT_SQL} SELECT id, component, split FROM result")
def greedy_split(spark, sf_dir):
    """A split for every text's class of near copies, chosen group by group."""
    d = near_dup_components(spark, sf_dir).join(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    d = written(d, "components")
    return d.join(groups.greedy_split(d, "component", "lang", "id"), "component").select("id", "component", "split")


@query(f"{_SPLIT_SQL} SELECT component, list_sort(list_distinct(list(split))) AS splits FROM result GROUP BY component HAVING count(DISTINCT split) > 1")
def split_leaks(spark, sf_dir):
    """Components that stand in two splits: none."""
    return groups.leaks(greedy_split(spark, sf_dir), "component", "split")


@query("""SELECT grp, list_sort(list_distinct(list(split))) AS splits FROM (SELECT md5(coalesce(text, '')) AS grp, ['train', 'val', 'test'][doc_id % 3 + 1] AS split FROM documents)
GROUP BY grp HAVING count(DISTINCT split) > 1""")
def row_split_leaks(spark, sf_dir):
    """Exact copies that a split by row number would part: what the leak check finds when there is something to find."""
    d = t(spark, sf_dir, "documents").select(F.md5(F.coalesce("text", F.lit(""))).alias("grp"), F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("split"))
    return groups.leaks(d, "grp", "split")


@query(f"""WITH {_FP_SQL}, q AS (SELECT * FROM fp WHERE id % 100 = 0), x AS (
  SELECT q.id, d.source AS dataset, min(bit_count(xor(q.fp, f.fp)))::INT AS distance FROM q, fp f JOIN documents d ON d.doc_id = f.id WHERE d.source IN ('src3', 'src0') AND bit_count(xor(q.fp, f.fp)) <= 6 GROUP BY 1, 2)
SELECT id::VARCHAR AS id, dataset, 0 AS distance, 'named' AS why FROM q JOIN documents d ON d.doc_id = q.id, (VALUES ('src3'), ('src0')) r(dataset) WHERE contains(lower(d.source || '/' || q.id), dataset)
UNION ALL SELECT id::VARCHAR, dataset, distance, 'alike' FROM x""")
def restricted_texts(spark, sf_dir):
    """Texts of the stated query set (ids divisible by 100) whose path names a restricted source or that are near one of its texts."""
    d = _docs(spark, sf_dir).where("fp IS NOT NULL").join(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    q = d.where("id % 100 = 0").withColumn("path", F.concat("source", F.lit("/"), F.col("id").cast("string")))
    held = d.where(F.col("source").isin("src3", "src0")).select(F.col("fp").alias("other"), F.col("source").alias("dataset")).distinct()
    j = hamming.banded(q, "fp", 6, flipped=True).join(hamming.banded(held, "other", 6), ["band", "bits"]).withColumn("distance", S.hamming("fp", "other").cast("int")).where("distance <= 6")
    near = j.groupBy("path", "dataset").agg(F.min("distance").alias("distance"))
    return joins.restricted_matches(q, near, ["src3", "src0"]).select(F.element_at(F.split("path", "/"), -1).alias("id"), "dataset", "distance", "why")


_BEST_SQL = f"""WITH {_FP_SQL}, b AS (SELECT id % 7 AS dataset, id, fp FROM fp), p AS (
  SELECT x.id AS id, y.id AS counterpart, bit_count(xor(x.fp, y.fp))::INT AS distance FROM b x JOIN b y ON x.dataset <> y.dataset WHERE bit_count(xor(x.fp, y.fp)) <= 6),
best AS (SELECT id, counterpart, distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, counterpart) AS r FROM p) WHERE r = 1)"""


@query(f"""{_BEST_SQL}, u AS (SELECT doc_id, list_distinct(w) AS w FROM w),
m AS (SELECT id, counterpart, distance, len(list_intersect(x.w, y.w))::DOUBLE AS shared, len(x.w) + len(y.w) AS n FROM best JOIN u x ON x.doc_id = id JOIN u y ON y.doc_id = counterpart)
SELECT id, counterpart, distance, round(shared / (n - shared), 6) AS likeness, shared / (n - shared) >= 0.9 AS confirmed FROM m""")
def verified_counterparts(spark, sf_dir):
    """A near fingerprint is only a candidate: each one is measured on the words of both texts and then confirmed or not."""
    best = best_counterpart(spark, sf_dir)
    words = t(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")).alias("w"))
    both = best.join(words.select(F.col("doc_id").alias("id"), F.col("w").alias("x")), "id").join(words.select(F.col("doc_id").alias("counterpart"), F.col("w").alias("y")), "counterpart")
    shared = F.size(F.array_intersect("x", "y"))
    measures = both.select("id", "counterpart", (shared / (F.size("x") + F.size("y") - shared)).alias("likeness"))
    return joins.verified(best, measures, ["id", "counterpart"], F.col("likeness") >= 0.9).withColumn("likeness", r6(F.col("likeness")))


@query("SELECT i::INT AS pick, r_name FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || r_name), r_name) - 1 AS r, count(*) OVER () AS n FROM region), range(0, 12) x(i) WHERE i % n = r")
def recycled_sample(spark, sf_dir):
    """Twelve picks of five regions: rows are taken again in turn (a sampling operator)."""
    return groups.recycled_sample(t(spark, sf_dir, "region"), "r_name", 12)


@query(f"""WITH {_FP_SQL}, b AS (SELECT id % 7 AS dataset, id, fp FROM fp), p AS (
  SELECT x.id AS id, y.id AS counterpart, bit_count(xor(x.fp, y.fp))::INT AS distance FROM b x JOIN b y ON x.dataset <> y.dataset WHERE bit_count(xor(x.fp, y.fp)) <= 6)
SELECT id, counterpart, distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, counterpart) AS r FROM p) WHERE r = 1""")
def best_counterpart(spark, sf_dir):
    """The nearest document of another data set for each document; ties take the least id."""
    d = _docs(spark, sf_dir).where("fp IS NOT NULL").withColumn("dataset", F.col("id") % 7)
    # per fingerprint and data set one row, the least id, so that groups of copies are not multiplied
    one = d.groupBy("fp", "dataset").agg(F.min("id").alias("least"))
    near = hamming.hamming_pairs(d, "fp", 6)
    both = near.select("fp_a", "fp_b", "distance").unionByName(near.select(F.col("fp_b").alias("fp_a"), F.col("fp_a").alias("fp_b"), "distance"))
    both = both.unionByName(one.select(F.col("fp").alias("fp_a"), F.col("fp").alias("fp_b"), F.lit(0).alias("distance")).distinct())
    j = one.select(F.col("fp").alias("fp_a"), "dataset").join(both, "fp_a").join(one.select(F.col("fp").alias("fp_b"), F.col("dataset").alias("other"), "least"), "fp_b").where("dataset != other")
    best = j.groupBy("fp_a", "dataset").agg(F.min(F.struct("distance", "least")).alias("m"))
    return d.join(best.withColumnRenamed("fp_a", "fp"), ["fp", "dataset"]).select("id", F.col("m.least").alias("counterpart"), F.col("m.distance").alias("distance"))
