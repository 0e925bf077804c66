"""Queries over the corpus tables: duplicates, inventories, quality, exclusions, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsift.functions import scalars as S
from quillsift.operators import filters, groups, joins, metrics
from quillsift.plans.base import DOC_PATH_SQL, doc_path, query, r6, t
from quillsift.sources import scans, sinks


def _digest():
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


@query("""
SELECT md5(coalesce(text, '')) AS digest, count(*) AS n_rows, min(doc_id) AS first_key, count(*) - 1 AS n_redundant
FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_dup_groups(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(_digest().alias("digest"), "doc_id")
    return groups.duplicate_groups(d, "digest", "doc_id")


@query("""
SELECT digest, source, lang, doc_id FROM (
  SELECT *, row_number() OVER (PARTITION BY digest ORDER BY source, lang, doc_id) AS r
  FROM (SELECT md5(text) AS digest, source, lang, doc_id FROM documents WHERE text IS NOT NULL)) WHERE r = 1""")
def exact_dedup_keep_first(spark, sf_dir):
    d = t(spark, sf_dir, "documents").where("text IS NOT NULL").select(_digest().alias("digest"), "source", "lang", "doc_id")
    return groups.keep_first(d, "digest", ["source", "lang", "doc_id"])


@query("""
WITH k AS (SELECT DISTINCT source, md5(coalesce(text, '')) AS digest FROM documents)
SELECT a.source AS group_a, b.source AS group_b, count(*) AS shared
FROM k a JOIN k b ON a.digest = b.digest AND a.source < b.source GROUP BY 1, 2""")
def cross_source_duplicates(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("source", _digest().alias("digest"))
    return joins.shared_between(d, "source", "digest")


@query("""
WITH d AS (SELECT DISTINCT doc_id FROM documents), l AS (SELECT DISTINCT doc_id FROM labels),
j AS (SELECT count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS n_both, count(*) FILTER (l.doc_id IS NULL) AS only_a,
             count(*) FILTER (d.doc_id IS NULL) AS only_b FROM d FULL JOIN l ON d.doc_id = l.doc_id)
SELECT *, 100.0::DOUBLE * n_both / nullif(n_both + only_a, 0) AS pct_of_a, 100.0::DOUBLE * n_both / nullif(n_both + only_b, 0) AS pct_of_b FROM j""")
def coverage_both_ways(spark, sf_dir):
    return joins.coverage(t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels"), "doc_id")


@query("""
SELECT source, count(*) AS n, count(DISTINCT lang) AS n_langs, min(n_chars)::DOUBLE AS low, median(n_chars)::DOUBLE AS median, round(avg(n_chars), 6) AS mean,
       round(quantile_cont(n_chars, 0.95), 6) AS p95, max(n_chars)::DOUBLE AS high, list_sort(list(n_chars))[count(*) // 2 + 1]::DOUBLE AS upper_median,
       round(stddev_pop(n_chars), 6) AS std
FROM documents GROUP BY source""")
def inventory_by_source(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("source", "lang", F.col("n_chars").cast("double").alias("x"))
    g = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("n_langs"), F.min("x").alias("low"), r6(F.avg("x")).alias("mean"), F.max("x").alias("high"), r6(F.stddev_pop("x")).alias("std"))
    q = metrics.quantiles(d, ["source"], "x", median=0.5, p95=0.95, upper_median=None)
    return metrics.beside(g, q.withColumn("p95", r6(F.col("p95"))), "source")


@query("""
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, median(value) AS median, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS high FROM events GROUP BY event_type""")
def latency_summary(spark, sf_dir):
    d = t(spark, sf_dir, "events").select("event_type", "value")
    g = d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"), F.max("value").alias("high"))
    q = metrics.quantiles(d, ["event_type"], "value", median=0.5, p95=0.95)
    return metrics.beside(g, q.withColumn("p95", r6(F.col("p95"))), "event_type")


@query("""
SELECT n_chars // 1000 AS thousand, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, thousand LIMIT 10""")
def histogram_top(spark, sf_dir):
    """The ten largest bars of a histogram (a top-k report)."""
    d = t(spark, sf_dir, "documents").groupBy(F.floor(F.col("n_chars") / 1000).alias("thousand")).agg(F.count(F.lit(1)).alias("n"))
    return d.orderBy(F.desc("n"), "thousand").limit(10)


@query("""
WITH c AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang),
k(label) AS (VALUES ('de'), ('en'), ('es'), ('fr'), ('xx')),
j AS (SELECT k.label, coalesce(n, 0) AS n FROM k LEFT JOIN c USING (label))
SELECT label, n, (SELECT sum(n) FROM j) / (5.0 * greatest(n, 1)) AS weight FROM j""")
def class_weights(spark, sf_dir):
    counts = t(spark, sf_dir, "documents").groupBy(F.col("lang").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return metrics.class_weights(counts, ["de", "en", "es", "fr", "xx"])


@query("""
SELECT min(n) AS smallest, least(600, round_even(2.0 * min(n), 0)::INT) AS cap FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)""")
def effective_cap(spark, sf_dir):
    n = t(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("smallest"))
    return n.select("smallest", metrics.effective_cap("smallest", 2.0, 600).alias("cap"))


@query("""
WITH g AS (SELECT source, count(*) AS n, sum(toxic) AS k FROM documents JOIN labels USING (doc_id) GROUP BY source),
w AS (SELECT *, k / n AS p, 1.96 * 1.96 AS zz FROM g)
SELECT source, n, k::BIGINT AS k, round(p, 6) AS share,
       round(greatest((p + zz / (2 * n)) / (1 + zz / n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4.0 * n * n)) / (1 + zz / n), 0), 6) AS low,
       round(least((p + zz / (2 * n)) / (1 + zz / n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4.0 * n * n)) / (1 + zz / n), 1), 6) AS high
FROM w""")
def wilson_by_source(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "source").join(t(spark, sf_dir, "labels"), "doc_id")
    g = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k"))
    share, low, high = metrics.wilson("k", "n")
    return g.select("source", "n", "k", r6(share).alias("share"), r6(low).alias("low"), r6(high).alias("high"))


_PREDICTED = "CAST(regexp_like(lower(text), 'idiot|stupid|moron|loser|scum') AS INT)"
_PREDICTED_SQL = "regexp_matches(lower(text), 'idiot|stupid|moron|loser|scum')::INT"


def _predictions(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.expr(_PREDICTED).alias("predicted"))
    return d.join(t(spark, sf_dir, "labels"), "doc_id")


@query(f"""
WITH p AS (SELECT d.lang, {_PREDICTED_SQL} AS predicted, toxic FROM documents d JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (toxic = 1 AND predicted = 1) AS tp, count(*) FILTER (toxic = 0 AND predicted = 1) AS fp,
             count(*) FILTER (toxic = 1 AND predicted = 0) AS fn, count(*) FILTER (toxic = 0 AND predicted = 0) AS tn FROM p GROUP BY lang)
SELECT *, tp / nullif(tp + fn, 0) AS sensitivity, tn / nullif(tn + fp, 0) AS specificity, tp / nullif(tp + fp, 0) AS ppv,
       tn / nullif(tn + fn, 0) AS npv, (tp + tn) / nullif(tp + fp + fn + tn, 0) AS accuracy FROM c""")
def confusion_by_lang(spark, sf_dir):
    return metrics.binary_rates(_predictions(spark, sf_dir).groupBy("lang").agg(*metrics.confusion_counts("toxic", "predicted")))


@query("""
WITH p AS (SELECT lang AS truth, CASE WHEN regexp_matches(text, '[ßäöü]') THEN 'de' WHEN regexp_matches(text, '[ñíó]') THEN 'es' WHEN regexp_matches(text, '[éèêç]') THEN 'fr' ELSE 'en' END AS predicted FROM documents),
k AS (SELECT DISTINCT truth AS class FROM p UNION SELECT DISTINCT predicted FROM p),
c AS (SELECT class, count(*) FILTER (truth = class AND predicted = class) AS tp, count(*) FILTER (truth <> class AND predicted = class) AS fp,
             count(*) FILTER (truth = class AND predicted <> class) AS fn, count(*) FILTER (truth <> class AND predicted <> class) AS tn FROM k, p GROUP BY class)
SELECT class, tp, fp, fn, tn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
       coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c""")
def per_class_metrics(spark, sf_dir):
    guess = filters.case((F.col("text").rlike("[ßäöü]"), "de"), (F.col("text").rlike("[ñíó]"), "es"), (F.col("text").rlike("[éèêç]"), "fr"), otherwise="en")
    return metrics.per_class(t(spark, sf_dir, "documents").select(F.col("lang").alias("truth"), guess.alias("predicted")), "truth", "predicted")


@query("""
SELECT quality, count(*) AS n, count(*) FILTER (toxic = 1) AS positives, count(*) FILTER (toxic = 1) / count(*) AS share FROM labels GROUP BY quality""")
def contingency(spark, sf_dir):
    g = t(spark, sf_dir, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("positives"))
    return g.withColumn("share", metrics.rate("positives", "n"))


@query("""
SELECT lang, count(*) FILTER (quality = 0) AS q0, count(*) FILTER (quality = 1) AS q1 FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def confusion_matrix(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "lang").join(t(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("lang").pivot("quality", [0, 1]).agg(F.count(F.lit(1))).na.fill(0).toDF("lang", "q0", "q1")


def _quality(spark, sf_dir):
    """Two measures of a text and a score: weighted ramps of repetition and of marks."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \n]+"), lambda w: w != "")
    d = t(spark, sf_dir, "documents").select(doc_path().alias("path"), "source", words.alias("w"), F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^#$%&*|!]", "")).alias("marks"))
    d = d.select("path", "source", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"), "marks")
    clip = F.coalesce(F.try_divide(F.col("marks").cast("double"), F.col("n_words").cast("double")), F.lit(0.0))
    score = 0.6 * S.ramp(F.coalesce(F.try_divide(F.col("n_distinct").cast("double"), F.col("n_words").cast("double")), F.lit(1.0)), 0.8, 0.2) + 0.4 * S.ramp(clip, 0.0, 0.5)
    return d.select("path", "source", clip.alias("clip_frac"), score.alias("score"))


_QUALITY_SQL = f"""
w AS (SELECT {DOC_PATH_SQL} AS path, source, list_filter(string_split_regex(coalesce(text, ''), '[ \\n]+'), lambda x: x <> '') AS words,
             length(regexp_replace(coalesce(text, ''), '[^#$%&*|!]', '', 'g')) AS marks FROM documents),
m AS (SELECT path, source, coalesce(marks / nullif(len(words), 0), 0) AS clip_frac, coalesce(len(list_distinct(words)) / nullif(len(words), 0), 1) AS variety FROM w),
q AS (SELECT path, source, round(clip_frac, 4) AS clip_frac,
             round(0.6 * greatest(least((variety - 0.8) / (0.2 - 0.8), 1), 0) + 0.4 * greatest(least(clip_frac / 0.5, 1), 0), 4) AS score FROM m)"""


@query(f"""WITH {_QUALITY_SQL}
SELECT path, source, clip_frac, score, CASE WHEN clip_frac >= 0.6 THEN 'clipped' WHEN score >= 0.7 THEN 'synthetic' ELSE 'photo' END AS proposed_label FROM q""")
def quality_score(spark, sf_dir):
    return sinks.rounded_features(_quality(spark, sf_dir))


@query(f"""WITH {_QUALITY_SQL},
r AS (SELECT path, CASE WHEN clip_frac >= 0.6 THEN 'clipped' WHEN score >= 0.7 THEN 'synthetic' END AS reason FROM q),
e AS (SELECT path, reason, 0 AS priority FROM r WHERE reason IS NOT NULL
      UNION ALL SELECT {DOC_PATH_SQL}, substr('marked by a reviewer because the quality label is zero', 1, 48), 1 FROM documents JOIN labels USING (doc_id) WHERE quality = 0)
SELECT path, reason FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY priority, reason) AS n FROM e) WHERE n = 1""")
def exclusion_cascade(spark, sf_dir):
    manual = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels").where("quality = 0"), "doc_id").select(doc_path().alias("path"), F.lit("marked by a reviewer because the quality label is zero").alias("reason"))
    return filters.exclusion_cascade(sinks.rounded_features(_quality(spark, sf_dir)), manual)


@query(f"""WITH {_QUALITY_SQL}
SELECT source, count(*) AS n_kept FROM q WHERE clip_frac < 0.6 AND score < 0.7 GROUP BY source""")
def exclusion_anti_join(spark, sf_dir):
    flags = sinks.rounded_features(_quality(spark, sf_dir))
    gone = filters.exclusion_cascade(flags, flags.select("path", F.lit("").alias("reason")).limit(0))
    return joins.not_in(flags, gone, ["path"]).groupBy("source").agg(F.count(F.lit(1)).alias("n_kept"))


@query(f"""WITH p AS (SELECT doc_id, {DOC_PATH_SQL} AS path FROM documents), n AS (SELECT doc_id, replace(path, chr(92), '/') AS path FROM p),
x AS (SELECT doc_id, path, split_part(path, '/', 1) AS first, regexp_extract(path, '([^/]*)$', 1) AS name FROM n)
SELECT doc_id, first, regexp_replace(name, '(.)\\.[^.]*$', '\\1') AS stem, lower(regexp_extract(name, '.(\\.[^.]*)$', 1)) AS suffix,
       CASE WHEN lower(name) LIKE '%.jpg' OR lower(name) LIKE '%.jpeg' OR lower(name) LIKE '%.png' THEN 'image' WHEN lower(name) LIKE '%.bin' THEN 'other' ELSE 'meta' END AS kind,
       NOT (path LIKE 'src1/%' OR path LIKE 'src2/%') AS kept, first IN ('src3', 'src4') AS allowed, nullif(regexp_extract(name, '^(doc-\\d+)', 1), '') AS patient,
       CASE WHEN regexp_matches(path, '(^|/)en(/|$)') THEN 'en' WHEN regexp_matches(path, '(^|/)fr(/|$)') THEN 'fr' END AS category
FROM x""")
def path_functions(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", doc_path().alias("path"))
    return d.select(
        "doc_id", S.first_segment("path").alias("first"), S.stem_of("path").alias("stem"), S.suffix_of("path").alias("suffix"), filters.file_kind(S.suffix_of("path")).alias("kind"),
        filters.keep_path("path", ["src1/", "src2/"]).alias("kept"), filters.allowed_folder("path", ["src3", "src4"]).alias("allowed"),
        S.extract_or_null(S.name_of("path"), r"^(doc-\d+)").alias("patient"), filters.category_of("path", ["en", "fr"]).alias("category"),
    )


@query(f"""WITH p AS (SELECT doc_id, lang, replace({DOC_PATH_SQL}, chr(92), '/') AS path FROM documents)
SELECT lang, doc_id, path, r FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY string_split(path, '/')) AS r FROM p) WHERE r <= 5""")
def path_order(spark, sf_dir):
    """The first five paths of each language, compared part by part (a top-k report)."""
    from pyspark.sql import Window as W

    d = t(spark, sf_dir, "documents").select("lang", "doc_id", S.slashed(doc_path()).alias("path"))
    return d.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(S.segments("path"))).cast("long")).where("r <= 5")


@query(f"""WITH p AS (SELECT {DOC_PATH_SQL} AS path, n_chars FROM documents WHERE lower({DOC_PATH_SQL}) LIKE '%.json')
SELECT path, n_chars AS size FROM p ORDER BY n_chars DESC, string_split(replace(path, chr(92), '/'), '/') LIMIT 1""")
def biggest_file(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(doc_path().alias("path"), F.col("n_chars").alias("length")).where(S.suffix_of("path") == ".json")
    return scans.biggest(d)


@query("""
SELECT p_type, CASE WHEN p_name LIKE 'red%' AND p_name LIKE '%ring%' THEN 'mixed' WHEN p_name LIKE 'red%' THEN 'patch' WHEN p_name LIKE '%ring%' THEN 'texture' ELSE 'none' END AS token_group,
       count(*) AS n FROM part GROUP BY 1, 2""")
def token_groups(spark, sf_dir):
    kind = S.token_class("p_name", ["^red"], ["ring"], ("patch", "texture", "mixed", "none"))
    return t(spark, sf_dir, "part").groupBy("p_type", kind.alias("token_group")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT lang, sum(CASE WHEN regexp_matches(text, '(?i)(?:diagnos|cancer|license|ring)') THEN 1 ELSE 0 END)::BIGINT AS n_inside,
       sum(CASE WHEN regexp_matches(text, '(?i)\\b(?:diagnos|cancer|license|ring)\\b') THEN 1 ELSE 0 END)::BIGINT AS n_words FROM documents GROUP BY lang""")
def vocabulary_guard(spark, sf_dir):
    terms = ["diagnos", "cancer", "license", "ring"]
    d = t(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count_if(filters.forbidden_term("text", terms)).alias("n_inside"), F.count_if(filters.forbidden_term("text", terms, whole_words=True)).alias("n_words"))


@query("""
SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) GROUP BY word ORDER BY n DESC, word LIMIT 12""")
def vocabulary_top(spark, sf_dir):
    """The twelve most frequent words (a top-k report)."""
    d = t(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return d.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(12)


@query("""
SELECT source, list_sort(list(DISTINCT lang)) AS langs, count(*) AS n_rows, count(DISTINCT lang) AS n_langs,
       count(*) FILTER (n_chars = 0 OR text IS NULL) AS n_empty, count(DISTINCT md5(coalesce(text, ''))) AS n_texts FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1""")
def group_sets(spark, sf_dir):
    d = t(spark, sf_dir, "documents").withColumn("digest", _digest())
    g = d.groupBy("source").agg(
        F.sort_array(F.collect_set("lang")).alias("langs"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("lang").alias("n_langs"),
        F.count_if((F.col("n_chars") == 0) | F.col("text").isNull()).alias("n_empty"), F.count_distinct("digest").alias("n_texts"),
    )
    return g.where("n_langs > 1")


@query("""
WITH n AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1, 2)
SELECT source, arg_min(lang, {'n': -n, 'f': first}) AS majority, sum(n)::BIGINT AS n_rows FROM n GROUP BY source""")
def majority_class(spark, sf_dir):
    return groups.majority_class(t(spark, sf_dir, "documents"), "source", "lang", "doc_id")


@query("""
WITH u AS (SELECT doc_id FROM documents WHERE n_chars > 1000 UNION ALL SELECT doc_id FROM labels),
i AS (SELECT doc_id FROM documents WHERE n_chars > 1000 INTERSECT SELECT doc_id FROM labels),
e AS (SELECT doc_id FROM documents WHERE n_chars > 1000 EXCEPT SELECT doc_id FROM labels)
SELECT 'union' AS op, count(*) AS n FROM u UNION ALL SELECT 'intersect', count(*) FROM i UNION ALL SELECT 'except', count(*) FROM e""")
def set_operations(spark, sf_dir):
    a, b = t(spark, sf_dir, "documents").where("n_chars > 1000").select("doc_id"), t(spark, sf_dir, "labels").select("doc_id")
    one = lambda name, d: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
    return one("union", a.unionByName(b)).unionByName(one("intersect", a.intersect(b))).unionByName(one("except", a.subtract(b)))


@query(f"""WITH {_QUALITY_SQL},
d AS (SELECT {DOC_PATH_SQL} AS path, lang, md5(coalesce(text, '')) AS digest FROM documents),
k AS (SELECT d.* FROM d JOIN q USING (path) WHERE clip_frac < 0.6 AND score < 0.7),
u AS (SELECT digest, min(path) AS path, arg_min(lang, path) AS lang FROM k GROUP BY digest),
c AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || path), path) AS r FROM u)
SELECT * FROM (VALUES (1, 'raw', (SELECT count(*) FROM documents)), (2, 'not excluded', (SELECT count(*) FROM k)), (3, 'distinct texts', (SELECT count(*) FROM u)),
               (4, 'capped', (SELECT count(*) FROM c WHERE r <= 100))) v(step, stage, n)""")
def build_funnel(spark, sf_dir):
    """Rows that each step of a data-set build leaves: exclusion, exact duplicates, cap per class."""
    docs = t(spark, sf_dir, "documents").select(doc_path().alias("path"), "lang", _digest().alias("digest"))
    flags = sinks.rounded_features(_quality(spark, sf_dir))
    kept = joins.not_in(docs, flags.where("proposed_label != 'photo'"), ["path"])
    unique = groups.keep_first(kept, "digest", ["path"])
    capped = groups.cap_per_group(unique, "lang", "path", 100)
    count = lambda i, name, d: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "n")
    out = count(1, "raw", docs)
    for i, name, d in ((2, "not excluded", kept), (3, "distinct texts", unique), (4, "capped", capped)):
        out = out.unionByName(count(i, name, d))
    return out
