"""Toxicity, LM scoring, near-dedup and the pipeline against brute force and held-out labels."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillsift.llm import near_dedup, packing, ppm, registry, toxicity

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# --- toxicity ---------------------------------------------------------------


def test_held_out_accuracy(spark):
    got = toxicity.op5_toxicity(spark, SF2)
    d = got.join(spark.read.parquet(f"{SF2}/labels.parquet"), "doc_id").where("held_out")
    r = d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted") == F.col("toxic")).alias("right"), F.avg(F.when(F.col("toxic") == 1, F.col("score"))).alias("bad"), F.avg(F.when(F.col("toxic") == 0, F.col("score"))).alias("good")).first()
    assert r.right / r.n > 0.88 and r.bad > r.good + 0.2
    for x in got.limit(50).collect():
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and x.predicted == int(x.score >= 0.5) and 0 <= x.score <= 1


def test_planted_words_are_learned(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8)))
    text = lambda bad: " ".join([word() for _ in range(60)] + (["zqxidiot"] if bad else []) + [word() for _ in range(60)])
    data = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(9999, None), (None, 1)], "doc_id long, toxic int")
    w, bias = toxicity.train(docs, labels)
    fresh = [(text(b), b) for b in (True, False) * 40]
    right = sum((toxicity.score_text(t, w, np.empty(len(w), np.int32), bias) >= 0.5) == b for t, b in fresh)
    assert right >= 78
    # labels of held-out rows and their texts play no part
    held = [i for i, _, _ in data if zlib.crc32(str(i).encode()) % 5 == 0]
    flipped = labels.withColumn("toxic", F.when(F.col("doc_id").isin(held), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    w2, b2 = toxicity.train(docs, flipped)
    assert np.array_equal(w, w2) and bias == b2


def brute_grams(text):
    """The hashes of a text's distinct character n-grams, one by one."""
    t, mask, out = f" {text.lower()} ", (1 << 64) - 1, set()
    for n in toxicity.SIZES:
        for i in range(len(t) - n + 1):
            h = ord(t[i]) * 0x9E3779B97F4A7C15 & mask
            for c in t[i + 1 : i + n]:
                h = ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 + ord(c)) & mask
            out.add((h * 0x94D049BB133111EB & mask) >> 64 - toxicity.BITS)
    return out


def test_scores_and_ratios_against_loops(spark):
    rng = random.Random(3)
    bad, plain = "vile rotten nasty".split(), "calm river stone paper green walk".split()
    texts = [(i, " ".join(rng.choice(plain) for _ in range(12)) + (" " + rng.choice(bad) if i % 2 else ""), i % 2) for i in range(120)]
    rows = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    w, bias = toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    learned = [(y, brute_grams(t)) for i, t, y in texts if zlib.crc32(str(i).encode()) % 5]
    seen = {y: Counter(g for k, grams in learned if k == y for g in grams) for y in (0, 1)}
    many = {g for g in seen[0] | seen[1] if seen[0][g] + seen[1][g] >= toxicity.MIN_TEXTS}
    number = Counter(y for y, _ in learned)
    p, n = (np.array([seen[y][g] for g in range(1 << toxicity.BITS)]) for y in (1, 0))
    keep, ratio = toxicity.pick(p, n, number[1], number[0])
    assert set(keep.tolist()) == many and set(np.flatnonzero(w).tolist()) <= many
    g = keep[0]
    assert ratio[0] == pytest.approx(math.log((seen[1][g] + 0.5) / (number[1] + 1)) - math.log((seen[0][g] + 0.5) / (number[0] + 1)))
    got = {r.row.doc_id: r.score for r in toxicity.score_rows(rows, (w, bias)).collect()}
    for i, t, y in texts:
        z = float(sum(float(w[x]) for x in brute_grams(t))) + bias
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5) and (got[i] >= 0.5) == y


def test_toxicity_edges(spark, awkward, nothing):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    w, bias = toxicity.train(awkward, empty)
    assert not w.any() and bias == 0.0
    ones = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, toxic int")
    model = toxicity.train(awkward, ones)
    got = toxicity.score_rows(awkward, model)
    assert got.count() == awkward.count() and got.where("score NOT BETWEEN 0 AND 1 OR score IS NULL").count() == 0
    assert got.select("row.*").columns == awkward.columns
    assert toxicity.score_rows(nothing, model).count() == 0


# --- LM scoring -------------------------------------------------------------


class Plain:
    """PPM by dictionaries, one byte at a time, over whole texts."""

    def __init__(self, texts):
        self.ctx = {}
        for t in texts:
            code = self.code(t)
            for i in range(ppm.ORDER, len(code)):
                for k in range(ppm.ORDER + 1):
                    self.ctx.setdefault(code[i - k : i], Counter())[code[i]] += 1

    @staticmethod
    def code(text):
        return b"\n" * ppm.ORDER + b"".join(w + b" " for w in ppm.tokens(text)) + b"\n"

    def log10(self, text):
        code, out = self.code(text), 0.0
        for i in range(ppm.ORDER, len(code)):
            gone, coded = set(), False
            for k in range(ppm.ORDER, -1, -1):
                live = {b: c for b, c in self.ctx.get(code[i - k : i], {}).items() if b not in gone}
                if not live:
                    continue
                total, distinct = sum(live.values()), ppm.DISCOUNT * len(live)
                if code[i] in live:
                    out += math.log10(live[code[i]] / (total + distinct))
                    coded = True
                    break
                out += math.log10(distinct / (total + distinct))
                gone |= set(live)
            if not coded:
                out -= math.log10(256 - len(gone))
        return out


def trained(texts):
    keys, n = np.unique(ppm.windows([Plain.code(t)[ppm.ORDER :] for t in texts]), return_counts=True)
    return ppm.Trie(ppm.levels_of(keys, n, ppm.ORDER, 0))


def test_trie_against_dictionaries():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(12))) for _ in range(40)]
    plain, trie = Plain(texts), trained(texts)
    for t in [*texts, "zzz", "", "abcdeabcde", "é ab Ab"]:
        assert trie.costs(ppm.windows([Plain.code(t)[ppm.ORDER :]])).sum() == pytest.approx(plain.log10(t))
    none = ppm.Trie(ppm.levels_of(np.empty(0, np.int64), np.empty(0, np.int64), ppm.ORDER, 0))
    assert none.costs(ppm.windows([b"ab \n", b"\n"])).sum() == pytest.approx(-5 * math.log10(256))


def test_codes_sum_to_at_most_one():
    trie = trained(["a ab", "ab a a", "abc", ""])
    for context in (b"\n\n\n\n\n", b"a ab ", b"\n\nab ", b"zzzzz", b"zzzza"):
        one = int.from_bytes(context, "big") << 8
        assert (10 ** trie.costs(one + np.arange(256))).sum() == pytest.approx(1)


def test_op6_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(ppm, "CHUNK_TOKENS", 2000)  # several chunks, pieces and buckets
    monkeypatch.setattr(ppm, "PIECE_BYTES", 5000)
    monkeypatch.setattr(ppm, "BUCKET_WINDOWS", 3000)
    got = {r.doc_id: r for r in ppm.op6_lm_scoring(spark, SF).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    toks = {i: [*ppm.tokens(t), ppm.END] for i, t in docs.items()}
    c = Counter()
    for i, t in toks.items():
        if not held[i]:
            c.update(t)
    n, v = sum(c.values()), len(c)
    plain = Plain([t for i, t in docs.items() if not held[i]])
    assert got.keys() == docs.keys()
    for i, t in toks.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
    for i in list(docs)[:60]:
        assert got[i].score == pytest.approx(plain.log10(docs[i]))


def test_the_trie_grows_and_word_order_counts(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10)) for _ in range(150_000)]
    texts = [(i, " ".join(words[s : s + 500])) for i, s in enumerate(range(0, len(words), 500))]
    known = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 10][:5]
    mixed = [(1000 + i, " ".join(sorted(texts[i][1].split()))) for i in known]
    rows = spark.createDataFrame(texts + mixed, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.score for r in ppm.lm_score(rows).collect()}
    whole = trained([t for i, t in texts + mixed if zlib.crc32(str(i).encode()) % 10])
    assert len(whole.levels[0].keys) > 1 << 20
    for i, t in texts[:20] + mixed:
        assert got[i] == pytest.approx(whole.costs(ppm.windows([Plain.code(t)[ppm.ORDER :]])).sum())
    assert all(abs(got[i] - got[1000 + i]) > 1 for i in known)


def test_the_model_beats_the_base_line_on_held_out_texts(spark):
    r = ppm.op6_lm_scoring(spark, SF2).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_lm_edges(spark, awkward, nothing):
    got = ppm.lm_score(awkward).collect()
    assert len(got) == awkward.count() and all(math.isfinite(r.score) and r.score < 0 and r.n_tokens >= 1 for r in got)
    same = [(r.n_tokens, round(r.score, 9)) for r in got if r.doc_id in (1, 2)]
    assert len(set(same)) == 1
    assert ppm.lm_score(nothing).count() == 0
    alone = [x for x in range(200) if zlib.crc32(str(x).encode()) % 10 == 0][0]
    lonely = ppm.lm_score(spark.createDataFrame([(alone, "all held out")], "doc_id long, text string")).first()
    assert lonely.train_tokens == 0 and lonely.n_known == 0 and lonely.score < 0


# --- near-dedup -------------------------------------------------------------


def test_samples_estimate_weighted_jaccard():
    rng, s, diff = np.random.default_rng(0), near_dedup.Sampler(), []
    for _ in range(60):
        base = rng.integers(0, 2**63, 200, dtype=np.uint64)
        k = int(rng.integers(0, 150))
        a, b = np.unique(base), np.unique(np.concatenate([base[k:], rng.integers(0, 2**63, k, dtype=np.uint64)]))
        w = {int(x): 1 + 2 * rng.random() for x in np.union1d(a, b)}
        wa, wb = (np.array([w[int(x)] for x in y], np.float32) for y in (a, b))
        diff.append((s.draw(a, wa) == s.draw(b, wb)).mean() - near_dedup.weighted_jaccard((a, wa), (b, wb)))
    assert abs(np.mean(diff)) < 0.03


def copies(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    docs, truth, i = [], {}, 0
    for g in range(40):
        words = [word() for _ in range(rng.randrange(150, 400))]
        for _ in range(rng.choice([1, 1, 2, 3, 30])):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1])):
                w[rng.randrange(len(w))] = word()
            docs.append((i, " ".join(w)))
            truth[i] = g
            i += 1
    return spark.createDataFrame(docs, "doc_id long, text string"), truth


def test_planted_copies_meet_and_others_do_not(spark):
    d, truth = copies(spark)
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(d).collect()}
    by = defaultdict(set)
    for i, g in truth.items():
        by[g].add(got[i])
    assert all(len(v) == 1 for v in by.values()) and len(set(got.values())) == len(by)
    assert all(got[i] <= i for i in got)


def test_cut_buckets_find_the_same_classes(spark, monkeypatch):
    d, truth = copies(spark)
    monkeypatch.setattr(near_dedup, "BUCKET", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(d).collect()}
    assert len(set(got.values())) == len(set(truth.values()))


def test_a_pair_is_taken_in_every_bucket_it_shares(spark):
    # the first shared band may be a hot one whose bucket was cut, so a later bucket must take the pair as well
    samples = np.arange(2 * near_dedup.SAMPLES, dtype=np.uint32).reshape(2, -1)
    samples[1, :21] = samples[0, :21]  # seven bands
    nodes = spark.createDataFrame([(b, n, bytearray(samples[n].astype("<u4").tobytes())) for b in (int(near_dedup.band_keys(samples)[0, 3]),) for n in (0, 1)], "bucket long, node long, samples binary")
    assert [tuple(r) for r in near_dedup.pairs(nodes).collect()] == [(0, 1)]


def templates(spark):
    """Texts of one template that are mostly not alike, with ten pairs that are, and the class of each by all pairs."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    base = [word() for _ in range(600)]
    texts = []
    for k in range(200):
        w = list(base)
        for x in rng.sample(range(5, 595), 8):
            w[x] = word()
        texts.append(w)
        if k < 10:  # a partner that shares three of the eight changes
            near, own = list(base), [x for x in range(600) if w[x] != base[x]][:3]
            for x in own:
                near[x] = w[x]
            for x in rng.sample(range(5, 595), 5):
                near[x] = word()
            texts.append(near)
    texts = [" ".join(w) for w in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = near_dedup.idf_table(near_dedup.document_frequencies(docs), len(texts))
    sets, least = [near_dedup.weighted_set(t, idf) for t in texts], list(range(len(texts)))
    for x in range(len(texts)):
        for y in range(x + 1, len(texts)):
            if near_dedup.weighted_jaccard(sets[x], sets[y]) >= near_dedup.THRESHOLD:
                low, high = sorted((least[x], least[y]))
                least = [low if v == high else v for v in least]
    return docs, dict(enumerate(least))


def test_nearest_strangers_hide_no_near_copy(spark):
    docs, truth = templates(spark)
    assert 100 < len(set(truth.values())) < len(truth) - 5
    assert {r.doc_id: r.class_id for r in near_dedup.near_dedup(docs).collect()} == truth


def test_large_buckets_are_compared_whole(spark, monkeypatch):
    docs, truth = templates(spark)
    monkeypatch.setattr(near_dedup, "BUCKET", 16)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    assert {r.doc_id: r.class_id for r in near_dedup.near_dedup(docs).collect()} == truth


def test_links_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(docs).collect()}
    rows = docs.collect()
    idf = near_dedup.idf_table(near_dedup.document_frequencies(docs), len(rows))
    first = {}
    for r in rows:
        first.setdefault(r.text, r.doc_id)
        assert got[r.doc_id] == got[first[r.text]]
    ids, sets = list(first.values()), [near_dedup.weighted_set(t, idf) for t in first]
    inverted, met = defaultdict(list), Counter()
    for k, (h, _) in enumerate(sets):
        for x in h.tolist():
            inverted[x].append(k)
    for v in inverted.values():
        for x in range(len(v)):
            for y in range(x + 1, len(v)):
                met[v[x], v[y]] += 1
    linked = [(x, y) for (x, y), n in met.items() if near_dedup.weighted_jaccard(sets[x], sets[y]) >= near_dedup.THRESHOLD]
    assert linked and all(got[ids[x]] == got[ids[y]] for x, y in linked)
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in linked:
        parent[find(x)] = find(y)
    assert len({got[i] for i in ids}) == len({find(x) for x in range(len(ids))})


def test_near_dedup_edges(awkward, nothing):
    got = near_dedup.near_dedup(awkward).collect()
    assert len(got) == awkward.count()
    cls = defaultdict(set)
    for r in got:
        cls[r.doc_id].add(r.class_id)
    assert cls[1] == cls[2] == cls[3] == {1} and cls[7] == {7}
    # null and empty are the same text, white space is another one; null ids have a class too
    assert cls[4] == cls[5] == {4} and cls[6] == {6} and cls[None] == {None, 4}
    assert near_dedup.near_dedup(nothing).count() == 0


# --- the pipeline and the registry -------------------------------------------


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    labels = {r.doc_id: (r.toxic, r.quality) for r in spark.read.parquet(f"{SF2}/labels.parquet").collect()}
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF2)
        assert after.columns == docs.columns and after.schema.simpleString() == docs.schema.simpleString()
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-stage-{name}"
        after.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        kept = {r.doc_id for r in docs.collect()}
        assert kept < before
        gone = [labels[i] for i in before - kept if i in labels]
        if name == "toxicity":
            assert sum(t for t, _ in gone) > 0.7 * len(gone)
        if name == "quality_rules":
            assert all(labels[i][1] == 1 for i in kept if i in labels)
        if name == "near_dedup":
            texts = [r.text for r in docs.collect()]
            assert len(set(texts)) == len(texts)
        before = kept
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF2).select("doc_id").distinct().collect()} == before


def test_pipeline_edges(spark, awkward, nothing):
    for rows in (awkward, nothing):
        d = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, SF)
            assert d.columns == awkward.columns
            d = spark.createDataFrame(d.collect(), d.schema)
        corpus_pipeline.STAGES[-1][1](spark, d, SF).count()
    one = corpus_pipeline.near_dedup_stage(spark, awkward, SF)
    ids = [r.doc_id for r in one.collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(12) == 1 and ids.count(14) == 2


def test_every_operator_has_a_query():
    names = registry.queries()
    assert [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(registry.oracle_sql()) <= set(names)
    assert packing.BIN_TOKENS == 2048


def test_native_queries_match_their_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    for name, sql in registry.oracle_sql().items():
        got = registry.queries()[name](spark, SF)
        want = c.sql(sql)
        cols = sorted(got.columns)
        a = sorted((tuple(plain(r[x]) for x in cols) for r in got.collect()), key=repr)
        at = [want.columns.index(x) for x in cols]
        assert a == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr), name
