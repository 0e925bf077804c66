"""Collocations, prefix tries and language identification, against plain loops."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillsift.llm import collocations, language_id, prefix_trie
from tests.llm.conftest import prose
from tests.helpers import rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
VOCABULARY = "Der die RAT Haus\x1f né ñu 😀 zu i18n x-y".split(" ")


def babble(n: int, seed: int, p_stop: float = 0.15) -> str:
    rng = random.Random(seed)
    return "".join(rng.choice(VOCABULARY[: rng.choice((3, 10))]) + rng.choice((" ", "\t", "  ")) + (rng.choice(".,;:!?\n\r\x0b\x0c") if rng.random() < p_stop else "") for _ in range(n))


def loop_collocations(docs, max_n=3, least=10, top=2000, share=50):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, max_n + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = lambda w, v: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
    out = []
    for (lang, w), a in found.items():
        if any(x == lang and len(v) > len(w) and inside(w, v) and 100 * b >= share * a for (x, v), b in found.items()):
            continue
        score, k = min((Fraction(1000000 * a * a, f[lang, w[:k]] * f[lang, w[k:]]).__floor__(), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out.sort()
    ranks = Counter()
    result = []
    for lang, score, a, phrase, l, r in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            result.append((lang, ranks[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(result, key=repr)


@pytest.mark.parametrize("max_n, share", [(2, 50), (3, 50), (4, 80)])
def test_collocations_equal_a_loop(spark, max_n, share):
    docs = [(("aa", "bb", None, "")[i % 4], babble(60, i)) for i in range(40)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    got = collocations.collocations(df, max_n, least=6, top=30, share=share)
    assert rows(got) == loop_collocations(docs, max_n, 6, 30, share)


def test_collocations_are_counted_over_chunks(monkeypatch):
    import pyarrow as pa

    text = babble(3000, 7)
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", "bb"]), pa.array([text, text[:900]])], ["lang", "text"])
    sums = []
    for chunk, block in ((50, 64), (1_000_000, 1 << 20), (700, 1)):
        monkeypatch.setattr(collocations, "BLOCK", block)
        total = Counter()
        for b in collocations.count_rows(iter([batch]), 3, chunk):
            for r in b.to_pylist():
                total[r["lang"], r["phrase"]] += r["f"]
        sums.append(total)
    assert sums[0] == sums[1] == sums[2] and sums[0]["aa", ""] == 3000


def test_phrases_of_many_words_are_numbered_anew():
    import pyarrow as pa

    words = [str(i % 997 * 7919 % 1009) for i in range(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["aa"]), pa.array([" ".join(words)])], ["lang", "text"])
    got = {r["phrase"]: r["f"] for b in collocations.count_rows(iter([batch]), 9) for r in b.to_pylist()}
    want = Counter(" ".join(words[i : i + n]) for n in range(1, 10) for i in range(len(words) - n + 1))
    assert got == {"": 5000} | want


def test_collocations_of_awkward_rows(spark, awkward, nothing):
    docs = [(r.lang, r.text) for r in awkward.select("lang", "text").collect()]
    assert rows(collocations.collocations(awkward, least=3)) == loop_collocations(docs, least=3)
    assert rows(collocations.collocations(nothing)) == []


def test_collocation_scores_do_not_overflow(spark):
    counts = spark.createDataFrame([("aa", "", 10**14), ("aa", "x", 9 * 10**13), ("aa", "y", 8 * 10**13), ("aa", "x y", 7 * 10**13)], collocations.COUNTS)
    got = collocations.scored(counts, 3, 2000, 50).collect()
    assert [r.score for r in got] == [1000000 * 49 * 10**26 // (72 * 10**26)]


def in_order(table):
    """Turns of each conversation; equal numbers by the digest of role and text."""
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        role, text = role or "", text or ""
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}


def loop_rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h, head = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = convs.get(head, [])[:h] + own[h:]
    return out


def loop_trie(convs):
    members, last = defaultdict(list), defaultdict(list)
    for c, turns in sorted(convs.items()):
        last[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(x[:-1] for x in members if x)
    leaves, saved = Counter(), Counter()
    for x, m in members.items():
        for d in range(len(x) + 1):
            leaves[x[:d]] += x not in kids
            saved[x[:d]] += (len(m) - 1) * len(x[-1][1].encode()) if x else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(((m[0], len(x), members[x[:-1]][0] if x else None, len(m), kids[x], leaves[x], saved[x], sha(last[x])) for x, m in members.items()), key=repr)


TURNS = "conv_id long, turn long, role string, text string"


def dialogues(n: int, seed: int, longest: int = 12):
    rng = random.Random(seed)
    out = []
    for c in range(-n // 4, n):
        for t in range(rng.randrange(longest) if c % 7 else 0):
            # few different turns, so that conversations share starts
            out.append((c, rng.choice((t, t, t, t, 0, None)), ("user", "assistant", None)[t % 3], rng.choice(("yes", "né 😀", "", None)) if rng.random() < 0.5 else "same"))
    return out


def trie_rows(df):
    return rows(df.drop("k1", "k2"))


@pytest.mark.parametrize("run", [2, 1024])
def test_trie_equals_a_loop(spark, monkeypatch, run):
    monkeypatch.setattr(prefix_trie, "RUN", run)
    table = dialogues(60, 3)
    ordered = prefix_trie.turns_in_order(spark.createDataFrame(table, TURNS).repartition(7))
    assert trie_rows(prefix_trie.prefix_trie(prefix_trie.rebuilt_sequences(ordered))) == loop_trie(loop_rebuilt(in_order(table)))
    assert trie_rows(prefix_trie.prefix_trie(prefix_trie.plain_sequences(ordered))) == loop_trie(in_order(table))


def test_trie_with_a_hot_conversation_and_hot_ends(spark):
    long = [(10**6, t, "user", str(t % 50)) for t in range(1500)]
    copies = [(c, 0, "user", "0") for c in range(9000)]
    table = long + copies
    ordered = prefix_trie.turns_in_order(spark.createDataFrame(table, TURNS))
    got = {r.depth: r for r in prefix_trie.prefix_trie(prefix_trie.plain_sequences(ordered)).collect()}
    assert len(got) == 1501
    assert (got[0].n_convs, got[1].n_convs, got[2].n_convs, got[1].conv_id, got[2].conv_id, got[2].parent_conv_id) == (9001, 9001, 1, 0, 10**6, 0)
    assert got[1].ends_sha256 == hashlib.sha256(",".join(map(str, range(9000))).encode()).hexdigest()
    assert got[0].n_leaves == 1 and got[0].saved_tokens == got[1].saved_tokens == 9000
    assert got[1500].ends_sha256 == hashlib.sha256(b"1000000").hexdigest() and got[1499].n_children == 1


def test_trie_of_awkward_turns(spark):
    table = [(None, 1, "user", "lost"), (1, None, None, None), (1, 3, "user", "x" * 200_000), (1, 3, "user", "x" * 200_000), (2, 3, "user", "b"), (2, 3, "user", "a"), (3, None, None, None)]
    df = spark.createDataFrame([(*x, 0, "c", 7) for x in table], TURNS + ", depth int, digest string, k1 int")
    got = prefix_trie.prefix_trie(prefix_trie.plain_sequences(prefix_trie.turns_in_order(df)))
    assert trie_rows(got) == loop_trie(in_order(table))
    assert rows(prefix_trie.prefix_trie(prefix_trie.rebuilt_sequences(prefix_trie.turns_in_order(df.limit(0))))) == []


def loop_phrases(text: bytes, sample: bytes) -> int:
    n = i = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def loop_predictions(samples, texts):
    plain = [(lang, b"\n".join(x for x in map(language_id.letters, parts) if x)) for lang, parts in samples]
    plain = [(lang, x) for lang, x in plain if x]
    out = []
    for t in texts:
        t = language_id.letters(t)
        if not t or not plain:
            out.append(("und", 0.0))
            continue
        bits = sorted((loop_phrases(t, x) * math.log2(len(x) + 1), lang) for lang, x in plain)
        out.append((bits[0][1], 1 - bits[0][0] / bits[1][0] if len(bits) > 1 else 1.0))
    return out


@pytest.mark.parametrize("piece", [5, 64, 2048])
def test_phrases_equal_a_loop(monkeypatch, piece):
    monkeypatch.setattr(language_id, "PIECE", piece)
    rng = random.Random(piece)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(20):
        samples = [(lang, [some("abcé ", rng.randrange(1, 60)) for _ in range(3)]) for lang in "xyz"]
        model = language_id.Model(samples)
        texts = [some("abcdÉ. ", rng.randrange(1, 300)) for _ in range(6)] + ["a" * 200, "ab" * 100, "dd", None, "", "12 ²"]
        want = loop_predictions(samples, texts)
        got = list(zip(*model.predict(texts)))
        assert [x for x, _ in got] == [x for x, _ in want]
        assert [s for _, s in got] == pytest.approx([s for _, s in want])


def test_language_of_held_out_texts(spark):
    r = language_id.op11_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(r) > 30 and sum(x.lang == x.lang_pred for x in r) >= 0.97 * len(r)


def test_sample_is_bounded_and_reads_only_labelled_texts(spark):
    docs = [(i, "né " * 300 + str(i), ("aa", "bb", None)[i % 3]) for i in range(60)] + [(99, "", "cc"), (98, None, "dd"), (97, "...", "ee")]
    got = dict(language_id.sample(spark.createDataFrame(docs, "doc_id long, text string, lang string"), rows=7))
    assert sorted(got) == ["aa", "bb", "ee"] and [len(got[x]) for x in ("aa", "bb")] == [7, 7]
    assert max(len(x) for x in got["aa"]) == language_id.FRAGMENT
    assert language_id.Model([("ee", ["..."])]).predict(["abc", "..."]) == (["und", "und"], [0.0, 0.0])


def test_language_of_awkward_rows(spark, awkward, nothing):
    samples = [("en", [prose(500, 1)]), ("xx", ["née ñandú aaaa"])]
    table = awkward.collect()
    got = language_id.predict_rows(awkward, samples).select("row.*", F.col("score").alias("s"), "lang_pred").toPandas()
    want = loop_predictions(samples, [r.text for r in table])
    assert sorted(zip(got.lang_pred, got.s.round(9))) == sorted((x, round(s, 9)) for x, s in want)
    assert set(got.columns) >= set(awkward.columns) and (got.lang_pred == "und").sum() == sum(not any(map(str.isalpha, r.text or "")) for r in table)
    assert rows(language_id.predict_rows(nothing, samples)) == [] and language_id.sample(nothing) == []
