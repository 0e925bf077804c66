"""BPE, packing and fingerprints against their libraries and plain loops."""

from __future__ import annotations

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillsift.llm import bpe, fingerprint, packing

SF = "/root/testdata/sf0.001"
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def tables():
    return bpe.Tables(bpe.read_ranks(MULTI), PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})


def test_perfect_hash_is_minimal(tables):
    h = tables.hash
    assert sorted(h.index) == list(range(h.n)) and h.n == len(tables.tokens)
    assert all(h.find(k) == i for i, k in enumerate(tables.tokens[:5000]))
    assert h.find(b"no such token in there") is None and bpe.PerfectHash([]).find(b"x") is None
    assert bpe.PerfectHash([b"one"]).find(b"one") == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoding_equals_the_library(tables, library, text):
    enc = bpe.Encoder(tables)
    ids = enc.encode(text)
    assert ids == library.encode_ordinary(text)
    assert b"".join(tables.tokens[i] for i in ids) == text.encode()


def test_memo_generations_do_not_change_ids(tables, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    enc = bpe.Encoder(tables)
    text = "thanonon erwhing thanonon zzxxqq aaaa bbbb thanonon " * 5
    assert enc.encode(text) == library.encode_ordinary(text)
    assert len(enc) <= 3 and len(enc.old) <= 3


def test_op1_round_trip(spark, library):
    got = {r.doc_id: r for r in bpe.op1_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode_ordinary(r.text or "")
        x = got[r.doc_id]
        assert x.n_tokens == len(ids) and x.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_bpe_edges(awkward, nothing, library):
    d = bpe.decode(bpe.encode(awkward, MULTI, PATTERN), MULTI, PATTERN).collect()
    assert len(d) == awkward.count()
    texts = sorted((r.text or "") for r in awkward.collect())
    assert sorted(bytes(r.bytes).decode() for r in d) == texts
    assert bpe.encode(nothing, MULTI, PATTERN).count() == 0


def test_packing_ids_are_those_of_the_json_vocabulary(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {k: np.array(x.ids + [0], "<u4") for k, x in zip(docs, tok.encode_batch(list(docs.values()), add_special_tokens=False))}
    got = packing.op7_best_fit_packing(spark, SF).collect()
    covered = {k: 0 for k in docs}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length <= 2048 and zlib.crc32(part) == r.ids_crc32
        covered[r.doc_id] += r.length
        if r.piece:
            assert r.length == 2048
    assert covered == {k: len(v) for k, v in ids.items()}
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(map(len, ids.values()))
    assert len(bins) <= -(-total // 2048) * 1.01 + 1


def test_local_search_empties_bins(spark):
    lengths, size = [6, 5, 5, 4, 4, 3, 3], 10
    start = packing.as_they_come(lengths, size)
    end = packing.local_search(start, lengths, size)
    assert sorted(i for b in end for i in b) == list(range(len(lengths)))
    assert len(start) > len(end) == 3 and all(sum(lengths[i] for i in b) <= size for b in end)
    rng = random.Random(0)
    for _ in range(50):
        lengths = [rng.randrange(1, 100) for _ in range(rng.randrange(1, 60))]
        end = packing.local_search(packing.as_they_come(lengths, 100), lengths, 100)
        assert sorted(i for b in end for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 100 for b in end)
    assert packing.local_search([], [], 10) == []
    # on real lengths the exchanges do the work: a fifth of the bins goes, up to the least number but one
    encode = packing.worker_encoder(*packing.vocabulary()).encode_to_numpy
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    some = [n for t in texts for _, n in packing.cuts(len(encode(t)) + 1, 2048) if n < 2048]
    start = packing.as_they_come(some, 2048)
    end = packing.local_search(start, some, 2048)
    assert len(end) <= -(-sum(some) // 2048) + 1 and len(end) < 0.85 * len(start)


def test_no_exchange_is_left():
    rng = random.Random(5)
    for _ in range(30):
        lengths = [rng.randrange(20, 60) for _ in range(20)]
        end = packing.local_search(packing.as_they_come(lengths, 100), lengths, 100)
        if len(end) > -(-sum(lengths) // 100):
            state = packing.Exchanges(end, lengths, 100)
            for s, source in enumerate(end):
                for t, target in enumerate(end):
                    room, fill = 100 - state.fill[t], state.fill[t]
                    if s != t and room and state.fill[s] <= fill:
                        out = [0, *(lengths[i] for i in target), *(lengths[i] + lengths[j] for x, i in enumerate(target) for j in target[x + 1 :])]
                        assert not any(0 < lengths[a] - o <= room for a in source for o in out)


def test_repeated_rows_are_dealt_to_all_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 100)
    d = spark.createDataFrame([(1, "the same short text")] * 1000, "doc_id long, text string")
    got = packing.best_fit_packing(d, *packing.vocabulary()).select("sequence_id").collect()
    assert len(got) == 1000 and len({r.sequence_id >> 32 for r in got}) == 10


def test_cuts():
    assert packing.cuts(1, 4) == [(0, 1)] and packing.cuts(4, 4) == [(0, 4)]
    assert packing.cuts(9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.cuts(8, 4) == [(0, 4), (4, 4)]


def test_packing_edges(awkward, nothing):
    p = packing.best_fit_packing(awkward, *packing.vocabulary())
    firsts = p.where("piece = 0").count()
    assert firsts == awkward.count()
    assert packing.best_fit_packing(nothing, *packing.vocabulary()).count() == 0


def brute_sketch(text):
    words = text.split() if text else []
    return set(fingerprint.shingles(text).tolist()) if words else set()


def test_sketch_estimates_containment():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    whole, part = " ".join(words), " ".join(words[:400])
    a, b = fingerprint.sketch(whole), fingerprint.sketch(part)
    assert fingerprint.containment(b, a) == 1.0
    assert abs(fingerprint.containment(a, b) - 0.1) < 0.04
    again = fingerprint.from_hex(fingerprint.to_hex(a))
    assert again.own is a.own is None and np.array_equal(again.kept, a.kept)
    assert len(a.kept) == sum(h < 2**62 for h in brute_sketch(whole))


@pytest.mark.parametrize("n", [4, 36, 37, 60, 68, 69, 130, 260, 270, 2000])
def test_merged_parts_give_the_sketch_of_the_whole(n):
    rng = random.Random(n)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    whole = fingerprint.sketch(" ".join(words))
    for cut in (5, n // 3, n // 2, n - 7):
        if 5 <= cut <= n - 5:
            parts = fingerprint.merge(fingerprint.sketch(" ".join(words[:cut])), fingerprint.sketch(" ".join(words[cut - 4 :])))
            assert fingerprint.to_hex(parts) == fingerprint.to_hex(whole)
    every = brute_sketch(" ".join(words))
    assert set(whole.kept.tolist()) == {h for h in every if h < 2**62}  # one fraction for all sizes
    assert (set(whole.own.tolist()) == every) if n <= 68 else whole.own is None


@pytest.mark.parametrize("n, unknown", [(5, 0.24), (30, 0.0002), (65, 0.0)])
def test_short_texts_inside_long_ones(n, unknown):
    """A text that stands whole inside one of 3,000 shingles is found whole, or said to be unknown; a stranger never is."""
    rng = random.Random(n)
    missing = 0
    for _ in range(300):
        words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3004)]
        at = rng.randrange(2000)
        part, long = fingerprint.sketch(" ".join(words[at : at + n + 4])), fingerprint.sketch(" ".join(words))
        got = fingerprint.containment(part, long)
        assert got in (fingerprint.UNKNOWN, 1.0)
        missing += got == fingerprint.UNKNOWN
        assert fingerprint.containment(fingerprint.sketch(" ".join("z" + w for w in words[:n])), long) in (fingerprint.UNKNOWN, 0.0)
        assert fingerprint.containment(long, part) <= n / 3000 + 0.03
    assert abs(missing / 300 - unknown) < 0.08


def test_short_texts_are_compared_exactly():
    a, b = "one two three four five six seven", "one two three four five six eight"
    x, y = brute_sketch(a), brute_sketch(b)
    assert fingerprint.containment(fingerprint.sketch(a), fingerprint.sketch(b)) == len(x & y) / len(x)
    assert fingerprint.containment(fingerprint.sketch(""), fingerprint.sketch(" ")) == 1.0
    assert fingerprint.containment(fingerprint.sketch("a"), fingerprint.sketch("")) == 0.0


def test_op3_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 7)  # many ranges, so that their edges count
    got = {r.doc_id: r for r in fingerprint.op3_fingerprints(spark, SF).collect()}
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert len(got) == len(docs)
    for (i, a), (_, b) in zip(docs, docs[1:] + docs[:1]):
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprint.to_hex(fingerprint.sketch(a)) and r.edited_fingerprint == fingerprint.to_hex(fingerprint.sketch(edited))
        assert r.near_edited == fingerprint.containment(fingerprint.sketch(a), fingerprint.sketch(edited))
        assert r.near_next == fingerprint.containment(fingerprint.sketch(a), fingerprint.sketch(b))


def test_rows_of_one_id_are_dealt_to_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 10)
    from pyspark.sql import functions as F

    texts = [(None if i % 3 else i, f"text number {i % 90} of all") for i in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    order = [r.text for r in df.withColumn("h", F.xxhash64("text")).orderBy(F.col("doc_id").asc_nulls_first(), "h", "text").collect()]
    seen = []

    def run(triples):
        import pyarrow as pa

        for _, a, b in triples:
            yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([b])], ["a", "b"])

    seen = sorted((r.a, r.b) for r in fingerprint.with_next(df, run, "a string, b string").collect())
    assert seen == sorted(zip(order, order[1:] + order[:1]))


def test_fingerprint_edges(awkward, nothing, spark):
    d = fingerprint.compare_edited(awkward).collect()
    assert len(d) == awkward.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in d)
    assert len({r.fingerprint for r in d if r.doc_id in (1, 2)}) == 1
    assert fingerprint.compare_edited(nothing).count() == 0 and fingerprint.fingerprints(nothing).count() == 0
    alone = fingerprint.compare_edited(awkward.where("doc_id = 12").limit(1)).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
