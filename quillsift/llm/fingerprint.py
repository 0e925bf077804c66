"""Document fingerprints: a threshold-scaled sketch of word shingles.

Every 5-word shingle (of a text with fewer words: all its words) is hashed to 64
bits; the sketch keeps every hash below a quarter of the hash range, whatever the
text's size.  So sketches of any sizes compare, and they merge exactly: the union of
two sketches is the sketch of the union.  The share of a sketch's hashes that another
one holds estimates containment, also between very unequal texts.

A text of at most OWN distinct shingles has all its hashes in a field of its own, so
that two such texts are compared exactly.  Against a longer text only the hashes below
a quarter count; a short text may have none of them (three quarters to the power of
its shingles: 24 % of texts with 5, 0.02 % with 30).  Nothing is known then, and the
likeness is UNKNOWN, 0.5.  A fingerprint is ``w:`` and all hashes, or ``p:`` and the
kept ones, sorted, in hex.

``with_next`` pairs each row with the next one by id without a global sort in
one task: ranges of (id, hash of the text) are dealt to tasks, so that very many rows
of one id are split too, and the first row of each range is also sent to the range
before it.

Edge cases: a null text counts as empty; a text without words has the empty
fingerprint, equal only to another empty one (likeness 1, else 0); very long texts
count with all their shingles, repeated ones once; null ids come
first; rows with equal ids follow each other by the hash of their text; a single row is its own
next one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm.common import table, whole_text

SHINGLE_WORDS = 5
#: One hash in 2 ** LEVEL is kept; distinct shingles up to which a text has all of them beside that; likeness where nothing is left to compare.
LEVEL, OWN, UNKNOWN = 2, 64, 0.5
#: Rows of a range of ids, and the most ranges; sampled rows of a range (16 bytes each, the only thing the driver holds).
RANGE_ROWS, MOST_RANGES, SAMPLE = 2000, 1 << 16, 20
MEMO_WORDS = 200_000


class WordHashes(dict):
    """word -> 64-bit hash, of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the text's k-word shingles, in order; of a shorter text one hash of all its words."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(k, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
    return mix(h)


class Sketch(NamedTuple):
    """kept: the sorted hashes below the fraction; own: all of them, or None if there are more than OWN."""

    kept: np.ndarray
    own: np.ndarray | None


def _sketch(h: np.ndarray) -> Sketch:
    return Sketch(below(h), h if len(h) <= OWN else None)


def below(h: np.ndarray) -> np.ndarray:
    """The sorted hashes in the lowest 1 / 2 ** LEVEL of their range."""
    return h[: np.searchsorted(h, np.uint64(1 << 64 - LEVEL))]


def sketch(text: str) -> Sketch:
    return _sketch(np.unique(shingles(text)))


def merge(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of the union of two texts' shingles."""
    if a.own is not None and b.own is not None:
        return _sketch(np.union1d(a.own, b.own))
    return Sketch(np.union1d(a.kept, b.kept), None)


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of a's shingles that b has, exact between short texts; an empty sketch is like another one only."""
    short = a.own is not None and b.own is not None
    x, y = (a.own, b.own) if short else (a.kept, b.kept)
    if not len(x):
        empty = a.own is not None and not len(a.own)
        return float(short and not len(y)) if empty else UNKNOWN
    if not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return float(np.count_nonzero(y[at] == x) / len(x))


def to_hex(s: Sketch) -> str:
    return ("p:" if s.own is None else "w:") + (s.kept if s.own is None else s.own).astype(">u8").tobytes().hex()


def from_hex(s: str) -> Sketch:
    kind, h = s.split(":")
    h = np.frombuffer(bytes.fromhex(h), ">u8").astype(np.uint64)
    return Sketch(h, None) if kind == "p" else _sketch(h)


def with_next(df: DataFrame, run, schema: str) -> DataFrame:
    """Apply ``run`` to (id, text, next text) triples; df has doc_id (integer) and text.

    ``run`` maps an iterator of (doc_id, text, next_text) to record batches.
    """
    spark = df.sparkSession
    d = df.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_k"), F.xxhash64("text").alias("_h"))
    n, low = d.agg(F.count(F.lit(1)), F.min(F.struct("_k", "_h"))).first()
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    pairs = np.dtype([("k", "<i8"), ("h", "<i8")])
    bounds = np.empty(0, pairs)
    if ranges > 1:  # from a sample of some SAMPLE rows a range
        some = np.sort(np.array([tuple(r) for r in d.select("_k", "_h").sample(min(1.0, SAMPLE * ranges / n), 42).toLocalIterator()], pairs))
        bounds = np.unique(some[np.arange(1, ranges) * len(some) // ranges]) if len(some) else some
        bounds = bounds[bounds != np.array(tuple(low), pairs)]
    shared = spark.sparkContext.broadcast((np.array([tuple(low)] if n else [], pairs), bounds))

    @F.pandas_udf("array<int>")
    def targets(k: pd.Series, h: pd.Series) -> pd.Series:
        least, cut = shared.value
        rows = np.empty(len(k), cut.dtype)
        rows["k"], rows["h"] = k, h
        at = np.searchsorted(cut, rows, side="right")
        heads = (at > 0) & (np.concatenate([least, cut])[at] == rows)
        # even: the row itself; odd: a copy for the end of the range before
        return pd.Series([[2 * a] + ([2 * a - 1] if head else []) + ([2 * len(cut) + 1] if first else []) for a, head, first in zip(at.tolist(), heads.tolist(), (rows == least).tolist())])

    d = d.withColumn("_to", F.explode(targets("_k", "_h")))
    d = d.select(F.expr("shiftright(_to, 1)").alias("_range"), (F.col("_to") % 2 == 1).alias("_copy"), "_k", "_h", "doc_id", "text")
    d = d.repartition("_range").sortWithinPartitions("_range", "_copy", "_k", "_h", "text").drop("_k", "_h")

    def triples(batches: Iterator[pa.RecordBatch]):
        at, held = None, None
        for b in batches:
            for r, copy, i, text in zip(*(c.to_pylist() for c in b.columns)):
                if held is not None and r == at:
                    yield (*held, text)
                held = None if copy else (i, text)
                at = r

    return d.mapInArrow(lambda batches: run(triples(batches)), schema)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for each row; moves no rows."""
    rows = df.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([to_hex(sketch(t.as_py())) for t in b.column(1)], pa.string())], ["doc_id", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fingerprint string")


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form (second half from the next text), and their likeness."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(triples):
        out, size, held = [], 0, None
        for i, text, after in triples:
            own = held[1] if held is not None and held[0] is text else sketch(text)
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            e, nxt = sketch(edited), sketch(after)
            held = (after, nxt)
            out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), to_hex(own), to_hex(e), containment(own, e), containment(own, nxt)))
            size += len(out[-1][3]) + len(out[-1][4])
            if len(out) >= 2000 or size > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return with_next(rows, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))
