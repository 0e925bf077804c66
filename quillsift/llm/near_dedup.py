r"""MinHash near-dedup: consistent weighted sampling over TF-IDF shingles, banded and verified.

A text is the set of its 5-word shingles (of a shorter text: all its words) with
the weights ``(1 + ln tf) * (1 + IDF_SHARE * idf)``; idf lies between 0 and 1.
Document frequencies are counted over all texts, in a hashed table of fixed size.
Improved consistent weighted sampling draws BANDS * ROWS samples of each set such
that two sets agree in a sample with the probability of their weighted Jaccard
similarity.  Texts that agree in all samples of a band meet in a bucket; pairs of
a bucket that agree in enough samples of all are verified by their exact weighted
Jaccard similarity; verified pairs of THRESHOLD or more are linked, and the links'
connected components are the classes.

Scale.  Equal texts are one node from the start (by two 64-bit hashes), so groups of
copies are never multiplied.  A bucket of more than BUCKET texts is cut by the next
bands' keys, and what is still too large into blocks.  Within a bucket a text is
paired with all candidates if they are few, else with its NEAREST ones.  A pair may
come from each bucket it shares, since any of them may be cut.  These are only short
cuts: after the components of the first links, an exact round compares in each bucket
that was not compared whole all texts that are still in different components, in
tiles of bounded size, and verifies within the tile every pair that agrees in enough
samples.  A tile gives back at most one link for each of its texts, never its pairs.
The idf share is small on purpose: in a large group of near copies the common
shingles are frequent, and with a full idf their few differences would outweigh them.

Edge cases: a null text counts as empty; texts without words are alike only if
equal; very long texts count with all their shingles; of ties the smaller node comes
first; rows of equal texts, also with equal or null ids, are one class; the class id
is the least id in the class (null if all are); an empty table gives an empty
result; only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm.common import release, small_batches, table, whole_text, written
from quillsift.llm.fingerprint import mix, shingles
from quillsift.operators.components import connected_components

THRESHOLD = 0.8
BANDS, ROWS = 10, 3
SAMPLES = BANDS * ROWS
#: Samples that a pair must share to be verified (of pairs at the threshold 1 in 5,000 share fewer).
AGREE = 15
IDF_SHARE = 0.1
#: Counters of the document frequency table, and the pieces it is summed in.
DF_BITS, DF_PIECES = 20, 256
#: Texts of a bucket that are compared in one piece; blocks of larger ones.
BUCKET, BLOCK = 512, 512
#: Texts of a side of a tile of the exact round, and their shingles, about.
TILE_TEXTS, TILE_SHINGLES = 2048, 2_000_000
#: Tasks that the texts of a class are dealt to.
SALTS = 16
#: Partners of a text in a bucket with many candidates.
NEAREST = 4


def text_hashes(text_col: str = "text") -> tuple[Column, Column]:
    """Two hashes by which equal texts are known."""
    return F.xxhash64(whole_text(text_col)).alias("hash"), F.xxhash64(F.lit(1), whole_text(text_col)).alias("hash2")


# --- weights --------------------------------------------------------------


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Texts per hashed shingle, over all rows of ``docs`` (text); 2 ** DF_BITS counters."""
    size = 1 << DF_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int32)
        for b in batches:
            for text in b.column(0):
                seen[np.unique(shingles(text.as_py()) & np.uint64(size - 1)).astype(np.int64)] += 1
        if seen.any():
            parts = [zlib.compress(p.astype("<i4").tobytes(), 1) for p in np.split(seen, DF_PIECES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(DF_PIECES), pa.int32()), pa.array(parts, pa.binary())], ["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of a piece come one after the other, so one sum is held
        at, total = None, None
        for b in batches:
            for piece, c in zip(b.column(0).to_pylist(), b.column(1)):
                if piece != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["piece", "counts"])
                    at, total = piece, np.zeros(size // DF_PIECES, np.int64)
                total += np.frombuffer(zlib.decompress(c.as_py()), "<i4")
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["piece", "counts"])

    out = np.zeros((DF_PIECES, size // DF_PIECES), np.int64)
    counted = docs.select("text").mapInArrow(count, "piece int, counts binary").repartition("piece").sortWithinPartitions("piece")
    for r in counted.mapInArrow(add, "piece int, counts binary").toLocalIterator():
        out[r.piece] = np.frombuffer(bytes(r.counts), np.int64)
    return out.reshape(-1)


def idf_table(df: np.ndarray, n: int) -> np.ndarray:
    """idf between 0 (in every text) and 1 (in none).

    The counters' median, what other shingles add to each of them, is taken off first, so that a large corpus does not fill them.
    """
    df = np.maximum(df - int(np.median(df)), 0)
    return (np.log((1 + n) / (1 + np.minimum(df, n))) / np.log(1 + max(n, 1))).astype(np.float32)


def weighted_set(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, weights)."""
    h, tf = np.unique(shingles(text), return_counts=True)
    return h, ((1 + np.log(tf)) * (1 + IDF_SHARE * idf[(h & np.uint64(len(idf) - 1)).astype(np.int64)])).astype(np.float32)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    at = np.searchsorted(hb, ha).clip(0, len(hb) - 1)
    both = hb[at] == ha
    low = float(np.minimum(wa[both], wb[at[both]]).sum(dtype=np.float64))
    return low / (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - low)


# --- consistent weighted sampling ----------------------------------------


class Sampler:
    """Draws the samples; gamma variables come from tables by bits of a shingle's hash."""

    def __init__(self):
        rng = np.random.default_rng(20240501)
        u = rng.random((4, 1 << 16))
        self.r = -np.log(u[0] * u[1]).astype(np.float32)
        self.log_c = np.log(-np.log(u[2] * u[3])).astype(np.float32)
        self.odd = (rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

    def draw(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """SAMPLES 32-bit samples of the weighted set, each the hash of an element and its level."""
        best, out = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint32)
        for s in range(0, len(h), 8192):
            part, log_w = h[s : s + 8192], np.log(w[s : s + 8192])
            z = part[None, :] * self.odd[:, None]
            z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            r = self.r[(z >> np.uint64(48)).astype(np.uint16)]
            beta = ((z >> np.uint64(16)).astype(np.uint16)).astype(np.float32) * np.float32(2**-16)
            level = np.floor(log_w[None, :] / r + beta)
            log_a = self.log_c[(z >> np.uint64(32)).astype(np.uint16)] - r * (level - beta) - r
            k = np.argmin(log_a, axis=1)
            rows = np.arange(SAMPLES)
            better = log_a[rows, k] < best
            best[better] = log_a[rows, k][better]
            value = mix(part[k] + level[rows, k].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out[better] = (value >> np.uint64(32)).astype(np.uint32)[better]
        return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """Keys of the bands, from samples of shape (n, SAMPLES)."""
    s = samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), s.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, i])
    return key.view(np.int64)


def sketches(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(hash, hash2, doc_id, samples, keys, shingles) for each row of docs (hash, hash2, doc_id, text); samples and keys are null for texts without words."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sampler = shared.value, Sampler()
        for b in batches:
            rows, sizes = [], []
            for text in b.column(3):
                h, w = weighted_set(text.as_py(), table)
                rows.append(sampler.draw(h, w) if len(h) else None)
                sizes.append(len(h))
            some = np.array([r for r in rows if r is not None], np.uint32).reshape(-1, SAMPLES)
            keys = iter(band_keys(some).tolist())
            drawn = [None if r is None else r.astype("<u4").tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(drawn, pa.binary()), pa.array([None if r is None else next(keys) for r in rows], pa.list_(pa.int64())), pa.array(sizes, pa.int64())],
                ["hash", "hash2", "doc_id", "samples", "keys", "shingles"],
            )
        release()

    return docs.select("hash", "hash2", "doc_id", "text").mapInArrow(run, "hash long, hash2 long, doc_id long, samples binary, keys array<long>, shingles long")


# --- candidates -----------------------------------------------------------


def in_buckets(texts: DataFrame) -> DataFrame:
    """Each text in each of its buckets with two texts or more; texts: one row per node with samples, keys and shingles."""
    placed = texts.select("node", "samples", "keys", "shingles", F.posexplode("keys").alias("band", "bucket"))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return written(placed.join(sizes, "bucket"), "buckets")


def buckets(placed: DataFrame) -> DataFrame:
    """(bucket, node, samples) of the buckets, with the large ones cut."""
    small = placed.where(F.col("n") <= BUCKET).select("bucket", "node", "samples")
    # cut a large bucket by the keys of the three bands that follow
    step = F.explode(F.array(*(F.lit(i) for i in (1, 2, 3))))
    finer = placed.where(F.col("n") > BUCKET).withColumn("step", step)
    finer = finer.withColumn("fine", F.xxhash64("bucket", "step", F.expr(f"keys[(band + step) % {BANDS}]")))
    fine = finer.groupBy("fine").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("first")).where("m > 1")
    # both sides of the join come straight from a shuffle, so that Spark can split the partition of a hot cut
    finer = finer.join(written(fine, "cuts"), "fine")
    few = finer.where(F.col("m") <= BUCKET).select(F.col("fine").alias("bucket"), "node", "samples")
    many = finer.where(F.col("m") > BUCKET)
    blocks = F.ceil(F.col("m") / BLOCK)
    # texts of a cut that is still large are dealt to blocks, and its first text goes to each of them
    block = F.when(F.col("node") == F.col("first"), F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", F.lit(7)), blocks)))
    many = many.withColumn("block", F.explode(block)).select(F.xxhash64("fine", "block").alias("bucket"), "node", "samples")
    # what does not meet so is left to the exact round
    return small.unionByName(few).unionByName(many)


def candidate_pairs(samples: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (i < j) of a bucket's texts to verify."""
    n = len(samples)
    left, right, agree = [], [], []
    for s in range(0, n, 256):
        same = np.zeros((min(256, n - s), n), np.uint8)
        for k in range(SAMPLES):
            same += samples[s : s + 256, k, None] == samples[None, :, k]
        i, j = np.nonzero(same >= AGREE)
        use = i + s < j
        left.append(i[use] + s)
        right.append(j[use])
        agree.append(same[i[use], j[use]])
    i, j, agree = np.concatenate(left), np.concatenate(right), np.concatenate(agree)
    if not len(i):
        return []
    if len(i) > NEAREST * n:
        a, b, g = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([agree, agree])
        order = np.lexsort((b, -g.astype(np.int16), a))
        a, b = a[order], b[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        a, b = a[rank < NEAREST], b[rank < NEAREST]
        code = np.unique(np.minimum(a, b).astype(np.int64) * n + np.maximum(a, b))
        i, j = code // n, code % n
    return list(zip(i.tolist(), j.tolist()))


def pairs(placed: DataFrame) -> DataFrame:
    """Distinct candidate pairs (a, b), a < b, of all buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        at = None
        out_a: list[int] = []
        out_b: list[int] = []

        def close() -> None:
            rows = dict(held)  # a node is once in a bucket
            if len(rows) > 1:
                nodes = sorted(rows)
                samples = np.frombuffer(b"".join(rows[x] for x in nodes), "<u4").reshape(-1, SAMPLES)
                for i, j in candidate_pairs(samples):
                    out_a.append(nodes[i])
                    out_b.append(nodes[j])

        for b in batches:
            for bucket, node, s in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != at:
                    close()
                    held, at = [], bucket
                held.append((node, s))
            if len(out_a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
                out_a.clear()
                out_b.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return placed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long").distinct()


# --- verification and classes --------------------------------------------


def text_of(nodes: DataFrame, docs: DataFrame, one: DataFrame) -> DataFrame:
    """(node, text) of distinct nodes; of the rows that hold a text one with its least id is taken."""
    ends = nodes.select("node").join(one.select("node", "hash", "hash2", F.col("doc_id").alias("_id")), "node")
    # the texts are shuffled alike at every size
    found = docs.join(ends.hint("merge"), ["hash", "hash2"]).where(F.col("doc_id").eqNullSafe(F.col("_id")))
    return found.dropDuplicates(["hash", "hash2"]).select("node", "text")


def verified(links: DataFrame, docs: DataFrame, one: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is at least the threshold."""
    shared = links.sparkSession.sparkContext.broadcast(idf)
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = written(text_of(ends, docs, one), "texts")
    d = links.select("a", "b").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    d = d.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        last, own = None, None
        for b in batches:
            keep = []
            for a, text_a, text_b in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
                if a != last:
                    last, own = a, weighted_set(text_a.as_py(), table)
                keep.append(weighted_jaccard(own, weighted_set(text_b.as_py(), table)) >= threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return d.mapInArrow(run, "a long, b long")


# --- the exact round ------------------------------------------------------

TILE = ["bucket", "i", "j"]
TILE_FIELDS = "bucket long, i long, j long, left boolean, node long, samples binary, band int, part long, asks boolean"


def tile_pairs(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (left, right) of a tile whose pair has to be verified, some left rows at a time.

    Pairs of different components that agree in enough samples.  Two texts that both ask
    meet twice and count once, and a pair belongs to the first band it shares: if that
    bucket is not in this round, all its pairs were verified.
    """
    left, node, part, asks = (t.column(c).to_numpy(zero_copy_only=False) for c in ("left", "node", "part", "asks"))
    samples = np.frombuffer(b"".join(t.column("samples").to_pylist()), "<u4").reshape(-1, SAMPLES)
    keys, band = band_keys(samples), t.column("band")[0].as_py()
    x, y = np.flatnonzero(left), np.flatnonzero(~left)
    columns = np.ascontiguousarray(samples[y].T)
    for s in range(0, len(x), 128):
        own = x[s : s + 128]
        same = np.zeros((len(own), len(y)), np.uint8)
        for k in range(SAMPLES):
            same += samples[own, k][:, None] == columns[k][None, :]
        p, q = np.nonzero((same >= AGREE) & (part[own][:, None] != part[y][None, :]))
        p, q = own[p], y[q]
        use = (~asks[q] | (node[p] < node[q])) & (np.argmax(keys[p] == keys[q], axis=1) == band)
        yield p[use], q[use]


def tiles(placed: DataFrame, parts: DataFrame) -> DataFrame:
    """TILE_FIELDS: the texts of each tile that are in a pair to verify.

    In a bucket that was not compared whole the texts outside its largest component ask all texts; the two
    sides are dealt into blocks, and a tile is a block of either.
    """
    # of at most 2 * NEAREST + 1 texts all pairs were taken
    hot = placed.where(F.col("n") > min(2 * NEAREST + 1, BUCKET)).select("bucket", "band", "node", "samples", "shingles")
    hot = written(hot.join(parts.select("node", F.col("component").alias("part")), "node", "left").withColumn("part", F.coalesce("part", "node")), "hot")
    mixed = hot.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("k"), F.sum("shingles").alias("s")).groupBy("bucket")
    mixed = mixed.agg(F.sum("k").alias("n"), F.sum("s").alias("s"), F.max(F.struct("k", "part", "s")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks = lambda n, s: F.greatest(F.ceil(n / TILE_TEXTS), F.ceil(s / TILE_SHINGLES))
    mixed = mixed.select("bucket", F.col("most.part").alias("main"), blocks(F.col("n") - F.col("most.k"), F.col("s") - F.col("most.s")).alias("rows"), blocks(F.col("n"), F.col("s")).alias("columns"))
    d = hot.join(written(mixed, "mixed"), "bucket").withColumn("asks", F.col("part") != F.col("main"))
    block = lambda n: F.pmod(F.xxhash64("node"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    held = ["node", "samples", "band", "part", "asks"]
    asking = d.where("asks").select("bucket", block(F.col("rows")).alias("i"), every(F.col("columns")).alias("j"), F.lit(True).alias("left"), *held)
    asked = d.select("bucket", every(F.col("rows")).alias("i"), block(F.col("columns")).alias("j"), F.lit(False).alias("left"), *held)

    def run(t: pa.Table) -> pa.Table:
        some = np.zeros(t.num_rows, bool)
        for p, q in tile_pairs(t):
            some[p] = some[q] = True
        return t.filter(pa.array(some))

    return asking.unionByName(asked).groupBy(*TILE).applyInArrow(run, TILE_FIELDS)


def exact_links(held: DataFrame, docs: DataFrame, one: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """(a, b): components that a verified pair of a tile links; held: what ``tiles`` gives."""
    shared = held.sparkSession.sparkContext.broadcast(idf)
    texts = written(text_of(held.select("node").distinct(), docs, one), "tile-texts")
    d = held.join(texts.hint("merge"), "node").select(*(f.split()[0] for f in TILE_FIELDS.split(", ")), "text")

    def run(t: pa.Table) -> pa.Table:
        node, part, text = (t.column(c) for c in ("node", "part", "text"))
        node, part = node.to_numpy(), part.to_numpy()
        right = np.flatnonzero(~t.column("left").to_numpy(zero_copy_only=False))
        sets = {n: None for n in node.tolist()}
        for n, x in zip(node.tolist(), text):
            if sets[n] is None:
                sets[n] = weighted_set(x.as_py(), shared.value)
        # the right side's sets one after the other, by numbers of the tile's shingles
        place = np.full(t.num_rows, -1)
        place[right] = np.arange(len(right))
        sizes = [len(sets[n][0]) for n in node[right].tolist()]
        known, flat = np.unique(np.concatenate([sets[n][0] for n in node[right].tolist()]), return_inverse=True)
        weights = np.concatenate([sets[n][1] for n in node[right].tolist()]).astype(np.float64)
        starts = np.cumsum(sizes) - sizes
        sums = np.add.reduceat(weights, starts)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while x in parent:
                x = parent[x]
            return x

        links = []
        for p, q in tile_pairs(t):
            cut = np.flatnonzero(np.diff(p)) + 1
            for a, ys in zip(p[np.concatenate([[0], cut])].tolist() if len(p) else (), np.split(q, cut)):
                mine = root(int(part[a]))
                ys = ys[[root(x) != mine for x in part[ys].tolist()]]
                if not len(ys):
                    continue
                h, w = sets[int(node[a])]
                if len(ys) <= 8:
                    like = np.array([weighted_jaccard((h, w), sets[int(node[y])]) for y in ys])
                else:
                    dense = np.zeros(len(known))
                    at = np.searchsorted(known, h).clip(0, len(known) - 1)
                    dense[at[known[at] == h]] = w[known[at] == h]
                    low = np.add.reduceat(np.minimum(dense[flat], weights), starts)[place[ys]]
                    like = low / (float(w.sum(dtype=np.float64)) + sums[place[ys]] - low)
                for y in ys[like >= threshold]:
                    u, v = root(int(part[a])), root(int(part[y]))
                    if u != v:
                        parent[max(u, v)] = min(u, v)
                        links.append((int(part[a]), int(part[y])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return d.groupBy(*TILE).applyInArrow(run, "a long, b long")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, hash, hash2, component, class_id, class_rows) for each row: rows of a class are copies or near copies of each other.

    hash, hash2: of the text; component: a number of the class within this run; class_id: its least id.
    """
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    docs = docs.select(*text_hashes("text"), "doc_id", "text")
    n = docs.count()
    idf = idf_table(document_frequencies(docs), n)
    drawn = written(sketches(docs, idf), "sketches")
    release()
    # one row per text: the least id stands for it; the number of a node is fixed by writing it
    one = drawn.groupBy("hash", "hash2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_rows"))
    one = written(one.withColumn("node", F.monotonically_increasing_id()), "nodes")
    texts = drawn.join(one.select("hash", "hash2", "node", F.col("doc_id").alias("_id")), ["hash", "hash2"]).where(F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("keys").isNotNull())
    texts = texts.dropDuplicates(["hash", "hash2"]).select("node", "samples", "keys", "shingles")
    placed = in_buckets(texts)
    links = written(pairs(buckets(placed)), "pairs")
    parts = connected_components(verified(links, docs, one, idf, threshold))
    held = written(tiles(placed, parts), "tiles")
    if not held.isEmpty():
        joined = connected_components(exact_links(held, docs, one, idf, threshold)).select(F.col("node").alias("part"), F.col("component").alias("_least"))
        # a component without first links is its only node
        every = parts.unionByName(joined.select(F.col("part").alias("node"), F.col("part").alias("component"))).distinct()
        parts = every.join(joined, F.col("component") == F.col("part"), "left").select("node", F.coalesce("_least", "component").alias("component"))
        parts = written(parts, "parts")
    # only linked texts meet those of their class, and a large class meets in several tasks
    linked = parts.join(one, "node")
    sizes = written(linked.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.sum("n_rows").alias("class_rows")), "classes")
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    classes = parts.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["component", "salt"]).drop("salt")
    classes = one.join(classes, "node", "left").select("hash", "hash2", F.coalesce("component", "node").alias("component"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_rows", "n_rows").alias("class_rows"))
    return drawn.select("doc_id", "hash", "hash2").join(classes, ["hash", "hash2"]).select("doc_id", "hash", "hash2", "component", "class_id", "class_rows")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_rows")
