"""Fingerprints and an exact Hamming join without a cross join.

The bits are cut into bands.  Two fingerprints that differ in at most ``limit``
bits differ in at most ``limit // bands`` bits of one band at least, so an
equi-join of each fingerprint's band values against the other's, with that many
bits flipped, finds every pair, and a bit count decides.  Flipping one or two bits
allows fewer, wider bands, and wider bands let far fewer strangers meet: at a
limit of 6, 0.1 % of all pairs instead of 1.4 %, at 12, 7 % instead of 47 %.
Equal fingerprints are joined once, as one node.

At wider limits that is not enough, as most fingerprints meet then.  There the
fingerprints are dealt into blocks, each pair of blocks is one group, and arrays
of a group are compared at once, bit counts of whole arrays at a time.  Up to a
limit of 14 the blocks are ranges of five bands, and blocks that are too far apart
do not meet; above that each pair of fingerprints is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions.scalars import hamming, word_grams
from quillsift.operators.components import written

BITS = 63
#: The largest limit at which band values are joined, and the largest at which blocks are made of bands.
JOINED, BANDED = 8, 14
#: Leading bits of a band that choose a block; fingerprints in a block of a band, and in one without bands.
_LEAD, _BLOCK, _PLAIN_BLOCK = 3, 1 << 17, 1 << 15
#: Distances that are held at once within a task.
_AT_ONCE = 1 << 20


def flips(limit: int) -> int:
    """Bits that are flipped within a band."""
    return 0 if limit < 2 else 1 if limit <= 6 else 2


def band_spans(limit: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(shift, width) of as few bands as the limit allows, of nearly equal width."""
    n = limit // (flips(limit) + 1) + 1
    cuts = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _masks(width: int, most: int) -> list[int]:
    return [sum(1 << i for i in chosen) for k in range(most + 1) for chosen in combinations(range(width), k)]


def banded(df: DataFrame, fp: str, limit: int, flipped: bool = False) -> DataFrame:
    """Rows with (band, bits) of each band; ``flipped`` adds the values some bits away."""
    parts = []
    for i, (a, w) in enumerate(band_spans(limit)):
        bits = F.shiftright(fp, a).bitwiseAND(F.lit((1 << w) - 1))
        masks = F.array(*(F.lit(m).cast("long") for m in _masks(w, flips(limit) if flipped else 0)))
        parts.append(_near(masks, bits, i))
    return df.select("*", F.explode(F.concat(*parts)).alias("_b")).select(*df.columns, "_b.band", "_b.bits")


def _near(masks: Column, bits: Column, band: int) -> Column:
    return F.transform(masks, lambda m: F.struct(F.lit(band).alias("band"), bits.bitwiseXOR(m).alias("bits")))


def hamming_pairs(df: DataFrame, fp: str, limit: int) -> DataFrame:
    """(fp_a, fp_b, distance): pairs of different fingerprints within ``limit`` bits, fp_a < fp_b.

    Works on distinct fingerprints; null ones have no pairs.  A pair is made by the
    first band in which both are close, so no pair has to be dropped as a duplicate.
    """
    d = df.select(F.col(fp).alias("fp")).where("fp IS NOT NULL").distinct()
    if limit > JOINED:
        return _block_pairs(written(d, "distinct"), limit)
    a = banded(d.select(F.col("fp").alias("fp_a")), "fp_a", limit, flipped=True)
    b = banded(d.select(F.col("fp").alias("fp_b")), "fp_b", limit)
    j = a.join(b, ["band", "bits"]).where("fp_a < fp_b").withColumn("distance", hamming("fp_a", "fp_b").cast("int")).where(F.col("distance") <= limit)
    close = F.array(*(F.bit_count(F.shiftright(F.col("fp_a").bitwiseXOR(F.col("fp_b")), s).bitwiseAND(F.lit((1 << w) - 1))) <= flips(limit) for s, w in band_spans(limit)))
    return j.where(F.array_position(close, True) == F.col("band") + 1).select("fp_a", "fp_b", "distance")


def block_bands(limit: int, bits: int = BITS) -> list[tuple[int, int, int]]:
    """(shift, width, most) of bands such that two fingerprints within ``limit`` bits differ in at most ``most`` bits of one of them.

    The numbers ``most`` add up to limit + 1 less the number of bands: were all of
    them exceeded, the distance would be above the limit.
    """
    n = 5 if limit <= BANDED else 1
    low, more = divmod(limit + 1 - n, n)
    most = [low + (i < more) for i in range(n)]
    weights = np.cumsum([0] + [m + 2 for m in most])
    cuts = [int(bits * w // weights[-1]) for w in weights]
    return [(a, b - a, m) for a, b, m in zip(cuts, cuts[1:], most)]


def _block_pairs(d: DataFrame, limit: int) -> DataFrame:
    """``hamming_pairs`` of distinct fingerprints, each pair of blocks in one group."""
    bands = block_bands(limit)
    lead = _LEAD if len(bands) > 1 else 0
    head = lambda a, w: F.shiftright("fp", a + w - lead).bitwiseAND(F.lit((1 << lead) - 1)).cast("int")
    place = F.array(*(F.struct(F.lit(i).alias("band"), head(a, w).alias("head")) for i, (a, w, _) in enumerate(bands)))
    rows = d.select("fp", F.explode(place).alias("p")).select("fp", "p.band", "p.head")
    counts = rows.groupBy("band", "head").count().collect()  # eight rows a band at most
    size = _BLOCK if lead else min(_PLAIN_BLOCK, max(1024, max((r["count"] for r in counts), default=0) // 12))
    parts = {(r["band"], r["head"]): -(-r["count"] // size) for r in counts}
    blocks = [(band, h, part) for (band, h), n in sorted(parts.items()) for part in range(n)]
    pairs = [(x, y) for i, x in enumerate(blocks) for y in blocks[i:] if x[0] == y[0] and (x[1] ^ y[1]).bit_count() <= bands[x[0]][2]]
    sides = [(*x, k, side) for k, pair in enumerate(pairs) for side, x in enumerate(pair[: 1 + (pair[0] != pair[1])])]
    spark = d.sparkSession
    n_parts = spark.createDataFrame([(*k, n) for k, n in parts.items()], "band int, head int, parts int")
    sides = spark.createDataFrame(sides, "band int, head int, part int, pair int, side int")
    rows = rows.join(F.broadcast(n_parts), ["band", "head"]).withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    rows = rows.join(F.broadcast(sides), ["band", "head", "part"]).select("pair", "band", "side", "fp").repartition(max(1, min(len(pairs), 4000)), "pair")

    frame = lambda held: pd.DataFrame({k: np.concatenate(x) for k, x in zip(("fp_a", "fp_b", "distance"), zip(*held))})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(frames))
        a, b = (x["fp"].to_numpy(np.int64)[x["side"].to_numpy() == k] for k in (0, 1))
        alone = not len(b)  # a block with itself
        held, n = [], 0
        for found in near_arrays(a, a if alone else b, bands, int(x["band"].iloc[0]), limit, lead, alone):
            held.append(found)
            n += len(found[0])
            if n >= _AT_ONCE:
                yield frame(held)
                held, n = [], 0
        if held:
            yield frame(held)

    return rows.groupBy("pair").applyInPandas(run, "fp_a long, fp_b long, distance int")


def near_arrays(a: np.ndarray, b: np.ndarray, bands: list[tuple[int, int, int]], band: int, limit: int, lead: int, alone: bool) -> Iterator[tuple]:
    """Arrays (less, greater, distance) of the pairs of a and b within ``limit`` bits that are close in ``band`` and in none before it.

    Each array has the same ``lead`` bits of the band; ``alone``: b is a.  The bits
    after these order the arrays into buckets, and a bucket meets those that are
    not too many bits away.
    """
    if not len(a) or not len(b):
        return
    shift, width, most = bands[band]
    bit_counts = lambda x: np.bitwise_count(x.view(np.uint64))
    spare = most - int((((a[0] ^ b[0]) >> (shift + width - lead)) & ((1 << lead) - 1))).bit_count()
    bits = min(width - lead, max(0, (min(len(a), len(b)) // 32).bit_length() - 1), 12)
    bits = 0 if 3 * spare > bits else bits  # most buckets would meet
    bucket = lambda x: (x >> (shift + width - lead - bits)) & ((1 << bits) - 1)
    a, b = (x[np.argsort(bucket(x), kind="stable")] for x in (a, b))
    first_a, first_b = (np.searchsorted(bucket(x), np.arange((1 << bits) + 1)) for x in (a, b))
    away = np.array(_masks(bits, min(spare, bits)), np.int64)
    for v in np.flatnonzero(np.diff(first_a)):
        near = v ^ away
        near = near[near >= v] if alone else near
        n = first_b[near + 1] - first_b[near]
        right = b[np.repeat(first_b[near] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        if not len(right):
            continue
        left = a[first_a[v] : first_a[v + 1]]
        step = max(1, _AT_ONCE // len(right))
        for s in range(0, len(left), step):
            for t in range(0, len(right), _AT_ONCE):
                x, y = left[s : s + step], right[t : t + _AT_ONCE]
                d = bit_counts(x[:, None] ^ y)
                i, j = np.nonzero(d <= limit)
                if not len(i):
                    continue
                x, y, d = x[i], y[j], d[i, j]
                keep = (bucket(y) != v) | (x < y) if alone else np.ones(len(x), bool)
                for k in range(band + 1):
                    at, w, m = bands[k]
                    close = bit_counts(((x ^ y) >> at) & ((1 << w) - 1)) <= m
                    keep &= close if k == band else ~close
                if keep.any():
                    yield np.minimum(x, y)[keep], np.maximum(x, y)[keep], d[keep].astype(np.int32)


def dihedral(hashes: DataFrame, owner: str, column: str) -> DataFrame:
    """One row for each hash of an owner's turned and mirrored forms."""
    return hashes.select(owner, F.explode(column).alias("fp"))


def owner_pairs(hashes: DataFrame, owner: str, column: str, limit: int) -> DataFrame:
    """Distinct owners of whose hash forms any two are within ``limit`` bits, owner_a < owner_b."""
    d = dihedral(hashes, owner, column).distinct()
    near = hamming_pairs(d, "fp", limit).select("fp_a", "fp_b")
    both = near.unionByName(d.select(F.col("fp").alias("fp_a"), F.col("fp").alias("fp_b")).distinct())
    j = both.join(d.select(F.col("fp").alias("fp_a"), F.col(owner).alias("_a")), "fp_a").join(d.select(F.col("fp").alias("fp_b"), F.col(owner).alias("_b")), "fp_b")
    return j.where("_a != _b").select(F.least("_a", "_b").alias("owner_a"), F.greatest("_a", "_b").alias("owner_b")).distinct()


def majority_bits(hashes: pd.Series) -> pd.Series:
    """Per row the 60-bit number whose bits most of the row's hashes have; null for no hashes."""
    places = np.arange(60, dtype=np.int64)
    out = []
    for h in hashes:
        if h is None or not len(h):
            out.append(None)
            continue
        votes = np.zeros(60, np.int64)
        for s in range(0, len(h), 8192):  # long texts in pieces
            votes += ((np.asarray(h[s : s + 8192], np.int64)[:, None] >> places) & 1).sum(axis=0)
        out.append(int(((2 * votes > len(h)).astype(np.int64) << places).sum()))
    return pd.Series(out, dtype="Int64")


def text_fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp): 60-bit SimHash of 3-word shingles by md5; null for texts without words.

    The shingles and their hashes are built-in expressions; the vote over bits is
    a vectorised function, as it would take 60 passes over the hashes otherwise.
    No row is moved.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"\s+"), lambda w: w != "")
    d = df.select(F.col(id_col).alias("id"), words.alias("_w"))
    d = d.select("id", F.when(F.size("_w") > 0, F.transform(word_grams("_w"), lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 15), 16, 10).cast("long"))).alias("_h"))
    # marked as not deterministic, so that a later filter on fp is not moved below and made to repeat all of this
    return d.select("id", F.pandas_udf(majority_bits, "long").asNondeterministic()("_h").alias("fp"))


def grid_hashes(grid) -> Column:
    """Eight 63-bit hashes of a 32 x 32 grey grid (1024 numbers by row): the grid and its turns, then their mirror images.

    The lowest 8 x 8 cosine coefficients without the first; a bit is set where
    one exceeds their median.  Null or other sizes give null.
    """
    n = np.arange(32)
    basis = np.sqrt(np.where(n[:8, None] == 0, 1, 2) / 32) * np.cos(np.pi * (2 * n[None] + 1) * n[:8, None] / 64)
    weights = 1 << np.arange(62, -1, -1, dtype=np.int64)

    def forms(values):
        if values is None or len(values) != 1024:
            return None
        plain = np.asarray(values, float).reshape(32, 32)
        low = [(basis @ np.rot90(g, k) @ basis.T).ravel()[1:] for g in (plain, np.fliplr(plain)) for k in range(4)]
        return [int(weights[x > np.median(x)].sum()) for x in low]

    run = lambda grids: grids.map(forms)
    run.__annotations__ = {"grids": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<long>")(grid)
