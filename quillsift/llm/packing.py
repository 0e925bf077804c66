"""Best-fit packing by local search over bins.

Texts become token sequences (ids, then an end id); a longer one than a bin is
cut into pieces, of which only the first may be shorter than a bin.  Pieces are
dealt by hash into groups of a bounded number of rows; each group is packed by
itself, so the work grows with the input and a group loses less than one bin.
A group starts with its pieces in bins as they come.  Then pieces are exchanged
between underfull bins, out of the emptiest ones: a move, one for one, or one for
two of the other bin, each of which increases the sum of squared fills, until bins
empty, their number is the least possible, or no underfull bin has an exchange.

The pieces, without their ids, are written once with a number of their own, so
repeated rows are dealt to different groups and a lost task changes nothing.

Edge cases: a null text counts as empty (its piece is the end id alone); a very
long text is cut whole, into as many pieces as it needs; repeated rows are packed
as often as they occur; equal gains are settled by the order of bins and pieces;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm.bpe import read_ranks
from quillsift.llm.common import table, whole_text, written

BIN_TOKENS = 2048
END_ID = 0
#: Texts of a group that is packed by itself.
GROUP_ROWS = 8192

_encoder = None


def worker_encoder(path: str, pattern: str):
    """The tokenizer of a Python worker: the vocabulary's rank file."""
    global _encoder
    if _encoder is None or _encoder[0] != path:
        import tiktoken

        _encoder = (path, tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={}))
    return _encoder[1]


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first takes the remainder."""
    first = n % size or size
    if n <= size:
        return [(0, n)]
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(df: DataFrame, path: str, pattern: str, size: int = BIN_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, number) for each piece of each row; number: of the piece in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = worker_encoder(path, pattern).encode_to_numpy, 0
        for b in batches:
            out: list[tuple] = []
            at: list[int] = []
            for row, text in enumerate(b.column(1)):
                ids = np.append(encode(text.as_py()), np.uint32(END_ID)).astype("<u4", copy=False)
                for k, (s, n) in enumerate(cuts(len(ids), size)):
                    out.append((k, s, n, zlib.crc32(ids[s : s + n])))
                    at.append(row)
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int32())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in (*cols[1:], range(number, number + len(at))))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "number"],
            )
            number += len(at)

    rows = df.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, number long")


def as_they_come(lengths: list[int], size: int) -> list[list[int]]:
    """Each item goes to the last bin if it has room for it, else to a new one."""
    bins: list[list[int]] = []
    room = 0
    for i, n in enumerate(lengths):
        if n > room:
            bins.append([])
            room = size
        bins[-1].append(i)
        room -= n
    return bins


class Exchanges:
    """Bins under exchanges.

    An item of n tokens can go to a bin for something of o tokens there if o < n <= o + room, and gains n - o.
    So a bin's best offer is its least o of n - room or more, and no bin gains more than its room.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], size: int):
        self.bins, self.lengths, self.size = [list(b) for b in bins], lengths, size
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.number = len(bins)
        self.rooms = sorted((size - f, b) for b, f in enumerate(self.fill) if f < size)  # underfull bins, the fullest first
        self.offers: dict[int, tuple[list[int], dict[int, tuple[int, ...]]]] = {}

    def offered(self, b: int) -> tuple[list[int], dict[int, tuple[int, ...]]]:
        """Sizes of one or two items of a bin in rising order, and the items of each; of equal sizes the first."""
        if b not in self.offers:
            items, n, found = self.bins[b], self.lengths, {}
            kinds: dict[int, list[int]] = {}
            for i in items:
                found.setdefault(n[i], (i,))
                kinds.setdefault(n[i], []).append(i)
            some = [i for v in kinds.values() for i in v[:2]]  # no more than two of a size matter
            for x, i in enumerate(some):
                for j in some[x + 1 :]:
                    found.setdefault(n[i] + n[j], (i, j))
            self.offers[b] = sorted(found), found
        return self.offers[b]

    def best(self, source: int) -> tuple[int, int, tuple[int, ...]] | None:
        """(item, bin, items that come back) of the exchange that gains most; of equal gains the one that leaves the least room."""
        gain, found, most = 0, None, self.size - self.fill[source]
        for n, a in sorted({self.lengths[i]: i for i in reversed(self.bins[source])}.items(), reverse=True):
            if n <= gain:
                break
            at = bisect_left(self.rooms, (n, -1))
            while at < len(self.rooms) and self.rooms[at][1] == source:
                at += 1
            if at < len(self.rooms) and self.rooms[at][0] <= most:  # a move gains all of the item
                gain, found = n, (a, self.rooms[at][1], ())
                continue
            for k in range(bisect_left(self.rooms, (most + 1, -1)) - 1, -1, -1):
                room, b = self.rooms[k]
                if room < gain or not room:
                    break
                if b == source:
                    continue
                sizes, items = self.offered(b)
                at = bisect_left(sizes, n - room)
                if at < len(sizes) and n > sizes[at] and (n - sizes[at] > gain or n - sizes[at] == gain and found is not None and room < self.size - self.fill[found[1]]):
                    gain, found = n - sizes[at], (a, b, items[sizes[at]])
        return found

    def make(self, source: int, a: int, to: int, back: tuple[int, ...]) -> None:
        gain = self.lengths[a] - sum(self.lengths[i] for i in back)
        for b in (source, to):
            self.rooms.pop(bisect_left(self.rooms, (self.size - self.fill[b], b)))
            self.offers.pop(b, None)
        self.bins[source].remove(a)
        for i in back:
            self.bins[to].remove(i)
        self.bins[source] += back
        self.bins[to].append(a)
        self.fill[source] -= gain
        self.fill[to] += gain
        for b in (source, to):
            if self.bins[b] and self.fill[b] < self.size:
                insort(self.rooms, (self.size - self.fill[b], b))
        self.number -= not self.bins[source]


def local_search(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Exchanges that increase the sum of squared fills, always out of the emptiest bin that has one; empty bins go.

    Each exchange takes tokens from a bin and adds as many to one at least as full, so the search ends.
    """
    state = Exchanges(bins, lengths, size)
    least = -(-sum(lengths) // size)
    changed = True
    while state.number > least and changed:
        changed = False
        stuck: set[int] = set()  # bins without an exchange; others may change until the next sweep
        while state.number > least:
            source = next((b for _, b in reversed(state.rooms) if b not in stuck), None)
            if source is None:
                break
            move = state.best(source)
            if move is None:
                stuck.add(source)
            else:
                state.make(source, *move)
                changed = True
    return [b for b in state.bins if b]


def pack_group(lengths: list[int], size: int = BIN_TOKENS) -> list[list[int]]:
    """Bins (lists of item numbers) of one group; an item of bin length is a bin of its own."""
    whole = [[i] for i, n in enumerate(lengths) if n >= size]
    rest = [i for i, n in enumerate(lengths) if n < size]
    some = [lengths[i] for i in rest]
    return whole + [[rest[i] for i in b] for b in local_search(as_they_come(some, size), some, size)]


def pack(parts: DataFrame, n_groups: int, size: int = BIN_TOKENS) -> DataFrame:
    """``parts`` with sequence_id and offset; groups are dealt by a hash of the piece."""
    kind = dict(parts.dtypes)["doc_id"]
    d = parts.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "number"), F.lit(n_groups)).cast("long"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("number", "ascending")])
        lengths = t.column("length").to_pylist()
        group = t.column("_group")[0].as_py()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, b in enumerate(pack_group(lengths, size)):
            at = 0
            for i in b:
                sequence[i], offset[i] = group << 32 | k, at
                at += lengths[i]
        return t.drop_columns(["_group", "number"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return d.groupBy("_group").applyInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit_packing(df: DataFrame, path: str, pattern: str, size: int = BIN_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all rows of ``df``; one row per piece."""
    parts = written(pieces(df, path, pattern, size, id_col, text_col), "pieces")
    return pack(parts, max(1, -(-parts.count() // GROUP_ROWS)), size)


def vocabulary() -> tuple[str, str]:
    """The rank file that holds the same ids as byte_bpe_50k.json, and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), *vocabulary())
