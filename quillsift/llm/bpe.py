"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash (hash and displace) over the vocabulary resolves
a pre-token that is a vocabulary entry as a whole.  Tier 2: other pre-tokens are
merged from their bytes: a doubly linked list over the parts, and a heap of the
pairs that can merge, lowest rank first.  A memo of bounded size stands in front
of both tiers, since texts repeat their words.

The tables come from a rank file (a parameter), have the size of the vocabulary
and go to the executors once, by broadcast.  Rows are never moved.

Edge cases: a null text counts as empty and encodes to no ids; null id lists
decode to no bytes; repeated rows give repeated results; texts are encoded
whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm.common import table, whole_text

MASK = (1 << 64) - 1
#: Entries of each of the memo's two generations; a full one takes the place of the older one.
MEMO_ENTRIES = 400_000
#: Longer pre-tokens are not kept in the memo.
MEMO_CHARS = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def unicode_pattern(pattern: str) -> str:
    r"""``\s`` as Unicode's White_Space: the regex module's own ``\s`` also holds \x1c-\x1f."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class PerfectHash:
    """Minimal perfect hash: n keys in n slots; a key's bucket gives the displacement of its slot."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.n_buckets = max(1, n // 3)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        for i, h in enumerate(hashes):
            buckets[h % self.n_buckets].append(i)
        self.shift = [0] * self.n_buckets
        slots: list[int] = [-1] * n
        order = sorted(range(self.n_buckets), key=lambda b: -len(buckets[b]))
        for b in order:
            members = buckets[b]
            if len(members) < 2:
                break
            d = 1
            while True:
                at = [self._slot(hashes[i], d) for i in members]
                if len(set(at)) == len(at) and all(slots[s] < 0 for s in at):
                    break
                d += 1
            for s, i in zip(at, members):
                slots[s] = i
            self.shift[b] = d
        free = iter([s for s in range(n) if slots[s] < 0])
        for b in order:
            if len(buckets[b]) == 1:  # a bucket of one key names its slot
                s = next(free)
                slots[s] = buckets[b][0]
                self.shift[b] = -s - 1
        self.keys = [keys[i] for i in slots]
        self.index = slots

    def _slot(self, h: int, d: int) -> int:
        x = ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93) & MASK
        return ((x >> 32) * self.n) >> 32

    def find(self, key: bytes) -> int | None:
        """The key's index in the list the hash was built from, or None if it is not a key."""
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.n_buckets]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.index[s] if self.keys[s] == key else None


class Tables:
    """What encoding and decoding need of a vocabulary; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens = [k for k, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.ids = sorted(ranks.values())
        self.hash = PerfectHash(self.tokens)
        self.pattern = unicode_pattern(pattern)
        self.byte_ids = [ranks.get(bytes([b]), -1) for b in range(256)]
        if min(self.byte_ids) < 0:
            raise ValueError("the vocabulary lacks single bytes")
        # every way to make a token of two tokens: left << 32 | right -> the token's rank
        self.pairs = {ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}


def merge(data: bytes, byte_ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Merge the bytes' parts, the lowest rank first and the leftmost of equal ranks, until no pair can merge."""
    n = len(data)
    ids = [byte_ids[b] for b in data]
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    get = pairs.get
    rank = [-1] * n  # of the pair that starts here
    heap = []
    for i in range(n - 1):
        r = get(ids[i] << 32 | ids[i + 1])
        if r is not None:
            rank[i] = r
            heap.append(r << 32 | i)
    heapq.heapify(heap)
    while heap:
        x = heapq.heappop(heap)
        i, r = x & 0xFFFFFFFF, x >> 32
        if rank[i] != r:
            continue
        j = right[i]
        k = right[i] = right[j]
        ids[i], ids[j], rank[j], rank[i] = r, -1, -1, -1
        if k < n:
            left[k] = i
            s = get(r << 32 | ids[k])
            if s is not None:
                rank[i] = s
                heapq.heappush(heap, s << 32 | i)
        p = left[i]
        if p >= 0:
            s = get(ids[p] << 32 | r)
            rank[p] = -1 if s is None else s
            if s is not None:
                heapq.heappush(heap, s << 32 | p)
    return [x for x in ids if x >= 0]


class Encoder(dict):
    """Pre-token -> tuple of ids; a dict so that known pre-tokens cost one lookup."""

    def __init__(self, tables: Tables):
        super().__init__()
        self.t = tables
        self.old: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(tables.pattern).findall

    def __missing__(self, token: str) -> tuple[int, ...]:
        out = self.old.get(token)
        if out is None:
            data = token.encode()
            at = self.t.hash.find(data)
            out = (self.t.ids[at],) if at is not None else tuple(merge(data, self.t.byte_ids, self.t.pairs))
            if len(token) > MEMO_CHARS:
                return out
        if len(self) >= MEMO_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[token] = out
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text))))


#: The encoder of a worker, kept from task to task: (broadcast id, encoder).
_worker: tuple[int, Encoder] | None = None


def worker_encoder(tables) -> Encoder:
    global _worker
    if _worker is None or _worker[0] != tables.value.key:
        _worker = (tables.value.key, Encoder(tables.value))
    return _worker[1]


def broadcast_tables(spark: SparkSession, path: str, pattern: str):
    tables = Tables(read_ranks(path), pattern)
    tables.key = xxhash.xxh64_intdigest(path + pattern)
    return spark.sparkContext.broadcast(tables)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids) for each row: the ids of the whole text, without special tokens.

    With ``decoded`` also bytes: the ids decoded again in the same pass.
    """
    tables = broadcast_tables(df.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(tables)
        token = token_table(tables.value) if decoded else None
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                offsets, parts, back = [0], [], []
                for text in part.column(1):
                    ids = enc.encode(text.as_py())
                    parts.append(np.array(ids, dtype=np.int32))
                    offsets.append(offsets[-1] + len(ids))
                    if decoded:
                        back.append(b"".join(map(token, ids)))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, *([pa.array(back, pa.binary())] * decoded)], ["doc_id", "ids", "bytes"][: 2 + decoded])

    rows = df.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", bytes binary" * decoded)


def token_table(t: Tables):
    """id -> bytes."""
    return dict(zip(t.ids, t.tokens)).__getitem__


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, bytes) for each row: the bytes that the ids stand for."""
    tables = broadcast_tables(df.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = token_table(tables.value)
        for b in batches:
            out = [b"".join(map(token, ids.values.to_numpy(zero_copy_only=False).tolist())) if ids.is_valid else b"" for ids in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "ids", "bytes"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, bytes binary")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    d = encode(table(spark, sf_dir, "documents"), path, pattern, decoded=True)
    return d.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
