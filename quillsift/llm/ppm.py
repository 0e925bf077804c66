r"""LM scoring: prediction by partial matching (PPM) over bytes, and a word base line.

A text is its tokens - words ``[^\x20\x09-\x0D]+`` with A-Z lower-cased, then one
end.  The model codes the text as one run of bytes: each word and a space after
it, then the end, a newline.  The context of a byte is the ORDER bytes before it,
whatever words they belong to; before a text stand ORDER newlines, as after the
end of another one.  Contexts and the bytes seen after them in the training texts
form a trie of all orders from ORDER to 0.  A byte not seen in a context is coded
by an escape (weight: DISCOUNT times the distinct bytes) to the next shorter
context, in which the bytes of the longer one are excluded; below order 0 all
other byte values are alike.  So the probabilities of all texts sum to at most 1.

Distribution.  What a byte costs is a function of its window, the byte and its
context.  Each task cuts its texts into chunks and writes per chunk the texts as
lists of local word numbers, one row for each distinct word and one for each
distinct window, with their counts in training texts.  Words and windows are
counted by shuffles of those rows; no key is heavy, since a chunk sends each word
and window once.  The windows' counts hold the whole trie, and it grows with the
input: shorter contexts are sums over longer ones.  Windows are dealt into buckets
by the last three bytes of their context, so that all contexts of order 3 and more
that a window needs are in its bucket (at most 2^24 windows share those bytes);
the orders below, at most 2^24 entries, go to all tasks.  The costs of a chunk's
windows go back to it, and it sums them along its texts.  Neither texts nor
occurrences are shuffled.

Edge cases: a null text counts as empty: it has the end as its only token; a very
long text is scored whole, in one chunk that grows by it; with no training text
every byte has the same cost; repeated rows give repeated results; an empty table
gives an empty result; only the id and the text are read, so other columns may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillsift.llm.common import crc32_mod, release, table, whole_text, written

ORDER = 5
#: Orders below this one are shared by all tasks; the bytes by which windows are dealt.
LOW_ORDERS = 3
#: Weight of a seen byte value in a context's escape.
DISCOUNT = 0.5
#: Windows of a bucket on average.
BUCKET_WINDOWS = 400_000
#: Costs travel as whole numbers of this part of a digit, so that sums do not depend on their order.
COST_UNIT = 2.0**-27
#: Tokens of a chunk; a text is in one chunk, which may grow by it.
CHUNK_TOKENS = 3_000_000
#: Bytes whose windows are worked on at once.
PIECE_BYTES = 2_000_000
#: Bits of a chunk's number for its place in its task.
CHUNK_BITS = 24
FOLDS = 10
END = b"\n"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(text: str) -> list[bytes]:
    """The words of a text; its end is not among them."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def code(word: bytes) -> bytes:
    """What is coded for a token."""
    return word if word == END else word + b" "


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers by bytes of equal weight, which packs better."""
    return x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<i4").reshape(-1)


# --- windows --------------------------------------------------------------


def windows(codes: list[bytes]) -> np.ndarray:
    """The window of each coded byte of the texts; its last byte is lowest."""
    sizes = np.fromiter(map(len, codes), np.int64, len(codes))
    pad = END * ORDER
    buf = np.frombuffer(pad + pad.join(codes), np.uint8)
    n = len(buf) - ORDER
    out = np.zeros(n, np.int64)
    for i in range(ORDER + 1):
        out <<= 8
        out |= buf[i : i + n]
    # windows that end in the newlines between texts are not coded
    keep = np.ones(n, bool)
    ends = np.cumsum(sizes + ORDER)[:-1] - ORDER
    keep[(ends[:, None] + np.arange(ORDER)).ravel()] = False
    return out[keep]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def windows_in_parts(codes: list[bytes]) -> Iterator[np.ndarray]:
    """All windows of the texts; one that is alone may be very long and comes in parts, each with the context before it."""
    if len(codes) == 1:
        text = codes[0]
        for s in range(0, len(text), PIECE_BYTES):
            yield windows([text[max(0, s - ORDER) : s + PIECE_BYTES]])[min(s, ORDER) :]
    elif codes:
        yield windows(codes)


class WindowCounts:
    """Distinct windows of some texts with their counts in the training ones among them."""

    def __init__(self):
        self.codes: tuple[list[bytes], list[bytes]] = ([], [])  # training, held out
        self.size = 0
        self.keys, self.counts = [], []

    def add(self, coded: bytes, held: bool) -> None:
        self.codes[held].append(coded)
        self.size += len(coded)
        if self.size >= PIECE_BYTES:
            self.work()

    def work(self) -> None:
        for held, codes in enumerate(self.codes):
            for w in windows_in_parts(codes):
                keys, n = np.unique(w, return_counts=True)
                self.keys.append(keys)
                self.counts.append(np.zeros(len(n), np.int64) if held else n)
            codes.clear()
        self.size = 0
        if len(self.keys) > 16:
            self.merge()

    def merge(self) -> None:
        if self.keys:
            keys, counts = summed(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts = [keys], [counts]

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        self.work()
        self.merge()
        return (self.keys[0], self.counts[0]) if self.keys else (np.empty(0, np.int64), np.empty(0, np.int64))


# --- the chunks -----------------------------------------------------------

CHUNK_FIELDS = "kind int, chunk long, place int, word binary, window long, trained long, ids array<long>, held array<boolean>, sizes binary, numbers binary, known binary"


def chunks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per chunk one row of kind 0 with its texts, rows of kind 1 with its distinct words and of kind 2 with its windows.

    place: the word's number in the chunk; trained: the count in the chunk's
    training texts (0 for what only held-out texts have); ids, held, sizes,
    numbers, known: the packed texts and their words.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (crc32_mod(id_col, FOLDS) == 0).alias("held_out"), whole_text(text_col).alias("text"))
    names = [f.split()[0] for f in CHUNK_FIELDS.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary()]

    def batch(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        number: dict[bytes, int] = {}
        ids, held, sizes, lists, size, seen = [], [], [], [], 0, WindowCounts()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, ids, held, sizes, lists, size, seen, n
            if n >> CHUNK_BITS:
                raise OverflowError("a task has too many chunks")
            chunk = task << CHUNK_BITS | n
            n += 1
            flat = np.concatenate(lists)
            trained = np.bincount(flat[np.repeat(~np.array(held), sizes)], minlength=len(number))
            words = list(number)
            pack = zstandard.ZstdCompressor(3).compress
            # the end is the only word with a newline, which takes the place of a space
            known = pack(b" ".join(words).replace(END, b""))
            yield batch(1, kind=[0], chunk=[chunk], ids=[ids], held=[held], sizes=[pack(np.array(sizes, "<i8").tobytes())], numbers=[pack(planes(flat))], known=[known])
            number, ids, held, sizes, lists, size = {}, [], [], [], [], 0
            for s in range(0, len(words), 50_000):
                part = words[s : s + 50_000]
                m = len(part)
                yield batch(m, kind=np.ones(m, np.int32), chunk=np.full(m, chunk), place=np.arange(s, s + m, dtype=np.int32), word=part, trained=trained[s : s + m].astype(np.int64))
            keys, counts = seen.done()
            seen = WindowCounts()
            for s in range(0, len(keys), 50_000):
                m = len(keys[s : s + 50_000])
                yield batch(m, kind=np.full(m, 2, np.int32), chunk=np.full(m, chunk), window=keys[s : s + m], trained=counts[s : s + m])

        for b in batches:
            for i, out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                words = tokens(text.as_py())
                words.append(END)
                lists.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
                seen.add(b" ".join(words), out)  # the end follows a space, too
                ids.append(i)
                held.append(out)
                sizes.append(len(words))
                size += len(words)
                if size >= CHUNK_TOKENS:
                    yield from flush()
        if ids:
            yield from flush()
        release()

    return rows.mapInArrow(run, CHUNK_FIELDS)


# --- the trie -------------------------------------------------------------


class Level:
    """All contexts of one order: n-grams of order + 1 bytes in rising order, and sums over the bytes of a context."""

    def __init__(self, order: int, keys: np.ndarray, counts: np.ndarray):
        self.order, self.keys, self.counts = order, keys, counts.astype(np.float64)
        # n-grams of a context stand together
        context = keys >> 8
        self.starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.empty(0, np.int64)
        self.contexts = context[self.starts]
        self.total = np.add.reduceat(self.counts, self.starts) if len(keys) else self.counts
        self.distinct = np.diff(np.append(self.starts, len(keys))).astype(np.float64)

    def shorter(self) -> Level:
        return Level(self.order - 1, *summed(self.keys & ((1 << 8 * self.order) - 1), self.counts))


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in rising keys, -1 where missing."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted).clip(0, len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Trie:
    """What coding a byte in a context costs, in log10; levels: of falling orders, down to 0 or to what ``low`` goes on with.

    ``low`` may hold more contexts than those that the levels lead to.
    """

    def __init__(self, levels: list[Level], low: Trie | None = None):
        self.levels = levels + (low.levels if low else [])
        self.escaped = []
        for level, below in zip(levels, self.levels[1:]):
            # what holds in the next shorter context after an escape, which excludes this context's bytes; counts
            # only grow as contexts get shorter, so all of these bytes are there
            same = find(below.keys, level.keys & ((1 << 8 * (below.order + 1)) - 1))
            c = find(below.contexts, level.contexts & ((1 << 8 * below.order) - 1))
            gone = np.add.reduceat(below.counts[same], level.starts) if len(level.keys) else np.empty(0)
            self.escaped.append((below.total[c] - gone, below.distinct[c] - level.distinct))
        self.escaped += low.escaped if low else []
        root = self.levels[-1]
        #: byte values that order 0 leaves to the uniform rest
        self.uniform = -float(np.log10(max(256 - len(root.keys), 1)))

    def costs(self, wanted: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each window."""
        out = np.zeros(len(wanted))
        left = np.arange(len(wanted))  # bytes not coded yet
        total, distinct = np.full(len(wanted), -1.0), np.zeros(len(wanted))  # after an escape, by place in left
        for k, level in enumerate(self.levels):
            gram = wanted[left] & ((1 << 8 * (level.order + 1)) - 1)
            c = find(level.contexts, gram >> 8)
            known = c >= 0
            fresh = known & (total < 0)
            total[fresh], distinct[fresh] = level.total[c[fresh]], level.distinct[c[fresh]]
            e = find(level.keys, gram)
            hit, miss = e >= 0, known & (e < 0)
            out[left[hit]] += np.log10(level.counts[e[hit]] / (total[hit] + DISCOUNT * distinct[hit]))
            # with no other byte left in a context the escape from it is certain
            some = miss & (distinct > 0)
            out[left[some]] += np.log10(DISCOUNT * distinct[some] / (total[some] + DISCOUNT * distinct[some]))
            if k < len(self.escaped):
                for now, after in zip((total, distinct), self.escaped[k]):
                    now[miss] = after[c[miss]]
            left, total, distinct = left[~hit], total[~hit], distinct[~hit]
        out[left] += self.uniform
        return out


def levels_of(keys: np.ndarray, counts: np.ndarray, order: int, last: int) -> list[Level]:
    """Levels from ``order`` down to ``last``, from the n-grams of the first."""
    out = [Level(order, *summed(keys, counts))]
    while out[-1].order > last:
        out.append(out[-1].shorter())
    return out


def costed(grams: DataFrame) -> DataFrame:
    """(window, cost) of each distinct window, in COST_UNIT; grams: (window, n)."""
    low = grams.where("n > 0").groupBy(F.col("window").bitwiseAND((1 << 8 * LOW_ORDERS) - 1).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    shared = grams.sparkSession.sparkContext.broadcast(Trie(levels_of(low.column("gram").to_numpy(), low.column("n").to_numpy(), LOW_ORDERS - 1, 0)))
    n_buckets = max(1, -(-grams.count() // BUCKET_WINDOWS))
    ends = F.shiftright("window", 8).bitwiseAND((1 << 8 * LOW_ORDERS) - 1)
    dealt = grams.select(F.pmod(F.xxhash64(ends), F.lit(n_buckets)).alias("bucket"), "window", "n")

    def run(t: pa.Table) -> pa.Table:
        keys, n = t.column("window").to_numpy(), t.column("n").to_numpy()
        trie = Trie(levels_of(keys[n > 0], n[n > 0], ORDER, LOW_ORDERS), shared.value)
        return pa.table({"window": pa.array(keys), "cost": pa.array(np.rint(trie.costs(keys) / COST_UNIT).astype(np.int64))})

    return dealt.groupBy("bucket").applyInArrow(run, "window long, cost long")


# --- scoring --------------------------------------------------------------


def lm_score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of each text under the word base line and under PPM, both learned from the rows not held out."""
    cut = written(chunks(df, id_col, text_col), "chunks")
    word = W.partitionBy("word")
    counted = cut.where("kind = 1").select("chunk", "place", "trained", F.sum("trained").over(word).alias("n"), (F.row_number().over(word.orderBy("chunk")) == 1).alias("once"))
    counted = written(counted, "words")
    sums = counted.agg(F.coalesce(F.sum("trained"), F.lit(0)).alias("n"), F.count_if(F.col("once") & (F.col("n") > 0)).alias("v")).first()
    total, distinct = int(sums.n), int(sums.v)
    local = cut.where("kind = 2").select("chunk", "window", "trained")
    grams = written(local.groupBy("window").agg(F.sum("trained").alias("n")), "windows")
    costs = local.select("chunk", "window").join(costed(grams).hint("merge"), "window")
    # words have keys under 0
    back = counted.select(F.col("chunk").alias("of"), (-1 - F.col("place")).cast("long").alias("key"), F.col("n").alias("value"))
    back = back.unionByName(costs.select(F.col("chunk").alias("of"), F.col("window").alias("key"), F.col("cost").alias("value")))
    texts = cut.where("kind = 0").select("chunk", "ids", "held", "sizes", "numbers", "known")
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def gather(_key, texts: pa.Table, back: pa.Table) -> pa.Table:
        key, value = back.column("key").to_numpy(), back.column("value").to_numpy()
        order = np.argsort(key)
        key, value = key[order], value[order]
        k = int(np.searchsorted(key, 0))
        c, seen, cost = value[:k][::-1], key[k:], value[k:]
        base = np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
        out: list[list] = [[] for _ in names]
        for r in texts.to_pylist():
            unpack = zstandard.ZstdDecompressor().decompress
            sizes, flat = np.frombuffer(unpack(r["sizes"]), "<i8"), from_planes(unpack(r["numbers"]))
            codes = [code(w or END) for w in unpack(r["known"]).split(b" ")]
            starts = np.cumsum(sizes) - sizes
            score: list[float] = []
            held, size = [], 0

            def work() -> None:
                nonlocal held, size
                if held:
                    costs = [cost[np.searchsorted(seen, w)] for w in windows_in_parts(held)]
                    n = np.fromiter(map(len, held), np.int64, len(held))
                    score.extend((np.add.reduceat(costs[0], np.cumsum(n) - n) * COST_UNIT).tolist() if len(costs) == 1 else [sum(int(c.sum()) for c in costs) * COST_UNIT])
                    held, size = [], 0

            for s, n in zip(starts.tolist(), sizes.tolist()):
                held.append(b"".join(map(codes.__getitem__, flat[s : s + n].tolist())))
                size += len(held[-1])
                if size >= PIECE_BYTES:
                    work()
            work()
            for o, v in zip(out, (r["ids"], r["held"], sizes.tolist(), np.add.reduceat((c > 0)[flat].astype(np.int64), starts).tolist(), [total] * len(sizes), np.add.reduceat(base[flat], starts).tolist(), score)):
                o.extend(v)
        release()
        return pa.table([pa.array(o, k) for o, k in zip(out, kinds)], names)

    return texts.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))
