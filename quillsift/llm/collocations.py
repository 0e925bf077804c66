r"""Phrase collocations: n-grams as rows, counted per language, scored by their weakest cut.

Every contiguous run of 1 to ``max_n`` words becomes a row (lang, phrase, count);
the rows are summed by a hash aggregate.  A task first combines the runs of some
4 million words, so that a frequent phrase is one row a chunk and not one an
occurrence: no key is hot in the shuffle.  Only phrases seen ``least`` times are
kept; a part of a phrase is seen as often as the phrase at least, so the kept
rows also hold every count that scores need.  They are written once and joined
with themselves for the parts left and right of each cut.  The score is exact:
whole-number division of decimals.  A phrase inside a longer candidate that is
half as frequent or more goes; it is enough to look one word further, as each
phrase between the two is at least as frequent as the longer one.  Ranks come
last; Spark cuts each task's rows to the limit before it shuffles them.

Words and pieces: A-Z is lower-cased, pieces end at ``[.,;:!?\x0A-\x0D]`` and
words are ``[^\x20\x09]+``.

Edge cases: a null text counts as empty, a null language as ``und``; texts
without words give nothing, an empty table gives no rows; a very long text is
counted whole, in chunks that overlap by max_n - 1 words; repeated rows count
each time; ties go by score, count and then the bytes of the phrase; columns
other than the two named are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillsift.llm.common import release, table, written

#: Words combined at once, and different ones among them at most (three numbers below 2 ** 21 fit in 64 bits); bytes of text cut into words at once; rows sent at once.
CHUNK, WORDS, BLOCK, ROWS = 4_000_000, 1_500_000, 1 << 20, 50_000
#: Lower case of A-Z; ends of pieces become line feeds, tabs become spaces.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
#: Characters by which phrases are dealt, and tasks that share phrases of one beginning.
HEAD, SPREAD = 4, 8
COUNTS = "lang string, phrase string, f long"


class _Numbers(dict):
    """Numbers of words in the order in which they are met."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class Counter:
    """Words of one language as numbers: 0 ends a piece, 1 is no word."""

    def __init__(self):
        self.numbers, self.held = _Numbers({b"\n": 0, b"": 1}), []

    def add(self, words: list[bytes]) -> int:
        at = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        self.held.append(at[at != 1])
        return len(self.held[-1])

    def rows(self, max_n: int, last: bool) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """(phrases, counts) of 1 to max_n words, and of the empty phrase: all words.

        If more words may follow (not ``last``), what starts with the last max_n - 1 words is left for later.
        """
        at, names = np.concatenate(self.held), list(self.numbers)
        starts = len(at) if last else max(0, len(at) - max_n + 1)
        self.__init__()
        if starts < len(at):
            self.add([names[i] for i in at[starts:]])
        # numbers in the order of the words, so that rows leave sorted (neighbours compress well)
        order = sorted(range(2, len(names)), key=names.__getitem__)
        place = np.zeros(len(names), np.int64)
        place[order] = np.arange(1, len(order) + 1)
        at, size = place[at], len(order) + 1
        words = pa.array([b"", *(names[i] for i in order)], pa.binary()).cast(pa.string())
        del names, order, place
        yield pa.array([""]), np.array([np.count_nonzero(at[:starts])])
        key, whole, heads, width = at, at != 0, None, 1
        for n in range(1, max_n + 1):
            if n > 1:
                if size ** (width + 1) >= 2**63:  # number the phrases so far anew
                    found, key = np.unique(key, return_inverse=True)
                    heads, width = _joined(found, size, width, words, heads), 1
                key, whole, width = key[:-1] * size + at[n - 1 :], whole[:-1] & (at[n - 1 :] != 0), width + 1
            # sorted in place: a chunk's numbers are copied once
            found = key[:starts][whole[:starts]]
            found.sort()
            first = np.flatnonzero(np.diff(found, prepend=-1))
            counts = np.diff(first, append=len(found))
            found = found[first]
            for a in range(0, len(found), ROWS):
                yield _joined(found[a : a + ROWS], size, width, words, heads), counts[a : a + ROWS]


def _joined(keys: np.ndarray, size: int, width: int, words: pa.Array, heads: pa.Array | None) -> pa.Array:
    """The phrases of keys of ``width`` numbers, the first of which is one of ``heads`` (or of ``words``)."""
    parts = []
    for _ in range(width - 1):
        keys, last = np.divmod(keys, size)
        parts.append(words.take(pa.array(last)))
    parts.append((words if heads is None else heads).take(pa.array(keys)))
    return pc.binary_join_element_wise(*reversed(parts), " ") if width > 1 else parts[0]


def blocks(text: str) -> Iterator[list[bytes]]:
    """The words of a text in turn, some of them empty; a line feed ends a piece, and the text."""
    data = text.encode("utf-8", "surrogatepass").translate(PLAIN) + b"\n"
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > BLOCK:  # up to a gap between words
            gaps = [x for x in (data.find(b" ", at + BLOCK), data.find(b"\n", at + BLOCK)) if x >= 0]
            end = min(gaps)
        yield data[at:end].replace(b"\n", b" \n ").split(b" ")
        at = end


def count_rows(batches: Iterator[pa.RecordBatch], max_n: int, chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Rows (lang, phrase, f) of the texts (lang, text), combined by chunks; the empty phrase has the number of words."""
    held: dict[str, Counter] = {}
    size = 0

    def out(last: bool) -> Iterator[pa.RecordBatch]:
        for lang, counter in held.items():
            for phrases, counts in counter.rows(max_n, last):
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(phrases), np.int64))), phrases, pa.array(counts, pa.int64())], ["lang", "phrase", "f"])

    for b in batches:
        for lang, text in zip(b.column(0), b.column(1)):
            counter = held.setdefault(lang.as_py(), Counter())
            for words in blocks(text.as_py() or ""):
                size += counter.add(words)
                if size > chunk or sum(len(c.numbers) for c in held.values()) > WORDS:
                    yield from out(last=False)
                    held = {k: c for k, c in held.items() if c.held}
                    size = 0
    yield from out(last=True)
    held.clear()
    release()


def phrase_counts(docs: DataFrame, max_n: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, f) of all phrases of 1 to max_n words seen ``least`` times, and of the empty phrase: all words."""
    texts = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    rows = texts.mapInArrow(lambda batches: count_rows(batches, max_n), COUNTS)
    # rows are combined already: they are dealt first, so that no second combining runs before the shuffle;
    # sorted neighbours go together, which compresses well, while phrases that begin alike go to SPREAD tasks
    dealt = F.substring("phrase", 1, HEAD), F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))
    return rows.repartition("lang", *dealt).groupBy("lang", dealt[0].alias("head"), dealt[1].alias("part"), "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | ((F.col("phrase") == "") & (F.col("f") > 0))).select("lang", "phrase", "f")


def _words():
    return F.split("phrase", " ")


def collocations(docs: DataFrame, max_n: int = 3, least: int = 10, top: int = 2000, share: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by the score of their weakest cut.

    share: a phrase goes if a longer candidate around it has this per cent of its count.
    """
    return scored(written(phrase_counts(docs, max_n, least, text_col, lang_col), "phrases"), max_n, top, share)


def scored(seen: DataFrame, max_n: int, top: int, share: int) -> DataFrame:
    """The ranks and scores from the counts (lang, phrase, f) of all frequent phrases of up to max_n words."""
    total = seen.where("phrase = ''").select("lang", F.col("f").alias("n"))
    seen = seen.where("phrase != ''").withColumn("size", F.size(_words())).where(F.col("size") <= max_n)
    candidates = seen.where("size > 1").withColumnRenamed("f", "a")

    # phrases one word shorter, with the most frequent candidate around them
    longer = candidates.where("size > 2").withColumn("w", _words())
    inner = longer.select("lang", "a", F.explode(F.array(F.array_join(F.slice("w", F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.col("size") - 1), " "))).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")

    part = lambda name: seen.select("lang", F.col("phrase").alias(name), F.col("f").alias(name[0]))
    cuts = kept.withColumn("w", _words()).select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    both = cuts.join(part("left"), ["lang", "left"]).join(part("right"), ["lang", "right"])
    exact = lambda c: f"CAST({c} AS DECIMAL(15, 0))"
    by_cut = both.withColumn("score", F.expr(f"CAST(CAST(1000000 AS DECIMAL(7, 0)) * ({exact('a')} * {exact('a')}) DIV ({exact('l')} * {exact('r')}) AS LONG)"))
    weakest = by_cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = weakest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def oracle(max_n: int = 3, least: int = 10, top: int = 2000, share: int = 50) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(translate(text, '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
sizes AS (SELECT unnest(range(1, {max_n + 1})) AS size),
f AS (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM pieces, sizes WHERE len(w) >= size)
  GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= {least}),
inner_phrases AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a FROM c, (SELECT unnest(range(2, {max_n})) AS m) AS ms, (SELECT unnest(range(1, {max_n + 1})) AS i) AS starts
  WHERE m < size AND i + m - 1 <= size),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM inner_phrases AS x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.a >= {share} * c.a)),
cuts AS (SELECT lang, phrase, a, w, size, unnest(range(1, size)) AS k FROM kept),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f AS y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[k + 1:cuts.size], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest) JOIN n USING (lang) WHERE rank <= {top}"""
