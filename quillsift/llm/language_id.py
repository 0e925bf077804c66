"""Language identification by cross-parsing: the language that needs fewest phrases wins.

For each language a suffix automaton holds every substring of its sample.  A text
is parsed from left to right: each phrase is the longest match with the sample
(a byte that starts no match is a phrase by itself).  A phrase costs log2 of the
sample's size, a pointer into it, so that languages with little text compare
fairly with the others; the cost by letter estimates the cross entropy.

What is parsed is the text's letters in lower case as UTF-8 bytes, with one space
for each run of other characters.  An automaton is a table of bytes and states;
a batch's texts are cut into pieces that are parsed in step.  A piece is first
parsed as if a phrase began with it, then again from the state that the piece
before ended in, until both parses meet; so the count is that of one pass over
the whole text.

The sample has at most ROWS fragments of each language, one of each text at a
place drawn by its id, those with the least hashes of the ids; at most LANGS
languages, those with most fragments, with at most TOTAL bytes in all.  These are
the documented bounds of the learned sample; it is sent to the tasks, which build
the automata.  Scoring is one scan.

Edge cases: null texts and texts without a letter are ``und`` with score 0; very
long texts are parsed whole; ties go to the first language by name; without a
learned language every text is ``und``; rows whose language is null are not
learned from; repeated rows give repeated results; an empty table gives an empty
result; columns with clashing names stay inside the row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quillsift.llm.common import crc32_mod, table

#: Fragments of each language and characters of each; languages; bytes of all samples.
ROWS, FRAGMENT, LANGS, TOTAL = 256, 256, 128, 1 << 18
#: Parts in which the rows of a language are cut first.
PARTS = 32
#: Bytes of a piece; bytes of texts that are worked on at once.
PIECE, BATCH = 2048, 8 << 20
FOLDS, HELD_OUT = 4, 2
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """The letters in lower case, one space for each run of others; empty if there is no letter."""
    plain = _OTHER.sub(" ", (text or "").lower()).strip()
    return plain.encode() if any(map(str.isalpha, plain)) else b""


def sample(docs: DataFrame, rows: int = ROWS, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> list[tuple[str, list[str]]]:
    """(language, fragments) of the rows of ``docs`` with a language; bounded by LANGS languages of ``rows`` fragments."""
    h = F.xxhash64(id_col, text_col)
    start = F.pmod(h, F.greatest(F.length(text_col) - FRAGMENT, F.lit(0)) + 1) + 1
    d = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.xxhash64(h).alias("h"), F.col(text_col).substr(start.cast("int"), F.lit(FRAGMENT)).alias("fragment"))
    # cut in each task, then in parts of a language, so that few rows of a frequent one meet
    d = d.withColumn("part", F.pmod("h", F.lit(PARTS)))
    for by in (("lang", "part"), ("lang",)):
        d = d.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy("h", "fragment"))).where(F.col("r") <= rows)
    first = d
    # one row a language; a language's fragments are at most rows * FRAGMENT characters
    langs = first.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("h", "fragment"))).alias("x")).orderBy(F.desc(F.size("x")), "lang").limit(LANGS)
    return sorted((r.lang, [f.fragment for f in r.x]) for r in langs.toLocalIterator())


def automaton(sample: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``sample``; state 0 is the start, every state is a way to go on."""
    edges, link, length, last = [{}], [-1], [0], 0
    for c in sample:
        now = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = now
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                twin = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[now] = twin
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
        last = now
    return edges


class Model:
    """The automata of all languages as one table, for parsing many texts in step.

    An entry has twice the place of the next state's row, plus 1 if a phrase
    begins with the byte.
    """

    def __init__(self, samples: list[tuple[str, list[str]]]):
        plain = [(lang, b"\n".join(x for x in map(letters, parts) if x)[: max(1, TOTAL // len(samples))]) for lang, parts in samples]
        plain = [(lang, x) for lang, x in plain if x]
        self.langs = [lang for lang, _ in plain]
        self.cost = np.array([np.log2(len(x) + 1) for _, x in plain])
        known = sorted({c for _, x in plain for c in x} - {10})
        self.classes = np.zeros(256, np.uint8)  # class 0: bytes that no sample has
        self.classes[known] = np.arange(1, len(known) + 1)
        width = len(known) + 1
        tables, starts, size = [], [], 0
        for _, x in plain:
            edges = automaton(x)
            t = np.full((len(edges), width), -1, np.int64)
            # fragments do not run into each other
            at = np.array([(s, self.classes[c], to) for s, e in enumerate(edges) for c, to in e.items() if c != 10], np.int64).reshape(-1, 3)
            t[at[:, 0], at[:, 1]] = at[:, 2]
            anew = 2 * (size + np.maximum(t[0], 0) * width) + 1
            t = np.where(t < 0, anew, 2 * (size + t * width))
            t[0] = anew  # at the start every byte begins a phrase
            tables.append(t.astype(np.int32).ravel())
            starts.append(size)
            size += t.size
        self.table = np.concatenate(tables) if tables else np.empty(0, np.int32)
        self.starts = np.array(starts, np.int64)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns); the texts are not empty."""
        n = len(self.langs)
        text = np.concatenate([np.full(-(-len(t) // PIECE), i) for i, t in enumerate(texts)])
        pieces = [t[a : a + PIECE] for t in texts for a in range(0, len(t), PIECE)]
        size = np.array([len(x) for x in pieces])
        order = np.argsort(-size, kind="stable")  # long pieces first, so that those still at work are a prefix
        data = np.zeros((len(pieces), int(size.max())), np.uint8)
        for k, i in enumerate(order):
            data[k, : size[i]] = np.frombuffer(pieces[i], np.uint8)
        data = self.classes[data.T]
        live = np.searchsorted(-size[order], -np.arange(len(data)), side="left")  # pieces longer than each position
        state = np.repeat(self.starts, len(pieces)).reshape(n, -1)
        count = np.zeros((n, len(pieces)), np.int64)
        for classes, m in zip(data, live):
            step = self.table[state[:, :m] + classes[:m]]
            count[:, :m] += step & 1
            state[:, :m] = step >> 1
        rank = np.empty(len(pieces), np.int64)
        rank[order] = np.arange(len(pieces))
        count, state = count[:, rank], state[:, rank]
        table, classes = memoryview(self.table), self.classes.tobytes()
        for k in np.flatnonzero(text[1:] == text[:-1]) + 1:
            piece = pieces[k].translate(classes)
            for j in range(n):
                a, b = int(self.starts[j]), int(state[j, k - 1])
                more = 0
                for c in piece:
                    if a == b:
                        break
                    x, y = table[a + c], table[b + c]
                    more += (y & 1) - (x & 1)
                    a, b = x >> 1, y >> 1
                else:
                    state[j, k] = b
                count[j, k] += more
        return np.stack([np.bincount(text, row, len(texts)) for row in count], 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """(language, score) of each text; score: the share of bits that the winner saves against the second."""
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        held, size = [], 0
        for i, t in enumerate(texts):
            plain = letters(t) if self.langs else b""
            if plain:
                held.append((i, plain))
                size += len(plain)
            if held and (size > BATCH or i + 1 == len(texts)):
                bits = self.phrases([x for _, x in held]) * self.cost
                best = bits.argmin(1)
                for (k, _), b, row in zip(held, best, bits):
                    langs[k] = self.langs[b]
                    scores[k] = float(1 - row[b] / np.partition(row, 1)[1]) if len(row) > 1 else 1.0
                held, size = [], 0
        return langs, scores


_built: dict[str, Model] = {}


def _model(samples: list[tuple[str, list[str]]]) -> Model:
    """The model of a sample; a worker builds it once for all its tasks."""
    key = hashlib.md5(repr(samples).encode()).hexdigest()
    if key not in _built:
        _built.clear()
        _built[key] = Model(samples)
    return _built[key]


def predict_rows(docs: DataFrame, samples: list[tuple[str, list[str]]], text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score) for each row of ``docs``; row is a struct of all its columns."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # bounded, see the module's text
    at = docs.columns.index(text_col)
    rows = docs.select(F.struct(*docs.columns).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for b in batches:
            langs, scores = model.predict(b.column(0).field(at).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = crc32_mod("doc_id", FOLDS)
    samples = sample(docs.where(fold != HELD_OUT))
    d = predict_rows(docs.select("doc_id", "text"), samples).select("row.doc_id", "lang_pred", "score")
    return d.select("doc_id", (fold == HELD_OUT).alias("held_out"), "lang_pred", "score")
