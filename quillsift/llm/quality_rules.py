"""Quality rules: one table of thresholds compiled into one Spark projection.

Native: only Spark's own column functions.  Each text is read once; no row is
moved, so the operator is a scan at any size.

Definitions
    words          maximal runs of ``[^\\x20\\x09-\\x0D]``
    n_dup_lines    lines with a word that equal an earlier line of the text
    n_repeat_words words that stand in a 3-word window found twice or more

Edge cases: a null or empty text has no words and fails the base rule; repeated
rows give repeated results; an empty table gives an empty result; columns of the
input other than the id and the text are not read, so clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm.common import SPACES, table, whole_text

#: The most frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with for is in a it on as was are at by this from or an "
    "le la les de des du et en un une que qui dans pour est pas sur par au "
    "der die das und ist in zu den mit von für auf ein eine nicht im dem "
    "el los las y que de en un una por con para es del se no al"
).split()

#: Bits of a packed key that hold the window's position; the rest hold its hash.
POSITION_BITS = 20
#: The longest text, in words, that packed keys can describe; longer ones take the plain sort.
PACKED_WORDS = 1 << POSITION_BITS


@dataclass(frozen=True)
class Threshold:
    """A text passes if ``low <= value <= high`` (null bounds are open)."""

    name: str
    value: str  # SQL over the measured columns
    low: float | None = None
    high: float | None = None


#: The threshold table.  Ratios are over words or lines; all measures are of the whole text.
THRESHOLDS = (
    Threshold("mean_word_length", "word_chars / n_words", 2.0, 20.0),
    Threshold("symbol_ratio", "n_symbols / n_words", None, 0.25),
    Threshold("exclamation_ratio", "n_exclamations / n_words", None, 0.25),
    Threshold("upper_ratio", "n_upper / word_chars", None, 0.5),
    Threshold("stop_word_ratio", "n_stop_words / n_words", 0.02, None),
    Threshold("dup_line_ratio", "n_dup_lines / n_lines", None, 0.4),
    Threshold("alpha_ratio", "n_alpha_words / n_words", 0.6, None),
)


def passes(thresholds=THRESHOLDS) -> Column:
    """The whole table as one boolean expression; null (no words) does not pass."""
    parts = []
    for t in thresholds:
        value = F.expr(t.value.replace(" / ", " * 1.0D / nullif(") + ", 0)")
        if t.low is not None:
            parts.append(value >= F.lit(float(t.low)))
        if t.high is not None:
            parts.append(value <= F.lit(float(t.high)))
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return F.coalesce(out, F.lit(False))


def _repeat_words() -> Column:
    """Words covered by repeated 3-word windows, from the sorted packed keys ``_keys``.

    A key is the window's hash with its lowest bits replaced by its position, so
    one primitive sort brings equal windows together.
    """
    shift = POSITION_BITS
    repeated = F.expr(
        f"filter(_keys, (x, j) -> (j > 0 AND shiftright(x, {shift}) = shiftright(_keys[j - 1], {shift})) "
        f"OR (j < size(_keys) - 1 AND shiftright(x, {shift}) = shiftright(_keys[j + 1], {shift})))"
    )
    return repeated


def _covered(positions: str) -> Column:
    """Words under the windows that start at the sorted ``positions``."""
    return F.expr(
        f"aggregate(zip_with({positions}, slice({positions}, 2, greatest(size({positions}) - 1, 0)), "
        f"(a, b) -> least(3L, coalesce(b, a + 3L) - a)), 0L, (s, x) -> s + x)"
    )


#: Repeated windows by a sort of the words themselves: for texts beyond PACKED_WORDS, or if two different windows share a packed hash.
_PLAIN = (
    "array_sort(transform(filter(transform(array(array_sort(transform(sequence(0, n_words - 3), "
    "i -> struct(_words[i] AS a, _words[i + 1] AS b, _words[i + 2] AS c, CAST(i AS BIGINT) AS i)))), s -> "
    "filter(s, (x, j) -> (j > 0 AND x.a = s[j - 1].a AND x.b = s[j - 1].b AND x.c = s[j - 1].c) "
    "OR (j < size(s) - 1 AND x.a = s[j + 1].a AND x.b = s[j + 1].b AND x.c = s[j + 1].c)))[0], "
    "x -> x IS NOT NULL), x -> x.i))"
)


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """Count what the thresholds need; one row out for each row in, with ``keep_row`` also the row itself as ``row``."""
    row = ["row"] * keep_row
    words = r"[\x20\x09-\x0D]+"
    mask = PACKED_WORDS - 1
    d = df.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("_text"), *([F.struct(*df.columns).alias("row")] * keep_row))
    d = d.withColumn("_trim", F.btrim("_text", F.lit(SPACES)))
    d = d.select(
        "doc_id",
        *row,
        "_trim",
        F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", words)).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0).alias("_lines"),
    )
    d = d.select(
        "doc_id",
        *row,
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_trim", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_trim", r"[^!]+", "")).cast("long").alias("n_exclamations"),
        F.length(F.regexp_replace("_trim", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("_words", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_alpha_words"),
        F.when(
            (F.size("_words") >= 3) & (F.size("_words") <= PACKED_WORDS),
            F.sort_array(
                F.expr(
                    f"transform(sequence(0, size(_words) - 3), i -> "
                    f"(xxhash64(_words[i], _words[i + 1], _words[i + 2]) & ~{mask}L) | CAST(i AS BIGINT))"
                )
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_keys"),
    )
    d = d.withColumn("_rep", _repeat_words())
    # Equal packed hashes must be equal windows, or the plain sort decides.
    d = d.withColumn(
        "_clash",
        (F.col("n_words") > PACKED_WORDS)
        | F.expr(
            f"exists(zip_with(_rep, slice(_rep, 2, greatest(size(_rep) - 1, 0)), (a, b) -> "
            f"shiftright(a, {POSITION_BITS}) = shiftright(b, {POSITION_BITS}) AND NOT ("
            + " AND ".join(f"_words[CAST(a & {mask}L AS INT) + {k}] = _words[CAST(b & {mask}L AS INT) + {k}]" for k in range(3))
            + ")), x -> coalesce(x, false))"
        ),
    )
    d = d.withColumn(
        "_at", F.when(F.col("_clash"), F.expr(_PLAIN)).otherwise(F.sort_array(F.expr(f"transform(_rep, x -> x & {mask}L)")))
    )
    return d.withColumn("n_repeat_words", _covered("_at")).drop("_words", "_keys", "_rep", "_clash", "_at")


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS, keep_row: bool = False) -> DataFrame:
    """Measures, the base rule and the verdict of the threshold table for each row."""
    d = measure(df, id_col, text_col, keep_row)
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return d.withColumn("kept", ~F.col("base_failed") & passes(thresholds))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(*COLUMNS)


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted(set(words))) + "]"


def oracle() -> str:
    tests = []
    for t in THRESHOLDS:
        value = t.value.replace(" / ", " * 1.0 / nullif(") + ", 0)"
        tests += [f"{value} >= {t.low}"] * (t.low is not None) + [f"{value} <= {t.high}"] * (t.high is not None)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM d WHERE len(words) >= 3),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS n FROM w),
c AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY rid),
m AS (
  SELECT doc_id, len(words) AS n_words, coalesce(length(array_to_string(words, '')), 0) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         length(regexp_replace(text, '[^!]+', '', 'g')) AS n_exclamations,
         length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         len(list_filter(words, lambda x: list_contains({_sql_list(STOP_WORDS)}, lower(x)))) AS n_stop_words,
         len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha_words,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce({" AND ".join(tests)}, false) AS kept
FROM b"""
