r"""License scans: ordered signature rules over normalised words.

Native: only Spark's own column functions; a scan that moves no rows.

A text is lower-cased (A-Z), cut into words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``
and joined again by single spaces.  Each rule is a regular expression over that
form with a keyword; a rule runs only on texts that hold its keyword, and texts
with no keyword at all skip the rules.  A detection is a span of words.  Spans
are resolved by containment: a span inside another one goes; of equal spans the
rule of higher priority (the earlier one) stays.  The base rules' labels stay in
any case.

Edge cases: a null text counts as empty; an empty text has no words, no labels
and score 0; a very long text is scanned whole (no pattern repeats without a
bound, so the matcher's stack does not grow with the text); repeated rows give
repeated results; an empty table gives an empty result; columns other than the
id and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm.common import table, whole_text

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The phrases of the base scan.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Licence families: label, keyword that must occur, name, identifier words (both over normalised words).
FAMILIES = (
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version)? (?:v)?1 1", "apache 1 1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?(?: version)? (?:v)?2(?: 0)?", "apache 2 0"),
    ("mit", "mit", r"mit(?: expat)?", "mit"),
    ("mit-0", "mit", r"mit no attribution", "mit 0"),
    ("x11", "x11", r"x11", "x11"),
    ("isc", "isc", r"isc", "isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?", "zlib"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd)", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd)", "bsd 4 clause"),
    ("0bsd", "bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)", "0bsd"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version)? (?:v)?1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version)? (?:v)?2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version)? (?:v)?3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("lgpl-2.0", "general public", r"(?:gnu )?library general public license(?: version)? (?:v)?2(?: 0)?", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "general public", r"(?:gnu )?lesser general public license(?: version)? (?:v)?2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "general public", r"(?:gnu )?lesser general public license(?: version)? (?:v)?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("agpl-3.0", "general public", r"(?:gnu )?affero general public license(?: version)? (?:v)?3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation license", "gfdl 1 [123](?: only| or later)?"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: version)? (?:v)?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license(?: version)? (?:v)?2 0", "mpl 2 0"),
    ("epl-1.0", "eclipse", r"eclipse public license(?: version)? (?:v)?1 0", "epl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public license(?: version)? (?:v)?2 0", "epl 2 0"),
    ("cpl-1.0", "common public", r"common public license(?: version)? 1 0", "cpl 1 0"),
    ("cddl-1.0", "common development", r"common development and distribution license(?: version)? 1 0", "cddl 1 0"),
    ("eupl-1.2", "european union", r"european union public licen[cs]e(?: version)? (?:v)?1 2", "eupl 1 2"),
    ("artistic-1.0", "artistic", r"artistic license(?: version)? 1 0", "artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic license(?: version)? 2 0", "artistic 2 0"),
    ("bsl-1.0", "boost", r"boost software license(?: version)? 1 0", "bsl 1 0"),
    ("wtfpl", "wtfpl", r"wtfpl", "wtfpl"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense"),
    ("python-2.0", "python software", r"python software foundation(?: license)?(?: version 2)?", "(?:python|psf) 2 0"),
    ("openssl", "openssl", r"openssl(?: and ssleay)?", "openssl"),
    ("postgresql", "postgresql", r"postgresql", "postgresql"),
    ("ofl-1.1", "open font", r"(?:sil )?open font license(?: version)? (?:v)?1 1", "ofl 1 1"),
    ("odbl-1.0", "open database", r"open database license(?: version)?(?: v?1 0)?", "odbl 1 0"),
    ("ms-pl", "microsoft", r"microsoft public license", "ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license", "ms rl"),
    ("cc0-1.0", "cc0", r"(?:cc0|creative commons zero|cc zero)(?: v?1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-3.0", "by 3", r"(?:cc|creative commons) by 3 0", "cc by 3 0"),
    ("cc-by-4.0", "by 4", r"(?:cc|creative commons) by 4 0", "cc by 4 0"),
    ("cc-by-sa-3.0", "sa 3", r"(?:cc|creative commons) by sa 3 0", "cc by sa 3 0"),
    ("cc-by-sa-4.0", "sa 4", r"(?:cc|creative commons) by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nc-3.0", "nc 3", r"(?:cc|creative commons) by nc 3 0", "cc by nc 3 0"),
    ("cc-by-nc-4.0", "nc 4", r"(?:cc|creative commons) by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "nd 4", r"(?:cc|creative commons) by nd 4 0", "cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "nc sa 4", r"(?:cc|creative commons) by nc sa 4 0", "cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "nc nd 4", r"(?:cc|creative commons) by nc nd 4 0", "cc by nc nd 4 0"),
)

#: Rule forms made from each family: name, pattern around {name} or {id}, further keyword, score.
FORMS = (
    ("tag", r"spdx licen[cs]e identifier {id}", "spdx", 1.0),
    ("notice", r"(?:licen[cs]ed|released|distributed|published|provided|made available|available|covered) (?:under|by) (?:the )?(?:terms of (?:the )?)?{name}(?: licen[cs]e)?", "", 0.95),
    ("link", r"(?:opensource org|spdx org|choosealicense com) licen[cs]es {id}", "licenses", 0.9),
    ("subject", r"(?:subject to|governed by|see|accept|accompanying) (?:the )?(?:terms of (?:the )?)?{name}(?: licen[cs]e)?", "", 0.85),
    ("named", r"(?:the )?{name} licen[cs]e", "licen", 0.8),
    ("titled", r"(?:the )?{name}", "", 0.75),
)

#: Rules written out by themselves: label, keyword, pattern, score.
TEXTS = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose", 1.0),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification", 0.9),
    ("apache-2.0", "apache org", r"www apache org licenses license 2 0", 1.0),
    ("gpl", "gnu org", r"www gnu org licenses(?: gpl)?", 0.7),
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify", 0.9),
    ("cc", "creativecommons", r"creativecommons org licenses (?:by nc nd|by nc sa|by nc|by nd|by sa|by|nc sa|nc|nd nc|nd|sa)(?: \d \d)?", 0.9),
    ("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero 1 0", 1.0),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", 0.8),
    ("proprietary", "all rights reserved", r"all rights reserved", 0.5),
    ("proprietary", "proprietary", r"proprietary and confidential", 0.7),
    ("boost", "boost", r"www boost org license 1 0 txt", 0.9),
    ("mpl-2.0", "mozilla", r"mozilla org mpl 2 0", 0.9),
)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    score: float


def rules() -> list[Rule]:
    """All rules in order of priority, made from the tables above; the base phrases come first."""
    out = [Rule(label, "license", phrase, 0.6) for phrase, label in BASE]
    out += [Rule(label, kw, pattern, score) for label, kw, pattern, score in TEXTS]
    for form, pattern, more, score in FORMS:
        for label, kw, name, ident in FAMILIES:
            if form == "titled" and " licen" not in name:
                continue  # a bare name is no license
            keyword = more if "{id}" in pattern else kw
            out.append(Rule(label, keyword, pattern.replace("{name}", f"(?:{name})").replace("{id}", f"(?:{ident})"), score))
    return out


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _matches(rank: int, rule: Rule, words: Column, keywords: Column) -> Column:
    """The rule with the matches of its pattern and the text between them; null if its keyword or every match is missing.

    The pattern is a literal, so that it is compiled once a task.
    """
    around = f"(?<= )(?:{rule.pattern})(?= )"
    # a normalised text has no \\x00
    gaps = F.split(F.regexp_replace(words, around, "\x00"), "\x00")
    found = F.struct(F.lit(rank).alias("rank"), F.lit(rule.label).alias("label"), F.lit(rule.score).alias("score"), gaps.alias("gaps"), F.regexp_extract_all(words, F.lit(around), F.lit(0)).alias("hits"))
    return F.when(F.array_contains(keywords, rule.keyword) & F.rlike(words, F.lit(around)), found)


def _spans(gaps: Column, hits: Column) -> Column:
    """Word spans (start, stop) of a pattern's matches: words and gaps before a match are counted by their spaces."""
    pair = F.zip_with(gaps, hits, lambda g, h: F.struct(_spaces(g).alias("gap"), _spaces(h).alias("hit"), h.isNotNull().alias("real")))
    start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("found"))
    step = lambda acc, p: F.when(
        p["real"],
        F.struct(
            (acc["at"] + p["gap"] + p["hit"]).alias("at"),
            F.array_append(acc["found"], F.struct((acc["at"] + p["gap"]).alias("start"), (acc["at"] + p["gap"] + p["hit"] + 1).alias("stop"))).alias("found"),
        ),
    ).otherwise(acc)
    return F.aggregate(pair, start, step, lambda acc: acc["found"])


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row in: words, base places, labels, score and all ``detections`` with their spans."""
    all_rules = rules()
    keywords = sorted({r.keyword for r in all_rules})
    spaced = F.regexp_replace(F.translate(whole_text(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), SEPARATORS, " ")
    d = df.select(F.col(id_col).alias("doc_id"), F.trim(spaced).alias("_norm"))
    d = d.withColumn("_kw", F.filter(F.array(*(F.lit(k) for k in keywords)), lambda k: F.contains(F.col("_norm"), k)))
    d = d.withColumn("_padded", F.concat(F.lit(" "), "_norm", F.lit(" ")))
    run = F.filter(F.array(*(_matches(i, r, F.col("_padded"), F.col("_kw")) for i, r in enumerate(all_rules))), lambda r: r.isNotNull())
    found = F.flatten(
        F.transform(
            run,
            lambda r: F.transform(
                _spans(r["gaps"], r["hits"]),
                # sorted by start, then the longer, then the rule of higher priority
                lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("neg_stop"), r["rank"].alias("rank"), r["label"].alias("label"), r["score"].alias("score")),
            ),
        )
    )
    none = F.array().cast("array<struct<start:int,neg_stop:int,rank:int,label:string,score:double>>")
    d = d.withColumn("_found", F.when(F.size("_kw") > 0, F.array_sort(found)).otherwise(none))
    # Spans come by start, so one inside an earlier span ends no later than the farthest end so far.
    begin = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))
    step = lambda acc, x: F.when(-x["neg_stop"] <= acc["end"], acc).otherwise(
        F.struct((-x["neg_stop"]).alias("end"), F.array_union(acc["labels"], F.array(x["label"])).alias("labels"), F.greatest(acc["score"], x["score"]).alias("score"))
    )
    d = d.withColumn("_kept", F.aggregate("_found", begin, step))
    d = d.withColumn("_base", F.filter("_found", lambda x: x["rank"] < len(BASE)))
    base_labels = F.array_distinct(F.transform("_base", lambda x: x["label"]))
    return d.select(
        "doc_id",
        F.when(F.col("_norm") == "", F.lit(0)).otherwise(_spaces(F.col("_norm")) + 1).cast("long").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda x: x["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_base", lambda x: x["start"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.col("_kept.labels"))), ",").alias("labels"),
        F.col("_kept.score").alias("score"),
        F.transform("_found", lambda x: F.struct(x["start"].alias("start"), (-x["neg_stop"]).alias("stop"), x["label"].alias("label"), x["score"].alias("score"))).alias("detections"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


def oracle() -> str:
    values = ",\n    ".join(f"({i}, '{r.label}', '{r.keyword}', '{r.pattern}', {r.score})" for i, r in enumerate(rules()))
    return rf"""
WITH RECURSIVE rules(rank, label, keyword, pattern, score) AS (VALUES
    {values}),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         ' ' || trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') || ' ' AS norm
  FROM documents),
-- the words' own spaces are doubled, so that matches side by side do not share one
c AS (SELECT rid, rank, label, score, ' ' || replace(trim(norm, ' '), ' ', '  ') || ' ' AS wide, pattern, unnest(regexp_extract_all(wide, ' ' || replace('(?:' || pattern || ')', ' ', '  ') || ' ')) AS hit, generate_subscripts(regexp_extract_all(wide, ' ' || replace('(?:' || pattern || ')', ' ', '  ') || ' '), 1) AS k
      FROM d JOIN rules ON contains(norm, keyword)),
p AS (  -- the place of the k-th hit: words in what stands before it
  SELECT rid, rank, label, score, 1 AS k, wide AS rest, 0 AS pos, hit FROM c WHERE k = 1
  UNION ALL
  SELECT p.rid, p.rank, p.label, p.score, p.k + 1, substr(p.rest, instr(p.rest, p.hit) + length(p.hit)),
         p.pos + len(string_split(trim(substr(p.rest, 1, instr(p.rest, p.hit) + length(p.hit) - 1), ' '), '  ')), c.hit
  FROM p JOIN c ON c.rid = p.rid AND c.rank = p.rank AND c.k = p.k + 1),
f AS (SELECT rid, rank, label, score,
             pos + CASE WHEN trim(substr(rest, 1, instr(rest, hit) - 1), ' ') = '' THEN 0 ELSE len(string_split(trim(substr(rest, 1, instr(rest, hit) - 1), ' '), '  ')) END AS start,
             len(string_split(trim(hit, ' '), '  ')) AS n FROM p),
s AS (SELECT *, start + n AS stop, coalesce(max(start + n) OVER (PARTITION BY rid ORDER BY start, -(start + n), rank, label, score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM f),
g AS (SELECT rid, count(*) FILTER (rank < {len(BASE)}) AS n_base, min(start) FILTER (rank < {len(BASE)}) AS first_word, max(start) FILTER (rank < {len(BASE)}) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (rank < {len(BASE)}) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (rank < {len(BASE)} OR stop > reach) AS labels,
             max(score) FILTER (stop > reach) AS score FROM s GROUP BY rid)
SELECT doc_id, CASE WHEN trim(norm, ' ') = '' THEN 0 ELSE len(string_split(trim(norm, ' '), ' ')) END AS n_words,
       coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN g USING (rid)"""
