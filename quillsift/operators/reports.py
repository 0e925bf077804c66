"""Reports as rows of lines: what was measured, what it was held against, and only then the band.

A line is a row (report, section, place, line); no report is gathered anywhere,
and sorting by section and place prints it.  A report without a usable comparison
has its own short form.  Two rules hold for every report and are checked by
queries: a refused one shows no digit, and no line before the conclusion names a band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.operators import rules as R
from quillsift.params import PARAMS

COMPARED, MEASURED, JUDGED, DECIDED, THEREFORE, NEXT, LIMITS = range(1, 8)
HEADINGS = {COMPARED: "COMPARED", MEASURED: "MEASURED", JUDGED: "HELD AGAINST", DECIDED: "DECIDED BY", THEREFORE: "THEREFORE", NEXT: "NEXT", LIMITS: "WHAT THIS CANNOT SAY"}
REFUSED = ("The photos could not be brought together well enough to compare them.", "Take both again from the same place and in the same light.", "Nothing was measured, so nothing is reported.")
CANNOT_SAY = ("It names no illness and rules none out.", "It does not replace an examination.")
NOTHING_REACHED = "No measurement reached its threshold."
ADVICE = "Show these photos at an examination."
#: What each rule found, in words.
FOUND = {"AREA_GROWTH_LARGE": "grew a lot", "AREA_GROWTH": "grew", "NEW_LESION": "was not there before", "COLOUR_CHANGE": "changed its colour", "PERSISTENT_CONDITION": "stayed"}


def report_lines(lesions: DataFrame, report: str, params: dict = PARAMS, rules: tuple[R.Rule, ...] = R.RULES) -> DataFrame:
    """(report, section, place, line) for each report of ``lesions`` (columns as for ``rules.assess``).

    Place orders the lines of a section: 0 for its heading, then by spot; whole
    per cent are rounded down, so that they never overstate.
    """
    bands = R.assess(lesions, report, params, rules)
    refused, assessed = bands.where(F.col("band") == R.NOT_ASSESSED), bands.where(F.col("band") != R.NOT_ASSESSED)
    known = assessed.select(report)
    spots = lesions.join(known, report)
    fired = R.counterfactuals(lesions, report, params, rules)
    spot = lambda rest: F.concat(F.lit("- spot "), F.col("lesion_id").cast("string"), F.lit(" "), rest)
    whole = lambda c: F.floor(c).cast("string")

    def lines(d: DataFrame, section: int, text: Column | str, place: Column | int = 1) -> DataFrame:
        return d.select(report, F.lit(section).alias("section"), (F.lit(place) if isinstance(place, int) else place).cast("long").alias("place"), (F.lit(text) if isinstance(text, str) else text).alias("line"))

    def headings(d: DataFrame, sections: list[int]) -> DataFrame:
        table = F.array(*(F.struct(F.lit(s).alias("section"), F.lit(0).cast("long").alias("place"), F.lit(HEADINGS[s]).alias("line")) for s in sections))
        return d.select(report, F.inline(table))

    def fixed(d: DataFrame, section: int, texts: tuple[str, ...]) -> DataFrame:
        return d.select(report, F.lit(section).alias("section"), F.posexplode(F.array(*map(F.lit, texts))).alias("place", "line")).select(report, "section", (F.col("place") + 1).cast("long").alias("place"), "line")

    change = F.when(F.col("status") != "ok", "could not be compared").when(F.col("comparability") != "full", "was seen only in part").when(F.col("area_change_pct").isNull(), "has no earlier size")
    change = change.otherwise(F.concat(F.lit("changed its area by "), whole(F.col("area_change_pct")), F.lit(" %")))
    words = F.create_map(*(F.lit(x) for r in rules for x in (r.rule_id, FOUND.get(r.rule_id, r.rule_id))))
    held = F.concat(words[F.col("rule_id")], F.when(F.col("threshold").isNotNull(), F.concat(F.lit(": "), whole(F.col("measured")), F.lit(" % against "), whole(F.col("threshold")), F.lit(" %"))).otherwise(""))
    concern = assessed.where(F.col("band") != R.LEVELS[0])
    out = [
        headings(assessed, [COMPARED, MEASURED, JUDGED, DECIDED, THEREFORE, LIMITS]), headings(concern, [NEXT]), headings(refused, [COMPARED, LIMITS]),
        lines(spots.groupBy(report).agg(F.count(F.lit(1)).alias("n")), COMPARED, F.concat(F.col("n").cast("string"), F.lit(" spots in an earlier and a later photo"))),
        lines(spots, MEASURED, spot(change), F.col("lesion_id") + 1),
        # a spot may fire several rules; they follow each other in the order of the rules
        lines(fired, JUDGED, spot(held), (F.col("lesion_id") + 1) * len(rules) + F.array_position(F.array(*(F.lit(r.rule_id) for r in rules)), F.col("rule_id")) - 1),
        lines(assessed.where("n_rules = 0"), JUDGED, NOTHING_REACHED),
        lines(R.deciding(lesions, report, params, rules).select(report, "rule_id").distinct(), DECIDED, F.concat(F.lit("- "), F.col("rule_id")), F.array_position(F.array(*(F.lit(r.rule_id) for r in rules)), F.col("rule_id"))),
        lines(assessed.where("n_rules = 0"), DECIDED, "- nothing"),
        lines(assessed, THEREFORE, F.concat(F.col("band"), F.when(F.col("escalated_by_rule_count"), F.lit(", as several rules fired")).otherwise(""))),
        lines(concern, NEXT, ADVICE),
        fixed(refused, COMPARED, REFUSED), fixed(bands, LIMITS, CANNOT_SAY),
    ]
    all_lines = out[0]
    for d in out[1:]:
        all_lines = all_lines.unionByName(d)
    return all_lines


def broken_lines(lines: DataFrame, report: str) -> DataFrame:
    """Lines that break a rule: a digit in a report that draws no conclusion, or a band named before the conclusion."""
    concluded = lines.where(F.col("section") == THEREFORE).select(report).distinct()
    digits = lines.where(F.col("line").rlike("[0-9]")).join(concluded, report, "left_anti")
    early = lines.where((F.col("section") < THEREFORE) & F.col("line").rlike(rf"\b({'|'.join(R.LEVELS)}|{R.NOT_ASSESSED})\b"))
    return digits.unionByName(early)
