"""Reports: order of the lines, refusals without a figure, bands only in the conclusion."""

from __future__ import annotations

from quillsift.operators import reports
from tests.helpers import rows

LESIONS = "visit long, lesion_id long, status string, comparability string, state string, area_change_pct double, colour_measurable boolean, notable_colour boolean, persistent_condition boolean"


def printed(spark, table):
    d = reports.report_lines(spark.createDataFrame(table, LESIONS), "visit")
    out = {}
    for r in d.orderBy("visit", "section", "place").collect():
        out.setdefault(r.visit, []).append(r.line)
    return d, out


def test_reports(spark):
    row = lambda visit, spot, status="ok", seen="full", state="persistent", pct=1.0, colour=False: (visit, spot, status, seen, state, pct, True, colour, False)
    d, out = printed(spark, [row(1, 1, pct=12.7), row(1, 2, state="new"), row(1, 3, seen="partial", pct=99.0), row(1, 4, "unreliable", pct=None), row(2, 5, "unreliable", pct=None), row(3, 6, pct=-3.2), row(4, 7, pct=None), row(5, 8, pct=31.0, colour=True)])
    assert out[1] == [
        "COMPARED", "4 spots in an earlier and a later photo", "MEASURED", "- spot 1 changed its area by 12 %", "- spot 2 changed its area by 1 %", "- spot 3 was seen only in part", "- spot 4 could not be compared",
        "HELD AGAINST", "- spot 1 grew: 12 % against 10 %", "- spot 2 was not there before", "DECIDED BY", "- AREA_GROWTH", "- NEW_LESION", "THEREFORE", "Elevated, as several rules fired", "NEXT", reports.ADVICE, "WHAT THIS CANNOT SAY", *reports.CANNOT_SAY,
    ]
    assert out[2] == ["COMPARED", *reports.REFUSED, "WHAT THIS CANNOT SAY", *reports.CANNOT_SAY]
    assert out[3][3:] == ["- spot 6 changed its area by -4 %", "HELD AGAINST", reports.NOTHING_REACHED, "DECIDED BY", "- nothing", "THEREFORE", "Low", "WHAT THIS CANNOT SAY", *reports.CANNOT_SAY]
    assert "- spot 7 has no earlier size" in out[4] and "Elevated" in out[5] and "- AREA_GROWTH_LARGE" in out[5] and "- COLOUR_CHANGE" not in out[5]
    assert rows(reports.broken_lines(d, "visit")) == []


def test_broken_lines_are_found(spark):
    d = spark.createDataFrame([(1, 5, 1, "Low"), (1, 2, 1, "so it is Low"), (1, 2, 2, "Lower by 3"), (2, 1, 1, "seen 3 times")], "visit long, section int, place long, line string")
    assert rows(reports.broken_lines(d, "visit").select("visit", "line")) == [(1, "so it is Low"), (2, "seen 3 times")]


def test_no_reports(spark):
    assert printed(spark, [])[1] == {}
