from __future__ import annotations

import pytest

from tessitura.plans import evaluation


def test_layout_issues(spark):
    pages = spark.createDataFrame([("a", 100.0), ("b", 100.0)], "page_id string, width double")
    bands = spark.createDataFrame([("a", 0, 10.0), ("a", 1, 10.0), ("a", 2, 20.0)], "page_id string, staff_index int, interline_px double")
    got = sorted((r.page_id, r.issue) for r in evaluation.staff_issues(pages, bands).collect())
    assert got == [("a", f"Staff band {i} interline ({x:.1f}px) deviates from mean (13.3px) by >3.0px") for i, x in ((0, 10), (1, 10), (2, 20))] + [("b", "Only 0 staff bands detected (expected ≥1)")]
    bars = spark.createDataFrame([("a", 5.0), ("a", 9.0), ("a", 120.0)], "page_id string, x double")
    got = sorted((r.page_id, r.issue) for r in evaluation.barline_issues(pages, bars).collect())
    assert got == [("a", "Barline 2 at x=120.0 is outside image [0, 100.0]"), ("a", "Barlines at x=5.0 and 9.0 are too close (4.0px)"), ("b", "Only 0 barlines detected (expected ≥1)")]
    counts = spark.createDataFrame([("a", 3, 2), ("b", 4, 2), ("c", 0, 0)], "page_id string, noteheads int, staves int")
    assert [r.issue for r in evaluation.notehead_issues(counts).collect()] == ["Only 3 noteheads detected across 2 staves (expected ≥4)"]


def test_metrics(spark):
    truth = spark.createDataFrame([("x", 8), ("y", 6)], "fixture string, measures int")
    got = evaluation.layout_metrics(spark.createDataFrame([("x", 8), ("y", 9), ("z", 1)], "fixture string, measures int"), truth).first()
    assert tuple(got) == (2, 1, 1.5, 17, 14)
    found = spark.createDataFrame([("x", "old", "F4", "4/4", 5), ("x", "new", "F4", "3/4", 10), ("y", "old", "G2", "4/4", 0), ("y", "new", "F4", "4/4", 4)], "fixture string, mode string, clef string, time string, heads int")
    known = spark.createDataFrame([("x", "F4", "4/4", 10), ("y", "F4", "4/4", 4)], "fixture string, gt_clef string, gt_time string, gt_notes int")
    rows = {r["mode"]: r for r in evaluation.stage_metrics(found, known).collect()}
    assert (rows["new"].clef_right, rows["new"].time_right, rows["new"].f1, rows["new"].count_error) == (2, 1, 1.0, 0.0)
    assert (rows["old"].clef_right, rows["old"].precision, rows["old"].recall) == (1, 0.5, 0.25) and rows["old"].f1 == pytest.approx(1 / 3)
