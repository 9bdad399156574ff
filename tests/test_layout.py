"""Operators over small groups and the staff bands, against cases worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.operators import decode, groups, select, sequence
from tessitura.vision import pages


def bands(spark, ys):
    rows = pages.staff_bands(spark.createDataFrame([("p", float(y)) for y in ys], "page_id string, y double")).orderBy("staff_index").collect()
    return [[int(y) for y in r.line_ys] for r in rows]


def test_bands_do_not_overlap(spark):
    # gaps of twice the interline get a line in their middle first
    assert bands(spark, [0, 10, 20, 30, 40, 60, 80, 100, 120]) == [[0, 10, 20, 30, 40], [50, 60, 70, 80, 90]]
    assert bands(spark, range(0, 90, 10)) == [[0, 10, 20, 30, 40]]
    assert bands(spark, [*range(0, 50, 10), *range(100, 150, 10)]) == [[0, 10, 20, 30, 40], [100, 110, 120, 130, 140]]


def test_bands_with_a_faint_line_and_a_title(spark):
    # the line at 20 is missing, that at 300 stands alone
    assert bands(spark, [0, 10, 30, 40, 100, 110, 120, 130, 140, 300]) == [[0, 10, 20, 30, 40], [100, 110, 120, 130, 140]]
    assert bands(spark, [0, 10, 20]) == []


def test_weak_bars_that_break_the_spacing_go():
    strong = [(100.0 * k, False) for k in range(1, 6)]
    assert groups.without_weak([*strong, (330.0, True)], 0.0, 10.0) == strong
    assert groups.without_weak([*strong, (330.0, False)], 0.0, 10.0) == sorted([*strong, (330.0, False)])
    assert groups.without_weak([(20.0, False), *strong], 0.0, 10.0) == strong  # at the front


def test_pieces_parted_by_a_line_are_joined():
    above, below, far = (4.0, 10.0, 5.0, 8, 3, 12, 7), (4.0, 11.0, 12.0, 9, 9, 13, 15), (4.0, 60.0, 12.0, 58, 9, 62, 15)
    assert groups.joined_pieces([below, above, far], 20.0) == [(8.0, 10.5, 8.5, 8, 3, 13, 15), far]


def test_systems_part_at_wide_gaps(spark):
    tops = [0, 100, 400, 500]
    rows = spark.createDataFrame([("p", i, float(t + 40), float(t), 10.0) for i, t in enumerate(tops)], "page string, i int, top double, bottom double, unit double")
    assert [r.system_index for r in sequence.split_systems(rows, ["page"], ["i"], "top", "bottom", "unit").orderBy("i").collect()] == [0, 0, 1, 1]


def test_context_fills_lone_symbols_and_rests(spark):
    rows = spark.createDataFrame([("a", 1, False, False), ("b", 2, True, False), ("b", 3, False, False), ("c", 4, True, False), ("c", 5, True, True)], "measure string, id int, is_rest boolean, known boolean")
    got = {r.id: (r.ticks, r.visual_score) for r in decode.context_hypotheses(rows, ["measure"], F.lit(1440)).collect()}
    assert got == {1: (1440, 0.4), 2: (1440, -2.0), 4: (1440, 1.5)}


def test_rescue_takes_more_only_in_proportion(spark):
    base = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "page string, i int")
    more = spark.createDataFrame([("a", i) for i in range(3)] + [("b", i) for i in range(9)], "page string, i int")
    sizes = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "page string, size double")
    got = {r.page: r["count"] for r in select.rescue(base, more, sizes, ["page"], few=22).groupBy("page").count().collect()}
    assert got == {"a": 3, "b": 1}
