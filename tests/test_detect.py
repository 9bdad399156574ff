from __future__ import annotations

import numpy as np
from tests.test_pages import page, staff

from tessitura.vision import detect


def test_bars_stems_and_beams(spark):
    gray = staff()
    gray[20:53, 120:122] = 0  # a bar
    gray[12:36, 58:59] = 0  # a stem up at the head's right
    image = page(spark, gray)
    bands = spark.createDataFrame([("p", 0, [20.0, 28.0, 36.0, 44.0, 52.0], 8.0), ("p", 1, [90.0, 98.0, 106.0, 114.0, 122.0], 8.0)], "page_id string, staff_index int, line_ys array<double>, interline_px double")
    runs = detect.column_runs(image, least=20, method="otsu")
    assert [r.x for r in detect.barlines(runs, bands, ratio=4.0).collect()] == [120.5]
    stems = detect.stems(runs, bands)
    found = {(r.stem_idx, r.staff_index, r.x_center) for r in stems.collect()}
    assert (0, 0, 58.0) in found
    head = spark.createDataFrame([("p", 0, 0, 54.0, 36.0, 50, 33, 58, 40)], "page_id string, symbol_idx int, staff_index int, cx double, cy double, x0 int, y0 int, x1 int, y1 int")
    attached = detect.attach_stems(head, stems)
    row = attached.first()
    assert (row.stem_idx, row.direction) == (0, "up") and row.score == 4.0
    more = stems.unionByName(stems.where("stem_idx = 0").selectExpr("page_id", "70 as stem_idx", "staff_index", "80.0 as x_center", "y0", "y1", "interline_px").select(stems.columns))
    beams = spark.createDataFrame([("p", 0, 0, 57, 11, 82, 14, 1), ("p", 1, 0, 57, 60, 82, 64, 1)], "page_id string, beam_idx int, staff_index int, x0 int, y0 int, x1 int, y1 int, level int")
    kept = detect.beams_with_stems(beams, more)
    assert [(r.beam_idx, r.stems) for r in kept.collect()] == [(0, [0, 70])]
    assert [(r.symbol_idx, r.flag_count) for r in detect.flags(attached, kept).collect()] == [(0, 1)]


def test_masks(spark):
    mask = np.zeros((40, 60), dtype=np.uint8)
    mask[5:8, 5:9], mask[20:24, 30:33], mask[0, 0] = 2, 9, 2
    rows = spark.createDataFrame([("p", 60, 40, bytearray(mask.tobytes()))], "page_id string, width int, height int, mask binary")
    got = sorted((r.symbol_id, r.area, r.x0, r.y0, r.x1, r.y1) for r in detect.mask_instances(rows).collect())
    assert got == [("seg_notehead_filled_000000", 12, 5, 5, 9, 8), ("seg_rest_000001", 12, 30, 20, 33, 24)]
    counts = {r.class_name: r.pixels for r in detect.class_counts(rows).collect()}
    assert (counts["notehead_filled"], counts["rest"], counts["beam"], len(counts)) == (13, 12, 0, 16)
