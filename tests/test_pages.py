"""Pages, assembly, policies, streams and the command line on small inputs."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura import cli
from tessitura.plans import assembly, policy
from tessitura.streaming import events as streams
from tessitura.vision import pages, pixels


def page(spark, gray, name="p"):
    h, w = gray.shape
    return spark.createDataFrame([(name, w, h, 1, bytearray(gray.astype(np.uint8).tobytes()))], "page_id string, width int, height int, channels int, data binary")


def staff() -> np.ndarray:
    gray = np.full((140, 200), 255)
    for top in (20, 90):
        for k in range(5):
            gray[top + 8 * k, 5:195] = 0
    gray[33:40, 50:58] = 0
    return gray


def test_components_equal_flood_fill():
    rng = np.random.default_rng(2)
    for connectivity in (4, 8):
        for _ in range(30):
            ink = (rng.random((12, 15)) < 0.45).astype(np.uint8)
            seen, want = np.zeros_like(ink), []
            for y, x in zip(*np.nonzero(ink), strict=True):
                if seen[y, x]:
                    continue
                stack, cells = [(y, x)], []
                seen[y, x] = 1
                while stack:
                    a, b = stack.pop()
                    cells.append((a, b))
                    for da in (-1, 0, 1):
                        for db in (-1, 0, 1):
                            if (connectivity == 8 or 0 in (da, db)) and 0 <= a + da < 12 and 0 <= b + db < 15 and ink[a + da, b + db] and not seen[a + da, b + db]:
                                seen[a + da, b + db] = 1
                                stack.append((a + da, b + db))
                ys, xs = zip(*cells, strict=True)
                want.append((len(cells), min(xs), min(ys), max(xs), max(ys)))
            assert [(c[0], *c[3:]) for c in pixels.components(ink, connectivity)] == want


def test_binarisation():
    gray = staff()
    assert (pixels.ink_otsu(gray) == (gray == 0)).all() and (pixels.ink_otsu(255 - gray) == (gray == 0)).all()
    assert pixels.ink_sauvola(gray)[36, 54] == 1 and pixels.ink_sauvola(gray)[5, 100] == 0


def test_staff_and_candidates(spark):
    image = page(spark, staff())
    bands = pages.staff_bands(pages.staff_lines(pages.row_profiles(image)))
    rows = bands.orderBy("staff_index").collect()
    assert [r.line_ys for r in rows] == [[20.0, 28.0, 36.0, 44.0, 52.0], [90.0, 98.0, 106.0, 114.0, 122.0]] and rows[0].interline_px == 8.0
    head = spark.createDataFrame([("p", 0, 56, 53.5, 36.0, 50, 33, 57, 39)], pages.COMPONENT)
    got = pages.candidates(head, bands).first()
    assert (got.staff_index, got.staff_step) == (0, 4.0)
    assert pages.page_components(image, method="otsu").count() > 0


def test_measures_of_a_page(spark):
    members = spark.createDataFrame([("p", 0, 0), ("p", 1, 0)], "page_id string, staff_index int, system_index int")
    bars = spark.createDataFrame([("p", 0, 100.0), ("p", 1, 103.0), ("p", 0, 205.0)], "page_id string, staff_index int, x double")
    merged = assembly.system_barlines(bars, members, 4.0)
    extents = spark.createDataFrame([("p", 0, 0.0, 210.0)], "page_id string, system_index int, x_left double, x_right double")
    bounds = assembly.measure_boundaries(merged, extents)
    assert [(r.measure_number, r.x_start, r.x_end, r.measure_id) for r in bounds.orderBy("measure_number").collect()] == [(1, 0.0, 101.5, "s0_m1"), (2, 101.5, 205.0, "s0_m2")]
    symbols = spark.createDataFrame([("p", i, "notehead", x, 0, 80.0, True, 0.0, 0.9) for i, x in enumerate((10.0, 30.0, 50.0, 70.0, 101.5, 300.0))], "page_id string, symbol_idx int, kind string, cx double, staff_index int, area double, is_filled boolean, staff_step double, confidence double")
    placed = assembly.symbols_in_measures(symbols, members, bounds)
    assert {r.symbol_idx: r.measure_number for r in placed.collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2}
    evidence = symbols.select("page_id", "symbol_idx", F.lit(True).alias("has_stem"), F.lit(0).alias("flag_count"), F.lit(0).alias("dot_count"))
    done = {r.measure_id: r for r in assembly.decode_pages(assembly.measure_evidence(placed, evidence), 4, 4).collect()}
    assert done["s0_m1"].valid and not done["s0_m2"].valid
    strict = assembly.measure_evidence(placed, evidence, threshold=0.8).first()
    assert strict.skip_score == pytest.approx(-1.75)
    bands = spark.createDataFrame([("p", 0, "F", 4)], "page_id string, staff_index int, clef_sign string, clef_line int")
    accidentals = spark.createDataFrame([("p", 0, 1)], "page_id string, symbol_idx int, alter int")
    got = assembly.pitched(symbols, bands, accidentals).where("symbol_idx = 0").first()
    assert (got.step, got.octave, got.alter) == ("G", 2, 1)
    voices = assembly.voices_by_stem(symbols.withColumn("direction", F.when(F.col("symbol_idx") == 1, "down").when(F.col("symbol_idx") == 4, "up")))
    assert {r.symbol_idx: r.voice for r in voices.collect()} == {0: 2, 1: 2, 2: 2, 3: 1, 4: 1, 5: 1}
    filled = assembly.fill_measures(spark.createDataFrame([("p", "a", 480), ("p", "b", 1920)], "page_id string, measure_id string, ticks int"), spark.createDataFrame([("p", "a", 1920), ("p", "b", 1920)], "page_id string, measure_id string, expected_ticks int"))
    assert [(r.measure_id, r.ticks) for r in filled.where("kind = 'fill'").collect()] == [("a", 1440)]


def test_policy(spark):
    assert len(policy.threshold_grid()) == 59
    rng = random.Random(6)
    rows = [(p, i, round(rng.random(), 2)) for p in "abc" for i in range(20)]
    labels = spark.createDataFrame(rows, "page string, index int, confidence double")
    targets = {"a": 4, "b": 7, "c": 2}
    known = spark.createDataFrame(list(targets.items()), "page string, target int")

    def key(t):
        errors = [sum(c >= t for q, _, c in rows if q == p) - n for p, n in targets.items()]
        return (sum(map(abs, errors)) / 3, abs(sum(errors)), -t)

    assert policy.fit_threshold(labels, known, ["page"]).first().threshold == min(policy.threshold_grid(), key=key)
    oracle = policy.evaluate(policy.page_errors(policy.oracle_selection(labels, known, ["page"], 0.8), known, ["page"])).first()
    assert (oracle.exact_count, oracle.mean_abs_error, oracle.infeasible_count) == (3, 0.0, 0)
    none = policy.evaluate(policy.page_errors(policy.select_by_threshold(labels, ["page"], 2.0), known, ["page"])).first()
    assert (none.total_selected, none.total_target, none.infeasible_count) == (0, 13, 3)
    assert policy.triage_page(labels, ["page"]).where("positive + uncertain + reject = 20").count() == 3


def test_compared_measures(spark):
    predicted = spark.createDataFrame([("f", 1, ["half"], 960, 960), ("f", 5, ["quarter."], 720, 960)], "fixture string, measure_idx int, labels array<string>, total_ticks int, expected_ticks int")
    truth = spark.createDataFrame([("f", 1, ["half"]), ("f", 2, ["half"]), ("f", 3, ["half"])], "fixture string, measure_idx int, labels array<string>")
    got = policy.duration_summary(policy.compare_measures(predicted, truth)).first()
    assert (got.exact_pages, got.pages, got.valid_measures, got.measures, got.valid_rate, got.event_delta) == (0, 1, 1, 2, 0.5, 0)
    assert {(r.label, r.n, r.dotted) for r in policy.label_histogram(predicted, F.col("labels")).collect()} == {("half", 1, False), ("quarter.", 1, True)}


def test_stream_clusters(spark, tmp_path):
    base = "2024-01-01 00:"
    rows = [(1, base + "00:00"), (1, base + "10:00"), (1, base + "20:01"), (2, base + "00:00"), (1, base + "05:00"), (3, base + "59:00")]
    spark.createDataFrame(rows, "k int, ts string").select("k", F.to_timestamp("ts").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    spark.createDataFrame([(9, "2024-01-02 00:00:00")], "k int, ts string").select("k", F.to_timestamp("ts").alias("ts")).write.parquet(str(tmp_path / "in" / "2"))
    stream = spark.readStream.schema("k int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    found = streams.gap_clusters(streams.watermarked(stream, "ts", "1 hour"), "k", "ts", 600)
    query = found.writeStream.format("memory").queryName("clusters").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.k, r.n) for r in spark.table("clusters").collect())
    assert got == [(1, 1), (1, 3), (2, 1), (3, 1)]


def test_command_line(spark, tmp_path):
    doc = {"ir_version": "0.1.0", "id": "s", "title": "t", "parts": [{"id": "P1", "name": "p", "measures": [{"id": "m1", "number": 1, "attributes": {"time": {"beats": 4, "beat_type": 4}}, "voices": [{"id": "v1", "events": [{"kind": "rest", "id": "r", "duration": {"numerator": 3, "denominator": 4}, "voice": 1}]}]}]}]}
    good, bad = tmp_path / "a.json", tmp_path / "b.json"
    good.write_text(json.dumps(doc))
    bad.write_text("[1, 2")
    code, body = cli.report(spark, str(good))
    assert code == 1 and body["summary"] == {"total": 1, "errors": 1, "warnings": 0, "info": 0} and body["issues"][0]["related_node_ids"] == ["r"]
    assert cli.report(spark, str(bad))[0] == 2 and cli.convert(spark, str(good), "mei")[0] == 2
    assert "<rest />" in cli.convert(spark, str(good), "musicxml")[1] and json.loads(cli.convert(spark, str(good), "json")[1])["id"] == "s"
    assert not cli.differs(spark, str(good), str(good)) and cli.main(["render", str(good)]) == 2
