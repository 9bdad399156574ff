"""Evidence, decoders and the sequential operators, against plain loops."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessitura.operators import decode, joins, select, sequence


def evidence(spark, rows):
    return spark.createDataFrame(rows, "measure_id int, symbol_id string, x double, is_filled boolean, has_stem boolean, flag_count int, dot_count int, is_rest boolean")


def test_primary_hypotheses(spark):
    rows = [(1, "a", 0.0, False, False, 0, 0, False), (1, "b", 1.0, False, True, 0, 0, False), (1, "c", 2.0, True, True, 0, 0, False), (1, "d", 3.0, True, True, 1, 0, False), (1, "e", 4.0, True, True, 2, 0, False), (1, "f", 5.0, True, True, 0, 1, False)]
    found = decode.duration_hypotheses(evidence(spark, rows)).where("hyp_idx = 0").collect()
    assert {r.symbol_id: r.ticks for r in found} == {"a": 1920, "b": 960, "c": 480, "d": 240, "e": 120, "f": 720}


def test_measure_is_filled(spark):
    rows = [(1, x, float(i), True, True, 0, 0, False) for i, x in enumerate("abcd")] + [(2, "lone", 0.0, True, True, 0, 0, False)]
    found = {r.measure_id: r for r in decode.decode_measures(evidence(spark, rows), ["measure_id"], F.lit(4), F.lit(4)).collect()}
    assert found[1].valid and [s.symbol_id for s in found[1].selected] == list("abcd") and found[1].rejected == []
    assert not found[2].valid and found[2].diagnostics == ["underfull: 480/1920 ticks"]


def test_best_path_is_best():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 5)
        ticks = [[rng.choice((120, 240, 480, 960)) for _ in range(rng.randint(1, 3))] for _ in range(n)]
        scores = [[round(-rng.random(), 3) for _ in t] for t in ticks]
        expected = 960

        def every(i, at, score):
            if i == n:
                return score + (decode.UNDERFULL_COST * (expected - at) / expected if at != expected else 0)
            options = [every(i + 1, at, score - 2.0)]
            options += [every(i + 1, at + t, score + v * t / 480) for t, v in zip(ticks[i], scores[i], strict=True) if at + t <= expected]
            return max(options)

        score, reached, choice = decode.best_path(ticks, scores, [-2.0] * n, expected)
        total = score + (decode.UNDERFULL_COST * (expected - reached) / expected if reached != expected else 0)
        assert abs(total - every(0, 0, 0.0)) < 1e-9
        assert sum(ticks[i][k] for i, k in enumerate(choice) if k >= 0) == reached


def test_alignment(spark):
    offered = spark.createDataFrame([(1, "a", 0.0, [480]), (1, "x", 5.0, [120]), (1, "b", 10.0, [960]), (1, "y", 15.0, [60]), (1, "c", 30.0, [480]), (2, "only", 0.0, [480])], "g int, symbol_id string, x double, ticks array<int>").withColumn("scores", F.array(F.lit(-0.1)))
    wanted = spark.createDataFrame([(1, 0.0, 480), (1, 1.0, 960), (1, 2.0, 480), (2, 0.0, 480), (2, 1.0, 480)], "g int, x double, target int")
    found = {r.g: r for r in decode.align_sequences(offered, wanted, ["g"]).collect()}
    assert found[1].selected == ["a", "b", "c"] and found[1].valid
    assert not found[2].valid and found[2].diagnostic == "candidate shortfall: 1 < 2"


def test_top_k_repair(spark):
    rows = [("p", i, c, 3) for i, c in enumerate((0.91, 0.84, 0.62, 0.58))] + [("q", 0, 0.9, 2)]
    got = select.top_k_repair(spark.createDataFrame(rows, "page string, i int, c double, target int"), ["page"], "c", "i", threshold=0.8, target="target").collect()
    assert sorted((r.page, r.i, r["mode"]) for r in got) == [("p", 0, "top_k"), ("p", 1, "top_k"), ("p", 2, "top_k"), ("q", 0, "infeasible")]


def test_upsert_keeps_the_better(spark):
    df = spark.createDataFrame([(1, 0, 10.0, 0.5), (1, 1, 11.0, 0.9), (1, 2, 30.0, 0.4), (1, 3, 31.0, 0.1)], "page int, i int, x double, c double")
    got = joins.merge_upsert(df, ["page"], ["i"], same=lambda a, b: abs(a["x"] - b["x"]) <= 3, better="c").collect()
    assert sorted(r.i for r in got) == [1, 2]


def test_states_equal_a_loop(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(60):
        open_items, depth = set(), 0
        for i in range(12):
            item, kinds, slur = rng.choice("ab"), rng.choice([(), ("start",), ("stop",), ("start", "stop"), ("continue",), ("continue", "start")]), rng.choice([1, 0, -1])
            code = None
            if "continue" in kinds:
                code = "INVALID" if len(kinds) > 1 else None if item in open_items else "CONTINUE_WITHOUT_START"
            else:
                if "stop" in kinds and item not in open_items:
                    code = "STOP_PITCH_MISMATCH" if open_items else "STOP_WITHOUT_START"
                open_items -= {item} if "stop" in kinds else set()
                if "start" in kinds:
                    code = code or ("START_WHILE_OPEN" if item in open_items else None)
                    open_items.add(item)
            unopened = slur <= 0 and depth <= 0
            depth = max(0, depth + slur)
            rows.append((g, i, item, list(kinds), slur))
            want[g, i] = (code, depth, unopened)
    df = spark.createDataFrame(rows, "g int, i int, item string, kinds array<string>, slur int")
    has = lambda k: F.array_contains("kinds", k)
    state = sequence.set_state(df, ["g"], ["item"], ["i"], has("start"), has("stop"), has("continue"))
    got = sequence.bracket_depth(state, ["g"], ["i"], F.col("slur")).collect()
    assert {(r.g, r.i): (r.code, r.depth, r.unopened) for r in got} == want


def test_components(spark):
    cells = spark.createDataFrame([(1, x, y) for x, y in ((0, 0), (1, 1), (5, 5), (6, 5), (0, 3))], "page int, x int, y int")
    got = decode.grid_components(cells, ["page"], "x", "y").orderBy("component").collect()
    assert [(r.area, r.x0, r.y0, r.x1, r.y1) for r in got] == [(2, 0, 0, 1, 1), (1, 0, 3, 0, 3), (2, 5, 5, 6, 5)]
    assert decode.grid_components(cells, ["page"], "x", "y", connectivity=4).count() == 4
