"""The duration lattice, decoders over it, and operators that compare or complete relations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rule, note type, ticks, visual score; the first of a rule is its primary hypothesis.
RULES = (
    ("rest", "quarter", 480, -0.5), ("rest", "eighth", 240, -1.0), ("rest", "half", 960, -1.0), ("rest", "whole", 1920, -1.5), ("rest", "16th", 120, -1.5),
    ("open_stem", "half", 960, -0.1), ("open_stem", "quarter", 480, -1.8), ("open_stem", "whole", 1920, -2.5),
    ("open", "whole", 1920, -0.2), ("open", "half", 960, -3.0),
    ("filled_stem_0", "quarter", 480, -0.1), ("filled_stem_0", "eighth", 240, -0.5),
    ("filled_stem_1", "eighth", 240, -0.1), ("filled_stem_1", "quarter", 480, -0.8), ("filled_stem_1", "16th", 120, -1.1),
    ("filled_stem_2", "16th", 120, -0.1), ("filled_stem_2", "eighth", 240, -0.7), ("filled_stem_2", "quarter", 480, -1.2),
    ("filled_stem_3", "32nd", 60, -0.1), ("filled_stem_3", "16th", 120, -1.0),
    ("filled", "quarter", 480, -0.7), ("filled", "eighth", 240, -1.2), ("filled", "half", 960, -2.0),
)
DOTTED_BONUS, UNDOTTED_COST, SKIP_COST, SMALL_SKIP_COST, SMALL_AREA, UNDERFULL_COST = 0.35, 1.20, -2.0, -0.8, 50, -100.0


def rule_of(filled: Column, stem: Column, flags: Column, rest: Column) -> Column:
    by_flags = F.concat(F.lit("filled_stem_"), F.greatest(F.lit(0), F.least(flags, F.lit(3))).cast("string"))
    return F.when(rest, "rest").when(~filled, F.when(stem, "open_stem").otherwise("open")).when(stem, by_flags).otherwise("filled")


def duration_hypotheses(symbols: DataFrame) -> DataFrame:
    """Each symbol (is_filled, has_stem, flag_count, dot_count, is_rest) with its hypotheses: rule, hyp_idx, note_type, dots, ticks, visual_score.

    With augmentation dots the dotted forms come first and score more; the undotted ones stay as costly fallbacks. A broadcast join with a
    table of fixed size, and an explode of two.
    """
    spark = symbols.sparkSession
    place: dict[str, int] = {}
    rows = []
    for rule, kind, n, score in RULES:
        rows.append((rule, place.get(rule, 0), kind, n, score))
        place[rule] = place.get(rule, 0) + 1
    table = F.broadcast(spark.createDataFrame(rows, "rule string, i int, note_type string, base int, score double"))
    dots = F.greatest(F.lit(0), F.least(F.col("dot_count"), F.lit(2))).cast("int")
    joined = symbols.withColumn("rule", rule_of(F.col("is_filled"), F.col("has_stem"), F.col("flag_count"), F.col("is_rest"))).withColumn("_dots", dots).join(table, "rule")
    plain = lambda cost, at: F.struct(at.alias("hyp_idx"), F.lit(0).alias("dots"), F.col("base").alias("ticks"), (F.col("score") - cost).alias("visual_score"))
    half, quarter = F.floor(F.col("base") / 2).cast("int"), F.floor(F.col("base") / 4).cast("int")
    long = F.col("base") + half + F.when(F.col("_dots") == 2, quarter).otherwise(F.lit(0))
    dotted = F.struct(F.col("i").alias("hyp_idx"), F.col("_dots").alias("dots"), long.alias("ticks"), (F.col("score") + DOTTED_BONUS).alias("visual_score"))
    options = F.when(F.col("_dots") > 0, F.array(dotted, plain(UNDOTTED_COST, F.col("i") + 100))).otherwise(F.array(plain(0.0, F.col("i"))))
    return joined.withColumn("_h", F.explode(options)).select(*symbols.columns, "rule", "note_type", "_h.*")


def best_path(ticks: list[list[int]], scores: list[list[float]], skips: list[float], expected: int, beam: int = 256) -> tuple[float, int, list[int]]:
    """(score, total ticks, choice of each symbol or -1): the best way to fill a measure with one hypothesis of each symbol or none.

    A dynamic programme over the symbols; a state is the ticks filled so far and keeps its best score, as arrays with links back. Skips cost
    ``skips``; a hypothesis scores in proportion to its quarters; what is missing at the end costs in proportion to the measure.
    """
    best = {0: 0.0}
    back: list[dict[int, tuple[int, int]]] = []
    for own, value, skip in zip(ticks, scores, skips, strict=True):
        after: dict[int, float] = {}
        link: dict[int, tuple[int, int]] = {}
        for at, score in best.items():
            options = [(at, score + skip, -1)] + [(at + t, score + v * (t / 480.0), k) for k, (t, v) in enumerate(zip(own, value, strict=True)) if at + t <= expected]
            for to, total, k in options:
                if to not in after or total > after[to]:
                    after[to], link[to] = total, (at, k)
        if len(after) > beam:
            keep = sorted(after.items(), key=lambda x: x[1], reverse=True)[:beam]
            after = dict(keep)
        best = after
        back.append(link)
    final, reached = -np.inf, 0
    for at, score in best.items():
        total = score + (UNDERFULL_COST * (expected - at) / expected if at != expected else 0.0)
        if total > final or (total == final and at == expected):
            final, reached = total, at
    choice, at = [], reached
    for link in reversed(back):
        at, k = link[at]
        choice.append(k)
    return best[reached], reached, choice[::-1]


DECODED = "expected_ticks int, total_ticks int, total_score double, valid boolean, selected array<struct<symbol_id:string,ticks:int,note_type:string,dots:int,score:double>>, rejected array<string>, diagnostics array<string>"
DECODED_ARROW = pa.schema([("expected_ticks", pa.int32()), ("total_ticks", pa.int32()), ("total_score", pa.float64()), ("valid", pa.bool_()), ("selected", pa.list_(pa.struct([("symbol_id", pa.string()), ("ticks", pa.int32()), ("note_type", pa.string()), ("dots", pa.int32()), ("score", pa.float64())]))), ("rejected", pa.list_(pa.string())), ("diagnostics", pa.list_(pa.string()))])


def decode_measures(symbols: DataFrame, keys: Sequence[str], beats: Column, beat_type: Column, *, beam: int = 256) -> DataFrame:
    """One row for each measure (``keys``): which hypothesis of which symbol fills it best.

    ``symbols``: keys, symbol_id, x and the evidence columns of ``duration_hypotheses``; optional ``skip_score`` and ``area``. Flagged
    symbols are taken first, then from left to right. Measures are independent: each becomes one row, and Arrow batches of them are decoded.
    """
    skip = F.col("skip_score") if "skip_score" in symbols.columns else F.when(F.col("area") < SMALL_AREA, SMALL_SKIP_COST).otherwise(SKIP_COST) if "area" in symbols.columns else F.lit(SKIP_COST)
    tagged = symbols.withColumn("_skip", skip.cast("double")).withColumn("_expected", F.floor(beats * 1920 / beat_type).cast("int"))
    first = F.when(F.col("flag_count") > 0, -1000 * F.col("flag_count")).otherwise(F.lit(0))
    hypothesis = F.struct(first.alias("p"), "x", "symbol_id", "hyp_idx", "ticks", "note_type", "dots", "visual_score", F.col("_skip").alias("skip"))
    measures = duration_hypotheses(tagged).groupBy(*keys).agg(F.max("_expected").alias("_expected"), F.array_sort(F.collect_list(hypothesis)).alias("_h"))

    def decode(batches):
        for batch in batches:
            rows = []
            for expected, listed in zip(batch.column("_expected").to_pylist(), batch.column("_h").to_pylist(), strict=True):
                names, options, skips = [], [], []
                for h in listed:
                    if not h["hyp_idx"]:
                        names.append(h["symbol_id"])
                        skips.append(h["skip"])
                        options.append([])
                    options[-1].append(h)
                score, reached, choice = best_path([[h["ticks"] for h in x] for x in options], [[h["visual_score"] for h in x] for x in options], skips, expected, beam)
                taken = [(names[i], options[i][k]) for i, k in enumerate(choice) if k >= 0]
                rows.append({
                    "expected_ticks": expected, "total_ticks": reached, "total_score": score, "valid": reached == expected,
                    "selected": [{"symbol_id": n, "ticks": h["ticks"], "note_type": h["note_type"], "dots": h["dots"], "score": h["visual_score"]} for n, h in taken],
                    "rejected": [names[i] for i, k in enumerate(choice) if k < 0], "diagnostics": [] if reached == expected else [f"underfull: {reached}/{expected} ticks"],
                })
            made = pa.Table.from_pylist(rows, schema=DECODED_ARROW).combine_chunks().to_batches()
            if made:
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *made[0].columns], names=[*keys, *DECODED_ARROW.names])

    fields = ", ".join(f"`{k}` {symbols.schema[k].dataType.simpleString()}" for k in keys)
    return measures.mapInArrow(decode, f"{fields}, {DECODED}")


def align(x: np.ndarray, offered: list[dict[int, float]], rest: np.ndarray, target: Sequence[int], expected: int) -> tuple[float, list[int]]:
    """(score, positions): one symbol for each target duration, from left to right; ``x`` ascending.

    A symbol scores what it offers for the target (-0.75 if it does not offer it), less its distance from the target's onset; ties go to
    the symbol further left.
    """
    onset = np.concatenate([[0], np.cumsum(target)[:-1]]) / expected if expected > 0 else np.zeros(len(target))
    where = (x - x[0]) / max(1.0, x[-1] - x[0])
    own = np.array([[o.get(t, -0.75) for o in offered] for t in target]) - 0.2 * np.abs(where[None, :] - onset[:, None]) + 0.15 * rest[None, :]
    gap = x[None, :] - x[:, None]
    step = np.where(gap <= 0, -1000.0, np.where(gap < 2.0, -4.0, 0.0))
    n, m = len(x), len(target)
    # a symbol can serve a target only if enough symbols lie on either side
    open_to = lambda t: (np.arange(n) >= t) & (n - np.arange(n) - 1 >= m - t - 1)
    best, links = np.where(open_to(0), own[0], -np.inf), []
    for t in range(1, m):
        total = np.where(np.triu(np.ones((n, n), dtype=bool), 1), best[:, None] + step, -np.inf)
        links.append(np.argmax(total, axis=0))
        best = np.where(open_to(t), total.max(axis=0) + own[t], -np.inf)
    at = int(np.argmax(best))
    score, path = float(best[at]), [at]
    for link in reversed(links):
        path.append(int(link[path[-1]]))
    return score, path[::-1]


def align_sequences(offered: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each group the symbols that a known sequence of durations would choose.

    ``offered``: keys, symbol_id, x, ticks (array of hypotheses), optional scores (array), is_rest; ``wanted``: keys, x (their order), target.
    """

    def pick(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        side = left if len(left) else right
        row: dict = {k: side[k].iloc[0] for k in keys}
        target = [int(t) for t in right.sort_values("x", kind="stable")["target"]] if len(right) else []
        left = left.sort_values(["x", "symbol_id"], kind="stable")
        if not target:
            return pd.DataFrame([row | {"selected": [], "total_score": 0.0, "valid": True, "diagnostic": ""}])
        if len(left) < len(target):
            return pd.DataFrame([row | {"selected": [], "total_score": None, "valid": False, "diagnostic": f"candidate shortfall: {len(left)} < {len(target)}"}])
        values = [list(s) for s in left["scores"]] if "scores" in left else [[0.0] * len(t) for t in left["ticks"]]
        options: list[dict[int, float]] = []
        for t, v in zip(left["ticks"], values, strict=True):
            best: dict[int, float] = {}
            for a, b in zip(t, v, strict=True):
                best[int(a)] = max(b, best.get(int(a), -np.inf))
            options.append(best)
        rest = left["is_rest"].to_numpy(dtype=float) if "is_rest" in left else np.zeros(len(left))
        score, path = align(left["x"].to_numpy(dtype=float), options, rest, target, sum(target))
        names = left["symbol_id"].tolist()
        return pd.DataFrame([row | {"selected": [names[i] for i in path], "total_score": score, "valid": True, "diagnostic": ""}])

    fields = ", ".join(f"`{k}` {offered.schema[k].dataType.simpleString()}" for k in keys)
    return offered.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(pick, f"{fields}, selected array<string>, total_score double, valid boolean, diagnostic string")


def threshold_counts(df: DataFrame, keys: Sequence[str], score: Column, grid: Sequence[float]) -> DataFrame:
    """(keys, step, n): how many rows of each group reach ``grid[step]``, zeros included; ``grid`` ascends.

    Each row is counted once, at the highest threshold it reaches; counts below follow by summing within the group.
    """
    reached = F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: t <= score))
    counts = df.groupBy(*keys, reached.alias("reached")).agg(F.count("*").alias("c")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("reached", "c"))).alias("m"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(len(grid) - 1)), lambda s: F.struct(s.alias("step"), F.aggregate(F.map_entries("m"), F.lit(0).cast("long"), lambda a, e: a + F.when(e["key"] > s, e["value"]).otherwise(F.lit(0))).alias("n")))
    return counts.select(*keys, F.inline(steps))


def structural_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, as multisets, with their ``side``; empty if both are equal."""
    only = lambda a, b, side: a.exceptAll(b).select(F.lit(side).alias("side"), *a.columns)
    return only(left, right, "left").unionByName(only(right, left, "right"))


def union_offset(first: DataFrame, second: DataFrame, index: str) -> DataFrame:
    """Both sides, the second one's indices moved behind the first one's; the offset is one row."""
    offset = F.broadcast(first.agg((F.coalesce(F.max(index), F.lit(-1)) + 1).alias("_offset")))
    return first.unionByName(second.crossJoin(offset).withColumn(index, F.col(index) + F.col("_offset")).drop("_offset"))


def gap_fill(rows: DataFrame, groups: DataFrame, keys: Sequence[str], amount: str, expected: str, *, digits: int) -> DataFrame:
    """The rows (kind ``line``), and for each group whose sum stays below what is expected one more (``fill``) with the rest."""
    sums = rows.groupBy(*keys).agg(F.sum(amount).alias("_sum"))
    rest = groups.join(sums, list(keys), "left").withColumn(amount, F.round(F.col(expected) - F.coalesce("_sum", F.lit(0.0)), digits)).where(F.col(amount) > 0)
    return rows.select(*keys, F.lit("line").alias("kind"), F.round(amount, digits).alias(amount)).unionByName(rest.select(*keys, F.lit("fill").alias("kind"), amount))


def label_grid(x: np.ndarray, y: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """The component of each cell, numbered by its first cell in raster order."""
    order = np.lexsort((x, y))
    place = {(int(y[i]), int(x[i])): i for i in order}
    parent = list(range(len(x)))

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    around = [(0, -1), (-1, 0)] + ([(-1, -1), (-1, 1)] if connectivity == 8 else [])
    for (row, column), i in place.items():
        for dy, dx in around:
            j = place.get((row + dy, column + dx))
            if j is not None and root(i) != root(j):
                parent[root(i)] = root(j)
    numbers: dict[int, int] = {}
    out = np.zeros(len(x), dtype=np.int64)
    for i in order:
        out[i] = numbers.setdefault(root(int(i)), len(numbers))
    return out


def grid_components(cells: DataFrame, keys: Sequence[str], x: str, y: str, *, connectivity: int = 8) -> DataFrame:
    """One row for each connected component of the cells of a group: component, area, cx, cy and its box, bounds inclusive."""

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(component=label_grid(frame[x].to_numpy(), frame[y].to_numpy(), connectivity))
        by = frame.groupby("component", sort=True)
        out = by.agg(area=(x, "size"), cx=(x, "mean"), cy=(y, "mean"), x0=(x, "min"), y0=(y, "min"), x1=(x, "max"), y1=(y, "max")).reset_index()
        for k in keys:
            out[k] = frame[k].iloc[0]
        return out[[*keys, "component", "area", "cx", "cy", "x0", "y0", "x1", "y1"]]

    fields = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys)
    return cells.groupBy(*keys).applyInPandas(label, f"{fields}, component long, area long, cx double, cy double, x0 int, y0 int, x1 int, y1 int")


#: Scores by which a lone symbol, a rest alone and a rest beside notes fill a measure.
LONE_FILL, REST_FILL, REST_BESIDE_NOTES = 0.4, 1.5, -2.0


def context_hypotheses(symbols: DataFrame, keys: Sequence[str], expected: Column) -> DataFrame:
    """One more hypothesis for symbols (is_rest, known) that may fill their measure: a lone symbol, or any rest.

    ``known``: whether a hypothesis of that length is there already; these get none. Adds ticks, visual_score and evidence.
    """
    counts = symbols.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(~F.col("is_rest")).alias("_notes"))
    met = symbols.join(counts, list(keys)).where(~F.col("known") & ((F.col("_n") == 1) | F.col("is_rest")))
    score = F.when(F.col("_n") == 1, LONE_FILL).when(F.col("_notes") == 0, REST_FILL).otherwise(REST_BESIDE_NOTES)
    name = F.when(F.col("_n") == 1, "single_symbol_measure_fill").otherwise("full_measure_rest_context")
    return met.withColumns({"ticks": expected.cast("int"), "visual_score": score, "evidence": name}).drop("_n", "_notes")
