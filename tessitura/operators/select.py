"""Filters, triage, numbering and top-k."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def triage(score: Column, positive: float, uncertain: float) -> Column:
    """``positive`` from the upper threshold, ``uncertain`` from the lower, else ``reject``; null for a null score."""
    return F.when(score >= positive, "positive").when(score >= uncertain, "uncertain").when(score.isNotNull(), "reject")


def size_window(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Rows whose named columns all lie in their closed ranges."""
    for name, (low, high) in bounds.items():
        df = df.where(F.col(name).between(low, high))
    return df


def near_median(df: DataFrame, keys: Sequence[str], value: str, *, low: float = 0.35, high: float = 1.65, least: int = 5) -> DataFrame:
    """Keeps values from ``low`` to ``high`` medians of their group, in groups of ``least`` rows or more; smaller groups stay whole.

    The median comes from an aggregation, so that no group is sorted in a window.
    """
    stats = df.groupBy(*keys).agg(F.median(value).alias("_median"), F.count(value).alias("_n"))
    near = F.col(value).between(F.col("_median") * low, F.col("_median") * high)
    return df.join(stats, list(keys)).where((F.col("_n") < least) | near).drop("_median", "_n")


def not_isolated(df: DataFrame, keys: Sequence[str], position: Column, order: Sequence[str], *, factor: float = 2.0, least: int = 5) -> DataFrame:
    """Keeps rows with a neighbour within ``factor`` median gaps; groups in which fewer than ``least`` would survive stay whole."""
    w = Window.partitionBy(*keys).orderBy(*order)
    gaps = df.withColumn("_back", position - F.lag(position).over(w)).withColumn("_ahead", F.lead(position).over(w) - position)
    median = gaps.groupBy(*keys).agg(F.median("_back").alias("_median"))
    near = F.coalesce(F.col("_back") <= F.col("_median") * factor, F.lit(False)) | F.coalesce(F.col("_ahead") <= F.col("_median") * factor, F.lit(False))
    flagged = gaps.join(median, list(keys)).withColumn("_near", near)
    survivors = F.sum(F.col("_near").cast("int")).over(Window.partitionBy(*keys))
    return flagged.withColumn("_left", survivors).where(F.col("_near") | (F.col("_left") < least)).drop("_back", "_ahead", "_median", "_near", "_left")


def numbered_spans(df: DataFrame, keys: Sequence[str], position: Column, order: Sequence[str], *, least: float) -> DataFrame:
    """Spans between consecutive rows, numbered from 1 before those shorter than ``least`` go: numbers keep the gaps."""
    w = Window.partitionBy(*keys).orderBy(*order)
    spans = df.withColumn("span_number", F.row_number().over(w)).withColumn("span", F.lead(position).over(w) - position)
    return spans.where(F.col("span") >= least)


def top_k_repair(df: DataFrame, keys: Sequence[str], score: str, index: str, *, threshold: float, target: str) -> DataFrame:
    """Chooses rows of each group so that ``target`` (a column constant in the group) of them remain.

    If the rows at or above ``threshold`` are as many, they stay (``threshold``); else the ``target`` best by (score down, index) stay
    (``top_k``), or all of them if there are fewer (``infeasible``). Adds ``mode`` and drops the others.
    """
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(F.col(score).desc(), index))
    above = F.sum((F.col(score) >= threshold).cast("int")).over(w)
    ranked = df.withColumn("_rank", rank).withColumn("_above", above).withColumn("_all", F.count("*").over(w))
    mode = F.when(F.col("_above") == F.col(target), "threshold").when(F.col("_all") < F.col(target), "infeasible").otherwise("top_k")
    # the rows above the threshold are the first ones in rank, so one condition serves all modes
    return ranked.withColumn("mode", mode).where(F.col("_rank") <= F.col(target)).drop("_rank", "_above", "_all")


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their ``rank``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def best_row(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """The one row that comes first in ``order``."""
    return df.orderBy(*order).limit(1)


def hash_split(df: DataFrame, name: str, fraction: float) -> DataFrame:
    """Adds ``is_validation``: the share ``fraction`` of rows whose names have the smallest SHA-256, at least one and never all.

    The count is rounded half to even. The boundary is one digest, found by a top-k, so no task sorts the whole table.
    """
    digest = F.sha2(F.col(name).cast("binary"), 256)
    n = df.count()
    take = 0 if n < 2 else min(n - 1, max(1, round(n * fraction)))
    if not take:
        return df.withColumn("is_validation", F.lit(False))
    last = df.select(digest.alias("d")).orderBy("d").limit(take).agg(F.max("d")).first()[0]
    return df.withColumn("is_validation", digest <= last)


def at_least(df: DataFrame, value: str, klass: str | None, minimums: Mapping[object, float], default: float) -> DataFrame:
    """Rows whose value reaches the minimum of their class, or ``default``."""
    least = F.lit(default)
    for name, low in minimums.items() if klass else ():
        least = F.when(F.col(klass) == name, F.lit(low)).otherwise(least)
    return df.where(F.col(value) >= least)


def having(df: DataFrame, keys: Sequence[str], condition: Column, *, least: int = 1) -> DataFrame:
    """The rows of groups in which ``least`` rows or more satisfy ``condition``."""
    return df.join(df.groupBy(*keys).agg(F.count_if(condition).alias("_n")).where(F.col("_n") >= least).drop("_n"), list(keys), "left_semi")


def contains_text(df: DataFrame, needle: str, columns: Sequence[str]) -> DataFrame:
    """Rows whose columns, joined by spaces, hold ``needle``, whatever its case; an empty one keeps all."""
    wanted = needle.strip().lower()
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(wanted))) if wanted else df


def rescue(base: DataFrame, more: DataFrame, groups: DataFrame, keys: Sequence[str], *, few: float, growth: float = 1.5) -> DataFrame:
    """For each group its ``base`` rows, or those of ``more`` where the base is scarce and more are not out of all proportion.

    Scarce: fewer rows than ``few`` a unit of the group's ``size``; proportion: at most ``growth`` times, rounded half to even.
    """
    n = base.groupBy(*keys).agg(F.count("*").alias("_n"))
    m = more.groupBy(*keys).agg(F.count("*").alias("_m"))
    counted = groups.join(n, list(keys), "left").join(m, list(keys), "left").fillna(0, ["_n", "_m"])
    better = (F.col("_n") < few * F.col("size")) & (F.col("_m") > F.col("_n")) & (F.col("_m") <= F.bround(F.col("_n") * growth, 0))
    chosen = counted.select(*keys, better.alias("rescued"))
    return base.join(chosen.where("not rescued"), list(keys)).unionByName(more.join(chosen.where("rescued"), list(keys)))


def accepted_bars(clusters: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """(keys, x, weak) of the bars that groups of close clusters (x, width, side, relative) stand for.

    Of several clusters the rightmost counts. One alone counts if it is wide and clean at its sides; if it is narrower, cleaner and not at
    the front, it counts as weak.
    """
    width, side = F.col("c.width"), F.col("c.side")
    one = clusters.groupBy(*keys, group).agg(F.count("*").alias("n"), F.max(F.struct("x", "width", "side", "relative")).alias("c"))
    strong = (F.col("n") > 1) | ((width >= 4) & (side <= 0.25))
    weak = (width >= 3) & (side <= 0.05) & (F.col("c.relative") >= 0.28)
    return one.where(strong | weak).select(*keys, F.col("c.x").alias("x"), (~strong).alias("weak"))


def best_per(df: DataFrame, keys: Sequence[str], score: Column, tie: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Of each group the row of highest score, of equal ones the first by ``tie``: a partial aggregation over a struct."""
    best = df.groupBy(*keys).agg(F.min(F.struct((-score).alias("_s"), *tie, *(c for c in columns if c not in tie))).alias("_b"))
    return best.select(*keys, *(F.col(f"_b.{c}").alias(c) for c in columns))


def first_of_equal(df: DataFrame, same: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows equal in ``same`` the first."""
    place = F.row_number().over(Window.partitionBy(*same).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def ordered(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, object] | str], out: str = "position") -> DataFrame:
    """Numbers rows from 0 by ``order``; a pair names a column and what stands for its nulls."""
    by = [F.coalesce(o[0], F.lit(o[1])) if isinstance(o, tuple) else F.col(o) for o in order]
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) - 1)
