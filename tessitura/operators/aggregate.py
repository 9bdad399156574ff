"""Aggregations: robust statistics, votes, histograms and evaluation metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def balance(df: DataFrame, keys: Sequence[str], amount: Column, budget: Column) -> DataFrame:
    """Sum of ``amount`` against the largest ``budget`` of the group: (keys, actual, expected, status OVER, UNDER or OK)."""
    out = df.groupBy(*keys).agg(F.sum(amount).alias("actual"), F.max(budget).alias("expected"))
    return out.withColumn("status", F.when(F.col("actual") > F.col("expected"), "OVER").when(F.col("actual") < F.col("expected"), "UNDER").otherwise("OK"))


def label_counts(df: DataFrame, keys: Sequence[str], label: Column, labels: Sequence[str]) -> DataFrame:
    """One column for each label with its count, zero where it does not occur."""
    return df.groupBy(*keys).agg(*(F.count_if(label == x).alias(x) for x in labels))


def severity_summary(df: DataFrame, keys: Sequence[str], severity: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(severity == "error").alias("errors"), F.count_if(severity == "warning").alias("warnings"), F.count_if(severity == "info").alias("info"),
        F.coalesce(F.bool_or(severity == "error"), F.lit(False)).alias("has_errors"), F.coalesce(F.bool_or(severity == "warning"), F.lit(False)).alias("has_warnings"),
    )


def histogram_zero(df: DataFrame, left: Sequence[str], bins: DataFrame, bin_columns: Sequence[str]) -> DataFrame:
    """Counts for every group and bin, those that do not occur included; ``bins`` is a small dimension."""
    groups = df.select(*left).distinct()
    counts = df.groupBy(*left, *bin_columns).agg(F.count("*").alias("n"))
    return groups.crossJoin(F.broadcast(bins)).join(counts, [*left, *bin_columns], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def mad_threshold(df: DataFrame, keys: Sequence[str], value: str, *, factor: float = 1.5, floor: float = 10.0, least_mad: float = 5.0) -> DataFrame:
    """(keys, median, mad, threshold): ``max(floor, median - factor * max(1.4826 * mad, least_mad))``."""
    middle = df.groupBy(*keys).agg(F.median(value).alias("median"))
    off = df.join(middle, list(keys)).groupBy(*keys).agg(F.first("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return off.withColumn("threshold", F.greatest(F.lit(floor), F.col("median") - F.lit(factor) * F.greatest(F.lit(1.4826) * F.col("mad"), F.lit(least_mad))))


def peaks(df: DataFrame, value: str, *, sigma: float = 1.2) -> DataFrame:
    """The rows at or above the mean plus ``sigma`` population standard deviations, with that ``threshold``."""
    level = df.agg((F.avg(value) + F.lit(sigma) * F.stddev_pop(value)).alias("threshold"))
    return df.crossJoin(F.broadcast(level)).where(F.col(value) >= F.col("threshold"))


def weighted_centroid(df: DataFrame, keys: Sequence[str], values: Mapping[str, str], weight: str) -> DataFrame:
    """Weighted means, ``values`` naming the results."""
    return df.groupBy(*keys).agg(*(((F.sum(F.col(weight) * F.col(c)) / F.sum(weight)).alias(out)) for out, c in values.items()))


def majority_vote(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """(keys, value, votes): the most frequent value, ties to the one seen first in ``order``."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    best = counts.groupBy(*keys).agg(F.min(F.struct(-F.col("n"), "_first", value)).alias("_b"))
    return best.select(*keys, F.col(f"_b.{value}").alias(value), (-F.col("_b.col1")).alias("votes"))


def count_errors(df: DataFrame, predicted: Column, target: Column) -> DataFrame:
    """One row: n, exact, mae, total_predicted, total_target, infeasible (fewer predicted than asked for)."""
    error = predicted - target
    return df.agg(F.count("*").alias("n"), F.count_if(error == 0).alias("exact"), F.avg(F.abs(error)).alias("mae"), F.sum(predicted).alias("total_predicted"), F.sum(target).alias("total_target"), F.count_if(error < 0).alias("infeasible"))


def precision_recall(df: DataFrame, predicted: Column, target: Column) -> DataFrame:
    """Means of per-row precision, recall and F1 with ``min(predicted, target)`` hits; 0 where a ratio is not defined."""
    hits = F.least(predicted, target)
    p = F.when(predicted > 0, hits / predicted).otherwise(F.lit(0.0))
    r = F.when(target > 0, hits / target).otherwise(F.lit(0.0))
    scored = df.select(p.alias("p"), r.alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(F.lit(0.0))
    return scored.agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg(f1).alias("f1"))


def validity(df: DataFrame, keys: Sequence[str], valid: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.bool_and(valid).alias("all_valid"), F.bool_or(valid).alias("any_valid"), F.count_if(valid).alias("n_valid"), F.round(F.count_if(valid) / F.count("*"), 4).alias("rate"))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of non-negative integers below 2**63, by Euclid's steps over a fixed sequence (91 suffice)."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.greatest(s["b"], F.lit(1))).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(91)), start, step)["a"]


def lcm_of(values: Column) -> Column:
    """Least common multiple of an array of positive integers; 1 for an empty one."""

    def meet(x: Column, y: Column) -> Column:
        # Euclid inside the fold: (x, y) -> x / gcd * y
        pair = F.aggregate(
            F.sequence(F.lit(1), F.lit(91)), F.struct(x.alias("a"), y.cast("long").alias("b")),
            lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.greatest(s["b"], F.lit(1))).alias("b"))),
        )
        return (x / pair["a"]).cast("long") * y.cast("long")

    return F.aggregate(values, F.lit(1).cast("long"), meet)
