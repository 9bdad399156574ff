"""Threshold policies for candidate symbols: fitting, selection and evaluation against known counts.

Known counts enter ``fit_threshold``, ``evaluate_*`` and the mode named oracle, never ``select_by_threshold``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import decode, select


def threshold_grid(start: float = 0.40, stop: float = 0.98, step: float = 0.01) -> list[float]:
    """From ``start`` to ``stop``, both included, rounded to three digits."""
    return [round(start + k * step, 3) for k in range(round((stop - start) / step) + 1)]


def select_by_threshold(labels: DataFrame, page: Sequence[str], threshold: float) -> DataFrame:
    return labels.where(F.col("confidence") >= threshold).withColumn("mode", F.lit("threshold"))


def oracle_selection(labels: DataFrame, targets: DataFrame, page: Sequence[str], threshold: float) -> DataFrame:
    """As many labels as the page is known to have, the most confident ones where the threshold gives another number. A leak by design."""
    return select.top_k_repair(labels.join(targets, list(page)), page, "confidence", "index", threshold=threshold, target="target")


def page_errors(selected: DataFrame, targets: DataFrame, page: Sequence[str]) -> DataFrame:
    """selected_count and error for every page with a known count, pages without any selection included."""
    counts = selected.groupBy(*page).agg(F.count("*").alias("selected_count"))
    joined = targets.join(counts, list(page), "left").withColumn("selected_count", F.coalesce("selected_count", F.lit(0)))
    return joined.withColumn("error", F.col("selected_count") - F.col("target"))


def evaluate(errors: DataFrame) -> DataFrame:
    return errors.agg(
        F.avg(F.abs("error")).alias("mean_abs_error"), F.count_if(F.col("error") == 0).alias("exact_count"), F.count("*").alias("fixture_count"),
        F.sum("selected_count").alias("total_selected"), F.sum("target").alias("total_target"), F.count_if(F.col("error") < 0).alias("infeasible_count"),
    )


def fit_threshold(labels: DataFrame, targets: DataFrame, page: Sequence[str], grid: Sequence[float] | None = None) -> DataFrame:
    """The one threshold of least mean absolute count error; ties to the smaller total difference, then to the higher threshold.

    Rows are counted once by the highest threshold they reach; the grid meets pages, not rows.
    """
    grid = list(grid or threshold_grid())
    counts = decode.threshold_counts(labels, page, F.col("confidence"), grid)
    steps = targets.select(*page, "target", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))).alias("step"))
    joined = steps.join(counts, [*page, "step"], "left").withColumn("error", F.coalesce("n", F.lit(0)) - F.col("target"))
    fits = joined.groupBy("step").agg(F.avg(F.abs("error")).alias("mean_abs_error"), F.count_if(F.col("error") == 0).alias("exact_count"), F.count("*").alias("fixture_count"), (F.sum("error") + F.sum("target")).alias("total_selected"), F.sum("target").alias("total_target"))
    best = select.best_row(fits, ["mean_abs_error", F.abs(F.col("total_selected") - F.col("total_target")), F.col("step").desc()])
    return best.withColumn("threshold", F.element_at(F.array(*map(F.lit, grid)), F.col("step") + 1)).drop("step")


def triage_page(labels: DataFrame, page: Sequence[str], positive: float = 0.82, uncertain: float = 0.55) -> DataFrame:
    """positive, uncertain and reject counts of every page."""
    label = select.triage(F.col("confidence"), positive, uncertain)
    return labels.groupBy(*page).agg(*(F.count_if(label == x).alias(x) for x in ("positive", "uncertain", "reject")), F.count("*").alias("candidates"))


def compare_measures(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """fixture, measure_idx, exact, valid: measures of both sides paired by their place in the file.

    ``predicted`` and ``truth``: fixture, measure_idx, labels (array); ``predicted`` also total_ticks and expected_ticks.
    """

    def placed(df: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("fixture").orderBy("measure_idx"))
        return df.withColumn("place", place).withColumnRenamed("labels", name)

    pairs = placed(predicted, "got").join(placed(truth, "wanted").select("fixture", "place", "wanted"), ["fixture", "place"])
    return pairs.select("fixture", F.col("place").alias("measure_idx"), (F.col("got") == F.col("wanted")).alias("exact"), (F.col("total_ticks") == F.col("expected_ticks")).alias("valid"), F.size("got").alias("n_predicted"), F.size("wanted").alias("n_target"))


def duration_summary(compared: DataFrame) -> DataFrame:
    pages = compared.groupBy("fixture").agg(F.bool_and("exact").alias("exact"), F.bool_and("valid").alias("valid"), F.count("*").alias("n"), F.count_if("valid").alias("v"), F.sum("n_predicted").alias("p"), F.sum("n_target").alias("t"))
    return pages.agg(F.count_if("exact").alias("exact_pages"), F.count_if("valid").alias("all_valid_pages"), F.count("*").alias("pages"), F.sum("v").alias("valid_measures"), F.sum("n").alias("measures"), F.round(F.sum("v") / F.sum("n"), 4).alias("valid_rate"), (F.sum("p") - F.sum("t")).alias("event_delta"))


def label_histogram(measures: DataFrame, labels: Column) -> DataFrame:
    return measures.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"), F.first(F.col("label").contains(".")).alias("dotted"))
