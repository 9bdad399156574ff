"""Checks of detected layouts and metrics of detections against known scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores


def _told(condition: Column, message: Column) -> Column:
    return F.when(condition, message)


def staff_issues(pages: DataFrame, bands: DataFrame, *, least: int = 1, most_off: float = 3.0) -> DataFrame:
    """(page_id, issue): pages with too few bands, else bands whose interline is off the page's mean by more than ``most_off`` pixels."""
    stats = bands.groupBy("page_id").agg(F.count("*").alias("n"), F.avg("interline_px").alias("mean"))
    counted = pages.select("page_id").join(stats, "page_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    few = counted.where(F.col("n") < least).select("page_id", F.concat(F.lit("Only "), F.col("n").cast("string"), F.lit(f" staff bands detected (expected ≥{least})")).alias("issue"))
    met = bands.join(counted.where(F.col("n") >= least), "page_id").where(F.abs(F.col("interline_px") - F.col("mean")) > most_off)
    off = met.select("page_id", F.format_string(f"Staff band %d interline (%.1fpx) deviates from mean (%.1fpx) by >{most_off}px", "staff_index", "interline_px", "mean").alias("issue"))
    return few.unionByName(off)


def barline_issues(pages: DataFrame, barlines: DataFrame, *, least: int = 1, gap: float = 10.0) -> DataFrame:
    """(page_id, issue): too few bars, else bars outside the page and bars closer than ``gap``. ``pages``: page_id, width."""
    counts = barlines.groupBy("page_id").agg(F.count("*").alias("n"))
    counted = pages.select("page_id", "width").join(counts, "page_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    few = counted.where(F.col("n") < least).select("page_id", F.concat(F.lit("Only "), F.col("n").cast("string"), F.lit(f" barlines detected (expected ≥{least})")).alias("issue"))
    w = Window.partitionBy("page_id").orderBy("x")
    met = barlines.join(counted.where(F.col("n") >= least), "page_id").withColumn("i", F.row_number().over(w) - 1).withColumn("ahead", F.lead("x").over(w))
    outside = _told((F.col("x") < 0) | (F.col("x") > F.col("width")), F.format_string("Barline %d at x=%.1f is outside image [0, %s]", F.col("i"), F.col("x"), F.col("width").cast("string")))
    close = _told(F.col("ahead") - F.col("x") < gap, F.format_string("Barlines at x=%.1f and %.1f are too close (%.1fpx)", F.col("x"), F.col("ahead"), F.col("ahead") - F.col("x")))
    return few.unionByName(met.select("page_id", F.explode(F.filter(F.array(outside, close), lambda m: m.isNotNull())).alias("issue")))


def notehead_issues(counts: DataFrame, *, per_staff: int = 2) -> DataFrame:
    """(page_id, issue) of pages (page_id, noteheads, staves) with fewer heads than staves ask for."""
    want = F.col("staves") * per_staff
    bad = counts.where((F.col("staves") > 0) & (F.col("noteheads") < want))
    return bad.select("page_id", F.format_string("Only %d noteheads detected across %d staves (expected ≥%d)", F.col("noteheads"), F.col("staves"), want).alias("issue"))


def layout_metrics(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Measure counts (fixture, measures) against known ones: fixtures, exact, mae and totals; fixtures without a known count are left out."""
    pairs = truth.withColumnRenamed("measures", "want").join(predicted.withColumnRenamed("measures", "got"), "fixture")
    off = F.col("got") - F.col("want")
    return pairs.agg(F.count("*").alias("fixtures"), F.count_if(off == 0).alias("exact"), F.avg(F.abs(off)).alias("mae"), F.sum("got").alias("total_predicted"), F.sum("want").alias("total_target"))


def stage_metrics(detections: DataFrame, truth: DataFrame) -> DataFrame:
    """By ``mode``: clef and time accuracy and mean precision, recall, F1 and count error of heads.

    ``detections``: fixture, mode, clef, time, heads; ``truth``: fixture, gt_clef, gt_time, gt_notes. Hits are the smaller of both counts.
    """
    rows = detections.join(truth, "fixture")
    hits = F.least("heads", "gt_notes")
    rated = rows.withColumn("p", hits / F.greatest(F.lit(1), F.col("heads"))).withColumn("r", hits / F.greatest(F.lit(1), F.col("gt_notes")))
    return rated.groupBy("mode").agg(
        F.count("*").alias("fixtures"), F.count_if(F.col("clef") == F.col("gt_clef")).alias("clef_right"), F.count_if(F.col("time") == F.col("gt_time")).alias("time_right"), F.avg("p").alias("precision"),
        F.avg("r").alias("recall"), F.avg(scores.f1(F.col("p"), F.col("r"))).alias("f1"), F.avg(F.abs(F.col("heads") - F.col("gt_notes"))).alias("count_error"),
    )


def leak_free(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Selections (fixture, selected, valid_measures, measures) against known counts (fixture, gt); fixtures without one are left out."""
    rows = found.join(truth, "fixture")
    off = F.col("selected") - F.col("gt")
    return rows.agg(
        F.count("*").alias("fixtures"), F.count_if(off == 0).alias("exact"), F.avg(F.abs(off)).alias("mae"), F.sum("selected").alias("total_selected"), F.sum("gt").alias("total_gt"),
        F.sum("valid_measures").alias("valid_measures"), F.sum("measures").alias("total_measures"), F.count_if(F.col("valid_measures") == F.col("measures")).alias("all_valid"),
    )


def supervised_summary(pages: DataFrame) -> DataFrame:
    """Shares as texts ``n/m`` over pages: page_exact, exact_measure_count, measure_count, selected_count, gt_event_count."""
    share = lambda a, b: F.concat_ws("/", a.cast("string"), b.cast("string"))
    exact, every = F.sum("exact_measure_count"), F.sum("measure_count")
    return pages.agg(F.count("*").alias("fixture_count"), share(F.count_if("page_exact"), F.count("*")).alias("page_exact"), share(exact, every).alias("exact_measures"), share(F.sum("selected_count"), F.sum("gt_event_count")).alias("selected_events"), (exact == every).alias("all_measures_exact"))


def mean_errors(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """The mean absolute difference of each named pair of columns."""
    return rows.agg(*(F.avg(F.abs(F.col(a) - F.col(b))).alias(name) for name, (a, b) in pairs.items()))
