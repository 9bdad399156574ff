"""Operators over ordered rows: carry-forward, clustering, runs, smoothing, state machines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(keys: Sequence[str], order: Sequence[str | Column]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """The last non-null ``value`` so far, this row included."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def last_anchor(df: DataFrame, keys: Sequence[str], order: Sequence[str], anchor: Column, out: str) -> DataFrame:
    """The last non-null ``anchor`` of the rows before this one."""
    return df.withColumn(out, F.last(anchor, ignorenulls=True).over(_before(keys, order)))


def gap_clusters(df: DataFrame, keys: Sequence[str], order: Sequence[str], position: Column, gap: float, out: str = "cluster") -> DataFrame:
    """Numbers single-linkage clusters from 1: a row begins one if it lies more than ``gap`` behind the row before. The gap itself links."""
    w = Window.partitionBy(*keys).orderBy(*order)
    linked = F.coalesce(position - F.lag(position).over(w) <= gap, F.lit(False))
    return df.withColumn("_new", (~linked).cast("int")).withColumn(out, F.sum("_new").over(w)).drop("_new")


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "run") -> DataFrame:
    """Numbers runs of equal values from 1; null equals null."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    return df.withColumn("_new", new.cast("int")).withColumn(out, F.sum("_new").over(w)).drop("_new")


def smooth(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, kernel: Sequence[float], out: str) -> DataFrame:
    """Convolution with an odd kernel, zeros beyond the ends."""
    w, half = Window.partitionBy(*keys).orderBy(*order), len(kernel) // 2
    terms = [F.coalesce(F.lag(value, k).over(w) if k > 0 else F.lead(value, -k).over(w) if k < 0 else F.col(value), F.lit(0)) * F.lit(float(kernel[half + k])) for k in range(-half, half + 1)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return df.withColumn(out, total)


def fill_gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], position: str, step: Column, *, low: float = 1.5, high: float = 2.5) -> DataFrame:
    """Adds a row (keys, position, filled) halfway to the next one where that is more than ``low`` and at most ``high`` steps away."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df, ahead = df.withColumn("_ahead", F.lead(position).over(w) - F.col(position)), F.col("_ahead")
    middle = F.when((ahead > step * low) & (ahead <= step * high), F.array(F.struct(F.col(position).cast("double").alias("p"), F.lit(False).alias("f")), F.struct((F.col(position) + ahead / 2).alias("p"), F.lit(True).alias("f"))))
    rows = df.withColumn("_r", F.explode(F.coalesce(middle, F.array(F.struct(F.col(position).cast("double").alias("p"), F.lit(False).alias("f"))))))
    return rows.select(*keys, F.col("_r.p").alias(position), F.col("_r.f").alias("filled"))


def not_increasing(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose ``value`` is not above the one before, which is added as ``previous``."""
    previous = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("previous", previous).where(F.col(value) <= F.col("previous"))


def repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows whose keys were seen before in ``order``, with their ``occurrence`` (2 and more)."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("occurrence > 1")


def prefix_fraction(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """The share of the group's total that lies before the row."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.coalesce(F.sum(value).over(_before(keys, order)), F.lit(0)) / total)


def bracket_depth(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Column) -> DataFrame:
    """Depth of brackets (``step``: 1 opens, -1 closes, 0 continues, null: no marker), held at 0: a close without an open is an error.

    Adds ``depth`` and ``unopened``, true where a close or continue has nothing open. The running sum less its running minimum below 0.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_step", step).withColumn("_sum", F.coalesce(F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    out = out.withColumn("depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    before = F.coalesce(F.lag("depth").over(w), F.lit(0))
    return out.withColumn("unopened", F.coalesce((F.col("_step") <= 0) & (before <= 0), F.lit(False))).drop("_step", "_sum")


def set_state(df: DataFrame, scope: Sequence[str], item: Sequence[str], order: Sequence[str], start: Column, stop: Column, keep: Column) -> DataFrame:
    """A set of open items per scope: a start adds the row's item, a stop takes it out, both mean out and in again, ``keep`` needs it open.

    Adds ``was_open`` (0 or 1), ``open_in_scope`` (items open before the row) and ``code``: INVALID (keep with start or stop, no change of
    state), CONTINUE_WITHOUT_START, STOP_PITCH_MISMATCH (another item of the scope is open), STOP_WITHOUT_START, START_WHILE_OPEN or null.
    """
    marks = df.withColumn("_start", start).withColumn("_stop", stop).withColumn("_keep", keep)
    marks = marks.withColumn("_mark", F.when(F.col("_keep"), F.lit(None).cast("int")).when(F.col("_start"), 1).when(F.col("_stop"), 0))
    marks = marks.withColumn("was_open", F.coalesce(F.last("_mark", ignorenulls=True).over(_before([*scope, *item], order)), F.lit(0)))
    marks = marks.withColumn("_delta", F.coalesce("_mark", "was_open") - F.col("was_open"))
    marks = marks.withColumn("open_in_scope", F.coalesce(F.sum("_delta").over(_before(scope, order)), F.lit(0)))
    code = (
        F.when(F.col("_keep") & (F.col("_start") | F.col("_stop")), "INVALID")
        .when(F.col("_keep") & (F.col("was_open") == 0), "CONTINUE_WITHOUT_START")
        .when(~F.col("_keep") & F.col("_stop") & (F.col("was_open") == 0), F.when(F.col("open_in_scope") > 0, "STOP_PITCH_MISMATCH").otherwise("STOP_WITHOUT_START"))
        .when(~F.col("_keep") & F.col("_start") & ~F.col("_stop") & (F.col("was_open") == 1), "START_WHILE_OPEN")
    )
    return marks.withColumn("code", code).drop("_start", "_stop", "_keep", "_mark", "_delta")


def periodicity(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, lags: Sequence[int], *, least_rows: int = 6, above: float = 0.4) -> DataFrame:
    """For each group the lag at which most values equal the one that many rows ahead: (keys, best_lag, best_share).

    Lags are tried in the order given and a later one must be better; shares up to ``above`` and groups of fewer rows do not count.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    flags = df
    for k in lags:
        flags = flags.withColumn(f"_{k}", (F.col(value) == F.lead(value, k).over(w)).cast("double"))
    shares = flags.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.avg(f"_{k}").alias(f"_{k}") for k in lags)).where(F.col("_n") >= least_rows)
    best = F.array_max(F.array(*(F.struct(F.col(f"_{k}").alias("share"), F.lit(-i).alias("i"), F.lit(k).alias("lag")) for i, k in enumerate(lags))))
    return shares.withColumn("_b", best).where(F.col("_b.share") > above).select(*keys, F.col("_b.lag").alias("best_lag"), F.col("_b.share").alias("best_share"))


def merge_runs(df: DataFrame, keys: Sequence[str], position: str, gap: float) -> DataFrame:
    """(keys, run, start, end, length): positions at most ``gap`` apart brought together, the length counting both ends."""
    grouped = gap_clusters(df.select(*keys, position).distinct(), keys, [position], F.col(position), gap, "run")
    return grouped.groupBy(*keys, "run").agg(F.min(position).alias("start"), F.max(position).alias("end")).withColumn("length", F.col("end") - F.col("start") + 1)


def dispersion(df: DataFrame, keys: Sequence[str], order: Sequence[str], position: Column) -> DataFrame:
    """(keys, dispersion): the sum of the deviations of gaps from their median, in medians; 0 for fewer than two gaps."""
    w = Window.partitionBy(*keys).orderBy(*order)
    gaps = df.select(*keys, (position - F.lag(position).over(w)).alias("gap"))
    rows = gaps.groupBy(*keys).agg(F.median("gap").alias("m"), F.collect_list("gap").alias("g"))
    off = F.aggregate("g", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("m")))
    return rows.select(*keys, F.when(F.size("g") >= 2, off / F.greatest(F.lit(1.0), F.col("m"))).otherwise(0.0).alias("dispersion"))


def split_systems(df: DataFrame, keys: Sequence[str], order: Sequence[str], top: str, bottom: str, unit: str, out: str = "system_index") -> DataFrame:
    """Numbers groups of consecutive bands from 0: a gap (this band's ``bottom`` less ``top`` of the one before) above a limit parts them.

    The limit follows the median of ``unit`` (6 of them for up to three gaps), else the median gap (2.5 of them, within 4 to 10 units). A
    group of more than eight bands parts again at gaps above 1.6 median gaps, or else at its first largest one, if above 1.5.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    gaps = df.withColumn("_gap", F.col(bottom) - F.lag(top).over(w))
    stats = gaps.groupBy(*keys).agg(F.median("_gap").alias("_m"), F.median(unit).alias("_u"), F.count("_gap").alias("_n"))
    limit = F.when(F.col("_n") <= 3, F.col("_u") * 6).otherwise(F.least(F.greatest(F.col("_u") * 4, F.col("_m") * 2.5), F.col("_u") * 10))
    rough = gaps.join(stats, list(keys)).withColumn("_new", F.coalesce(F.col("_gap") > limit, F.lit(True)).cast("int")).withColumn("_group", F.sum("_new").over(w))
    inside = Window.partitionBy(*keys, "_group")
    inner = F.when(F.col("_new") == 0, F.col("_gap"))
    rough = rough.withColumn("_size", F.count("*").over(inside)).withColumn("_inner", inner).withColumn("_most", F.max(inner).over(inside))
    rough = rough.withColumn("_clear", F.max((F.col("_inner") > F.col("_m") * 1.6).cast("int")).over(inside))
    largest = (F.col("_inner") == F.col("_most")) & (F.col("_most") > F.col("_m") * 1.5)
    rough = rough.withColumn("_nth", F.sum(F.coalesce(largest, F.lit(False)).cast("int")).over(inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    again = (F.col("_size") > 8) & F.coalesce(F.when(F.col("_clear") == 1, F.col("_inner") > F.col("_m") * 1.6).otherwise(largest & (F.col("_nth") == 1)), F.lit(False))
    rough = rough.withColumn("_new", ((F.col("_new") == 1) | again).cast("int"))
    return rough.withColumn(out, (F.sum("_new").over(w) - 1).cast("int")).select(*df.columns, out)


def box_sums(df: DataFrame, keys: Sequence[str], x: str, y: str, value: str, out: str = "total") -> DataFrame:
    """The sum of all values up to each cell of a full grid, in both directions: one window along rows, one down columns."""
    along = Window.partitionBy(*keys, y).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, x).orderBy(y).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_row", F.sum(value).over(along)).withColumn(out, F.sum("_row").over(down)).drop("_row")
