"""Bars, stems, beams and mask instances: pixels give rows inside Arrow batches, joins and windows do the rest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import joins, sequence
from . import pixels
from .pages import _binary, _gray_pages

# The classes of a segmentation mask, by number.
CLASSES = ("background", "staff_line", "notehead_filled", "notehead_open", "stem", "beam", "barline", "ledger_line", "clef", "rest", "accidental", "articulation", "tie_slur", "dynamic_mark", "text", "fingering")
RUN = "page_id string, x int, y0 int, y1 int"


def column_runs(pages: DataFrame, *, least: int, method: str = "sauvola") -> DataFrame:
    """Vertical ink runs of ``least`` pixels or more: page_id, x, y0, y1 (exclusive)."""

    def find(batches):
        for batch in batches:
            for page, gray in _gray_pages(batch):
                runs = pixels.row_runs(_binary(gray, method).T, least)
                if runs:
                    x, y0, y1 = (pa.array(c, pa.int32()) for c in zip(*runs, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([page] * len(runs)), x, y0, y1], names=["page_id", "x", "y0", "y1"])

    return pages.mapInArrow(find, RUN)


def barlines(runs: DataFrame, bands: DataFrame, *, ratio: float = 5.0, gap: int = 4) -> DataFrame:
    """page_id, x: centres of groups of columns whose longest run spans ``ratio`` median interlines (24 pixels at least)."""
    level = bands.groupBy("page_id").agg(F.greatest(F.lit(24), (F.median("interline_px") * ratio).cast("int")).alias("least"))
    columns = runs.groupBy("page_id", "x").agg(F.max(F.col("y1") - F.col("y0")).alias("run")).join(level, "page_id").where("run >= least")
    clusters = sequence.gap_clusters(columns, ["page_id"], ["x"], F.col("x"), gap)
    return clusters.groupBy("page_id", "cluster").agg(F.avg("x").alias("x")).drop("cluster")


def stems(runs: DataFrame, bands: DataFrame, *, low: float = 2.0, high: float = 6.0) -> DataFrame:
    """page_id, stem_idx, staff_index, x_center, y0, y1, interline_px: runs of stem height, those of neighbouring columns together, at their nearest band."""
    page = bands.groupBy("page_id").agg(F.median("interline_px").alias("i"))
    tall = runs.join(page, "page_id").where((F.col("y1") - F.col("y0")).between(F.col("i") * low, F.col("i") * high))
    # neighbouring columns first, then those whose runs overlap
    columns = sequence.gap_clusters(tall, ["page_id"], ["x", "y0"], F.col("x"), 1, "column")
    w = Window.partitionBy("page_id", "column").orderBy("y0", "x")
    apart = F.coalesce(F.col("y0") >= F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    parted = columns.withColumn("_new", apart.cast("int")).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = parted.groupBy("page_id", "column", "cluster").agg(F.avg("x").alias("x_center"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    numbered = grouped.withColumn("stem_idx", F.row_number().over(Window.partitionBy("page_id").orderBy("x_center", "y0")) - 1).drop("column", "cluster")
    middle = bands.select("page_id", "staff_index", "interline_px", F.col("line_ys")[2].alias("middle"))
    near = joins.nearest(numbered, middle, ["page_id"], ["page_id", "stem_idx"], F.abs((F.col("y0") + F.col("y1")) / 2 - F.col("middle")), ["staff_index"])
    return near.drop("distance", "middle")


def attach_stems(heads: DataFrame, stem_rows: DataFrame) -> DataFrame:
    """Each head with the stem of its staff that fits best, if its score is above -1: stem_idx, direction, score.

    A stem scores as an upward one at the head's right and as a downward one at its left: nearness, touch and extent; the better counts.
    Both need the staff's interline; ties go to the first stem.
    """
    i = F.col("interline_px")
    near = lambda edge: F.exp(-F.abs(F.col("x_center") - F.col(edge)) / F.greatest(F.lit(1.0), i * 0.25)) * 2.0
    sign = lambda c: F.when(c, 1.0).otherwise(-1.0)
    up = near("x1") + F.when(F.col("stem_y1") >= F.col("y0") - i * 0.5, 1.0).otherwise(0.0) + sign(F.col("stem_y0") < F.col("cy") - i * 0.3)
    down = near("x0") + F.when(F.col("stem_y0") <= F.col("y1") + i * 0.5, 1.0).otherwise(0.0) + sign(F.col("stem_y1") > F.col("cy") + i * 0.3)
    right = stem_rows.select("page_id", "staff_index", "stem_idx", "x_center", F.col("y0").alias("stem_y0"), F.col("y1").alias("stem_y1"), "interline_px")
    found = joins.scored_attach(heads, right, ["page_id", "staff_index"], ["page_id", "symbol_idx"], F.greatest(up, down), ["stem_idx"], above=-1.0)
    return found.withColumn("direction", F.when(up >= down, "up").otherwise("down")).select(*heads.columns, "stem_idx", "direction", "score")


def beams_with_stems(beams: DataFrame, stem_rows: DataFrame, *, least: int = 2) -> DataFrame:
    """Beams (page_id, beam_idx, staff_index, x0, y0, x1, y1) that meet ends of ``least`` stems of their staff, with those stems in order."""
    i = F.col("interline_px")
    right = stem_rows.select("page_id", "staff_index", "stem_idx", "x_center", F.col("y0").alias("stem_y0"), F.col("y1").alias("stem_y1"), "interline_px")
    ends = F.least(*(F.abs(F.col(a) - F.col(b)) for a in ("stem_y0", "stem_y1") for b in ("y0", "y1")))
    near = F.col("x_center").between(F.col("x0") - i * 0.5, F.col("x1") + i * 0.5) & (ends <= i * 0.5)
    met = beams.join(right, ["page_id", "staff_index"]).where(near).groupBy("page_id", "beam_idx").agg(F.array_sort(F.collect_set("stem_idx")).alias("stems"))
    return beams.join(met.where(F.size("stems") >= least), ["page_id", "beam_idx"])


def flags(heads: DataFrame, beams: DataFrame) -> DataFrame:
    """(page_id, symbol_idx, flag_count): the highest level of the beams at a head's stem; all heads of a stem have it."""
    by_stem = beams.select("page_id", "level", F.explode("stems").alias("stem_idx"))
    return heads.join(by_stem, ["page_id", "stem_idx"]).groupBy("page_id", "symbol_idx").agg(F.max("level").alias("flag_count"))


def mask_instances(masks: DataFrame, *, least_area: int = 4) -> DataFrame:
    """Instances of the classes of masks (page_id, width, height, mask: a byte a pixel): symbol_id, class_name, area, centre and box, x1 and y1 exclusive."""
    out = "page_id string, symbol_id string, class_name string, area int, cx double, cy double, x0 int, y0 int, x1 int, y1 int"

    def find(batches):
        for batch in batches:
            for row in batch.select(["page_id", "width", "height", "mask"]).to_pylist():
                mask = np.frombuffer(row["mask"], np.uint8).reshape(row["height"], row["width"])
                rows: list[tuple] = []
                for number in (int(n) for n in np.unique(mask) if 0 < n < len(CLASSES)):
                    for area, cx, cy, x0, y0, x1, y1 in pixels.components((mask == number).astype(np.uint8), 4):
                        if area >= least_area:
                            rows.append((row["page_id"], f"seg_{CLASSES[number]}_{len(rows):06d}", CLASSES[number], area, cx, cy, x0, y0, x1 + 1, y1 + 1))
                if rows:
                    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in out.split(", ")])

    return masks.mapInArrow(find, out)


def class_counts(masks: DataFrame) -> DataFrame:
    """page_id, class_name, pixels of every class, zeros included."""

    def count(batches):
        for batch in batches:
            for page, mask in zip(batch.column("page_id").to_pylist(), batch.column("mask").to_pylist(), strict=True):
                n = np.bincount(np.frombuffer(mask, np.uint8), minlength=len(CLASSES))[: len(CLASSES)]
                yield pa.RecordBatch.from_arrays([pa.array([page] * len(CLASSES)), pa.array(CLASSES), pa.array(n.astype(np.int64))], names=["page_id", "class_name", "pixels"])

    return masks.mapInArrow(count, "page_id string, class_name string, pixels long")
