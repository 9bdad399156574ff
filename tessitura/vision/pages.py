"""Pages to relations: ink components, line profiles and staff bands."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import aggregate, sequence
from . import pixels

COMPONENT = "page_id string, component int, area int, cx double, cy double, x0 int, y0 int, x1 int, y1 int"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id (file name without suffix), width, height, channels and pixels of images."""
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    name = F.regexp_extract("image.origin", r"([^/]+)\.[^./]+$", 1)
    return images.select(name.alias("page_id"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def _gray_pages(batch: pa.RecordBatch):
    """The pages of a batch, decoded one by one."""
    for k in range(batch.num_rows):
        (row,) = batch.slice(k, 1).select(["page_id", "height", "width", "channels", "data"]).to_pylist()
        yield row["page_id"], pixels.luminance(row["data"], row["height"], row["width"], row["channels"])


def _binary(gray: np.ndarray, method: str) -> np.ndarray:
    return pixels.ink_otsu(gray) if method == "otsu" else pixels.ink_sauvola(gray)


def page_components(pages: DataFrame, *, method: str = "sauvola", connectivity: int = 8, least_area: int = 1) -> DataFrame:
    """Ink components of every page, numbered in raster order. One page is in memory at a time."""

    def find(batches):
        for batch in batches:
            for page, gray in _gray_pages(batch):
                rows = [(page, i, *c) for i, c in enumerate(pixels.components(_binary(gray, method), connectivity)) if c[0] >= least_area]
                if rows:
                    kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in COMPONENT.split(", ")])

    return pages.mapInArrow(find, COMPONENT)


def clear_components(pages: DataFrame, bands: DataFrame, *, method: str = "otsu", half: int = 1) -> DataFrame:
    """Ink components of every page that has bands, without the rows of staff lines and ``half`` rows beside them."""
    lines = bands.groupBy("page_id").agg(F.flatten(F.collect_list("line_ys")).alias("lines"))
    names = [x.split()[0] for x in COMPONENT.split(", ")]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())

    def find(batches):
        for batch in batches:
            for k, (page, gray) in enumerate(_gray_pages(batch)):
                ink = pixels.erase_rows(_binary(gray, method), [round(y) for y in batch.column("lines")[k].as_py()], half)
                rows = [(page, i, *c) for i, c in enumerate(pixels.components(ink, 8))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return pages.join(lines, "page_id").mapInArrow(find, COMPONENT)


def row_profiles(pages: DataFrame, *, method: str = "otsu") -> DataFrame:
    """page_id, y, ink, first, last, width: ink pixels of each row, its first and last (null without any), and the page's width."""

    def measure(batches):
        for batch in batches:
            for page, gray in _gray_pages(batch):
                dark = _binary(gray, method).astype(bool)
                ink, none = dark.sum(axis=1).astype(np.int64), ~dark.any(axis=1)
                first, last = dark.argmax(axis=1), dark.shape[1] - 1 - dark[:, ::-1].argmax(axis=1)
                places = [pa.array(x.astype(np.int32), mask=none) for x in (first, last)]
                yield pa.RecordBatch.from_arrays([pa.array([page] * len(ink)), pa.array(np.arange(len(ink), dtype=np.int32)), pa.array(ink), *places, pa.array(np.full(len(ink), dark.shape[1], dtype=np.int32))], names=["page_id", "y", "ink", "first", "last", "width"])

    return pages.mapInArrow(measure, "page_id string, y int, ink long, first int, last int, width int")


def gaussian(sigma: float) -> list[float]:
    """A kernel of three sigmas, odd, summing to 1."""
    half = max(3, round(sigma * 3)) // 2
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-half, half + 1)]
    return [w / sum(weights) for w in weights]


def staff_lines(profiles: DataFrame, *, smoothing: float = 2.0, sigma: float = 1.2, gap: int = 3, span: float = 0.5) -> DataFrame:
    """Centres of groups of rows whose smoothed ink reaches the page's mean plus ``sigma`` deviations: page_id, line, y, ink.

    Where profiles tell the first and last ink of rows, lines whose ink spans less than ``span`` of the page, as of text, go.
    """
    smooth = sequence.smooth(profiles, ["page_id"], ["y"], "ink", gaussian(smoothing), "smooth")
    level = smooth.groupBy("page_id").agg((F.avg("smooth") + F.lit(sigma) * F.stddev_pop("smooth")).alias("level"))
    strong = smooth.join(level, "page_id").where("smooth >= level")
    grouped = sequence.gap_clusters(strong, ["page_id"], ["y"], F.col("y"), gap, "line")
    lines = aggregate.weighted_centroid(grouped, ["page_id", "line"], {"y": "y"}, "ink")
    if "first" not in profiles.columns:
        return lines
    wide = profiles.where(F.col("last") - F.col("first") >= F.floor(F.col("width") * span)).select("page_id", F.col("y").alias("_y")).distinct()
    return lines.withColumn("_y", F.bround("y", 0).cast("int")).join(wide, ["page_id", "_y"], "left_semi").drop("_y")


def _gaps(ys: Column) -> Column:
    return F.zip_with(F.slice(ys, 2, F.greatest(F.size(ys) - 1, F.lit(0))), F.slice(ys, 1, F.greatest(F.size(ys) - 1, F.lit(0))), lambda b, a: b - a)


def _quantile(values: Column, share: float) -> Column:
    """The linear quantile of an array; null if it is empty."""
    v = F.array_sort(values)
    at = F.lit(share) * (F.size(v) - 1)
    low, high = F.try_element_at(v, (F.floor(at) + 1).cast("int")), F.try_element_at(v, (F.ceil(at) + 1).cast("int"))
    return F.when(F.size(v) > 0, low + (high - low) * (at - F.floor(at)))


def _near(ys: Column, reach: Column) -> Column:
    """For each of sorted positions whether the one before or behind is within ``reach``."""
    return F.transform(ys, lambda y, i: F.when(i > 0, y - F.get(ys, i - 1) <= reach).otherwise(False) | F.coalesce(F.get(ys, i + 1) - y <= reach, F.lit(False)))


def staff_bands(lines: DataFrame, *, low: float = 4.0, high: float = 50.0, tolerance: float = 0.35) -> DataFrame:
    """Blocks of five lines at even distances: page_id, staff_index, line_ys (downwards), interline_px.

    Lines without a neighbour within two median gaps go, if five are left. The interline is the 25th percentile of the gaps from ``low`` to
    ``high``; a gap of about two of them inside a staff gets a line in its middle. Blocks are taken from the top, none overlaps one before.
    A page's lines are one short array, worked through in the JVM.
    """
    page = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.col("y").cast("double"))).alias("ys")).where(F.size("ys") >= 5)
    plausible = F.filter(_gaps(F.col("ys")), lambda g: g.between(3, 80))
    page = page.withColumn("m", F.greatest(F.lit(4.0), F.coalesce(_quantile(plausible, 0.5), F.lit(12.0))))
    near = F.transform(F.filter(F.arrays_zip(F.col("ys").alias("y"), _near(F.col("ys"), F.col("m") * 2).alias("n")), lambda p: p["n"]), lambda p: p["y"])
    page = page.withColumn("kept", near).withColumn("ys", F.when((F.size("ys") > 5) & (F.size("kept") >= 5), F.col("kept")).otherwise(F.col("ys")))
    even = F.filter(_gaps(F.col("ys")), lambda g: g.between(low, high))
    page = page.withColumn("i", F.greatest(F.lit(low), F.coalesce(_quantile(even, 0.25), F.lit(12.0)))).withColumn("staff", _near(F.col("ys"), F.col("i") * 2))

    def filled(y: Column, k: Column) -> Column:
        gap = F.get("ys", k + 1) - y
        inside = F.get("staff", k) & F.get("staff", k + 1) & (gap > F.col("i") * 1.5) & (gap <= F.col("i") * 2.5)
        return F.when(inside, F.array(y, F.bround(y + gap / 2, 0))).otherwise(F.array(y))

    page = page.withColumn("ys", F.flatten(F.transform("ys", filled)))
    room = F.greatest(F.lit(2.0), F.col("i") * tolerance)
    block = lambda k: F.slice(F.col("ys"), k + 1, 5)
    fits = F.filter(F.sequence(F.lit(0), F.greatest(F.size("ys") - 5, F.lit(0))), lambda k: (F.size(block(k)) == 5) & F.forall(_gaps(block(k)), lambda g: F.abs(g - F.col("i")) <= room))
    taken = F.aggregate(fits, F.array().cast("array<int>"), lambda a, k: F.when((F.size(a) == 0) | (k >= F.element_at(F.concat(F.array(F.lit(-9)), a), -1) + 5), F.concat(a, F.array(k))).otherwise(a))
    rows = page.withColumn("taken", taken).select("page_id", F.posexplode(F.transform("taken", lambda k: F.slice("ys", k + 1, 5))).alias("staff_index", "line_ys"))
    return rows.withColumn("interline_px", (F.element_at("line_ys", 5) - F.element_at("line_ys", 1)) / 4)


def candidates(components: DataFrame, bands: DataFrame, *, area: tuple[float, float] = (0.25, 2.2), side: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """Components of notehead size (in interlines) with their nearest band and staff step; steps from -8 to 15."""
    middle = F.col("line_ys")[2]
    pairs = components.join(bands, "page_id").withColumn("_d", F.abs(F.col("cy") - middle))
    nearest = pairs.groupBy("page_id", "component").agg(F.min(F.struct("_d", "staff_index", "interline_px", middle.alias("middle"))).alias("b"))
    met = components.join(nearest, ["page_id", "component"]).withColumn("i", F.col("b.interline_px"))
    box = geometry.box(F.col("x0"), F.col("y0"), F.col("x1") + 1, F.col("y1") + 1)
    step = (F.col("b.middle") - F.col("cy")) / (F.col("i") / 2) + 4
    sized = met.where((F.col("area") / (F.col("i") * F.col("i"))).between(*area) & (geometry.width(box) / F.col("i")).between(*side) & (geometry.height(box) / F.col("i")).between(*side))
    return sized.withColumn("staff_step", step).where(F.col("staff_step").between(-8, 15)).select("page_id", "component", "area", "cx", "cy", "x0", "y0", "x1", "y1", F.col("b.staff_index").alias("staff_index"), "staff_step")
