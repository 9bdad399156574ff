"""Boxes as structs x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIND = "struct<x0:double,y0:double,x1:double,y1:double>"


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Null unless x0 < x1 and y0 < y1."""
    made = F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))
    return F.when((x0 < x1) & (y0 < y1), made)


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Column:
    return box(x, y, x + w, y + h)


def to_xywh(b: Column) -> Column:
    return F.struct(b["x0"].alias("x"), b["y0"].alias("y"), width(b).alias("width"), height(b).alias("height"))


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def center(b: Column) -> Column:
    return F.struct(((b["x0"] + b["x1"]) / 2).alias("x"), ((b["y0"] + b["y1"]) / 2).alias("y"))


def contains(b: Column, x: Column, y: Column) -> Column:
    """Edges included."""
    return x.between(b["x0"], b["x1"]) & y.between(b["y0"], b["y1"])


def intersects(a: Column, b: Column) -> Column:
    """Boxes that only touch do not."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def intersection(a: Column, b: Column) -> Column:
    return box(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))


def iou(a: Column, b: Column) -> Column:
    common = F.coalesce(area(intersection(a, b)), F.lit(0.0))
    return common / (area(a) + area(b) - common)


def translate(b: Column, dx: Column | float, dy: Column | float) -> Column:
    return box(b["x0"] + dx, b["y0"] + dy, b["x1"] + dx, b["y1"] + dy)


def expand(b: Column, by: Column | float) -> Column:
    return box(b["x0"] - by, b["y0"] - by, b["x1"] + by, b["y1"] + by)
