"""Scores of shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def trapezoid(value: Column, low: float, ideal_low: float, ideal_high: float, high: float) -> Column:
    """1 in the ideal range, 0 at ``low`` and ``high`` and beyond, linear between."""
    rising = (value - low) / (ideal_low - low) if ideal_low > low else F.lit(1.0)
    falling = (F.lit(high) - value) / (high - ideal_high) if high > ideal_high else F.lit(1.0)
    return F.when((value <= low) | (value >= high), 0.0).when(value < ideal_low, rising).when(value <= ideal_high, 1.0).otherwise(falling)


def weighted(parts: Sequence[tuple[float, Column]], *, keep: float = 1.0, prior: float = 0.0) -> Column:
    """The weighted sum of ``parts``, mixed with a prior and held within 0 and 1."""
    total = F.lit(0.0)
    for weight, part in parts:
        total = total + F.lit(weight) * part
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total * keep + (1 - keep) * prior))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def dot(width: Column, height: Column, area: Column, right_of: Column, reach: Column, step_error: Column, unit: Column) -> Column:
    """How well a component fits an augmentation dot, 0 if a bound is broken.

    ``right_of``: how far its centre lies behind the symbol's right edge, ``reach``: behind its left one; ``step_error``: staff steps to the
    nearest place where the dot may stand.
    """
    density, aspect, w, h = area / (width * height), width / height, width / unit, height / unit
    sound = (density >= 0.35) & aspect.between(0.45, 2.2) & w.between(0.1, 0.7) & h.between(0.1, 0.7) & (area / (unit * unit)).between(0.015, 0.35)
    near = (right_of > 0) & (reach <= unit * 3) & (step_error <= 1.1)
    size = lambda x: trapezoid(x, 0.1, 0.18, 0.45, 0.7)
    shape = trapezoid(aspect, 0.45, 0.75, 1.45, 2.2)
    full = F.when(density >= 0.55, F.when(density <= 1, 1.0).otherwise(0.0)).otherwise((density - 0.35) / 0.2)
    place = F.greatest(F.lit(0.0), 1 - step_error / 1.1)
    return F.when(sound & near, 0.2 * size(w) + 0.2 * size(h) + 0.2 * shape + 0.25 * place + 0.15 * full).otherwise(0.0)


def dot_step_error(step: Column, symbol_step: Column) -> Column:
    """Steps from a dot to its symbol's own place, or where that is on a line also to the spaces beside it."""
    line = F.bround(symbol_step, 0)
    on_line = (F.abs(symbol_step - line) <= 0.25) & (F.pmod(line, F.lit(2)) == 0)
    own = F.abs(step - symbol_step)
    return F.when(on_line, F.least(own, F.abs(step - line - 1), F.abs(step - line + 1))).otherwise(own)
