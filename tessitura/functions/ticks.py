"""Musical time in ticks, 1920 to a whole note."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE, QUARTER = 1920, 480

# The note types and their ticks.
TICKS = {"whole": 1920, "half": 960, "quarter": 480, "eighth": 240, "16th": 120, "32nd": 60, "64th": 30}


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def of_name(name: Column) -> Column:
    return _lookup(TICKS, name)


def name_of(ticks: Column) -> Column:
    return _lookup({v: k for k, v in TICKS.items()}, ticks)


def per_measure(beats: Column, beat_type: Column) -> Column:
    return F.floor(beats * WHOLE / beat_type).cast("int")


def dotted(base: Column, dots: Column) -> Column:
    """Half of the base for the first dot, a quarter for the second, both rounded down; more than two dots count for nothing."""
    half, quarter = F.floor(base / 2).cast("int"), F.floor(base / 4).cast("int")
    return base + F.when(dots == 1, half).when(dots == 2, half + quarter).otherwise(F.lit(0))


def label(ticks: Column) -> Column:
    """``half.`` and the like for whole to 16th notes with up to two dots, else ``unknown:<ticks>``."""
    known = {base * num // den: name + mark for name, base in TICKS.items() if base >= 120 for mark, num, den in (("", 1, 1), (".", 3, 2), ("..", 7, 4))}
    return F.coalesce(_lookup(known, ticks), F.concat(F.lit("unknown:"), ticks.cast("string")))


def of_duration(duration: Column, divisions: Column) -> Column:
    """Ticks of a duration in divisions of a quarter, rounded half to even."""
    return F.bround(duration * QUARTER / divisions, 0).cast("int")


def typed_label(note_type: Column, dots: Column) -> Column:
    return F.concat(F.lower(F.trim(note_type)), F.repeat(F.lit("."), dots))


def units(num: Column, den: Column, divisions: Column) -> Column:
    """A duration of ``num / den`` whole notes in divisions of a quarter; null if that is no integer."""
    total = num * 4 * divisions
    return F.when(total % den == 0, (total / den).cast("int"))


def duration_of(filled: Column, stem: Column, flags: Column, dots: Column) -> tuple[Column, Column]:
    """(numerator, denominator) of a note from its looks: open heads are wholes or halves, filled ones quarters less their flags.

    Each dot adds half of what the one before added, so that ``d`` dots make 2 - 2**-d times the length.
    """
    den = F.when(filled, F.when(stem & flags.between(1, 4), F.shiftleft(F.lit(4), 1) * F.element_at(F.array(*map(F.lit, (1, 2, 4, 8))), F.greatest(F.lit(1), F.least(flags, F.lit(4))))).otherwise(4)).otherwise(F.when(stem, 2).otherwise(1))
    over = F.element_at(F.array(*map(F.lit, (1, 2, 4, 8))), F.least(F.greatest(dots, F.lit(0)), F.lit(3)) + 1)
    return (2 * over - 1).cast("int"), (den * over).cast("int")
