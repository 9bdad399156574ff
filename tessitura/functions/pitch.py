"""Pitches from staff positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "CDEFGAB"

# Letter and octave of the lowest line by clef sign and line.
LOWEST_LINE = {("G", 2): ("E", 4), ("F", 4): ("G", 2), ("C", 3): ("F", 3), ("C", 4): ("E", 3), ("G", 1): ("D", 4), ("F", 3): ("D", 2), ("C", 1): ("E", 3), ("C", 2): ("D", 3), ("C", 5): ("A", 2)}
FALLBACK = ("E", 4)


def _number(letter: str, octave: int) -> int:
    return 7 * octave + LETTERS.index(letter)


def of_step(step: Column, sign: Column, line: Column) -> tuple[Column, Column]:
    """(letter, octave) at a staff step, 0 being the lowest line and halves rounded to even; octaves are held within 0 and 9."""
    base = F.lit(_number(*FALLBACK))
    for (s, n), (letter, octave) in LOWEST_LINE.items():
        base = F.when((sign == s) & (line == n), F.lit(_number(letter, octave))).otherwise(base)
    n = base + F.bround(step, 0).cast("int")
    letter = F.substring(F.lit(LETTERS), F.pmod(n, F.lit(7)) + 1, F.lit(1))
    return letter, F.greatest(F.lit(0), F.least(F.lit(9), F.floor(n / 7))).cast("int")


def key(step: Column, alter: Column, octave: Column) -> Column:
    """``C+0:4``."""
    return F.format_string("%s%+d:%d", step, alter, octave)


def staff_step(line_ys: Column, interline: Column, y: Column) -> Column:
    """Half interlines above the lowest line, measured from the middle one."""
    return (F.element_at(line_ys, 3) - y) / (interline / 2) + 4
