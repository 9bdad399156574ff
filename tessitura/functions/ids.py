"""Identifiers: formatted, parsed and numbered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def format_id(prefix: str, index: Column, width: int = 3) -> Column:
    """``prefix-007``; longer numbers keep their digits. Null for a negative index or a prefix that is not a lower-case identifier."""
    text = index.cast("string")
    sound = F.lit(prefix).rlike("^[a-z][a-z0-9_]*$") & (index >= 0)
    return F.when(sound, F.concat(F.lit(prefix + "-"), F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))))


def parse_id(identifier: Column) -> tuple[Column, Column]:
    """(prefix, number) at the last hyphen; nulls if there is none before digits."""
    pattern = "^(.*)-([0-9]+)$"
    fits = identifier.rlike(pattern)
    return F.when(fits, F.regexp_extract(identifier, pattern, 1)), F.when(fits, F.regexp_extract(identifier, pattern, 2).cast("bigint"))


def digits(text: Column) -> Column:
    """All digits of a text as one number, else null."""
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit("")).cast("bigint")


def last_digits(text: Column) -> Column:
    """The number that a text ends with, else null."""
    return F.nullif(F.regexp_extract(text, "([0-9]+)$", 1), F.lit("")).cast("bigint")


def staff_of(measure_id: Column) -> Column:
    """The staff index in ``..._s<n>_...``, else null."""
    return F.nullif(F.regexp_extract(measure_id, "_s([0-9]+)_", 1), F.lit("")).cast("int")


def measure_id(system: Column, number: Column) -> Column:
    return F.concat(F.lit("s"), system.cast("string"), F.lit("_m"), number.cast("string"))


def with_ids(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], prefix: str, out: str, *, seed: int = 1, width: int = 3) -> DataFrame:
    """Numbers rows within ``keys`` from ``seed`` and formats the numbers."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) + F.lit(seed - 1)
    return df.withColumn(out, format_id(prefix, number, width))
