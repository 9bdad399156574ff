"""Joins of labels with documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: str, modulus: int, kept_out: int) -> Column:
    """Whether a key's crc32 as text leaves ``kept_out``; false for a null key."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % modulus == kept_out, F.lit(False))


def training_labels(labels: DataFrame, *, key: str, label: str, modulus: int, kept_out: int) -> DataFrame:
    """(key, label) of the labelled keys that may be learnt from, each once; of unlike labels of one key the largest counts."""
    sound = labels.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isin(0, 1) & ~held_out(key, modulus, kept_out))
    return sound.groupBy(F.col(f"`{key}`").cast("long").alias("label_key")).agg(F.max(f"`{label}`").cast("int").alias("label"))
