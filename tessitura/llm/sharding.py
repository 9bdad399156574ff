"""Sharding: rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import spare

#: Rows that one numbering bucket of a shard should hold.
BUCKET_ROWS = 200_000


def race(key: Column, shard: int, weight: float, seed: int) -> Column:
    """The arrival time of a shard for a key: exponential with rate ``weight``, from a hash of key and shard alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, F.lit(shard)), 11)
    unit = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.log(unit) / F.lit(float(weight))


def winner(key: Column, weights: Sequence[float], seed: int) -> Column:
    """The shard that arrives first; shards of weight 0 take nothing. A tie goes to the lower shard."""
    entries = [F.struct(race(key, i, w, seed).alias("at"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    if not entries:
        raise ValueError("a shard of positive weight is needed")
    return (F.least(*entries) if len(entries) > 1 else entries[0])["shard"]


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], *, seed: int = 7, shard: str = "shard", grown_weight: float | None = None, grown: str = "grown_shard") -> DataFrame:
    """Adds the shard of each row, and with ``grown_weight`` the shard it would have beside one more shard of that weight.

    Key and weights alone decide: a row keeps its shard whatever else the table holds, equal keys share a shard, and shard i receives a
    share of keys in proportion to ``weights[i]``. Adding a shard moves rows only into it; removing the last moves only its rows. A null
    key is a key like any other. Column names that ``df`` has already are replaced. No shuffle.
    """
    here = winner(F.col(f"`{key}`"), weights, seed)
    out = df.withColumn(shard, here)
    if grown_weight is not None:
        out = out.withColumn(grown, winner(F.col(f"`{key}`"), [*weights, grown_weight], seed))
    return out


def numbered(df: DataFrame, group: str, order: Sequence[str], *, slot: str = "slot", rows: int = BUCKET_ROWS) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps, and never sorts a whole group in one task.

    A group is cut by a hash of ``order`` into buckets of about ``rows`` rows. Each bucket is numbered on its own, after the rows of the
    buckets before it; their sizes are one small row each. Rows equal in ``order`` share a bucket, so many of them weigh on one task only
    as far as they are equal in all of ``order``. Rows that are equal altogether may swap numbers when a task runs again.
    """
    total = df.count()
    buckets = max(1, -(-total // rows))
    b, upto = spare(df, "bucket"), spare(df, "upto")
    keyed = df.withColumn(b, F.pmod(F.xxhash64(F.lit(3), *(F.col(f"`{c}`") for c in order)), F.lit(buckets)))
    sizes = keyed.groupBy(group, b).agg(F.count("*").alias(upto))
    before = Window.partitionBy(group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(group).alias(f"_{group}"), F.col(b).alias(f"_{b}"), F.coalesce(F.sum(upto).over(before), F.lit(0)).alias(upto))
    local = keyed.withColumn(slot, F.row_number().over(Window.partitionBy(group, b).orderBy(*(F.col(f"`{c}`") for c in order))))
    joined = local.join(sizes, F.col(group).eqNullSafe(F.col(f"_{group}")) & (F.col(b) == F.col(f"_{b}")))
    return joined.withColumn(slot, F.col(upto) + F.col(slot).cast("long") - 1).drop(b, upto, f"_{group}", f"_{b}")


def shard_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 40, grown_weight: float | None = 1.0, seed: int = 7) -> DataFrame:
    """Key, size, checksum, shard, slot and grown shard of every row of ``docs``.

    Size: bytes of the text in UTF-8 plus 16; a null or empty text has none, and checksum 0. Slots count the rows of a shard from 0 without
    gaps. Repeated rows and equal keys are rows of their own with the same shard. An empty table gives an empty result. The text stays where
    it was read: only its size and checksum are shuffled.
    """
    body = F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8")
    slim = docs.select(F.col(f"`{key}`").alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    placed = assign_shards(slim, "doc_id", weights, seed=seed, grown_weight=grown_weight)
    return numbered(placed.withColumn("law", F.lit("key")), "shard", ["doc_id", "size", "text_crc32"])
