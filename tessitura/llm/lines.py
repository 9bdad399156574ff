"""Line de-duplication over overlapping windows of three lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rowfilter import row_filter
from .shared import bounded_batches, extended, spare, stored

#: Stands for a null key in the order of documents: before all others.
NULL_KEY = -(2**63)


def line_windows(docs: DataFrame, *, key: str, text: str, width: int) -> DataFrame:
    """One row for each window of ``width`` lines of one text: (key, body, start, window), window being the md5 of the lines."""
    lines = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NULL_KEY)).alias("key"), F.xxhash64(f"`{text}`").alias("body"), F.split(f"`{text}`", "\n").alias("lines"))
    digest = F.transform(F.sequence(F.lit(0), F.size("lines") - width), lambda i: F.unhex(F.md5(F.array_join(F.slice("lines", i + 1, width), "\n"))))
    return lines.where(F.size("lines") >= width).select("key", "body", F.posexplode(digest).alias("start", "window"))


def repeated_starts(docs: DataFrame, *, key: str, text: str, width: int) -> DataFrame:
    """(key, body, starts) of texts with windows that occur earlier: under a smaller key, or before in the same text."""
    windows = line_windows(docs, key=key, text=text, width=width)
    first = windows.groupBy("window").agg(F.min(F.struct("key", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(first, "window").where(F.struct("key", "start") > F.col("first"))
    return later.groupBy("key", "body").agg(F.collect_set("start").alias("starts"))


def drop_repeated_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """Adds n_lines, n_removed and kept: the text without the lines that later windows cover.

    Lines are what stands between line feeds, compared byte for byte. A window is ``width`` consecutive lines of one text; it is later if
    the same lines start earlier, under a smaller key or above in the same text. All windows are judged on the input. The lines that later
    windows cover go, overlapping windows merged. A null text has no lines and stays null; an empty one has one empty line. Texts of fewer
    lines keep them all. Rows that repeat both key and text are one text read twice, and fare alike; a null key comes before all others.
    Extra columns stay. A window's count is partially summed before its shuffle, and hot windows meet their first place in a join that
    adaptive execution can split. Texts without a later window are told by a row filter and are not shuffled.
    """
    bounded_batches(docs.sparkSession)
    k, b, held, own, moves = (spare(docs, name) for name in ("_key", "_body", "_starts", "_own", "_moves"))
    own_key, own_body = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NULL_KEY)), F.xxhash64(f"`{text}`")
    starts = stored(repeated_starts(docs, key=key, text=text, width=width).select(F.col("key").alias(k), F.col("body").alias(b), F.col("starts").alias(held)))
    # only texts that may have a repeated window move; the others stay where they are read
    some = row_filter(starts.select(F.xxhash64(k, b).alias(own)))
    named = docs.select(F.xxhash64(own_key, own_body).alias(own), "*")
    moved = named.mapInArrow(some.passing, named.schema).drop(own)
    joined = moved.join(starts.hint("merge"), (own_key == F.col(k)) & (own_body == F.col(b)), "left").drop(k, b)

    def whole(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(text)
        lines = pc.fill_null(pc.add(pc.count_substring(texts, "\n"), 1), 0).cast(pa.int64())
        return [lines, pa.array(np.zeros(batch.num_rows, dtype=np.int64)), texts, pa.array(some.has(batch.column(own).to_numpy()))]

    still = extended(named, whole, f"n_lines long, n_removed long, kept string, {moves} boolean").where(~F.col(moves)).drop(own, moves)

    def keep(batch: pa.RecordBatch) -> list[pa.Array]:
        total, removed, kept = [], [], []
        for body, starts in zip(batch.column(text).to_pylist(), batch.column(held).to_pylist(), strict=True):
            lines = [] if body is None else body.split("\n")
            covered = {s + k for s in starts or () for k in range(width)}
            total.append(len(lines))
            removed.append(len(covered))
            kept.append(body if not covered else "\n".join(x for i, x in enumerate(lines) if i not in covered))
        return [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]

    return still.unionByName(extended(joined, keep, "n_lines long, n_removed long, kept string").drop(held))
