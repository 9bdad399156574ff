"""A bit table of keys, of bounded size, by which rows are let through before a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .shared import schema
from .text import mix

#: Most bits of a table (16 MB); bits for each key below that.
FILTER_BITS, BITS_OF_A_KEY = 1 << 27, 16


@dataclass
class RowFilter:
    """Lets through all rows whose first column, a long, is in the table, and few others: beyond ``FILTER_BITS`` more of them, none less."""

    table: Broadcast
    bits: int

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = mix(keys.view(np.uint64)) % np.uint64(self.bits)
        return ((self.table.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)

    def passing(self, batches):
        for batch in batches:
            hit = self.has(batch.column(0).to_numpy())
            if hit.any():
                yield batch.filter(pa.array(hit))


def row_filter(keys: DataFrame) -> RowFilter:
    """The table of the one column of ``keys``, longs without nulls. Only the table comes to the driver."""
    bits = 1 << 13
    wanted = BITS_OF_A_KEY * keys.count()
    while bits < min(wanted, FILTER_BITS):
        bits *= 2

    def mark(batches):
        table = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            at = mix(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(bits)
            np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([table.tobytes()], pa.binary())], names=["g", "bits"])

    def merge(batches):
        table = None
        for batch in batches:
            for x in batch.column("bits").to_pylist():
                got = np.frombuffer(x, np.uint8)
                table = got.copy() if table is None else table | got
        if table is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([table.tobytes()], pa.binary())], names=["g", "bits"])

    kind = schema("g int, bits binary")
    rows = keys.coalesce(16).mapInArrow(mark, kind).repartition(1).mapInArrow(merge, kind).collect()
    table = np.frombuffer(bytes(rows[0]["bits"]), np.uint8) if rows else np.zeros(bits // 8, dtype=np.uint8)
    return RowFilter(keys.sparkSession.sparkContext.broadcast(table), bits)
