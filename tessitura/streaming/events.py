"""Streams of timed rows: windowed label counts, gap clusters and interval assignment."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watermarked(stream: DataFrame, ts: str, late: str) -> DataFrame:
    """``ts`` as an instant (wall-clock times cannot carry a watermark) that may be ``late``."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def windowed_labels(stream: DataFrame, ts: str, every: str, label: Column, labels: Sequence[str]) -> DataFrame:
    """Counts of each label by tumbling window, zeros included."""
    counted = stream.groupBy(F.window(ts, every)).agg(*(F.count_if(label == x).alias(x) for x in labels))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *labels)


def in_intervals(stream: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, start: str, end: str) -> DataFrame:
    """Stream rows with the half-open intervals of a static relation that hold them."""
    return stream.join(intervals, list(keys)).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end)))


def gap_clusters(stream: DataFrame, key: str, ts: str, gap_seconds: float) -> DataFrame:
    """(key, start, end, n) of each cluster whose rows lie ``gap_seconds`` or less apart, the gap itself linking.

    A cluster is given out once the watermark has passed its last row by more than the gap. The state of a key is its open clusters, three
    numbers each; rows may come out of order within the watermark.
    """
    gap = pd.Timedelta(seconds=gap_seconds)
    kind = stream.schema[key].dataType.simpleString()

    def fold(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spans = [tuple(s) for s in state.get[0]] if state.exists else []
        for frame in frames:
            spans += [(t.value, t.value, 1) for t in frame[ts]]
        joined: list[list[int]] = []
        for a, b, n in sorted(spans):
            if joined and a - joined[-1][1] <= gap.value:
                joined[-1] = [joined[-1][0], max(b, joined[-1][1]), joined[-1][2] + n]
            else:
                joined.append([a, b, n])
        seen = state.getCurrentWatermarkMs() * 1_000_000
        closed = [s for s in joined if s[1] + gap.value < seen]
        left = [s for s in joined if s[1] + gap.value >= seen]
        if left:
            state.update((left,))
            state.setTimeoutTimestamp(max(int(min(s[1] for s in left) + gap.value) // 1_000_000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: [name[0]] * len(closed), "start": [pd.Timestamp(s[0]) for s in closed], "end": [pd.Timestamp(s[1]) for s in closed], "n": [s[2] for s in closed]})

    return stream.groupBy(key).applyInPandasWithState(fold, f"`{key}` {kind}, start timestamp, end timestamp, n long", "spans array<array<long>>", "append", GroupStateTimeout.EventTimeTimeout)
