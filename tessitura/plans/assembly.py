"""From symbols on pages to measures: boundaries, assignment, evidence (without context durations), pitches, and gap filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, pitch
from ..operators import decode, joins, sequence

SYSTEM = ["page_id", "system_index"]


def system_barlines(barlines: DataFrame, members: DataFrame, gap: float) -> DataFrame:
    """Bars of staves brought together by system: those within ``gap`` of the one before are one bar at their mean."""
    met = barlines.join(F.broadcast(members), ["page_id", "staff_index"]).select(*SYSTEM, "x")
    clusters = sequence.gap_clusters(met, SYSTEM, ["x"], F.col("x"), gap)
    return clusters.groupBy(*SYSTEM, "cluster").agg(F.avg("x").alias("x")).drop("cluster")


def measure_boundaries(barlines: DataFrame, extents: DataFrame, *, least: float = 10.0) -> DataFrame:
    """Spans between the left edge of a system, its bars and its right edge; numbered from 1 before spans below ``least`` go.

    ``extents``: page_id, system_index, x_left, x_right.
    """
    edges = extents.select(*SYSTEM, F.col("x_left").alias("x")).union(barlines.select(*SYSTEM, "x")).union(extents.select(*SYSTEM, F.col("x_right").alias("x"))).distinct()
    w = Window.partitionBy(*SYSTEM).orderBy("x")
    spans = edges.withColumn("x_end", F.lead("x").over(w)).withColumn("measure_number", F.row_number().over(w)).where("x_end is not null")
    kept = spans.where(F.col("x_end") - F.col("x") >= least)
    return kept.select(*SYSTEM, "measure_number", F.col("x").alias("x_start"), "x_end", ids.measure_id(F.col("system_index"), F.col("measure_number")).alias("measure_id"))


def symbols_in_measures(symbols: DataFrame, members: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Each symbol with the first measure of its staff's system (0 without one) that holds its centre; others are dropped."""
    placed = joins.lookup_default(symbols, members, ["page_id", "staff_index"], {"system_index": 0})
    pairs = joins.interval_join(placed, boundaries, SYSTEM, "cx", "x_start", "x_end")
    return joins.first_match(pairs, ["page_id", "symbol_idx"], ["measure_number"])


def measure_evidence(symbols: DataFrame, evidence: DataFrame, *, threshold: float | None = None) -> DataFrame:
    """Symbols of measures as decoder input. With ``threshold`` the cost of leaving a symbol out grows with its confidence above it."""
    joined = symbols.join(evidence, ["page_id", "symbol_idx"], "left")
    rows = joined.select("page_id", "measure_id", F.format_string("nh_%d", "symbol_idx").alias("symbol_id"), F.col("cx").alias("x"), "area", "is_filled", F.coalesce("has_stem", F.lit(False)).alias("has_stem"), F.coalesce("flag_count", F.lit(0)).alias("flag_count"), F.coalesce("dot_count", F.lit(0)).alias("dot_count"), (F.col("kind") == "rest").alias("is_rest"), "confidence")
    if threshold is None:
        return rows
    above = F.greatest(F.lit(0.0), F.col("confidence") - threshold)
    return rows.withColumn("skip_score", -(0.25 + above * 5.0) - F.when(F.col("confidence") >= threshold, 1.0).otherwise(0.0))


def decode_pages(rows: DataFrame, beats: int, beat_type: int) -> DataFrame:
    return decode.decode_measures(rows, ["page_id", "measure_id"], F.lit(beats), F.lit(beat_type))


def pitched(symbols: DataFrame, bands: DataFrame, accidentals: DataFrame | None = None) -> DataFrame:
    """Symbols with step, octave and alter by their staff's clef; an accidental (alter other than 0) decides the alteration."""
    met = symbols.join(F.broadcast(bands.select("page_id", "staff_index", "clef_sign", "clef_line")), ["page_id", "staff_index"])
    letter, octave = pitch.of_step(F.col("staff_step"), F.col("clef_sign"), F.col("clef_line"))
    out = met.withColumn("step", letter).withColumn("octave", octave)
    if accidentals is None:
        return out.withColumn("alter", F.lit(0))
    return out.join(accidentals.select("page_id", "symbol_idx", "alter"), ["page_id", "symbol_idx"], "left").withColumn("alter", F.coalesce("alter", F.lit(0)))


def voices_by_stem(symbols: DataFrame, *, within: float = 50.0) -> DataFrame:
    """Voice 1 for stems up, 2 for stems down; a symbol without a stem takes that of the nearest stemmed one of its staff, else 1."""
    own = F.when(F.col("direction") == "up", 1).when(F.col("direction") == "down", 2)
    marked = symbols.withColumn("own", own)
    stemmed = marked.where("own is not null").select("page_id", "staff_index", F.col("symbol_idx").alias("other"), F.col("cx").alias("other_cx"), F.col("own").alias("near_voice"))
    near = joins.nearest(marked, stemmed, ["page_id", "staff_index"], ["page_id", "symbol_idx"], F.abs(F.col("cx") - F.col("other_cx")), ["other"], within=within, kind="left")
    return near.withColumn("voice", F.coalesce("own", "near_voice", F.lit(1))).select(*symbols.columns, "voice")


def fill_measures(events: DataFrame, measures: DataFrame) -> DataFrame:
    """Events (page_id, measure_id, ticks) with a rest for what a measure lacks."""
    return decode.gap_fill(events, measures, ["page_id", "measure_id"], "ticks", "expected_ticks", digits=0)
