"""Scores as ordered token rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import score_json

LAST = 2**31 - 1


def token_rows(scores: DataFrame) -> DataFrame:
    """score_id, position (from 0), token: each relation gives its tokens with their places, one sort by place gives the sequence."""
    flat = score_json.measures(scores)
    voices = score_json.voices(flat)
    events = score_json.events(voices)

    def rows(df: DataFrame, place: list, token) -> DataFrame:
        names = ("part", "measure", "section", "voice", "event", "detail")
        at = F.struct(*((F.col(p) if isinstance(p, str) else F.lit(p)).cast("int").alias(n) for p, n in zip(place, names, strict=True)))
        return df.select("score_id", at.alias("place"), token.alias("token"))

    length = F.format_string("%d/%d", "num", "den")
    note = F.concat(F.format_string("note:%s%+d:%d:", "step", "alter", "octave"), length, F.when(F.col("chord"), ":chord").otherwise(""))
    details = F.concat(F.transform("articulations", lambda a: F.concat(F.lit("articulation:"), a)), F.when(F.col("lyric").isNotNull(), F.array(F.concat(F.lit("lyric:"), F.col("lyric")))).otherwise(F.array().cast("array<string>")))
    notes = events.where("kind = 'note'")
    named = scores.select(F.col("id").alias("score_id"))
    parts = scores.select(F.col("id").alias("score_id"), F.posexplode("parts").alias("part_idx", "p"))
    all_rows = [
        rows(named, [-2, 0, 0, 0, 0, 0], F.lit("<BOS>")), rows(named, [-1, 0, 0, 0, 0, 0], F.format_string("<score:%s>", "score_id")), rows(named, [LAST, 0, 0, 0, 0, 0], F.lit("<EOS>")),
        rows(parts, ["part_idx", -1, 0, 0, 0, 0], F.format_string("<part:%s>", "p.id")), rows(flat, ["part_idx", "measure_idx", 0, 0, 0, 0], F.format_string("<measure:%d>", "number")),
        rows(score_json.directions(flat), ["part_idx", "measure_idx", 1, "dir_idx", 0, 0], F.concat_ws(":", F.lit("direction"), "kind", "value", "placement")),
        rows(voices, ["part_idx", "measure_idx", 2, "voice_idx", -1, 0], F.format_string("<voice:%s>", "voice_id")), rows(notes, ["part_idx", "measure_idx", 2, "voice_idx", "event_idx", -1], note),
        rows(events.where("kind = 'rest'"), ["part_idx", "measure_idx", 2, "voice_idx", "event_idx", -1], F.concat(F.lit("rest:"), length)),
        rows(notes.select("*", F.posexplode(details).alias("detail", "body")), ["part_idx", "measure_idx", 2, "voice_idx", "event_idx", "detail"], F.col("body")),
    ]
    union = all_rows[0]
    for more in all_rows[1:]:
        union = union.unionByName(more)
    return union.withColumn("position", F.row_number().over(Window.partitionBy("score_id").orderBy("place")) - 1).select("score_id", "position", "token")
