"""Score documents as JSON: one nested row for each, and the flat relations of their parts, measures, voices and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = (
    "struct<kind:string,id:string,pitch:struct<step:string,octave:int,alter:int>,duration:struct<numerator:int,denominator:int>,voice:int,ties:array<string>,slurs:array<string>,"
    "articulations:array<string>,beams:array<string>,lyric:string,fingering:string,chord:boolean,tuplet:string,tuplet_ratio:struct<actual_notes:int,normal_notes:int>,"
    "provenance:struct<source:string,producer:string,page:int,bbox:struct<x0:double,y0:double,x1:double,y1:double>,confidence:double,notes:string>>"
)
MEASURE = (
    "struct<id:string,number:int,attributes:struct<clef:struct<sign:string,line:int>,key:struct<fifths:int,mode:string>,time:struct<beats:int,beat_type:int>,divisions:int>,"
    f"barline:struct<style:string>,directions:array<struct<id:string,kind:string,value:string,placement:string,number:int>>,voices:array<struct<id:string,events:array<{EVENT}>>>>"
)
SCORE = f"ir_version string, id string, title string, parts array<struct<id:string,name:string,measures:array<{MEASURE}>>>"


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Documents under ``path``, one a file. ``_broken`` holds the text of those that are no JSON object of this shape."""
    return spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").schema(SCORE + ", _broken string").json(path)


def parse_scores(df: DataFrame, text: str) -> DataFrame:
    """Like ``read_scores``, from a text column."""
    parsed = df.withColumn("_s", F.from_json(text, SCORE + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}))
    return parsed.select("_s.*")


def _filled(array: Column) -> Column:
    return F.coalesce(array, F.array().cast("array<string>"))


def measures(scores: DataFrame) -> DataFrame:
    """score_id, part_idx, part_id, measure_idx, measure_id, number, clef, key, time, divisions, barline_style, directions, voices."""
    parts = scores.select(F.col("id").alias("score_id"), F.posexplode("parts").alias("part_idx", "_p"))
    rows = parts.select("score_id", "part_idx", F.col("_p.id").alias("part_id"), F.col("_p.name").alias("part_name"), F.posexplode("_p.measures").alias("measure_idx", "_m"))
    return rows.select("score_id", "part_idx", "part_id", "part_name", "measure_idx", F.col("_m.id").alias("measure_id"), F.col("_m.number").alias("number"), F.col("_m.attributes.clef").alias("clef"), F.col("_m.attributes.key").alias("key"), F.col("_m.attributes.time").alias("time"), F.col("_m.attributes.divisions").alias("divisions"), F.coalesce("_m.barline.style", F.lit("regular")).alias("barline_style"), F.col("_m.directions").alias("directions"), F.col("_m.voices").alias("voices"))


def directions(measure_rows: DataFrame) -> DataFrame:
    rows = measure_rows.select("score_id", "part_idx", "measure_idx", F.posexplode("directions").alias("dir_idx", "_d"))
    return rows.select("score_id", "part_idx", "measure_idx", "dir_idx", "_d.id", "_d.kind", "_d.value", F.coalesce("_d.placement", F.lit("above")).alias("placement"), F.coalesce("_d.number", F.lit(1)).alias("number"))


def voices(measure_rows: DataFrame) -> DataFrame:
    """Every voice, empty ones too, with its ``events``; the columns of the measure stay."""
    kept = [c for c in measure_rows.columns if c not in ("voices", "directions")]
    return measure_rows.select(*kept, F.posexplode("voices").alias("voice_idx", "_v")).select(*kept, "voice_idx", F.col("_v.id").alias("voice_id"), F.col("_v.events").alias("events"))


def events(voice_rows: DataFrame) -> DataFrame:
    """One row for each note or rest, absent optional fields at their defaults."""
    kept = [c for c in voice_rows.columns if c != "events"]
    rows = voice_rows.select(*kept, F.posexplode("events").alias("event_idx", "_e"))
    return rows.select(
        *kept, "event_idx", "_e.kind", F.col("_e.id").alias("event_id"), F.coalesce("_e.voice", F.lit(1)).alias("voice"), F.col("_e.pitch.step").alias("step"), F.col("_e.pitch.octave").alias("octave"),
        F.when(F.col("_e.pitch").isNotNull(), F.coalesce("_e.pitch.alter", F.lit(0))).alias("alter"), F.col("_e.duration.numerator").alias("num"), F.col("_e.duration.denominator").alias("den"),
        F.coalesce("_e.chord", F.lit(False)).alias("chord"), _filled(F.col("_e.ties")).alias("ties"), _filled(F.col("_e.slurs")).alias("slurs"), _filled(F.col("_e.articulations")).alias("articulations"),
        _filled(F.col("_e.beams")).alias("beams"), "_e.lyric", "_e.fingering", "_e.tuplet", "_e.tuplet_ratio", "_e.provenance",
    )


def violations(event_rows: DataFrame) -> DataFrame:
    """Events with the list of value constraints that they break: rows to quarantine."""
    checks = {
        "blank id": F.trim(F.coalesce("event_id", F.lit(""))) == "", "duration not positive": ~((F.col("num") > 0) & (F.col("den") > 0)), "unknown kind": ~F.col("kind").isin("note", "rest"),
        "step outside A to G": (F.col("kind") == "note") & ~F.coalesce(F.col("step").isin(*"ABCDEFG"), F.lit(False)), "octave outside 0 to 9": ~F.coalesce(F.col("octave").between(0, 9), F.lit(True)),
        "alter outside -2 to 2": ~F.coalesce(F.col("alter").between(-2, 2), F.lit(True)), "voice below 1": F.col("voice") < 1, "tie": ~F.forall("ties", lambda t: t.isin("start", "stop", "continue")),
        "slur": ~F.forall("slurs", lambda t: t.isin("start", "stop", "continue")), "tuplet": ~F.coalesce(F.col("tuplet").isin("start", "stop"), F.lit(True)),
        "tuplet ratio not positive": ~F.coalesce((F.col("tuplet_ratio.actual_notes") > 0) & (F.col("tuplet_ratio.normal_notes") > 0), F.lit(True)),
    }
    broken = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items())), lambda x: x.isNotNull())
    return event_rows.withColumn("violations", broken).where(F.size("violations") > 0)


def to_json(scores: DataFrame) -> DataFrame:
    """id and ``json``: absent fields and empty lists left out."""

    def lists(e: Column) -> Column:
        for name in ("ties", "slurs", "articulations", "beams"):
            e = e.withField(name, F.when(F.size(e[name]) > 0, e[name]))
        return e.withField("chord", F.when(e["chord"], e["chord"]))

    def measure(m: Column) -> Column:
        m = m.withField("voices", F.transform(m["voices"], lambda v: v.withField("events", F.transform(v["events"], lists))))
        return m.withField("directions", F.when(F.size(m["directions"]) > 0, m["directions"]))

    parts = F.transform("parts", lambda p: p.withField("measures", F.transform(p["measures"], measure)))
    return scores.select("id", F.to_json(F.struct("ir_version", "id", "title", parts.alias("parts")), {"ignoreNullFields": "true"}).alias("json"))
