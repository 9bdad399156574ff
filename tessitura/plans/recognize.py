"""From page images to scores in one call: bands, systems, bars, heads, stems, decoded measures, and the nested score.

Held: filled and open heads, stems, bars, five-line staves of one given clef and time. Not held: rests, accidentals, dots, flags, key signs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import aggregate, sequence
from ..sources import musicxml, score_json
from ..vision import detect
from ..vision import pages as vision
from . import assembly

PAGE_STAFF = ["page_id", "staff_index"]
EVENTS = "array<struct<x:double,kind:string,pitch:struct<step:string,octave:int,alter:int>,ticks:int>>"


@dataclass(frozen=True)
class Profile:
    """What is not read from the page: the clef and time of all staves."""

    clef_sign: str = "G"
    clef_line: int = 2
    beats: int = 4
    beat_type: int = 4


#: Profiles by name; ``profile_of`` chooses by a word in the path.
PROFILES = {"default": Profile(), "cello": Profile("F", 4)}


def profile_of(path: str) -> Profile:
    return next((p for name, p in PROFILES.items() if name in path.lower()), PROFILES["default"])


def staves(pages: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bands with clefs, members of systems with their place, left and right ends of systems)."""
    profiles = vision.row_profiles(pages)
    bands = vision.staff_bands(vision.staff_lines(profiles)).withColumns({"clef_sign": F.lit(profile.clef_sign), "clef_line": F.lit(profile.clef_line)}).persist()
    # a band's lower edge is where the gap to the next begins
    edges = bands.withColumns({"_low": F.col("line_ys")[4], "_high": F.col("line_ys")[0]})
    members = sequence.split_systems(edges, ["page_id"], ["staff_index"], "_low", "_high", "interline_px").select(*PAGE_STAFF, "system_index")
    members = members.withColumn("pos", F.row_number().over(Window.partitionBy("page_id", "system_index").orderBy("staff_index")) - 1).persist()
    rows = bands.select(*PAGE_STAFF, F.explode("line_ys").alias("y")).withColumn("y", F.bround("y", 0).cast("int"))
    ends = rows.join(profiles, ["page_id", "y"]).join(members, PAGE_STAFF).groupBy(*assembly.SYSTEM)
    return bands, members, ends.agg(F.min("first").cast("double").alias("x_left"), F.max("last").cast("double").alias("x_right"))


def bars(runs: DataFrame, bands: DataFrame, members: DataFrame) -> DataFrame:
    """Bars of systems: columns of ink from a staff's first line to its last."""
    met = runs.join(bands, "page_id").where((F.col("y0") <= F.col("line_ys")[0] + 1) & (F.col("y1") >= F.col("line_ys")[4]))
    return assembly.system_barlines(met.select(*PAGE_STAFF, F.col("x").cast("double").alias("x")).distinct(), members, 4.0)


def heads(pages: DataFrame, bands: DataFrame) -> DataFrame:
    """Noteheads with their staff step; filled where ink covers 45 % of the box or more."""
    found = vision.candidates(vision.clear_components(pages, bands), bands)
    cover = F.col("area") / ((F.col("x1") + 1 - F.col("x0")) * (F.col("y1") + 1 - F.col("y0")))
    return found.withColumns({"symbol_idx": F.col("component"), "kind": F.lit("notehead"), "is_filled": cover >= 0.45, "confidence": F.lit(1.0)}).drop("component")


def decoded_events(pages: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events of measures with pitch and ticks, measure spans, members). Relations that several joins read are kept, so that pages are decoded once for each kind."""
    bands, members, ends = staves(pages, profile)
    runs = detect.column_runs(pages, least=8, method="otsu").persist()
    spans = assembly.measure_boundaries(bars(runs, bands, members), ends).persist()
    marked = assembly.pitched(heads(pages, bands), bands).persist()
    units = bands.select(*PAGE_STAFF, "interline_px")
    stemmed = detect.attach_stems(marked.join(units, PAGE_STAFF).drop("interline_px"), detect.stems(runs, bands)).select("page_id", "symbol_idx", F.lit(True).alias("has_stem"))
    evidence = stemmed.withColumns({"flag_count": F.lit(0), "dot_count": F.lit(0)})
    placed = assembly.symbols_in_measures(marked, members.select(*PAGE_STAFF, "system_index"), spans)
    # every staff of a system has measures of its own
    own = placed.withColumn("measure_id", F.concat_ws("_", "measure_id", "staff_index")).persist()
    chosen = assembly.decode_pages(assembly.measure_evidence(own, evidence), profile.beats, profile.beat_type)
    taken = chosen.select("page_id", "measure_id", F.explode("selected").alias("h")).select("page_id", "measure_id", "h.symbol_id", "h.ticks")
    named = own.withColumn("symbol_id", F.format_string("nh_%d", "symbol_idx"))
    return named.join(taken, ["page_id", "measure_id", "symbol_id"]), spans, members


def _length(ticks: Column) -> Column:
    common = aggregate.gcd(ticks.cast("long"), F.lit(1920).cast("long"))
    return F.struct((ticks / common).cast("int").alias("numerator"), (F.lit(1920) / common).cast("int").alias("denominator"))


def build_scores(events: DataFrame, spans: DataFrame, members: DataFrame, profile: Profile) -> DataFrame:
    """Nested scores, one a page: a part for each place in a system, measures numbered over systems, a rest for what a measure lacks."""
    expected = profile.beats * 1920 // profile.beat_type
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("system_index", "measure_number"))
    slots = spans.withColumn("number", number).join(members, assembly.SYSTEM).select("page_id", "pos", "staff_index", "system_index", "measure_number", "number")
    pitch = F.struct("step", "octave", "alter")
    note = F.struct(F.col("cx").alias("x"), F.lit("note").alias("kind"), pitch.alias("pitch"), "ticks")
    sounding = events.groupBy("page_id", "staff_index", "system_index", "measure_number").agg(F.array_sort(F.collect_list(note)).alias("notes"), F.sum("ticks").alias("total"))
    rows = slots.join(sounding, ["page_id", "staff_index", "system_index", "measure_number"], "left")
    missing = F.lit(expected) - F.coalesce("total", F.lit(0))
    rest = F.struct(F.lit(1e9).alias("x"), F.lit("rest").alias("kind"), F.lit(None).cast("struct<step:string,octave:int,alter:int>").alias("pitch"), missing.cast("int").alias("ticks"))
    none = F.array().cast(EVENTS)
    listed = F.concat(F.coalesce(F.col("notes").cast(EVENTS), none), F.when(missing > 0, F.array(rest).cast(EVENTS)).otherwise(none))
    place = F.concat(F.lit("P"), (F.col("pos") + 1).cast("string"), F.lit("_m"), F.col("number").cast("string"))
    made = F.transform(listed, lambda e, k: F.struct(e["kind"].alias("kind"), F.concat(place, F.lit("_v1_e"), (k + 1).cast("string")).alias("id"), e["pitch"].alias("pitch"), _length(e["ticks"]).alias("duration"), F.lit(1).alias("voice")))
    clef = F.struct(F.lit(profile.clef_sign).alias("sign"), F.lit(profile.clef_line).alias("line"))
    given = F.struct(clef.alias("clef"), F.struct(F.lit(profile.beats).alias("beats"), F.lit(profile.beat_type).alias("beat_type")).alias("time"))
    measure = F.struct("number", F.struct(place.alias("id"), "number", F.when(F.col("number") == 1, given).alias("attributes"), F.array(F.struct(F.lit("v1").alias("id"), F.col("events").alias("events"))).alias("voices")).alias("m"))
    parts = rows.withColumn("events", made).groupBy("page_id", "pos").agg(F.array_sort(F.collect_list(measure)).alias("ms"))
    part = F.struct("pos", F.concat(F.lit("P"), (F.col("pos") + 1).cast("string")).alias("id"), F.concat(F.lit("Part "), (F.col("pos") + 1).cast("string")).alias("name"), F.transform("ms", lambda x: x["m"]).alias("measures"))
    scores = parts.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.to_json(part).alias("json")))), lambda x: x["json"]).alias("parts"))
    text = F.format_string('{"ir_version":"0.1.0","id":"%s","title":"%s","parts":[%s]}', "page_id", "page_id", F.array_join("parts", ","))
    return score_json.parse_scores(scores.select(text.alias("json")), "json")


def recognize(pages: DataFrame, profile: Profile = PROFILES["default"]) -> DataFrame:
    """Scores of page images (page_id, width, height, channels, data); pages without staves or bars give none."""
    return build_scores(*decoded_events(pages, profile), profile)


def recognize_to_musicxml(pages: DataFrame, profile: Profile = PROFILES["default"]) -> DataFrame:
    """id, xml and error of each page that gives a score."""
    return musicxml.to_musicxml(recognize(pages, profile))
