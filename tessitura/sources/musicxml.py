"""MusicXML: readers of measure, duration and count relations, and a writer."""

from __future__ import annotations

import math
import xml.etree.ElementTree as ET
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ticks
from ..operators import sequence

NOTE = "struct<_id:string,chord:string,rest:string,pitch:struct<step:string,alter:int,octave:int>,duration:int,voice:int,type:string,dot:array<string>,tie:array<struct<_type:string>>,lyric:array<struct<text:string>>>"
ATTRIBUTES = "array<struct<divisions:int,key:struct<fifths:int,mode:string>,time:struct<beats:int,`beat-type`:int>,clef:array<struct<sign:string,line:int>>>>"
DOCUMENT = f"part array<struct<_id:string,measure:array<struct<_number:string,attributes:{ATTRIBUTES},note:array<{NOTE}>>>>>"


def read_measures(spark: SparkSession, path: str) -> DataFrame:
    """fixture (file name without suffix), part_idx, measure_idx, number, attributes and notes of partwise documents."""
    docs = spark.read.format("xml").option("rowTag", "score-partwise").schema(DOCUMENT).load(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1)
    return _measures(docs.select(name.alias("fixture"), "part"))


def parse_measures(df: DataFrame, name: str, text: str) -> DataFrame:
    """Like ``read_measures``, from a column of documents; ``name`` becomes the fixture."""
    return _measures(df.select(F.col(name).alias("fixture"), F.from_xml(text, DOCUMENT).alias("_x")).select("fixture", "_x.part"))


def _measures(docs: DataFrame) -> DataFrame:
    parts = docs.select("fixture", F.posexplode("part").alias("part_idx", "_p"))
    rows = parts.select("fixture", "part_idx", F.posexplode("_p.measure").alias("measure_idx", "_m"))
    return rows.select("fixture", "part_idx", "measure_idx", F.col("_m._number").alias("number"), F.try_element_at("_m.attributes", F.lit(1)).alias("attributes"), F.coalesce("_m.note", F.array().cast(f"array<{NOTE}>")).alias("notes"))


def measure_counts(measures: DataFrame) -> DataFrame:
    return measures.groupBy("fixture").agg(F.count("*").alias("measures"))


def event_counts(measures: DataFrame) -> DataFrame:
    """Pitched notes and rests; a note with a pitch is pitched whatever else it holds."""
    notes = measures.select("fixture", F.explode("notes").alias("n"))
    return notes.groupBy("fixture").agg(F.count_if(F.col("n.pitch").isNotNull()).alias("pitched"), F.count_if(F.col("n.pitch").isNull() & F.col("n.rest").isNotNull()).alias("rests"))


def first_attributes(measures: DataFrame) -> DataFrame:
    """Clef, time and key of a file's first measure that has attributes."""
    first = measures.where("attributes is not null").groupBy("fixture").agg(F.min_by("attributes", F.struct("part_idx", "measure_idx")).alias("a"))
    clef = F.try_element_at("a.clef", F.lit(1))
    return first.select("fixture", clef["sign"].alias("clef_sign"), clef["line"].alias("clef_line"), F.col("a.time.beats").alias("beats"), F.col("a.time.beat-type").alias("beat_type"), F.col("a.key.fifths").alias("fifths"))


def gt_measures(measures: DataFrame) -> DataFrame:
    """fixture, measure_idx (from 1), expected_ticks, event_ticks and labels: durations with divisions and time carried forward, chord tones left out."""
    keys, order = ["fixture", "part_idx"], ["measure_idx"]
    carried = sequence.carry_forward(measures, keys, order, F.col("attributes.divisions"), "divisions")
    carried = sequence.carry_forward(carried, keys, order, F.when(F.col("attributes.time.beats").isNotNull(), F.col("attributes.time")), "meter")
    sounding = F.filter("notes", lambda n: n["chord"].isNull() & n["duration"].isNotNull())
    length = F.transform(sounding, lambda n: ticks.of_duration(n["duration"], F.coalesce("divisions", F.lit(1))))
    label = F.transform(sounding, lambda n: F.when(n["type"].isNull(), ticks.label(ticks.of_duration(n["duration"], F.coalesce("divisions", F.lit(1))))).otherwise(ticks.typed_label(n["type"], F.coalesce(F.size(n["dot"]), F.lit(0)))))
    expected = ticks.per_measure(F.coalesce("meter.beats", F.lit(4)), F.coalesce(F.col("meter.beat-type"), F.lit(4)))
    return carried.select("fixture", (F.col("measure_idx") + 1).alias("measure_idx"), expected.alias("expected_ticks"), length.alias("event_ticks"), label.alias("labels"))


# Printed note types.
_TYPES = {Fraction(1, 1 << k): name for k, name in enumerate(("whole", "half", "quarter", "eighth", "16th", "32nd"))}


def _node(parent: ET.Element, tag: str, body: object = None, **attributes: object) -> ET.Element:
    child = ET.SubElement(parent, tag, {k: str(v) for k, v in attributes.items()})
    if body is not None:
        child.text = str(body)
    return child


def _digits(name: str) -> str:
    return "".join(c for c in name if c.isdigit())


def _staff(event: dict) -> int | None:
    _, mark, tail = event["id"].partition("_s")
    number = tail.partition("_")[0]
    return int(number) if mark and number.isdigit() and "_" in tail else None


def _shape(length: Fraction) -> tuple[str, int]:
    if length in _TYPES:
        return _TYPES[length], 0
    return (_TYPES[length * 2 / 3], 1) if length * 2 / 3 in _TYPES else ("quarter", 0)


def _joined(marks: list[str]) -> list[str]:
    """A continued tie ends and begins."""
    return [x for m in marks for x in (("stop", "start") if m == "continue" else (m,)) if x in ("start", "stop")]


def _write_event(measure: ET.Element, event: dict, voice: str, divisions: int, staves: dict[int, int]) -> None:
    is_note = event["kind"] == "note"
    length = Fraction(event["duration"]["numerator"], event["duration"]["denominator"])
    units = length * 4 * divisions
    if units.denominator != 1:
        raise ValueError(f"a duration of {length} has no integer number of units at {divisions} divisions")
    note = _node(measure, "note", id=event["id"])
    if staves:
        _node(note, "staff", staves.get(_staff(event), 1))
    if is_note and event["chord"]:
        _node(note, "chord")
    if is_note:
        at, alter = _node(note, "pitch"), event["pitch"]["alter"] or 0
        for tag, value in (("step", event["pitch"]["step"]), ("alter", alter or None), ("octave", event["pitch"]["octave"])):
            if value is not None:
                _node(at, tag, value)
        for kind in _joined(event["ties"] or []):
            _node(note, "tie", type=kind)
    else:
        _node(note, "rest")
    _node(note, "duration", units.numerator)
    _node(note, "voice", event["voice"] or voice)
    shape, dots = _shape(length)
    _node(note, "type", shape)
    for _ in range(dots):
        _node(note, "dot")
    if not is_note:
        return
    if ratio := event["tuplet_ratio"]:
        change = _node(note, "time-modification")
        _node(change, "actual-notes", ratio["actual_notes"])
        _node(change, "normal-notes", ratio["normal_notes"])
    for k, beam in enumerate(event["beams"] or [], 1):
        _node(note, "beam", beam, number=k)
    if any((event["ties"], event["slurs"], event["articulations"], event["tuplet"] is not None, event["fingering"] is not None)):
        marks = _node(note, "notations")
        for kind in _joined(event["ties"] or []):
            _node(marks, "tied", type=kind)
        for kind in event["slurs"] or []:
            _node(marks, "slur", type=kind, number=1)
        if event["articulations"]:
            group = _node(marks, "articulations")
            for name in event["articulations"]:
                _node(group, name)
        if event["tuplet"] is not None:
            _node(marks, "tuplet", type=event["tuplet"], number=1)
        if event["fingering"] is not None:
            _node(_node(marks, "technical"), "fingering", event["fingering"])
    if event["lyric"] is not None:
        _node(_node(note, "lyric"), "text", event["lyric"])


def _write_attributes(measure: ET.Element, given: dict | None, divisions: int, staves: int) -> None:
    at = _node(measure, "attributes")
    _node(at, "divisions", divisions)
    if staves > 1:
        _node(at, "staves", staves)
    for tag, source, fields in (("key", "key", (("fifths", "fifths"), ("mode", "mode"))), ("time", "time", (("beats", "beats"), ("beat-type", "beat_type"))), ("clef", "clef", (("sign", "sign"), ("line", "line")))):
        if given and given[source]:
            group = _node(at, tag)
            for name, field in fields:
                _node(group, name, given[source][field])


def _write_direction(measure: ET.Element, direction: dict) -> None:
    kind, value = direction["kind"], direction["value"]
    at = _node(_node(measure, "direction", placement=direction["placement"] or "above", id=direction["id"]), "direction-type")
    if kind == "dynamic":
        _node(_node(at, "dynamics"), value)
    elif kind == "wedge":
        _node(at, "wedge", type=value, number=direction["number"] or 1)
    else:
        _node(at, "rehearsal" if kind == "rehearsal" else "words", value)


def document(score: dict) -> str:
    """The partwise MusicXML of one nested score."""
    events = [e for p in score["parts"] for m in p["measures"] for v in m["voices"] for e in v["events"] or []]
    common = math.lcm(*(e["duration"]["denominator"] for e in events)) if events else 1
    root = ET.Element("score-partwise", version="4.0")
    _node(_node(root, "work"), "work-title", score["title"])
    listed = _node(root, "part-list")
    for part in score["parts"]:
        _node(_node(listed, "score-part", id=part["id"]), "part-name", part["name"])
    for part in score["parts"]:
        own = sorted({s for m in part["measures"] for v in m["voices"] for e in v["events"] or [] if (s := _staff(e)) is not None})
        staves = {s: k for k, s in enumerate(own, 1)} if len(own) > 1 else {}
        top, divisions = _node(root, "part", id=part["id"]), common
        for k, m in enumerate(part["measures"]):
            at, given = _node(top, "measure", number=m["number"]), m["attributes"]
            if k == 0 or given is not None:
                divisions = (given and given["divisions"]) or divisions
                _write_attributes(at, given, divisions, len(staves))
            for direction in m["directions"] or []:
                _write_direction(at, direction)
            for number, voice in enumerate(m["voices"], 1):
                for event in voice["events"] or []:
                    _write_event(at, event, _digits(voice["id"]) or str(number), divisions, staves)
            if m["barline"] and m["barline"]["style"] not in (None, "regular"):
                _node(at, "barline", location="right")
    ET.indent(root, space="  ")
    return ET.tostring(root, encoding="unicode", xml_declaration=True)


def to_musicxml(scores: DataFrame) -> DataFrame:
    """id and ``xml`` of each nested score; ``error`` instead where a duration cannot be written."""

    def write(batches):
        for batch in batches:
            texts, errors = [], []
            for row in batch.to_pylist():
                try:
                    texts.append(document(row))
                    errors.append(None)
                except ValueError as error:
                    texts.append(None)
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["id", "xml", "error"])

    return scores.select("id", "title", "parts").mapInArrow(write, "id string, xml string, error string")
