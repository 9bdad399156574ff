"""Semantic validation of scores: all rules as windows and aggregations, one ordered relation of issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, pitch
from ..operators import aggregate, sequence
from ..sources import score_json

PART = ["score_id", "part_idx"]
MEASURE = [*PART, "measure_idx"]
VOICE = [*MEASURE, "voice_idx"]
EVENT = [*VOICE, "event_idx"]
LAST = 2**31 - 1


def quoted(c: Column | str) -> Column:
    return F.concat(F.lit("'"), F.col(c) if isinstance(c, str) else c, F.lit("'"))


def text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def fraction(num: Column, den: Column) -> Column:
    """In lowest terms; a whole number without its denominator."""
    g = aggregate.gcd(num, den)
    over = (den / g).cast("long")
    return F.when(over == 1, (num / g).cast("long").cast("string")).otherwise(F.concat((num / g).cast("long").cast("string"), F.lit("/"), over.cast("string")))


def issue(df: DataFrame, severity: str | Column, code: str | Column, message: Column, rank: int | Column, *, node: str = "measure_id", related: Column | None = None, marker: Column | None = None, end: bool = False, **places: int) -> DataFrame:
    """Rows of ``df`` as issues. Positions that ``df`` lacks come before its parts, or with ``end`` behind them."""
    at = [F.lit(places[c]) if c in places else F.col(c) if c in df.columns else F.lit(LAST if end else -1) for c in EVENT[1:]]
    lit = lambda x: F.lit(x) if isinstance(x, (str, int)) else x
    related = F.array().cast("array<string>") if related is None else related
    place = F.struct(*(c.cast("int").alias(n) for c, n in zip(at, EVENT[1:], strict=True)), lit(rank).alias("rank"), (F.lit(0) if marker is None else marker).alias("marker"))
    return df.select("score_id", place.alias("place"), lit(severity).alias("severity"), lit(code).alias("code"), message.alias("message"), F.col(node).alias("node_id"), related.alias("related_node_ids"))


def measure_issues(measures: DataFrame) -> list[DataFrame]:
    by_part = Window.partitionBy(*PART).orderBy("measure_idx")
    seen = measures.withColumn("n", F.row_number().over(Window.partitionBy(*PART, "number").orderBy("measure_idx"))).withColumn("previous", F.lag("number").over(by_part))
    return [
        issue(seen.where("n > 1"), "error", "DUPLICATE_MEASURE_NUMBER", text("Duplicate measure number ", F.col("number"), " in part ", F.col("part_id"), "."), 0),
        issue(seen.where("number <= previous"), "warning", "NON_MONOTONIC_MEASURE_ORDER", text("Measure numbers are not strictly increasing in part ", F.col("part_id"), ": ", F.col("previous"), " -> ", F.col("number"), "."), 1),
        issue(measures.where("active.beats is null"), "error", "MISSING_TIME_SIGNATURE", F.lit("No active time signature for measure duration validation."), 2),
    ]


def voice_issues(voices: DataFrame) -> list[DataFrame]:
    """Rules on whole voices: repeated ids, emptiness and durations. A voice of one measure is a bounded list."""
    n = F.row_number().over(Window.partitionBy(*MEASURE, "voice_id").orderBy("voice_idx"))
    named = voices.withColumn("n", n)
    out = [
        issue(named.where("n > 1"), "error", "DUPLICATE_VOICE_ID", text("Duplicate voice id ", quoted("voice_id"), " in measure ", F.col("number"), "."), 0),
        issue(voices.where(F.size("events") == 0), "warning", "EMPTY_VOICE", text("Voice ", quoted("voice_id"), " in measure ", F.col("number"), " has no events."), 1),
    ]
    sounding = F.filter("events", lambda e: ~((e["kind"] == "note") & F.coalesce(e["chord"], F.lit(False))))
    base = aggregate.lcm_of(F.array_distinct(F.transform(sounding, lambda e: e["duration"]["denominator"])))
    summed = voices.withColumn("_sounding", sounding).withColumn("_base", base)
    actual = F.aggregate("_sounding", F.lit(0).cast("long"), lambda a, e: a + e["duration"]["numerator"].cast("long") * (F.col("_base") / e["duration"]["denominator"]).cast("long"))
    summed = summed.withColumn("_actual", actual)
    have, want = F.col("_actual") * F.col("active.beat_type"), F.col("active.beats") * F.col("_base")
    code = F.when(have > want, "MEASURE_DURATION_OVERFLOW").otherwise("MEASURE_DURATION_UNDERFLOW")
    verb = F.when(have > want, " overfills measure ").otherwise(" underfills measure ")
    got, expected = fraction(F.col("_actual"), F.col("_base")), fraction(F.col("active.beats").cast("long"), F.col("active.beat_type").cast("long"))
    message = text("Voice ", F.col("voice_id"), verb, F.col("number"), ": expected ", expected, ", got ", got, ".")
    out.append(issue(summed.where(have != want), "error", code, message, 2, related=F.transform("events", lambda e: e["id"]), event_idx=LAST))
    return out


def event_issues(events: DataFrame) -> list[DataFrame]:
    related = F.array("event_id")
    order = ["part_idx", "measure_idx", "voice_idx", "event_idx"]
    repeated = events.withColumn("n", F.row_number().over(Window.partitionBy("score_id", "event_id").orderBy(*order))).where("n > 1")
    implied = events.withColumn("implied", ids.digits(F.col("voice_id"))).where("voice <> implied")
    return [
        issue(repeated, "error", "DUPLICATE_EVENT_ID", text("Duplicate event id ", quoted("event_id"), " detected in score."), 0, related=related),
        issue(implied, "warning", "EVENT_VOICE_MISMATCH", text("Event ", quoted("event_id"), " has voice=", F.col("voice"), ", but container voice id ", quoted("voice_id"), " implies ", F.col("implied"), "."), 1, related=related),
    ]


def chord_issues(notes: DataFrame) -> list[DataFrame]:
    anchored = sequence.last_anchor(notes, VOICE, ["event_idx"], F.when(~F.col("chord"), F.struct("num", "den")), "anchor").where("chord")
    longer = anchored.where(F.col("num").cast("long") * F.col("anchor.den") > F.col("anchor.num").cast("long") * F.col("den"))
    big = lambda c: F.col(c).cast("long")
    return [
        issue(anchored.where("anchor is null"), "error", "CHORD_WITHOUT_ANCHOR", text("Note ", quoted("event_id"), " is marked as chord tone without a preceding anchor note in voice ", quoted("voice_id"), "."), 2, related=F.array("event_id")),
        issue(longer, "error", "CHORD_DURATION_EXCEEDS_ANCHOR", text("Chord tone ", quoted("event_id"), " duration ", fraction(big("num"), big("den")), " exceeds anchor duration ", fraction(big("anchor.num"), big("anchor.den")), " in voice ", quoted("voice_id"), "."), 2, related=F.array("event_id")),
    ]


def tuplet_issues(notes: DataFrame) -> list[DataFrame]:
    ratio = F.col("tuplet_ratio")
    mark = F.when(F.col("tuplet") == "start", F.struct(ratio.alias("r"))).when(F.col("tuplet") == "stop", F.struct(F.when(F.lit(False), ratio).alias("r")))
    state = sequence.last_anchor(notes, VOICE, ["event_idx"], mark, "state").withColumn("open", F.col("state.r"))
    show = lambda c: text(F.col(f"{c}.actual_notes"), ":", F.col(f"{c}.normal_notes"))
    note, related = quoted("event_id"), F.array("event_id")
    start, stop, none = F.col("tuplet") == "start", F.col("tuplet") == "stop", F.col("tuplet").isNull()
    is_open = F.col("open").isNotNull()
    # the state behind a voice's last marker
    final = notes.withColumn("_mark", mark).where("_mark is not null").groupBy(*VOICE, "voice_id", "measure_id", "number").agg(F.max(F.struct("event_idx", F.col("_mark.r.actual_notes").alias("actual_notes"), F.col("_mark.r.normal_notes").alias("normal_notes"))).alias("left"))
    return [
        issue(state.where(none & is_open & ratio.isNull()), "warning", "MISSING_TUPLET_RATIO_IN_ACTIVE_GROUP", text("Note ", note, " in voice ", quoted("voice_id"), " is inside an active tuplet group but lacks tuplet_ratio."), 3, related=related),
        issue(state.where(start & is_open), "warning", "TUPLET_START_WHILE_OPEN", text("Note ", note, " starts a new tuplet while one is already open."), 3, related=related),
        issue(state.where(start & ratio.isNull()), "error", "TUPLET_START_MISSING_RATIO", text("Tuplet start on note ", note, " must define tuplet_ratio."), 4, related=related),
        issue(state.where(stop & ~is_open), "error", "TUPLET_STOP_WITHOUT_START", text("Tuplet stop on note ", note, " has no active tuplet to close."), 3, related=related),
        issue(state.where(stop & is_open & ratio.isNotNull() & (ratio != F.col("open"))), "error", "TUPLET_RATIO_MISMATCH", text("Tuplet stop on note ", note, " has ratio ", show("tuplet_ratio"), ", expected ", show("open"), "."), 3, related=related),
        issue(final.where("left.actual_notes is not null"), "warning", "UNCLOSED_TUPLET_AT_MEASURE_END", text("Voice ", quoted("voice_id"), " ends measure ", F.col("number"), " with an open tuplet ratio ", show("left"), "."), 0, event_idx=LAST),
    ]


def slur_issues(notes: DataFrame) -> list[DataFrame]:
    marks = notes.select("*", F.posexplode("slurs").alias("marker", "slur"))
    step = F.when(F.col("slur") == "start", 1).when(F.col("slur") == "stop", -1).when(F.col("slur") == "continue", 0)
    deep = sequence.bracket_depth(marks, VOICE, ["event_idx", "marker"], step)
    code = F.when(F.col("slur") == "stop", "SLUR_STOP_WITHOUT_START").otherwise("SLUR_CONTINUE_WITHOUT_START")
    left = deep.groupBy(*VOICE, "voice_id", "measure_id", "number").agg(F.max(F.struct("event_idx", "marker", "depth")).alias("last"))
    return [
        issue(deep.where("unopened"), "error", code, text("Slur ", F.col("slur"), " on note ", quoted("event_id"), " without active slur."), 5, related=F.array("event_id"), marker=F.col("marker")),
        issue(left.where("last.depth > 0"), "warning", "UNCLOSED_SLUR_AT_MEASURE_END", text("Voice ", quoted("voice_id"), " ends measure ", F.col("number"), " with ", F.col("last.depth"), " unclosed slur marker(s)."), 1, event_idx=LAST),
    ]


def tie_issues(notes: DataFrame) -> list[DataFrame]:
    has = lambda kind: F.array_contains("ties", kind)
    keyed = notes.withColumn("pitch_key", pitch.key(F.col("step"), F.col("alter"), F.col("octave")))
    order = ["measure_idx", "voice_idx", "event_idx"]
    state = sequence.set_state(keyed, [*PART, "voice_id"], ["pitch_key"], order, has("start"), has("stop"), has("continue"))
    note, related = quoted("event_id"), F.array("event_id")
    tied = state.where(F.col("code").isNotNull())
    message = (
        F.when(F.col("code") == "INVALID", text("Note ", note, " mixes 'continue' with 'start'/'stop'. Use either continue or explicit start+stop."))
        .when(F.col("code") == "CONTINUE_WITHOUT_START", text("Note ", note, " continues a tie that was never opened."))
        .when(F.col("code") == "STOP_WITHOUT_START", text("Note ", note, " stops a tie that was never opened for pitch ", F.col("pitch_key"), "."))
        .when(F.col("code") == "STOP_PITCH_MISMATCH", text("Note ", note, " stops tie for pitch ", F.col("pitch_key"), ", but no matching pitch tie is open in voice ", quoted("voice_id"), "."))
        .otherwise(text("Note ", note, " starts a tie that is already open."))
    )
    name = F.when(F.col("code") == "INVALID", "INVALID_TIE_ENCODING").otherwise(F.concat(F.lit("TIE_"), F.col("code")))
    severity = F.when(F.col("code") == "START_WHILE_OPEN", "warning").otherwise("error")
    mark = F.when(has("continue"), F.lit(None).cast("int")).when(has("start"), 1).when(has("stop"), 0)
    last = keyed.withColumn("_mark", mark).where("_mark is not null").groupBy(*PART, "part_id", "voice_id", "pitch_key").agg(F.max(F.struct(*order, "_mark")).alias("last")).where("last._mark = 1")
    place = F.row_number().over(Window.partitionBy(*PART).orderBy("voice_id", "pitch_key"))
    left = last.withColumn("marker", place)
    return [
        issue(tied, severity, name, message, 6, related=related),
        issue(left, "warning", "UNCLOSED_TIE_AT_PART_END", text("Tie start does not have a matching stop by part end: voice=", F.col("voice_id"), ", pitch=", F.col("pitch_key"), "."), 9, node="part_id", marker=F.col("marker"), end=True),
    ]


def validate(scores: DataFrame) -> DataFrame:
    """score_id, issue_idx (from 0, in the order of reading), severity, code, message, node_id, related_node_ids.

    Measures without an active time signature are reported and take no part in any other rule than those on measure numbers.
    """
    flat = sequence.carry_forward(score_json.measures(scores), PART, ["measure_idx"], F.col("time"), "active")
    timed = flat.where("active.beats is not null")
    voices = score_json.voices(timed)
    events = score_json.events(voices)
    notes = events.where("kind = 'note'")
    found = [*measure_issues(flat), *voice_issues(voices), *event_issues(events), *chord_issues(notes), *tuplet_issues(notes), *slur_issues(notes), *tie_issues(notes)]
    every = reduce(DataFrame.unionByName, found)
    number = F.row_number().over(Window.partitionBy("score_id").orderBy("place", "code")) - 1
    return every.withColumn("issue_idx", number.cast("long")).select("score_id", "issue_idx", "severity", "code", "message", "node_id", "related_node_ids")


def summary(issues: DataFrame) -> DataFrame:
    return aggregate.severity_summary(issues, ["score_id"], F.col("severity"))
