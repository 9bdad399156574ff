"""The validation rules, one small score for each code, and order and text of the issues."""

from __future__ import annotations

import json
import os

import pytest

from tessitura.plans import tokens, validation
from tessitura.sources import musicxml, score_json


def note(name, step="C", octave=4, num=1, den=4, **more):
    return {"kind": "note", "id": name, "pitch": {"step": step, "octave": octave}, "duration": {"numerator": num, "denominator": den}, "voice": 1, **more}


def rest(name, num=1, den=4):
    return {"kind": "rest", "id": name, "duration": {"numerator": num, "denominator": den}, "voice": 1}


def measure(number, events, time=(1, 4), name=None, voice="v1", voices=None):
    out = {"id": name or f"m{number}", "number": number, "voices": voices if voices is not None else [{"id": voice, "events": events}]}
    if time:
        out["attributes"] = {"time": {"beats": time[0], "beat_type": time[1]}, "divisions": 4}
    return out


def score(*measures):
    return {"ir_version": "0.1.0", "id": "s", "title": "t", "parts": [{"id": "P1", "name": "p", "measures": list(measures)}]}


def parsed(spark, *documents):
    return score_json.parse_scores(spark.createDataFrame([(json.dumps(d),) for d in documents], "j string"), "j")


TRIPLET = {"actual_notes": 3, "normal_notes": 2}
CASES = {
    "valid": (score(measure(1, [note("a")])), []),
    "underflow": (score(measure(1, [note("a", num=3)], (4, 4))), [("MEASURE_DURATION_UNDERFLOW", "Voice v1 underfills measure 1: expected 1, got 3/4.")]),
    "overflow": (score(measure(1, [note("a", num=1, den=3)])), [("MEASURE_DURATION_OVERFLOW", "Voice v1 overfills measure 1: expected 1/4, got 1/3.")]),
    "thirds are exact": (score(measure(1, [note("a", den=12), note("b", den=12), note("c", den=12)])), []),
    "carried meter": (score(measure(1, [note("a")]), measure(2, [note("b")], None)), []),
    "no meter": (score(measure(1, [note("a"), note("a")], None)), [("MISSING_TIME_SIGNATURE", "No active time signature for measure duration validation.")]),
    "numbers": (score(measure(1, [note("a")]), measure(1, [note("b")], name="again")), [("DUPLICATE_MEASURE_NUMBER", "Duplicate measure number 1 in part P1."), ("NON_MONOTONIC_MEASURE_ORDER", "Measure numbers are not strictly increasing in part P1: 1 -> 1.")]),
    "voices": (score(measure(1, [], voices=[{"id": "v1", "events": [note("a")]}, {"id": "v1", "events": []}])), [("DUPLICATE_VOICE_ID", "Duplicate voice id 'v1' in measure 1."), ("EMPTY_VOICE", "Voice 'v1' in measure 1 has no events."), ("MEASURE_DURATION_UNDERFLOW", "Voice v1 underfills measure 1: expected 1/4, got 0.")]),
    "events": (score(measure(1, [note("a", voice=2)]), measure(2, [note("a")])), [("EVENT_VOICE_MISMATCH", "Event 'a' has voice=2, but container voice id 'v1' implies 1."), ("DUPLICATE_EVENT_ID", "Duplicate event id 'a' detected in score.")]),
    "chord": (score(measure(1, [note("a", chord=True), note("b"), note("c", num=1, den=2, chord=True)])), [("CHORD_WITHOUT_ANCHOR", "Note 'a' is marked as chord tone without a preceding anchor note in voice 'v1'."), ("CHORD_DURATION_EXCEEDS_ANCHOR", "Chord tone 'c' duration 1/2 exceeds anchor duration 1/4 in voice 'v1'.")]),
    "chord after rest": (score(measure(1, [note("a"), rest("r"), note("b", chord=True)], (2, 4))), []),
    "tuplet": (score(measure(1, [note("a", tuplet="start", tuplet_ratio=TRIPLET), note("b"), note("c", tuplet="stop", tuplet_ratio={"actual_notes": 5, "normal_notes": 4})], (3, 4))), [("MISSING_TUPLET_RATIO_IN_ACTIVE_GROUP", "Note 'b' in voice 'v1' is inside an active tuplet group but lacks tuplet_ratio."), ("TUPLET_RATIO_MISMATCH", "Tuplet stop on note 'c' has ratio 5:4, expected 3:2.")]),
    "tuplet starts": (score(measure(1, [note("a", tuplet="start"), note("b", tuplet="start", tuplet_ratio=TRIPLET), note("c", tuplet="start", tuplet_ratio=TRIPLET)], (3, 4))), [("TUPLET_START_MISSING_RATIO", "Tuplet start on note 'a' must define tuplet_ratio."), ("TUPLET_START_WHILE_OPEN", "Note 'c' starts a new tuplet while one is already open."), ("UNCLOSED_TUPLET_AT_MEASURE_END", "Voice 'v1' ends measure 1 with an open tuplet ratio 3:2.")]),
    "tuplet stop": (score(measure(1, [note("a", tuplet="stop")])), [("TUPLET_STOP_WITHOUT_START", "Tuplet stop on note 'a' has no active tuplet to close.")]),
    "slurs": (score(measure(1, [note("a", slurs=["continue", "stop", "start", "start"])])), [("SLUR_CONTINUE_WITHOUT_START", "Slur continue on note 'a' without active slur."), ("SLUR_STOP_WITHOUT_START", "Slur stop on note 'a' without active slur."), ("UNCLOSED_SLUR_AT_MEASURE_END", "Voice 'v1' ends measure 1 with 2 unclosed slur marker(s).")]),
    "tie chain": (score(measure(1, [note("a", ties=["start"])]), measure(2, [note("b", ties=["continue"])]), measure(3, [note("c", ties=["stop"])])), []),
    "ties": (
        score(measure(1, [note("a", ties=["stop"]), note("b", ties=["start"]), note("c", "D", ties=["stop"]), note("d", ties=["start"]), note("e", "E", ties=["continue"]), note("f", ties=["continue", "start"])], (6, 4))),
        [
            ("TIE_STOP_WITHOUT_START", "Note 'a' stops a tie that was never opened for pitch C+0:4."), ("TIE_STOP_PITCH_MISMATCH", "Note 'c' stops tie for pitch D+0:4, but no matching pitch tie is open in voice 'v1'."), ("TIE_START_WHILE_OPEN", "Note 'd' starts a tie that is already open."),
            ("TIE_CONTINUE_WITHOUT_START", "Note 'e' continues a tie that was never opened."), ("INVALID_TIE_ENCODING", "Note 'f' mixes 'continue' with 'start'/'stop'. Use either continue or explicit start+stop."), ("UNCLOSED_TIE_AT_PART_END", "Tie start does not have a matching stop by part end: voice=v1, pitch=C+0:4."),
        ],
    ),
}


def test_issues_of_every_code(spark):
    documents = [doc | {"id": name} for name, (doc, _) in CASES.items()]
    found = validation.validate(parsed(spark, *documents)).orderBy("score_id", "issue_idx").collect()
    for name, (_, want) in CASES.items():
        assert [(r.code, r.message) for r in found if r.score_id == name] == want, name
    assert len({r.code for r in found}) == 26


def test_summary(spark):
    row = validation.summary(validation.validate(parsed(spark, CASES["slurs"][0]))).first()
    assert (row.total, row.errors, row.warnings, row.info, row.has_errors, row.has_warnings) == (3, 2, 1, 0, True, True)


def test_tokens_and_round_trip(spark):
    doc = score(measure(1, [note("a", chord=False, articulations=["staccato"], lyric="la"), rest("r", 3, 4)], (4, 4)))
    scores = parsed(spark, doc)
    got = [r.token for r in tokens.token_rows(scores).orderBy("position").collect()]
    assert got == ["<BOS>", "<score:s>", "<part:P1>", "<measure:1>", "<voice:v1>", "note:C+0:4:1/4", "articulation:staccato", "lyric:la", "rest:3/4", "<EOS>"]
    text = score_json.to_json(scores).first().json
    again = score_json.parse_scores(spark.createDataFrame([(text,)], "j string"), "j")
    assert again.exceptAll(score_json.parse_scores(spark.createDataFrame([(score_json.to_json(again).first().json,)], "j string"), "j")).count() == 0
    assert "slurs" not in text


def test_violations(spark):
    doc = score(measure(1, [note("a", "H", 11), note(" ", num=0)]))
    rows = score_json.violations(score_json.events(score_json.voices(score_json.measures(parsed(spark, doc))))).collect()
    assert [r.violations for r in rows] == [["step outside A to G", "octave outside 0 to 9"], ["blank id", "duration not positive"]]


def test_musicxml_round_trip(spark, tmp_path):
    doc = score(measure(1, [note("a", num=3, den=8, ties=["continue"], beams=["begin"]), note("b", den=8, chord=True), rest("r", 5, 8)], (4, 4)))
    row = musicxml.to_musicxml(parsed(spark, doc)).first()
    assert row.error is None and "<tied type=\"stop\" />" in row.xml and "<dot />" in row.xml
    (tmp_path / "one.musicxml").write_text(row.xml)
    read = musicxml.read_measures(spark, str(tmp_path / "*.musicxml"))
    counts = musicxml.event_counts(read).first()
    assert (counts.fixture, counts.pitched, counts.rests) == ("one", 2, 1)
    truth = musicxml.gt_measures(read).first()
    assert (truth.expected_ticks, truth.event_ticks, truth.labels) == (1920, [720, 1200], ["quarter.", "quarter"])


@pytest.mark.parametrize("golden", [os.environ.get("GOLDEN_SCORES", "/nowhere")])
def test_golden_counts(spark, golden):
    import glob

    files = glob.glob(f"{golden}/*/*.musicxml")
    if not files:
        pytest.skip("no golden files here")
    read = musicxml.read_measures(spark, f"{golden}/*/*.musicxml")
    total = musicxml.event_counts(read).groupBy().sum("pitched", "rests").first()
    assert (read.count(), total[0], total[1]) == (290, 976, 65)
