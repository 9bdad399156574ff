"""Score documents made from the event table, and the score relations over them as named queries with SQL.

A user is a score of one part, eight events in a row a measure, four of them a voice. Cents of an event's value decide what it is, so that
every rule of validation meets sound and broken material.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import musicxml, score_json
from . import tokens, validation
from .table_queries import query, read

TIES = (["start"], ["stop"], ["continue"], ["stop", "start"], ["continue", "start"])
SLURS = (["start"], ["stop"], ["continue"], ["stop", "start"])
LENGTHS = (4, 8, 2, 3)


def _marks(kinds: tuple, number: Column) -> Column:
    out = F.array().cast("array<string>")
    for k, marks in enumerate(kinds):
        out = F.when(number == k, F.array(*map(F.lit, marks))).otherwise(out)
    return out


def placed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_id, event_id, event_type, c (cents), rn, m (measure), v (voice), i (place in it), c0 (cents of the measure's first event)."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, sf_dir, "events").select("*", F.round(F.col("value") * 100).cast("long").alias("c"), (F.row_number().over(by_user) - 1).alias("rn"))
    rows = rows.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("score_id"), "event_id", "event_type", "c", "rn", F.expr("rn div 8").alias("m"), F.expr("rn % 8 div 4").alias("v"), F.expr("rn % 4").alias("i"))
    return rows.withColumn("c0", F.first("c").over(Window.partitionBy("score_id", "m").orderBy("rn")))


def event_struct() -> Column:
    c, kind = F.col("c"), F.when(F.col("event_type") == "error", "rest").otherwise("note")
    t = F.expr("c div 7 % 8")
    ratio = lambda a, b: F.struct(F.lit(a).alias("actual_notes"), F.lit(b).alias("normal_notes"))
    pitch = F.struct(F.when(c % 2 == 0, "C").otherwise("D").alias("step"), F.lit(4).alias("octave"), F.when(c % 11 == 0, 1).otherwise(0).alias("alter"))
    den = F.element_at(F.array(*map(F.lit, LENGTHS)), (c % 4 + 1).cast("int"))
    note = lambda x: F.when(kind == "note", x)
    return F.struct(
        kind.alias("kind"), F.when(c % 9 == 0, F.concat(F.lit("d"), (c % 20).cast("string"))).otherwise(F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("id"), note(pitch).alias("pitch"),
        F.struct(F.lit(1).alias("numerator"), den.alias("denominator")).alias("duration"), F.when(c % 8 == 0, 3).otherwise(F.col("v") + 1).alias("voice"), note(_marks(TIES, c % 10)).alias("ties"),
        note(_marks(SLURS, F.expr("c div 10 % 10"))).alias("slurs"), note(c % 5 == 1).alias("chord"), note(F.when(t.isin(0, 2), "start").when(t.isin(1, 3, 4), "stop")).alias("tuplet"),
        note(F.when(t.isin(0, 1, 5), ratio(3, 2)).when(t == 3, ratio(5, 4))).alias("tuplet_ratio"),
    )


def score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document for each score, in ``json``."""
    rows = placed_events(spark, sf_dir).select("score_id", "m", "v", "c0", F.struct("i", event_struct().alias("e")).alias("e"))
    by_voice = rows.groupBy("score_id", "m", "c0", "v").agg(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["e"]).alias("events"))
    named = F.when((F.col("v") == 1) & (F.col("c0") % 4 != 0), "v2").otherwise("v1")
    by_measure = by_voice.groupBy("score_id", "m", "c0").agg(F.array_sort(F.collect_list(F.struct("v", named.alias("id"), "events"))).alias("voices"))
    # an empty voice behind the others
    empty = F.transform(F.filter("voices", lambda x: (F.col("c0") % 6 == 0) & (x["v"] == 0)), lambda x: x.withField("id", F.lit("v3")).withField("events", F.filter(x["events"], lambda e: F.lit(False))))
    voices = F.transform(F.concat("voices", empty), lambda x: F.struct(x["id"].alias("id"), x["events"].alias("events")))
    time = F.when(F.col("c0") % 3 == 0, F.lit(4)).when(F.col("c0") % 5 == 0, F.lit(3))
    attributes = F.when(time.isNotNull(), F.struct(F.struct(time.alias("beats"), F.lit(4).alias("beat_type")).alias("time")))
    number = F.col("m") + F.when(F.col("c0") % 7 == 0, 0).otherwise(1)
    measures = by_measure.select("score_id", F.struct("m", F.struct(F.concat(F.lit("m"), F.col("m").cast("string")).alias("id"), number.alias("number"), attributes.alias("attributes"), voices.alias("voices")).alias("x")).alias("x"))
    by_score = measures.groupBy("score_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["x"]).alias("measures"))
    part = F.struct(F.lit("P1").alias("id"), F.lit("Part").alias("name"), F.col("measures").alias("measures"))
    return by_score.select("score_id", F.to_json(F.struct(F.lit("0.1.0").alias("ir_version"), F.col("score_id").alias("id"), F.array(part).alias("parts"))).alias("json"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_json.parse_scores(score_documents(spark, sf_dir), "json")


#: The same material as SQL: placed events ``e``, measures ``ms`` with the active time, voices ``vo`` and events ``ev`` of timed measures.
_MATERIAL = """b as (select 'u' || user_id as score_id, event_id, event_type, round(value * 100)::bigint as c, row_number() over (partition by user_id order by ts, event_id) - 1 as rn from events),
e as (select *, rn // 8 as m, rn % 8 // 4 as v, rn % 4 as i, first_value(c) over (partition by score_id, rn // 8 order by rn) as c0 from b),
m0 as (select score_id, m, any_value(c0) as c0, max(v) + 1 as n_voices, m + case when any_value(c0) % 7 = 0 then 0 else 1 end as number, case when any_value(c0) % 3 = 0 then 4 when any_value(c0) % 5 = 0 then 3 end as beats from e group by 1, 2),
ms as (select *, last_value(beats ignore nulls) over (partition by score_id order by m) as active from m0),
ae as (select score_id, m, v, i, c, c0, event_id, case when event_type = 'error' then 'rest' else 'note' end as kind, case when c % 9 = 0 then 'd' || (c % 20) else 'e' || event_id end as id, case when v = 1 and c0 % 4 <> 0 then 'v2' else 'v1' end as voice_id,
  case c % 4 when 0 then 4 when 1 then 8 when 2 then 2 else 3 end as den, case when c % 8 = 0 then 3 else v + 1 end as voice, event_type <> 'error' and c % 5 = 1 as chord, case when c % 2 = 0 then 'C' else 'D' end as step, case when c % 11 = 0 then 1 else 0 end as alter,
  case c % 10 when 0 then ['start'] when 1 then ['stop'] when 2 then ['continue'] when 3 then ['stop', 'start'] when 4 then ['continue', 'start'] else []::varchar[] end as ties,
  case c // 10 % 10 when 0 then ['start'] when 1 then ['stop'] when 2 then ['continue'] when 3 then ['stop', 'start'] else []::varchar[] end as slurs,
  case when c // 7 % 8 in (0, 2) then 'start' when c // 7 % 8 in (1, 3, 4) then 'stop' end as tuplet, case when c // 7 % 8 in (0, 1, 5) then '3:2' when c // 7 % 8 = 3 then '5:4' end as ratio from e),
ev as (select ae.*, ms.number, ms.active from ae join ms using (score_id, m) where ms.active is not null), nt as (select * from ev where kind = 'note'),
vo as (select distinct score_id, m, v, voice_id, number, active from ev union all select score_id, m, n_voices, 'v3', number, active from ms where active is not null and c0 % 6 = 0)"""
_NONE = "[]::varchar[]"


def _issues(source: str, severity: str, code: str, message: str, rank: int | str, *, v: str = "-1", i: str = "-1", m: str = "m", marker: str = "0", node: str = "'m' || m", related: str = _NONE, p: str = "0") -> str:
    return f"select score_id, {p} as p, {m} as m, {v} as v, {i} as i, {rank} as rank, {marker} as marker, {severity} as severity, {code} as code, {message} as message, {node} as node_id, {related} as related from {source}"


_LAST = str(validation.LAST)
_BY_EVENT = {"v": "v", "i": "i", "related": "[id]"}
_ISSUES_SQL = f"""with {_MATERIAL},
ms2 as (select *, row_number() over (partition by score_id, number order by m) as n, lag(number) over (partition by score_id order by m) as previous from ms),
vo2 as (select *, row_number() over (partition by score_id, m, voice_id order by v) as n from vo),
du as (select score_id, m, v, list(id order by i) as ids, sum(case when chord then 0 else 24 // den end) as actual from ev group by 1, 2, 3),
vd as (select vo.*, coalesce(ids, {_NONE}) as ids, coalesce(actual, 0) as actual, active * 6 as expected, greatest(1, gcd(coalesce(actual, 0), 24)) as g, case active when 4 then '1' else '3/4' end as want from vo left join du using (score_id, m, v)),
vf as (select *, case when actual % 24 = 0 then (actual // 24)::varchar else (actual // g) || '/' || (24 // g) end as got from vd),
ev2 as (select *, row_number() over (partition by score_id, id order by m, v, i) as n, regexp_replace(voice_id, '[^0-9]', '', 'g')::bigint as implied from ev),
ch as (select *, last_value(case when not chord then den end ignore nulls) over (partition by score_id, m, v order by i rows between unbounded preceding and 1 preceding) as anchor from nt),
tu0 as (select *, case tuplet when 'start' then coalesce(ratio, '') when 'stop' then '' end as mark from nt), tu as (select *, nullif(last_value(mark ignore nulls) over (partition by score_id, m, v order by i rows between unbounded preceding and 1 preceding), '') as open from tu0),
tl as (select score_id, m, v, any_value(voice_id) as voice_id, any_value(number) as number, max_by(mark, i) as mark from tu0 where mark is not null group by 1, 2, 3),
sl0 as (select *, unnest(slurs) as slur, unnest(range(0, len(slurs))) as k from nt), sl1 as (select *, sum(case slur when 'start' then 1 when 'stop' then -1 else 0 end) over (partition by score_id, m, v order by i, k) as s from sl0),
sl2 as (select *, s - least(0, min(s) over (partition by score_id, m, v order by i, k)) as depth from sl1), sl as (select *, coalesce(lag(depth) over (partition by score_id, m, v order by i, k), 0) as before from sl2),
ll as (select score_id, m, v, any_value(voice_id) as voice_id, any_value(number) as number, max_by(depth, i * 10 + k) as depth from sl group by 1, 2, 3),
ti0 as (select *, format('{{}}{{}}{{}}:4', step, '+', alter) as pitch, list_contains(ties, 'continue') as co, list_contains(ties, 'start') as st, list_contains(ties, 'stop') as sp from nt), ti1 as (select *, case when co then null when st then 1 when sp then 0 end as mk from ti0),
ti2 as (select *, coalesce(last_value(mk ignore nulls) over (partition by score_id, voice_id, pitch order by m, v, i rows between unbounded preceding and 1 preceding), 0) as ob from ti1),
ti3 as (select *, coalesce(sum(coalesce(mk, ob) - ob) over (partition by score_id, voice_id order by m, v, i rows between unbounded preceding and 1 preceding), 0) as openv from ti2),
ti as (select *, case when co and (st or sp) then 'INVALID_TIE_ENCODING' when co and ob = 0 then 'TIE_CONTINUE_WITHOUT_START' when not co and sp and ob = 0 and openv > 0 then 'TIE_STOP_PITCH_MISMATCH' when not co and sp and ob = 0 then 'TIE_STOP_WITHOUT_START' when not co and st and not sp and ob = 1 then 'TIE_START_WHILE_OPEN' end as code from ti3),
to0 as (select score_id, voice_id, pitch, max_by(mk, m * 1000 + v * 10 + i) as mk from ti1 where mk is not null group by 1, 2, 3), tx as (select *, row_number() over (partition by score_id order by voice_id, pitch) as place from to0 where mk = 1),
x as ({' union all '.join((
    _issues("ms2 where n > 1", "'error'", "'DUPLICATE_MEASURE_NUMBER'", "'Duplicate measure number ' || number || ' in part P1.'", 0),
    _issues("ms2 where number <= previous", "'warning'", "'NON_MONOTONIC_MEASURE_ORDER'", "'Measure numbers are not strictly increasing in part P1: ' || previous || ' -> ' || number || '.'", 1),
    _issues("ms where active is null", "'error'", "'MISSING_TIME_SIGNATURE'", "'No active time signature for measure duration validation.'", 2),
    _issues("vo2 where n > 1", "'error'", "'DUPLICATE_VOICE_ID'", "format('Duplicate voice id ''{}'' in measure {}.', voice_id, number)", 0, v="v"),
    _issues("vf where len(ids) = 0", "'warning'", "'EMPTY_VOICE'", "format('Voice ''{}'' in measure {} has no events.', voice_id, number)", 1, v="v"),
    _issues("vf where actual <> expected", "'error'", "case when actual > expected then 'MEASURE_DURATION_OVERFLOW' else 'MEASURE_DURATION_UNDERFLOW' end", "format('Voice {} {} measure {}: expected {}, got {}.', voice_id, case when actual > expected then 'overfills' else 'underfills' end, number, want, got)", 2, v="v", i=_LAST, related="ids"),
    _issues("ev2 where n > 1", "'error'", "'DUPLICATE_EVENT_ID'", "format('Duplicate event id ''{}'' detected in score.', id)", 0, **_BY_EVENT),
    _issues("ev2 where voice <> implied", "'warning'", "'EVENT_VOICE_MISMATCH'", "format('Event ''{}'' has voice={}, but container voice id ''{}'' implies {}.', id, voice, voice_id, implied)", 1, **_BY_EVENT),
    _issues("ch where chord and anchor is null", "'error'", "'CHORD_WITHOUT_ANCHOR'", "format('Note ''{}'' is marked as chord tone without a preceding anchor note in voice ''{}''.', id, voice_id)", 2, **_BY_EVENT),
    _issues("ch where chord and den < anchor", "'error'", "'CHORD_DURATION_EXCEEDS_ANCHOR'", "format('Chord tone ''{}'' duration 1/{} exceeds anchor duration 1/{} in voice ''{}''.', id, den, anchor, voice_id)", 2, **_BY_EVENT),
    _issues("tu where tuplet is null and open is not null and ratio is null", "'warning'", "'MISSING_TUPLET_RATIO_IN_ACTIVE_GROUP'", "format('Note ''{}'' in voice ''{}'' is inside an active tuplet group but lacks tuplet_ratio.', id, voice_id)", 3, **_BY_EVENT),
    _issues("tu where tuplet = 'start' and open is not null", "'warning'", "'TUPLET_START_WHILE_OPEN'", "format('Note ''{}'' starts a new tuplet while one is already open.', id)", 3, **_BY_EVENT),
    _issues("tu where tuplet = 'start' and ratio is null", "'error'", "'TUPLET_START_MISSING_RATIO'", "format('Tuplet start on note ''{}'' must define tuplet_ratio.', id)", 4, **_BY_EVENT),
    _issues("tu where tuplet = 'stop' and open is null", "'error'", "'TUPLET_STOP_WITHOUT_START'", "format('Tuplet stop on note ''{}'' has no active tuplet to close.', id)", 3, **_BY_EVENT),
    _issues("tu where tuplet = 'stop' and ratio <> open", "'error'", "'TUPLET_RATIO_MISMATCH'", "format('Tuplet stop on note ''{}'' has ratio {}, expected {}.', id, ratio, open)", 3, **_BY_EVENT),
    _issues("tl where mark <> ''", "'warning'", "'UNCLOSED_TUPLET_AT_MEASURE_END'", "format('Voice ''{}'' ends measure {} with an open tuplet ratio {}.', voice_id, number, mark)", 0, v="v", i=_LAST),
    _issues("sl where slur in ('stop', 'continue') and before <= 0", "'error'", "case slur when 'stop' then 'SLUR_STOP_WITHOUT_START' else 'SLUR_CONTINUE_WITHOUT_START' end", "format('Slur {} on note ''{}'' without active slur.', slur, id)", 5, marker="k", **_BY_EVENT),
    _issues("ll where depth > 0", "'warning'", "'UNCLOSED_SLUR_AT_MEASURE_END'", "format('Voice ''{}'' ends measure {} with {} unclosed slur marker(s).', voice_id, number, depth::bigint)", 1, v="v", i=_LAST),
    _issues("ti where code is not null", "case code when 'TIE_START_WHILE_OPEN' then 'warning' else 'error' end", "code", "case code when 'INVALID_TIE_ENCODING' then format('Note ''{}'' mixes ''continue'' with ''start''/''stop''. Use either continue or explicit start+stop.', id) when 'TIE_CONTINUE_WITHOUT_START' then format('Note ''{}'' continues a tie that was never opened.', id) when 'TIE_STOP_WITHOUT_START' then format('Note ''{}'' stops a tie that was never opened for pitch {}.', id, pitch) when 'TIE_STOP_PITCH_MISMATCH' then format('Note ''{}'' stops tie for pitch {}, but no matching pitch tie is open in voice ''{}''.', id, pitch, voice_id) else format('Note ''{}'' starts a tie that is already open.', id) end", 6, **_BY_EVENT),
    _issues("tx", "'warning'", "'UNCLOSED_TIE_AT_PART_END'", "format('Tie start does not have a matching stop by part end: voice={}, pitch={}.', voice_id, pitch)", 9, m=_LAST, v=_LAST, i=_LAST, marker="place", node="'P1'"),
))})"""


@query(f"{_ISSUES_SQL} select score_id, row_number() over (partition by score_id order by p, m, v, i, rank, marker, code) - 1 as issue_idx, severity, code, message, node_id, array_to_string(related, ',') as related from x")
def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules of validation over documents that are written as JSON and read again."""
    return validation.validate(scores(spark, sf_dir)).select("score_id", "issue_idx", "severity", "code", "message", "node_id", F.array_join("related_node_ids", ",").alias("related"))


@query(f"{_ISSUES_SQL} select score_id, count(*) as total, count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings, 0::bigint as info, bool_or(severity = 'error') as has_errors, bool_or(severity = 'warning') as has_warnings from x group by 1")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.summary(validation.validate(scores(spark, sf_dir)))


@query(f"""with {_MATERIAL} select score_id, m as measure_idx, number, v as voice_idx, i as event_idx, ae.kind, id as event_id, voice, voice_id, case when kind = 'note' then step end as step, case when kind = 'note' then alter end as alter, den, chord,
array_to_string(case when kind = 'note' then ties else [] end, ',') as ties, array_to_string(case when kind = 'note' then slurs else [] end, ',') as slurs, case when kind = 'note' then tuplet end as tuplet, case when kind = 'note' then ratio end as ratio from ae join ms using (score_id, m)""")
def score_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the documents, written as JSON, read, written by the writer and read again: the round trip loses nothing."""
    again = score_json.parse_scores(score_json.to_json(scores(spark, sf_dir)), "json")
    rows = score_json.events(score_json.voices(score_json.measures(again)))
    ratio = F.concat_ws(":", "tuplet_ratio.actual_notes", "tuplet_ratio.normal_notes")
    return rows.select("score_id", "measure_idx", "number", "voice_idx", "event_idx", "kind", "event_id", "voice", "voice_id", "step", "alter", "den", "chord", F.array_join("ties", ",").alias("ties"), F.array_join("slurs", ",").alias("slurs"), "tuplet", F.when(F.col("tuplet_ratio").isNotNull(), ratio).alias("ratio"))


@query(f"""with {_MATERIAL}, t as (select score_id, -1::bigint as m, 0 as s, 0::bigint as v, 0::bigint as i, '<BOS>' as token from (select distinct score_id from e) union all select distinct score_id, -1, 1, 0, 0, format('<score:{{}}>', score_id) from e union all select distinct score_id, -1, 2, 0, 0, '<part:P1>' from e
union all select distinct score_id, {_LAST}, 0, 0, 0, '<EOS>' from e union all select score_id, m, 0, -1, -1, format('<measure:{{}}>', number) from ms union all select distinct score_id, m, 1, v, -1, format('<voice:{{}}>', voice_id) from ae union all select score_id, m, 1, n_voices, -1, '<voice:v3>' from ms where c0 % 6 = 0
union all select score_id, m, 1, v, i, case kind when 'rest' then format('rest:1/{{}}', den) else format('note:{{}}+{{}}:4:1/{{}}', step, alter, den) || case when chord then ':chord' else '' end end from ae)
select score_id, row_number() over (partition by score_id order by m, s, v, i) - 1 as position, token from t""")
def score_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_rows(scores(spark, sf_dir))


@query(f"""with {_MATERIAL} select score_id as fixture, count(distinct m) as measures, count(*) filter (kind = 'note') as pitched, count(*) filter (kind = 'rest') as rests from ae group by 1""")
def musicxml_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, notes and rests of the documents as MusicXML, read back."""
    measures = musicxml.parse_measures(musicxml.to_musicxml(scores(spark, sf_dir)), "id", "xml")
    return musicxml.measure_counts(measures).join(musicxml.event_counts(measures), "fixture")


@query(f"""with {_MATERIAL}, t as (select score_id, m, coalesce(last_value(beats ignore nulls) over (partition by score_id order by m), 4) as beats from ms),
d as (select score_id, m, string_agg((1920 // den)::varchar, ',' order by v, i) as ticks, string_agg(case den when 4 then 'quarter' when 8 then 'eighth' when 2 then 'half' else 'quarter' end, ',' order by v, i) as labels from ae where not chord group by 1, 2)
select score_id as fixture, m + 1 as measure_idx, beats * 480 as expected_ticks, coalesce(ticks, '') as ticks, coalesce(labels, '') as labels from t left join d using (score_id, m)""")
def musicxml_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks and labels of each measure, from divisions and times carried forward through the MusicXML."""
    measures = musicxml.parse_measures(musicxml.to_musicxml(scores(spark, sf_dir)), "id", "xml")
    return musicxml.gt_measures(measures).select("fixture", "measure_idx", "expected_ticks", F.array_join("event_ticks", ",").alias("ticks"), F.array_join("labels", ",").alias("labels"))
