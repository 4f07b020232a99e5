"""Queries of the analysis timeline: series, peaks, summaries, stages, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from obspark.functions import text
from obspark.operators import timeline
from obspark.sources import views

#: Most model calls at once that the summary is held against.
CAP = 40


def _events(s, d):
    return views.analysis(s, d)


def _hints(s, d):
    """Hints for each scale and kind of unit, under several caps."""
    each = timeline.peaks(timeline.grouped(_events(s, d)), ["grouping", "value"])
    out = None
    for cap in (None, 2, CAP, 100_000):
        one = timeline.hints(each, cap).select("grouping", "value", F.lit(cap or 0).alias("cap"), F.array_join("hints", " / ").alias("hints"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "event_category": lambda s, d: _events(s, d).groupBy(text.event_category(F.col("event_name")).alias("category")).agg(F.count("*").alias("n")),
    "event_labels": lambda s, d: timeline.projected(_events(s, d)).select("event_id", timeline.label(["unit_id", "span_id", "job_id"]).alias("label"), "scale", "kind", "outcome"),
    "event_keys": lambda s, d: timeline.projected(_events(s, d)).select("event_id", timeline.first_of(["unit_id", "span_id", "event_key"]).alias("unit_key"), timeline.first_of(timeline.STAGE_KEY).alias("stage_key")),
    "timeline_peaks": lambda s, d: timeline.peaks(timeline.projected(_events(s, d))),
    "timeline_series": lambda s, d: timeline.running(timeline.marked(timeline.projected(_events(s, d))), "key", ["series"]),
    "timeline_counts": lambda s, d: timeline.counts(_events(s, d)),
    "timeline_summary": lambda s, d: timeline.summary(_events(s, d), CAP).withColumn("hints", F.array_join("hints", " / ")),
    "timeline_bottlenecks": _hints,
    "group_summary": lambda s, d: timeline.group_summary(_events(s, d)),
    "group_event_counts": lambda s, d: timeline.group_events(_events(s, d)),
    "stage_latency": lambda s, d: timeline.stage_latency(_events(s, d)),
    "unit_report": lambda s, d: timeline.unit_report(_events(s, d)),
    "slow_units_report": lambda s, d: timeline.unit_report(_events(s, d)).orderBy(F.desc("slowest_ms"), "unit_id").limit(10),
}

_key = lambda *c: "coalesce(" + ", ".join(f"nullif({x}, '')" for x in c) + ", CAST(event_id AS VARCHAR))"
_change = lambda series, key, starts, ends: f"SELECT *, '{series}' AS series, {key} AS key, CASE WHEN {starts} THEN 1 WHEN {ends} THEN 0 END AS mark FROM src"


def _keyed(series: str, start: str, end: str, key: str) -> str:
    return _change(series, _key(key, "span_id"), f"event_name = '{start}' AND event_phase IN ('instant', 'start')", f"event_name = '{end}' AND event_phase IN ('instant', 'finish', 'fail')")


def _staged(series: str, names: str) -> str:
    return _change(series, _key("span_id", "unit_id", "model_call_id"), f"event_name IN ({names}) AND event_phase = 'start'", f"event_name IN ({names}) AND event_phase IN ('finish', 'fail')")


_MARKS = " UNION ALL ".join(
    (
        _keyed("active_units", "unit_running", "unit_finished", "unit_id"),
        _keyed("scheduler_waiters", "vlm_scheduler_wait", "vlm_scheduler_wait", "model_call_id"),
        _keyed("outbound_vlm_calls", "vlm_provider_call", "vlm_provider_call", "model_call_id"),
        _staged("pre_vlm_active", "'frame_select', 'media_refs_built', 'detector_gate'"),
        _staged("frame_select_active", "'frame_select'"),
        _staged("media_refs_build_active", "'media_refs_built'"),
        _staged("detector_gate_active", "'detector_gate'"),
    )
)
#: Changes of all series within each group of ``src``.
SERIES_SQL = f"""mk AS ({_MARKS}), de AS (SELECT *, mark - coalesce(lag(mark) OVER (PARTITION BY g, v, series, key ORDER BY at_ms, event_id), 0) AS delta FROM mk WHERE mark IS NOT NULL),
 ac AS (SELECT g, v, series, at_ms, event_id, CAST(sum(delta) OVER (PARTITION BY g, v, series ORDER BY at_ms, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS active FROM de WHERE delta <> 0),
 rt AS (SELECT g, v, CASE event_name WHEN 'vlm_scheduler_wait' THEN 'vlm_ready_rate_per_sec' ELSE 'provider_start_rate_per_sec' END AS series, count(*) AS active FROM src WHERE event_name IN ('vlm_scheduler_wait', 'vlm_provider_call') AND event_phase = 'start' GROUP BY g, v, event_name, at_ms // 1000),
 pk AS (SELECT g, v, series, max(active) AS peak FROM (SELECT g, v, series, active FROM ac UNION ALL SELECT * FROM rt) GROUP BY ALL)"""
_NAMES = (*timeline.KEYED, *timeline.STAGED, *timeline.RATES)
_WIDE = ", ".join(f"coalesce(max(peak) FILTER (WHERE series = '{n}'), 0) AS peak_{n}" for n in _NAMES)
_ALL = f"WITH {views.ANALYSIS_SQL}, src AS (SELECT *, 0 AS g, 0 AS v FROM an), {SERIES_SQL}"
_GROUPS = f"WITH {views.ANALYSIS_SQL}, src AS (SELECT *, 'analysis_scale' AS g, scale AS v FROM an UNION ALL SELECT *, 'unit_kind', kind FROM an), {SERIES_SQL}, wide AS (SELECT g, v, {_WIDE} FROM pk GROUP BY g, v)"


def _hints_sql(cap: str) -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    rules = (
        f"CASE WHEN peak_pre_vlm_active > 0 AND peak_scheduler_waiters = 0 AND peak_outbound_vlm_calls <= greatest(1, peak_pre_vlm_active // 4) THEN {q(timeline.SUPPLY)} END",
        f"CASE WHEN peak_scheduler_waiters > 0 AND peak_outbound_vlm_calls < peak_scheduler_waiters THEN {q(timeline.WAITING)} END",
        f"CASE WHEN {cap} > 0 AND peak_outbound_vlm_calls < greatest(1, {cap} // 4) AND peak_active_units > peak_outbound_vlm_calls THEN {q(timeline.BELOW_CAP)} END",
        f"CASE WHEN {cap} > 0 AND peak_outbound_vlm_calls > 0 AND peak_outbound_vlm_calls >= {cap} THEN {q(timeline.AT_CAP)} END",
    )
    return f"coalesce(nullif(concat_ws(' / ', {', '.join(rules)}), ''), {q(timeline.NO_RULE)})"


_SOME = lambda c: f"count(DISTINCT nullif({c}, ''))"
STAGE_TIMES = f"""{views.ANALYSIS_SQL}, sk AS (SELECT *, {_key("span_id", "unit_id")} AS stage_key FROM an WHERE event_name IN ({", ".join(f"'{x}'" for x in timeline.STAGES)})),
 s0 AS (SELECT *, last_value(CASE WHEN event_phase = 'start' THEN at_ms END IGNORE NULLS) OVER (PARTITION BY event_name, stage_key ORDER BY at_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS started FROM sk),
 sd AS (SELECT * REPLACE (coalesce(duration_ms, CASE WHEN started IS NOT NULL THEN greatest(0, at_ms - started) END) AS duration_ms) FROM s0 WHERE event_phase <> 'start')"""
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in timeline.STAGES.items())
_STAGES = (*timeline.STAGES.values(), "total_unit_ms")
UNITS_SQL = f"""{STAGE_TIMES}, r0 AS (SELECT *, last_value(CASE WHEN event_name = 'unit_running' THEN at_ms END IGNORE NULLS) OVER (PARTITION BY unit_id ORDER BY at_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS started FROM an WHERE event_name IN ('unit_running', 'unit_finished')),
 al AS (SELECT unit_id, CASE event_name {_CASES} END AS stage, duration_ms, at_ms, event_id FROM sd WHERE duration_ms IS NOT NULL UNION ALL SELECT unit_id, 'total_unit_ms', greatest(0, at_ms - started), at_ms, event_id FROM r0 WHERE event_name = 'unit_finished' AND started IS NOT NULL),
 la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, stage ORDER BY at_ms DESC, event_id DESC) AS r FROM al WHERE unit_id <> '') WHERE r = 1),
 w AS (SELECT unit_id, {", ".join(f"max(duration_ms) FILTER (WHERE stage = '{x}') AS {x}" for x in _STAGES)} FROM la GROUP BY unit_id),
 w2 AS (SELECT *, greatest({", ".join(f"coalesce({x}, -1)" for x in _STAGES)}) AS slowest_ms FROM w), ur AS (SELECT *, CASE {" ".join(f"WHEN {x} = slowest_ms THEN '{x}'" for x in _STAGES)} END AS slowest_stage FROM w2)"""


def lerp_sql(q: float) -> str:
    """Linear interpolation between the neighbours of position (n - 1) q of the sorted list ``l``, rounded half to even."""
    pos = f"((n - 1) * CAST({q} AS DOUBLE))"
    lo, hi = f"CAST(floor({pos}) AS BIGINT)", f"CAST(ceil({pos}) AS BIGINT)"
    return f"CAST(round_even(CASE WHEN {lo} = {hi} THEN CAST(l[{lo} + 1] AS DOUBLE) ELSE ({hi} - {pos}) * l[{lo} + 1] + ({pos} - {lo}) * l[{hi} + 1] END, 0) AS BIGINT)"


ORACLE_SQL = {
    "event_category": f"WITH {views.ANALYSIS_SQL} SELECT CASE {' '.join(f"WHEN starts_with(event_name, '{p}') THEN '{c}'" for p, c in text.EVENT_CATEGORIES)} ELSE 'other' END AS category, count(*) AS n FROM an GROUP BY 1",
    "event_labels": f"WITH {views.ANALYSIS_SQL} SELECT event_id, concat_ws(' | ', event_name, event_phase, coalesce(nullif(unit_id, ''), nullif(span_id, ''), nullif(job_id, ''))) AS label, scale, kind, outcome FROM an",
    "event_keys": f"WITH {views.ANALYSIS_SQL} SELECT event_id, {_key('unit_id', 'span_id')} AS unit_key, {_key('span_id', 'unit_id', 'model_call_id')} AS stage_key FROM an",
    "timeline_peaks": f"{_ALL} SELECT {_WIDE} FROM pk",
    "timeline_series": f"{_ALL} SELECT series, at_ms, event_id, active FROM ac",
    "timeline_counts": f"""WITH {views.ANALYSIS_SQL}, c AS (SELECT event_name, outcome, CASE {' '.join(f"WHEN starts_with(event_name, '{p}') THEN '{c}'" for p, c in text.EVENT_CATEGORIES)} ELSE 'other' END AS category FROM an)
 SELECT 'event' AS kind_of_count, event_name AS value, count(*) AS n FROM c GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'status', outcome, count(*) FROM c GROUP BY 2""",
    "timeline_summary": f"""{_ALL}, one AS (SELECT {_WIDE} FROM pk), t AS (SELECT min(occurred_at) AS start, max(occurred_at) AS "end", count(*) AS event_count, {_SOME('job_id')} AS job_count, {_SOME('unit_id')} AS unit_count, {_SOME('model_call_id')} AS model_call_count, count(*) FILTER (WHERE starts_with(event_name, 'publication')) AS publication_write_count FROM an)
 SELECT *, {_hints_sql(str(CAP))} AS hints FROM t, one""",
    "timeline_bottlenecks": f"{_GROUPS}, caps AS (SELECT unnest([0, 2, {CAP}, 100000]) AS cap) SELECT g AS grouping, v AS value, cap, {_hints_sql('cap')} AS hints FROM wide, caps",
    "group_summary": f"{_GROUPS}, n AS (SELECT g, v, count(*) AS event_count, {_SOME('unit_id')} AS unit_count, {_SOME('model_call_id')} AS model_call_count FROM src GROUP BY g, v) SELECT n.g AS grouping, n.v AS value, event_count, unit_count, model_call_count, peak_active_units, peak_pre_vlm_active, peak_outbound_vlm_calls FROM n JOIN wide ON n.g = wide.g AND n.v = wide.v",
    "group_event_counts": f"{_GROUPS} SELECT g AS grouping, v AS value, event_name, count(*) AS n FROM src GROUP BY ALL",
    "stage_latency": f"WITH {STAGE_TIMES}, z AS (SELECT unnest([{', '.join(f"'{x}'" for x in timeline.STAGES)}]) AS event_name), a AS (SELECT event_name, count(*) AS n, list_sort(list(duration_ms)) AS l, max(duration_ms) AS most FROM sd WHERE duration_ms IS NOT NULL GROUP BY 1) SELECT z.event_name, coalesce(n, 0) AS n, {lerp_sql(0.5)} AS p50, {lerp_sql(0.9)} AS p90, {lerp_sql(0.99)} AS p99, most FROM z LEFT JOIN a ON z.event_name = a.event_name",
    "unit_report": f"WITH {UNITS_SQL} SELECT * FROM ur",
    "slow_units_report": f"WITH {UNITS_SQL} SELECT * FROM ur ORDER BY slowest_ms DESC, unit_id LIMIT 10",
}
