"""Queries of temporal planning, pipeline state, timelines, capacity and evaluation, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from obspark.functions import numeric, text, udfs
from obspark.operators import capacity, evaluate, pipeline, temporal, timeline
from obspark.plans.timeline_queries import lerp_sql
from obspark.sources import views
from obspark.streaming import motion, spans, streams, upserts

NOW = "2000-01-01 00:00:00"
HOUR, THRESHOLD = 3_600_000, 0.15
STAGES = ("signup", "purchase", "error")


def _t(s, d, name):
    return views.table(s, d, name)


def _durations(s, d):
    """Videos with durations of up to some minutes."""
    return _t(s, d, "customer").select(F.col("c_custkey").alias("video_id"), (F.col("c_custkey") * 977 % 300000).alias("duration_ms"))


DURATIONS_SQL = "dur AS (SELECT c_custkey AS video_id, c_custkey * 977 % 300000 AS duration_ms FROM customer)"


def _spans(s, d):
    return _t(s, d, "customer").select(F.col("c_custkey").alias("trigger_id"), (F.col("c_custkey") * 31 % 5000).alias("start_ms"), (F.col("c_custkey") * 31 % 5000 + F.col("c_custkey") * 57 % 20000).alias("end_ms"))


SPANS_SQL = "sp AS (SELECT c_custkey AS trigger_id, c_custkey * 31 % 5000 AS start_ms, c_custkey * 31 % 5000 + c_custkey * 57 % 20000 AS end_ms FROM customer)"


def _triggers(s, d):
    return temporal.motion_triggers(views.motion(s, d), THRESHOLD, HOUR, 6 * HOUR)


TRIGGERS_SQL = f"""{views.MOTION_SQL}, gaps AS (SELECT series, ts_ms - lag(ts_ms) OVER (PARTITION BY series ORDER BY ts_ms, event_id) AS gap FROM mo),
 steps AS (SELECT series, greatest(1, coalesce(list_sort(list(gap) FILTER (WHERE gap IS NOT NULL))[CAST(count(gap) // 2 AS INT) + 1], 1)) AS step_ms FROM gaps GROUP BY series),
 s1 AS (SELECT mo.*, coalesce(lead(ts_ms) OVER w, ts_ms + step_ms) AS end_ms, score >= {THRESHOLD} AS hot, lag(score >= {THRESHOLD}) OVER w AS was FROM mo JOIN steps USING (series) WINDOW w AS (PARTITION BY series ORDER BY ts_ms, event_id)),
 s2 AS (SELECT *, sum(CASE WHEN hot AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY ts_ms, event_id) AS run FROM s1),
 runs AS (SELECT series, run, min(ts_ms) AS a, max(end_ms) AS z, max(score) AS peak FROM s2 WHERE hot GROUP BY series, run),
 r2 AS (SELECT *, CASE WHEN a - lag(z) OVER (PARTITION BY series ORDER BY run) > {6 * HOUR} THEN 1 ELSE 0 END AS fresh FROM runs),
 r3 AS (SELECT *, sum(fresh) OVER (PARTITION BY series ORDER BY run) AS island FROM r2),
 trig AS (SELECT series, min(a) AS trigger_start_ms, greatest(max(z), min(a) + {HOUR}) AS trigger_end_ms, round(max(peak), 6) AS peak FROM r3 GROUP BY series, island)"""


def _frames(s, d):
    """Frame scores: 40 series of events."""
    e = views.timeline(s, d)
    return e.select((F.col("unit_id") % 40).alias("series"), F.col("event_id").cast("bigint").alias("frame_index"), F.col("at_ms").alias("timestamp_ms"), (F.col("value") / 200).alias("motion"), (F.col("k") / 100).alias("scene"), (F.col("value") * 3).alias("blur"), (F.col("k") * 2.5).cast("double").alias("brightness"))


FRAMES_SQL = f"""{views.TIMELINE_SQL}, f0 AS (SELECT unit_id % 40 AS series, event_id AS frame_index, at_ms AS timestamp_ms, value / 200 AS motion, k / 100 AS scene, value * 3 AS blur, k * CAST(2.5 AS DOUBLE) AS brightness FROM tl),
 f1 AS (SELECT *, blur >= 20 AND brightness >= 16 AND brightness <= 240 AS ok, 0.5 * motion + 0.3 * scene + 0.2 * least(blur, 500.0) / 500 AS score FROM f0),
 f2 AS (SELECT *, bool_or(ok) OVER (PARTITION BY series) AS any_ok, min(timestamp_ms) OVER (PARTITION BY series) AS t0, max(timestamp_ms) OVER (PARTITION BY series) AS t1 FROM f1), fr AS (SELECT * FROM f2 WHERE ok OR NOT any_ok)"""


def _units(s, d):
    status = F.when(F.col("o_orderkey") % 97 == 0, "running").when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0), "failed").when(F.col("o_orderstatus") == "O", "succeeded").otherwise("skipped")
    return _t(s, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderpriority").alias("analysis_scale"), status.alias("status"), F.col("o_orderkey").alias("unit_id"), F.col("o_orderdate").alias("started_at"), F.lit(None).cast("string").alias("error_code"))


SWEPT = "1996-01-01 00:00:00"
SWEPT_SQL = f"""st AS (SELECT unit_id FROM u WHERE status = 'running' AND started_at IS NOT NULL AND started_at < TIMESTAMP '{SWEPT}' ORDER BY started_at, unit_id LIMIT 40),
 sw AS (SELECT * REPLACE (CASE WHEN unit_id IN (SELECT unit_id FROM st) THEN 'failed' ELSE status END AS status), CASE WHEN unit_id IN (SELECT unit_id FROM st) THEN 'orphan_timeout' END AS error_code FROM u ORDER BY unit_id)"""
ROLLUP_SQL = """sc AS (SELECT job_id, analysis_scale, count(*) FILTER (WHERE status = 'succeeded') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status IN ('running', 'queued', 'pending')) AS open FROM u GROUP BY ALL),
 ss AS (SELECT *, CASE WHEN open > 0 THEN 'running' WHEN failed > 0 AND succeeded > 0 THEN 'partial_failed' WHEN failed > 0 THEN 'failed' ELSE 'succeeded' END AS scale_status FROM sc),
 js AS (SELECT job_id, CASE WHEN bool_or(scale_status = 'running') THEN 'running' WHEN bool_or(analysis_scale = '1-URGENT' AND succeeded = 0) THEN 'failed' WHEN bool_or(scale_status IN ('failed', 'partial_failed')) THEN 'partial_failed' ELSE 'succeeded' END AS job_status FROM ss GROUP BY job_id)"""
UNITS_SQL = """u AS (SELECT o_custkey AS job_id, o_orderpriority AS analysis_scale, CASE WHEN o_orderkey % 97 = 0 THEN 'running' WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderstatus = 'O' THEN 'succeeded' ELSE 'skipped' END AS status, o_orderkey AS unit_id, o_orderdate AS started_at FROM orders)"""


def _swept(s, d):
    return pipeline.sweep_orphans(_units(s, d), F.lit(SWEPT).cast("timestamp_ntz"), 40)


def _tasks(s, d):
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "running").otherwise("succeeded")
    return _t(s, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderkey").alias("unit_id"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), F.col("o_orderdate").alias("next_run_at"), status.alias("status"), F.expr("o_orderdate + INTERVAL 1 DAY").alias("lease_expires_at"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("started_at"))


TASKS_SQL = "ta AS (SELECT o_orderkey AS task_id, 6 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, o_orderdate AS next_run_at, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'running' ELSE 'succeeded' END AS status, o_orderdate + INTERVAL 1 DAY AS lease_expires_at, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS started_at FROM orders)"
_now = lambda: F.lit(NOW).cast("timestamp_ntz")
KEY = ["video_id", "segment_start_ms", "segment_end_ms", "analysis_scale"]


def _active(s, d):
    return views.observations(s, d).select("record_id", *KEY, "security_level")


def _incoming(s, d):
    """New records: of every third document, two for every ninth."""
    base = _active(s, d).withColumn("doc_id", F.substring("record_id", 5, 8).cast("bigint")).filter("doc_id % 3 = 0")
    n = F.explode(F.sequence(F.lit(1), F.when(F.col("doc_id") % 9 == 0, 2).otherwise(1)))
    moved = base.withColumn("n", n).withColumn("record_id", F.concat("record_id", F.lit("_v"), F.col("n").cast("string")))
    return moved.withColumn("segment_start_ms", F.when(F.col("doc_id") % 6 == 0, F.col("segment_start_ms") + 1).otherwise(F.col("segment_start_ms"))).withColumn("seq", F.col("doc_id") * 10 + F.col("n")).drop("doc_id", "n")


INCOMING_SQL = f"""{views.OBSERVATIONS_SQL}, act AS (SELECT doc_id, record_id, video_id, segment_start_ms, segment_end_ms, analysis_scale, security_level FROM obs),
 inc AS (SELECT record_id || '_v' || CAST(n AS VARCHAR) AS record_id, video_id, CASE WHEN doc_id % 6 = 0 THEN segment_start_ms + 1 ELSE segment_start_ms END AS segment_start_ms, segment_end_ms, analysis_scale, security_level, doc_id * 10 + n AS seq
 FROM act, (SELECT unnest([1, 2]) AS n) WHERE doc_id % 3 = 0 AND (n = 1 OR doc_id % 9 = 0)),
 chain AS (SELECT record_id, video_id, segment_start_ms, segment_end_ms, analysis_scale, security_level, -1 AS seq FROM act UNION ALL SELECT * FROM inc),
 nx AS (SELECT *, lead(record_id) OVER (PARTITION BY video_id, segment_start_ms, segment_end_ms, analysis_scale ORDER BY seq) AS nxt FROM chain)"""


def _publish(s, d, part):
    now, history = pipeline.publish(_active(s, d), _incoming(s, d), KEY, "job_1")
    return now if part == "now" else history.select("old_record_id", "replaced_by_record_id", "archived_by")


def _ranked(s, d, order):
    o = _t(s, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("record_id"), "o_totalprice", "o_orderdate")
    return evaluate.ranked_lists(o, "query_id", [*order, F.col("record_id")]).filter("rank <= 10").select("query_id", "record_id", "rank")


def _relevant(s, d):
    return _t(s, d, "orders").filter("o_orderstatus = 'F' AND o_orderkey % 2 = 0").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("record_id"))


def _metrics(s, d, order=None):
    return evaluate.metrics(_ranked(s, d, order or [F.desc("o_totalprice")]), _relevant(s, d), 5)


def _metrics_sql(order: str) -> str:
    return f"""(WITH rk AS (SELECT o_custkey AS query_id, o_orderkey AS record_id, row_number() OVER (PARTITION BY o_custkey ORDER BY {order}, o_orderkey) AS rank FROM orders), rel AS (SELECT o_custkey AS query_id, o_orderkey AS record_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0),
 m AS (SELECT rk.query_id, count(*) FILTER (WHERE rank <= 5) AS top, count(*) FILTER (WHERE rank <= 5 AND rel.record_id IS NOT NULL) AS hits, min(rank) FILTER (WHERE rel.record_id IS NOT NULL) AS first FROM rk LEFT JOIN rel ON rk.query_id = rel.query_id AND rk.record_id = rel.record_id WHERE rank <= 10 GROUP BY 1),
 n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1)
 SELECT coalesce(m.query_id, n.query_id) AS query_id, coalesce(CAST(hits AS DOUBLE) / top, 0) AS precision, coalesce(CAST(hits AS DOUBLE) / n.n, 0) AS recall, coalesce(CAST(1.0 AS DOUBLE) / first, 0) AS reciprocal_rank FROM m FULL JOIN n ON m.query_id = n.query_id)"""


def _arms(s, d):
    arms = [("price", 0, [F.desc("o_totalprice")]), ("newest", 1, [F.desc("o_orderdate")]), ("oldest", 2, [F.asc("o_orderdate")])]
    each = None
    for name, position, order in arms:
        m = evaluate.mean_metrics(_metrics(s, d, order)).withColumn("arm", F.lit(name)).withColumn("position", F.lit(position))
        each = m if each is None else each.unionByName(m)
    return evaluate.best_arm(each)


def _stage_durations(s, d):
    return timeline.stage_durations(views.timeline(s, d), ["unit_id"])


STAGE_SQL = f"""{views.TIMELINE_SQL}, st0 AS (SELECT *, last_value(CASE WHEN event_phase = 'start' THEN at_ms END IGNORE NULLS) OVER (PARTITION BY unit_id ORDER BY at_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS started_ms FROM tl),
 st AS (SELECT *, CASE WHEN started_ms IS NOT NULL THEN greatest(0, at_ms - started_ms) END AS duration_ms FROM st0 WHERE event_phase IN ('finish', 'fail'))"""


def _latencies(s, d):
    return timeline.latency_stats(_stage_durations(s, d), "event_type", "duration_ms", STAGES)


def _breakdown(s, d):
    return timeline.unit_breakdown(_stage_durations(s, d).withColumn("stage", F.col("event_type")), ("purchase", "error"))


BREAKDOWN_SQL = f"""{STAGE_SQL}, la AS (SELECT unit_id, event_type AS stage, duration_ms FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, event_type ORDER BY at_ms DESC, event_id DESC) AS r FROM st WHERE duration_ms IS NOT NULL) WHERE r = 1),
 bd AS (SELECT unit_id, max(duration_ms) FILTER (WHERE stage = 'purchase') AS purchase, max(duration_ms) FILTER (WHERE stage = 'error') AS error FROM la GROUP BY unit_id),
 bk AS (SELECT *, coalesce(purchase, 0) + coalesce(error, 0) AS total_ms, CASE WHEN purchase IS NOT NULL AND purchase >= coalesce(error, -1) THEN 'purchase' ELSE 'error' END AS slowest_stage, greatest(coalesce(purchase, -1), coalesce(error, -1)) AS slowest_ms FROM bd)"""


#: Capacity is planned for as many cameras, within so many hours, on groups of eight accelerators.
PLAN = capacity.Plan(cameras=16, window_hours=2.0, accelerators=8, memory_gb=80.0)


def _capacity(s, d):
    calls = views.model_calls(s, d).withColumn("status", F.when(F.col("status") == "O", "succeeded").otherwise("failed"))
    jobs = views.jobs(s, d).select(F.col("created_at").alias("started_at"), F.col("created_at").alias("finished_at"))
    return capacity.report(calls, jobs, views.videos(s, d), PLAN).withColumn("notes", F.array_join("notes", "; "))


def _capacity_unknown(s, d):
    """The derived metrics where inputs are missing: no hours, no wall time, rates told."""
    plans = (PLAN, capacity.Plan(4), capacity.Plan(4, headroom=0.0, measured_rate=0.25), capacity.Plan(4, effective_rate=0.5, accelerators=2), capacity.Plan(4, measured_rate=0.5, memory_gb=24.0))
    given = s.createDataFrame([(0, 1200, 8.0, 3600), (1, 1200, None, 3600), (2, 1200, 8.0, None), (3, 0, 8.0, 0)], "case_id int, requests long, hours double, wall_seconds long")
    out = None
    for i, plan in enumerate(plans):
        one = capacity.estimate(given, plan).withColumn("plan_id", F.lit(i)).withColumn("notes", F.array_join("notes", "; "))
        out = one if out is None else out.unionByName(one)
    return out


CAPACITY_DERIVED = """d0 AS (SELECT *, CASE WHEN hours > 0 THEN CAST(requests AS DOUBLE) / hours END AS hourly, coalesce(p_measured, CASE WHEN wall_seconds > 0 THEN CAST(requests AS DOUBLE) / wall_seconds END) AS measured FROM m),
 d1 AS (SELECT *, hourly * cameras / 3600 AS realtime, coalesce(p_effective, measured * 0.7) AS effective, accelerators * memory AS group_memory FROM d0),
 d2 AS (SELECT *, CASE WHEN headroom > 0 THEN realtime / headroom END AS needed FROM d1), d3 AS (SELECT *, CASE WHEN effective > 0 THEN needed / effective END AS groups FROM d2)"""
CAPACITY_COLUMNS = """round(hourly, 6) AS requests_per_camera_hour, round(hourly * cameras, 6) AS production_requests_per_hour, round(hourly * cameras * window_hours, 6) AS production_requests, round(realtime, 6) AS required_realtime_rate, round(needed, 6) AS required_rate_with_headroom,
 round(measured, 6) AS measured_rate, round(effective, 6) AS effective_rate, round(CASE WHEN effective > 0 THEN hourly * cameras * window_hours / effective / 3600 END, 6) AS processing_hours, round(groups, 6) AS needed_groups, round(groups * accelerators, 6) AS needed_accelerators, round(group_memory, 6) AS group_memory_gb, round(groups * group_memory, 6) AS needed_memory_gb,
 concat_ws('; ', CASE WHEN hourly IS NULL THEN 'video_hours unavailable; cannot compute requests_per_camera_hour' END, CASE WHEN p_measured IS NULL AND coalesce(wall_seconds, 0) <= 0 THEN 'measured_req_s unavailable; provide --effective-req-s or wall-time input' END,
  CASE WHEN hourly IS NOT NULL AND coalesce(effective, 0) <= 0 THEN 'effective_req_s unavailable; cannot compute processing_time_hours' END) AS notes"""
_plan_sql = lambda c, w, h, me, ef, a, g: f"{c} AS cameras, CAST({w} AS DOUBLE) AS window_hours, CAST({h} AS DOUBLE) AS headroom, CAST({me} AS DOUBLE) AS p_measured, CAST({ef} AS DOUBLE) AS p_effective, CAST({a} AS DOUBLE) AS accelerators, CAST({g} AS DOUBLE) AS memory"
CAPACITY_SQL = f"""{views.CALLS_SQL}, m AS (SELECT (SELECT count(*) FROM calls) AS requests, (SELECT count(*) FROM calls WHERE status = 'O') AS succeeded, (SELECT count(*) FROM calls WHERE status <> 'O') AS failed, (SELECT quantile_disc(duration_ms, 0.5) / 1000 FROM calls) AS p50_s, (SELECT quantile_disc(duration_ms, 0.95) / 1000 FROM calls) AS p95_s,
 (SELECT round(sum(CAST(trunc(c_acctbal * 1000) AS BIGINT)) FILTER (WHERE CAST(trunc(c_acctbal * 1000) AS BIGINT) > 0) / 3.6e6, 6) FROM customer) AS hours,
 (SELECT CAST(epoch(max(o_orderdate)) - epoch(min(o_orderdate)) AS BIGINT) FROM orders) AS wall_seconds, (SELECT CAST(sum(greatest(0, m - 1)) AS BIGINT) FROM (SELECT max(attempt_count) AS m FROM calls GROUP BY unit_id)) AS retries, {_plan_sql(16, 2.0, 0.7, "NULL", "NULL", 8, 80.0)}), {CAPACITY_DERIVED}
 SELECT requests, succeeded, failed, hours, wall_seconds, retries, p50_s, p95_s, {CAPACITY_COLUMNS} FROM d3"""
UNKNOWN_SQL = f"""WITH c AS (SELECT * FROM (VALUES (0, 1200, CAST(8 AS DOUBLE), 3600), (1, 1200, NULL, 3600), (2, 1200, 8, NULL), (3, 0, 8, 0)) AS t(case_id, requests, hours, wall_seconds)),
 pl AS (SELECT 0 AS plan_id, {_plan_sql(16, 2.0, 0.7, "NULL", "NULL", 8, 80.0)} UNION ALL SELECT 1, {_plan_sql(4, 1, 0.7, "NULL", "NULL", "NULL", "NULL")} UNION ALL SELECT 2, {_plan_sql(4, 1, 0, 0.25, "NULL", "NULL", "NULL")} UNION ALL SELECT 3, {_plan_sql(4, 1, 0.7, "NULL", 0.5, 2, "NULL")} UNION ALL SELECT 4, {_plan_sql(4, 1, 0.7, 0.5, "NULL", "NULL", 24.0)}),
 m AS (SELECT * FROM c, pl), {CAPACITY_DERIVED} SELECT case_id, plan_id, requests, hours, wall_seconds, {CAPACITY_COLUMNS} FROM d3"""


def _gate(s, d):
    line = _t(s, d, "lineitem")
    det = F.array(F.struct(F.col("l_returnflag").alias("label"), (1 - F.col("l_discount") * 8).alias("confidence")), F.struct(F.lit("person").alias("label"), (F.col("l_tax") * 10).alias("confidence")))
    return line.select(F.col("l_orderkey").alias("unit_id"), F.lit(8).alias("frame_count"), det.alias("detections"))


RATIO_SQL = "ra AS (SELECT l_orderkey AS unit_id, sum(CASE WHEN l_tax * 10 >= 0.5 THEN 1 ELSE 0 END) / 8 AS ratio FROM lineitem GROUP BY 1)"


def _decisions(s, d):
    r = pipeline.positive_ratio(_gate(s, d), "person", 0.5)
    forced = _t(s, d, "orders").select(F.col("o_orderkey").alias("unit_id"), F.when(F.col("o_orderkey") % 17 == 0, "manual").otherwise("").alias("force_reason"))
    return pipeline.gate_decision(forced.join(r, "unit_id", "left"), 0.25).select("unit_id", "triggered", "reason")


DECISIONS_SQL = f"{RATIO_SQL}, de AS (SELECT o_orderkey AS unit_id, o_orderkey % 17 = 0 OR coalesce(ratio, 0) >= 0.25 AS triggered, CASE WHEN o_orderkey % 17 = 0 THEN 'forced:manual' WHEN coalesce(ratio, 0) >= 0.25 THEN 'rule_matched' ELSE 'suppressed' END AS reason FROM orders LEFT JOIN ra ON o_orderkey = unit_id)"


def _dispatch(s, d):
    o = _t(s, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("unit_id"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("is_high"))
    from pyspark.sql import Window

    o = o.withColumn("ordinal", F.row_number().over(Window.partitionBy("job_id", "is_high").orderBy("unit_id")) - 1)
    return temporal.dispatch_order(o, 2).select("job_id", "unit_id", "position")


def _redact(s, d):
    p = _t(s, d, "part")
    kind = F.col("p_partkey") % 4
    key = F.when(kind == 0, "api_key").otherwise("note")
    value = F.when(kind == 1, F.concat(F.lit("/srv/media/"), "p_name")).when(kind == 2, F.concat(F.lit("data:image/png;base64,"), "p_brand")).otherwise(F.col("p_name"))
    return p.select("p_partkey", text.redacted(key, value).alias("shown"))


def _model_json(s, d):
    k = F.col("p_partkey") % 4
    answer = F.when(k == 0, F.concat(F.lit('```json\n{"name": "'), "p_brand", F.lit('"}\n```'))).when(k == 1, F.lit("")).when(k == 2, F.concat(F.lit("no object: "), "p_name")).otherwise(F.concat(F.lit('{"size": '), F.col("p_size").cast("string"), F.lit("} done")))
    p = _t(s, d, "part").withColumn("answer", answer)
    return p.select("p_partkey", text.model_status(F.col("answer")).alias("status"), F.get_json_object(text.model_json(F.col("answer")), "$.name").alias("name"))


def _latest_status(s, d):
    return pipeline.latest(views.timeline(s, d), ["unit_id"], ["at_ms", "event_id"], ["event_phase", "event_type"])


def _upsert(s, d):
    c = _t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("created"))
    new = _t(s, d, "orders").select((F.col("o_custkey") * 2 % 2000).alias("id"), F.col("o_orderpriority").alias("segment"), F.lit(-1).cast("int").alias("created"), F.col("o_orderkey").alias("seq"))
    return pipeline.upsert(c, new, ["id"], ["created"])


def _conflicts(s, d):
    c = _t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("payload"))
    new = _t(s, d, "customer").select((F.col("c_custkey") + 20).alias("id"), F.col("c_nationkey").alias("payload"), F.col("c_custkey").alias("seq"))
    fresh, conflict = pipeline.insert_new(c, new, ["id"], ["payload"])
    return fresh.select("id", F.lit("new").alias("outcome")).unionByName(conflict.withColumn("outcome", F.lit("conflict")))


def _illegal(s, d):
    from pyspark.sql import Window

    name = F.element_at(F.create_map(*[F.lit(x) for x in ("O", "queued", "F", "running", "P", "succeeded")]), F.col("o_orderstatus"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    c = _t(s, d, "orders").select("o_custkey", "o_orderkey", name.alias("to_status"), F.lag(name).over(w).alias("from_status")).filter("from_status IS NOT NULL")
    return pipeline.illegal_transitions(c).select("o_orderkey", "from_status", "to_status")


def _tokens(s, d):
    return _t(s, d, "benchmark").select("item_id", udfs.playback_token("test-only")(F.col("item_id").cast("string")).alias("token"))


def _frames_q(strategy):
    return lambda s, d: temporal.select_frames(_frames(s, d), 6, strategy)


QUERIES = {
    "default_segments": lambda s, d: temporal.default_segments(_durations(s, d), 12000, 3000).select("video_id", "segment_start_ms", "segment_end_ms", "window_index"),
    "high_freq_windows": lambda s, d: temporal.high_freq_windows(_spans(s, d), 4000, 0.25, 1000).select("trigger_id", "window_start_ms", "window_end_ms"),
    "sample_timestamps": lambda s, d: temporal.sample_timestamps(_durations(s, d), 30000).select("video_id", "timestamp_ms"),
    "uniform_timestamps": lambda s, d: _durations(s, d).select("video_id", F.explode(temporal.uniform_timestamps(F.lit(0), F.col("duration_ms"), 4)).alias("timestamp_ms")),
    "motion_triggers": _triggers,
    "trigger_windows": lambda s, d: temporal.trigger_windows(_triggers(s, d), 2 * HOUR, 0.5, HOUR // 2),
    "frame_select_bins": _frames_q("bins_then_score"),
    "frame_select_score": _frames_q("score"),
    "frame_select_uniform": _frames_q("uniform"),
    "dispatch_order": _dispatch,
    "claim_order": lambda s, d: pipeline.claim_order(_tasks(s, d), _now(), 200).select("task_id", "priority", "next_run_at"),
    "stale_running": lambda s, d: pipeline.stale_running(_tasks(s, d), _now(), 100).select("unit_id", "started_at"),
    "scale_rollup": lambda s, d: pipeline.scale_status(_units(s, d)),
    "job_rollup": lambda s, d: pipeline.job_status(pipeline.scale_status(_units(s, d)), "1-URGENT"),
    "orphan_sweep": lambda s, d: _swept(s, d).filter("error_code IS NOT NULL").select("unit_id", "status", "error_code"),
    "swept_jobs": lambda s, d: pipeline.swept_jobs(_swept(s, d), "1-URGENT"),
    "residual_reconcile": lambda s, d: pipeline.reconcile_residual(_units(s, d), F.lit(4)).select("unit_id", "status", "error_code"),
    "publish_upsert": lambda s, d: _publish(s, d, "now"),
    "history_snapshot": lambda s, d: _publish(s, d, "history"),
    "dimension_upsert": _upsert,
    "idempotent_insert": _conflicts,
    "illegal_transitions": _illegal,
    "latest_status": _latest_status,
    "gate_ratio": lambda s, d: pipeline.positive_ratio(_gate(s, d), "person", 0.5),
    "gate_decision": _decisions,
    "gate_kpis": lambda s, d: capacity.gate_kpis(_decisions(s, d)),
    "event_rate_per_sec": lambda s, d: timeline.event_rate(views.timeline(s, d)),
    "active_series": lambda s, d: timeline.active_series(views.timeline(s, d).withColumn("shard", F.col("unit_id") % 8), "unit_id", ["shard"]),
    "peak_concurrency": lambda s, d: timeline.peak_active(views.timeline(s, d).withColumn("shard", F.col("unit_id") % 8), "unit_id", ["shard"]),
    "stage_duration_asof": lambda s, d: _stage_durations(s, d).select("event_id", "unit_id", "started_ms", "duration_ms"),
    "latency_interpolated_by_stage": _latencies,
    "unit_stage_pivot": _breakdown,
    "top_slow_units": lambda s, d: _breakdown(s, d).orderBy(F.desc("slowest_ms"), "unit_id").limit(10),
    "group_summary_gsets": lambda s, d: timeline.count_groupings(views.timeline(s, d), "event_type", "event_phase"),
    "bottleneck_hints": lambda s, d: timeline.exceeded(timeline.peak_active(views.timeline(s, d).withColumn("shard", F.col("unit_id") % 8), "unit_id", ["shard"]), [("peak", 3, "many_active"), ("peak", 5, "very_many_active")], "none").select("shard", F.array_join("hints", ",").alias("hints")),
    "requests_by_scale": lambda s, d: capacity.group_count(views.model_calls(s, d), "analysis_scale"),
    "status_counts": lambda s, d: capacity.group_count(views.model_calls(s, d), "status"),
    "requests_by_video": lambda s, d: capacity.requests_by_video(views.model_calls(s, d), views.jobs(s, d)),
    "requests_by_camera": lambda s, d: capacity.requests_by_camera(views.model_calls(s, d), views.jobs(s, d), views.videos(s, d)),
    "retry_estimate": lambda s, d: capacity.retry_estimate(views.model_calls(s, d)),
    "latency_nearest_rank": lambda s, d: capacity.nearest_rank(views.model_calls(s, d), ["analysis_scale"], "duration_ms", {"p50": 0.5, "p95": 0.95}).select("analysis_scale", "p50", "p95"),
    "video_hours": lambda s, d: capacity.video_hours(views.videos(s, d)),
    "job_wall": lambda s, d: capacity.job_wall(views.jobs(s, d), "created_at", "created_at"),
    "capacity_estimate": _capacity,
    "capacity_unknowns": _capacity_unknown,
    "distinct_counts": lambda s, d: capacity.distinct_counts(views.model_calls(s, d)),
    "precision_recall_mrr": lambda s, d: _metrics(s, d).select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "reciprocal_rank")]),
    "mean_metrics": lambda s, d: evaluate.mean_metrics(_metrics(s, d)),
    "arm_experiment": _arms,
    "redact_metadata": _redact,
    "parse_model_json": _model_json,
    "retry_backoff": lambda s, d: _t(s, d, "lineitem").select(F.col("l_linenumber").alias("attempt")).distinct().select("attempt", numeric.backoff(F.col("attempt"), 0.5, 8.0).alias("delay_s")),
    "polygon_box": lambda s, d: _t(s, d, "embeddings").select("vec_id", numeric.bounding_box(F.transform(F.slice("embedding", 1, 8), lambda x: F.round(x.cast("double"), 4)), F.transform(F.slice("embedding", 9, 8), lambda x: F.round(x.cast("double"), 4))).alias("b")).select("vec_id", "b.*"),
    "table_counts": lambda s, d: _counts(s, d),
    "playback_tokens": _tokens,
    "streaming_event_rate": streams.event_rate,
    "streaming_hopping": streams.hopping_counts,
    "streaming_dedup": streams.distinct_events,
    "streaming_sessions": lambda s, d: streams.sessions(s, d, 6 * HOUR),
    "streaming_motion": lambda s, d: motion.motion_triggers(s, d, motion.Rules(THRESHOLD, HOUR, 6 * HOUR)),
    "streaming_spans": lambda s, d: spans.spans(s, d, 3 * HOUR),
    "streaming_upserts": lambda s, d: upserts.keyed_events(s, d)[0],
    "streaming_conflicts": lambda s, d: upserts.keyed_events(s, d)[1],
    "streaming_expiry": lambda s, d: streams.sessions(s, d, 12 * HOUR, 20 * HOUR),
}


def _counts(s, d):
    """Rows of each table."""
    out = None
    for name in views.TABLES:
        n = _t(s, d, name).agg(F.count("*").alias("n")).withColumn("table_name", F.lit(name))
        out = n if out is None else out.unionByName(n)
    return out


_PICK = "SELECT series, frame_index, timestamp_ms FROM"
PEAKS_SQL = f"""{views.TIMELINE_SQL}, mk AS (SELECT *, unit_id % 8 AS shard, CASE event_phase WHEN 'start' THEN 1 WHEN 'instant' THEN NULL ELSE 0 END AS mark FROM tl WHERE event_phase <> 'instant'),
 dl AS (SELECT *, mark - coalesce(lag(mark) OVER (PARTITION BY unit_id ORDER BY at_ms, event_id), 0) AS delta FROM mk),
 ac AS (SELECT shard, at_ms, event_id, sum(delta) OVER (PARTITION BY shard ORDER BY at_ms, event_id ROWS UNBOUNDED PRECEDING) AS active FROM dl WHERE delta <> 0)"""

ORACLE_SQL = {
    "default_segments": f"WITH {DURATIONS_SQL}, g AS (SELECT video_id, duration_ms, unnest(generate_series(0, duration_ms - 1, 9000)) AS s FROM dur WHERE duration_ms > 0) SELECT video_id, s AS segment_start_ms, least(s + 12000, duration_ms) AS segment_end_ms, s // 9000 AS window_index FROM g WHERE s = 0 OR s + 3000 < duration_ms",
    "high_freq_windows": f"WITH {SPANS_SQL}, g AS (SELECT *, unnest(CASE WHEN end_ms - start_ms <= 4000 THEN [start_ms] ELSE generate_series(start_ms, end_ms - 1, 3000) END) AS s FROM sp WHERE end_ms > start_ms) SELECT trigger_id, s AS window_start_ms, least(s + 4000, end_ms) AS window_end_ms FROM g WHERE (s = start_ms OR s - 3000 + 4000 < end_ms) AND least(s + 4000, end_ms) - s >= 1000",
    "sample_timestamps": f"WITH {DURATIONS_SQL} SELECT video_id, unnest(generate_series(0, duration_ms - 1, 30000)) AS timestamp_ms FROM dur WHERE duration_ms > 0",
    "uniform_timestamps": f"WITH {DURATIONS_SQL} SELECT video_id, CAST(floor(duration_ms / 5 * i) AS BIGINT) AS timestamp_ms FROM dur, (SELECT unnest([1, 2, 3, 4]) AS i)",
    "motion_triggers": f"WITH {TRIGGERS_SQL} SELECT * FROM trig",
    "trigger_windows": f"""WITH {TRIGGERS_SQL}, ti AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY trigger_start_ms) - 1 AS x FROM trig), g AS (SELECT *, unnest(CASE WHEN trigger_end_ms - trigger_start_ms <= {2 * HOUR} THEN [trigger_start_ms] ELSE generate_series(trigger_start_ms, trigger_end_ms - 1, {HOUR}) END) AS s FROM ti),
 h AS (SELECT series, x, s, least(s + {2 * HOUR}, trigger_end_ms) AS e FROM g WHERE (s = trigger_start_ms OR s - {HOUR} + {2 * HOUR} < trigger_end_ms) AND least(s + {2 * HOUR}, trigger_end_ms) - s >= {HOUR // 2}),
 n AS (SELECT *, x * 1000 + row_number() OVER (PARTITION BY series, x ORDER BY s) - 1 AS w FROM h) SELECT series, s AS window_start_ms, e AS window_end_ms, min(w) AS window_index FROM n GROUP BY series, s, e""",
    "frame_select_bins": f"""WITH {FRAMES_SQL}, b AS (SELECT *, least(5, (timestamp_ms - t0) * 6 // (t1 - t0 + 1)) AS bin FROM fr), c AS (SELECT *, row_number() OVER (PARTITION BY series, bin ORDER BY score DESC, frame_index) AS ib FROM b),
 r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY CASE WHEN ib > 1 THEN 1 ELSE 0 END, CASE WHEN ib = 1 THEN bin END NULLS FIRST, score DESC, frame_index) AS r FROM c) {_PICK} r WHERE r <= 6""",
    "frame_select_score": f"WITH {FRAMES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY score DESC, frame_index) AS r FROM fr) {_PICK} r WHERE r <= 6",
    "frame_select_uniform": f"WITH {FRAMES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY timestamp_ms, frame_index) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM fr) {_PICK} r WHERE i IN (0, n // least(6, n), 2 * n // least(6, n), 3 * n // least(6, n), 4 * n // least(6, n), 5 * n // least(6, n))",
    "dispatch_order": "WITH o AS (SELECT o_custkey AS job_id, o_orderkey AS unit_id, o_orderpriority IN ('1-URGENT', '2-HIGH') AS hi FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY job_id, hi ORDER BY unit_id) - 1 AS i FROM o) SELECT job_id, unit_id, row_number() OVER (PARTITION BY job_id ORDER BY CASE WHEN hi THEN i // 2 ELSE i END, CASE WHEN hi THEN 0 ELSE 1 END, i) AS position FROM n",
    "claim_order": f"WITH {TASKS_SQL} SELECT task_id, priority, next_run_at FROM ta WHERE next_run_at <= TIMESTAMP '{NOW}' AND (status = 'queued' OR (status = 'running' AND lease_expires_at < TIMESTAMP '{NOW}')) ORDER BY priority DESC, next_run_at, task_id LIMIT 200",
    "stale_running": f"WITH {TASKS_SQL} SELECT task_id AS unit_id, started_at FROM ta WHERE status = 'running' AND started_at IS NOT NULL AND started_at < TIMESTAMP '{NOW}' ORDER BY started_at, task_id LIMIT 100",
    "scale_rollup": f"WITH {UNITS_SQL}, {ROLLUP_SQL} SELECT * FROM ss",
    "job_rollup": f"WITH {UNITS_SQL}, {ROLLUP_SQL} SELECT * FROM js",
    "orphan_sweep": f"WITH {UNITS_SQL}, {SWEPT_SQL} SELECT unit_id, status, error_code FROM sw WHERE error_code IS NOT NULL",
    "swept_jobs": f"WITH {UNITS_SQL.replace('u AS', 'u0 AS', 1)}, {SWEPT_SQL.replace('FROM u ', 'FROM u0 ')}, u AS (SELECT * FROM sw WHERE job_id IN (SELECT job_id FROM sw WHERE error_code IS NOT NULL)), {ROLLUP_SQL} SELECT * FROM js",
    "residual_reconcile": f"WITH {UNITS_SQL} SELECT unit_id, CASE WHEN status = 'running' AND job_id = 4 THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' AND job_id = 4 THEN 'analysis_unit_failed' END AS error_code FROM u",
    "publish_upsert": f"WITH {INCOMING_SQL} SELECT record_id, video_id, segment_start_ms, segment_end_ms, analysis_scale, security_level FROM nx WHERE nxt IS NULL",
    "history_snapshot": f"WITH {INCOMING_SQL} SELECT record_id AS old_record_id, nxt AS replaced_by_record_id, 'job_1' AS archived_by FROM nx WHERE nxt IS NOT NULL",
    "dimension_upsert": "WITH n AS (SELECT id, segment FROM (SELECT o_custkey * 2 % 2000 AS id, o_orderpriority AS segment, row_number() OVER (PARTITION BY o_custkey * 2 % 2000 ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1) SELECT coalesce(c_custkey, n.id) AS id, coalesce(n.segment, c_mktsegment) AS segment, coalesce(c_nationkey, -1) AS created FROM customer FULL JOIN n ON c_custkey = n.id",
    "idempotent_insert": "WITH n AS (SELECT c_custkey + 20 AS id, c_nationkey AS payload FROM customer) SELECT n.id, CASE WHEN c_custkey IS NULL THEN 'new' ELSE 'conflict' END AS outcome FROM n LEFT JOIN customer ON n.id = c_custkey WHERE c_custkey IS NULL OR c_nationkey <> n.payload",
    "illegal_transitions": "WITH s AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'running' ELSE 'succeeded' END AS t, o_orderdate FROM orders), c AS (SELECT o_orderkey, t AS to_status, lag(t) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS from_status FROM s) SELECT o_orderkey, from_status, to_status FROM c WHERE from_status <> to_status AND NOT (from_status = 'queued' AND to_status = 'running') AND NOT (from_status = 'running' AND to_status = 'succeeded')",
    "latest_status": f"WITH {views.TIMELINE_SQL} SELECT unit_id, event_phase, event_type FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY at_ms DESC, event_id DESC) AS r FROM tl) WHERE r = 1",
    "gate_ratio": f"WITH {RATIO_SQL} SELECT * FROM ra",
    "gate_decision": f"WITH {DECISIONS_SQL} SELECT * FROM de",
    "gate_kpis": f"WITH {DECISIONS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE triggered) AS n_triggered, count(*) FILTER (WHERE NOT triggered) AS detector_only, round(avg(CAST(triggered AS INT)), 6) AS positive_rate FROM de",
    "event_rate_per_sec": f"WITH {views.TIMELINE_SQL} SELECT at_ms // 1000 AS second, count(*) AS n FROM tl GROUP BY 1",
    "active_series": f"WITH {PEAKS_SQL} SELECT shard, at_ms, event_id, CAST(active AS BIGINT) AS active FROM ac",
    "peak_concurrency": f"WITH {PEAKS_SQL} SELECT shard, CAST(max(active) AS BIGINT) AS peak FROM ac GROUP BY shard",
    "bottleneck_hints": f"WITH {PEAKS_SQL}, pk AS (SELECT shard, max(active) AS peak FROM ac GROUP BY shard) SELECT shard, CASE WHEN peak > 5 THEN 'many_active,very_many_active' WHEN peak > 3 THEN 'many_active' ELSE 'none' END AS hints FROM pk",
    "stage_duration_asof": f"WITH {STAGE_SQL} SELECT event_id, unit_id, started_ms, duration_ms FROM st",
    "latency_interpolated_by_stage": f"WITH {STAGE_SQL}, z AS (SELECT unnest(['signup', 'purchase', 'error']) AS event_type), a AS (SELECT event_type, count(*) AS n, list_sort(list(duration_ms)) AS l, max(duration_ms) AS most FROM st WHERE duration_ms IS NOT NULL GROUP BY 1) SELECT z.event_type, coalesce(n, 0) AS n, {lerp_sql(0.5)} AS p50, {lerp_sql(0.9)} AS p90, {lerp_sql(0.99)} AS p99, most FROM z LEFT JOIN a ON z.event_type = a.event_type",
    "unit_stage_pivot": f"WITH {BREAKDOWN_SQL} SELECT * FROM bk",
    "top_slow_units": f"WITH {BREAKDOWN_SQL} SELECT * FROM bk ORDER BY slowest_ms DESC, unit_id LIMIT 10",
    "group_summary_gsets": f"WITH {views.TIMELINE_SQL} SELECT 'event_type' AS grouping, event_type AS value, count(*) AS events, count(DISTINCT unit_id) AS units, count(*) FILTER (WHERE event_phase = 'fail') AS failures FROM tl GROUP BY event_type UNION ALL SELECT 'event_phase', event_phase, count(*), count(DISTINCT unit_id), count(*) FILTER (WHERE event_phase = 'fail') FROM tl GROUP BY event_phase",
    "requests_by_scale": f"WITH {views.CALLS_SQL} SELECT analysis_scale AS value, count(*) AS n FROM calls WHERE analysis_scale IS NOT NULL GROUP BY 1",
    "status_counts": f"WITH {views.CALLS_SQL} SELECT status AS value, count(*) AS n FROM calls WHERE status IS NOT NULL GROUP BY 1",
    "requests_by_video": "SELECT o_custkey AS video_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "requests_by_camera": "SELECT c_nationkey AS camera_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "retry_estimate": "SELECT CAST(sum(greatest(0, m - 1)) AS BIGINT) AS retries FROM (SELECT max(l_linenumber) AS m FROM lineitem GROUP BY l_orderkey)",
    "latency_nearest_rank": "SELECT l_returnflag AS analysis_scale, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1",
    "video_hours": "SELECT round(sum(CAST(trunc(c_acctbal * 1000) AS BIGINT)) / 3.6e6, 6) AS hours FROM customer WHERE CAST(trunc(c_acctbal * 1000) AS BIGINT) > 0",
    "job_wall": "SELECT CAST(epoch(max(o_orderdate)) - epoch(min(o_orderdate)) AS BIGINT) AS wall_seconds FROM orders",
    "capacity_estimate": f"WITH {CAPACITY_SQL}",
    "capacity_unknowns": UNKNOWN_SQL,
    "distinct_counts": "SELECT count(DISTINCT l_orderkey) AS jobs, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS calls FROM lineitem",
    "precision_recall_mrr": f"SELECT query_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank FROM {_metrics_sql('o_totalprice DESC')}",
    "mean_metrics": f"SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS reciprocal_rank, count(*) AS queries FROM {_metrics_sql('o_totalprice DESC')}",
    "arm_experiment": f"WITH a AS (SELECT 'price' AS arm, 0 AS p, round(avg(reciprocal_rank), 6) AS m FROM {_metrics_sql('o_totalprice DESC')} UNION ALL SELECT 'newest', 1, round(avg(reciprocal_rank), 6) FROM {_metrics_sql('o_orderdate DESC')} UNION ALL SELECT 'oldest', 2, round(avg(reciprocal_rank), 6) FROM {_metrics_sql('o_orderdate')}) SELECT arm AS best_arm FROM a ORDER BY m DESC, p LIMIT 1",
    "redact_metadata": "SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 1, 2) THEN '[redacted]' ELSE p_name END AS shown FROM part",
    "parse_model_json": "SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'empty' WHEN 2 THEN 'no_json' ELSE 'ok' END AS status, CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS name FROM part",
    "retry_backoff": "SELECT DISTINCT l_linenumber AS attempt, least(0.5 * pow(2.0, l_linenumber - 1), CAST(8.0 AS DOUBLE)) AS delay_s FROM lineitem",
    "polygon_box": "WITH e AS (SELECT vec_id, [round(CAST(x AS DOUBLE), 4) for x in embedding] AS v FROM embeddings) SELECT vec_id, list_min(v[1:8]) AS x0, list_min(v[9:16]) AS y0, list_max(v[1:8]) AS x1, list_max(v[9:16]) AS y1 FROM e",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in views.TABLES),
    "streaming_event_rate": "SELECT epoch_us(ts) // 1000000 AS second, count(*) AS n FROM events GROUP BY 1",
    "streaming_hopping": "WITH w AS (SELECT (epoch_us(ts) // 1000000 // 32400 - i) * 32400 AS start_s, epoch_us(ts) AS t FROM events, (SELECT unnest([0, 1]) AS i)) SELECT start_s, count(*) AS n FROM w WHERE t < (start_s + 43200) * 1000000 GROUP BY 1",
    "streaming_motion": f"WITH {TRIGGERS_SQL} SELECT * FROM trig",
    "streaming_spans": f"""WITH {views.TIMELINE_SQL}, p AS (SELECT s.unit_id AS unit, s.event_id AS start_id, s.at_ms AS a, e.event_id AS end_id, e.at_ms AS z FROM tl s JOIN tl e ON e.unit_id = s.unit_id AND e.event_phase IN ('finish', 'fail') AND (e.at_ms, e.event_id) > (s.at_ms, s.event_id) AND e.at_ms - s.at_ms <= {3 * HOUR} WHERE s.event_phase = 'start'),
 r AS (SELECT *, row_number() OVER (PARTITION BY end_id ORDER BY a DESC, start_id DESC) AS n FROM p)
 SELECT unit, start_id, end_id, z - a AS duration_ms FROM r WHERE n = 1 UNION ALL SELECT unit_id, event_id, NULL, NULL FROM tl WHERE event_phase = 'start' AND event_id NOT IN (SELECT start_id FROM p)""",
    "streaming_upserts": "SELECT event_id, event_type, value, 0 AS delivery FROM events",
    "streaming_conflicts": "SELECT event_id, event_type, value + 1 AS value, 1 AS delivery FROM events WHERE event_id % 10 = 0",
    "streaming_dedup": "SELECT event_id, event_type FROM events",
    "streaming_expiry": f"""WITH RECURSIVE {views.TIMELINE_SQL}, o AS (SELECT unit_id, at_ms, row_number() OVER (PARTITION BY unit_id ORDER BY at_ms, event_id) AS r FROM tl),
 x(unit_id, r, at_ms, start_ms) AS (SELECT unit_id, r, at_ms, at_ms FROM o WHERE r = 1 UNION ALL SELECT o.unit_id, o.r, o.at_ms, CASE WHEN o.at_ms - x.at_ms <= {12 * HOUR} AND o.at_ms - x.start_ms <= {20 * HOUR} THEN x.start_ms ELSE o.at_ms END FROM x JOIN o ON o.unit_id = x.unit_id AND o.r = x.r + 1)
 SELECT unit_id AS user_id, start_ms, max(at_ms) AS end_ms, count(*) AS n FROM x GROUP BY 1, 2""",
    "streaming_sessions": f"WITH {views.TIMELINE_SQL}, a AS (SELECT unit_id, at_ms, event_id, CASE WHEN at_ms - lag(at_ms) OVER w <= {6 * HOUR} THEN 0 ELSE 1 END AS f FROM tl WINDOW w AS (PARTITION BY unit_id ORDER BY at_ms, event_id)), b AS (SELECT *, sum(f) OVER (PARTITION BY unit_id ORDER BY at_ms, event_id) AS g FROM a) SELECT unit_id AS user_id, min(at_ms) AS start_ms, max(at_ms) AS end_ms, count(*) AS n FROM b GROUP BY unit_id, g",
}
