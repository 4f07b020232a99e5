"""Domain tables as deterministic views over the driver's parquet tables (nothing is written)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed step between the segments of a video, and their length, in ms.
STEP_MS, SEGMENT_MS = 9000, 12000
#: All tables of a scale-factor folder.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def after(ms) -> Column:
    """So many ms (a bigint) after the first of January 2024."""
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (ms / 1000).cast("decimal(18,6)"))


def _record() -> dict[str, Column]:
    """What a document alone tells of its record: the id, the first line as the static text, the rest as the dynamic."""
    return {
        "record_id": F.format_string("doc_%08d", "doc_id"),
        "static_text": F.substring_index("text", "\n", 1),
        "dynamic_text": F.expr("substring(text, length(substring_index(text, '\\n', 1)) + 2)"),
    }


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and texts of all observations (record_id, static_text, dynamic_text).

    Labels tell no more than how often a document is there, so they are joined only if one has several, and no text is shuffled for them.
    """
    docs = table(spark, sf_dir, "documents")
    several = table(spark, sf_dir, "labels").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    if not several.isEmpty():
        docs = docs.join(several, "doc_id", "left").withColumn("_", F.explode(F.array_repeat(F.lit(0), F.coalesce("n", F.lit(1)).cast("int"))))
    return docs.select(*[c.alias(k) for k, c in _record().items()])


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation records: documents with their labels; the first line is the static text, the rest the dynamic."""
    labels = table(spark, sf_dir, "labels")
    start = F.floor(F.col("doc_id") / 50).cast("bigint") * STEP_MS
    record = _record()
    level = F.when(F.col("toxic") == 1, "restricted").when(F.col("quality") == 1, "public").when(F.col("quality") == 0, "confidential").otherwise("internal")
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "medium").otherwise("long")
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        "doc_id",
        record["record_id"].alias("record_id"),
        F.lit("tenant_default").alias("tenant_id"),
        F.concat(F.lit("vid_"), (F.col("doc_id") % 50).cast("string")).alias("video_id"),
        F.when(F.col("doc_id") % 2 == 0, "default_segment").otherwise("high_freq_event").alias("analysis_scale"),
        start.alias("segment_start_ms"),
        (start + SEGMENT_MS).alias("segment_end_ms"),
        after(start).alias("observed_start"),
        after(start + SEGMENT_MS).alias("observed_end"),
        F.col("source").alias("camera_id"),
        F.col("lang").alias("location_id"),
        record["static_text"].alias("static_text"),
        record["dynamic_text"].alias("dynamic_text"),
        F.array("lang", "source", size).alias("tags"),
        F.when(F.col("doc_id") % 3 == 0, "pol_a").otherwise("pol_b").alias("access_policy_id"),
        level.alias("security_level"),
    )


OBSERVATIONS_SQL = """obs AS (SELECT d.doc_id, printf('doc_%08d', d.doc_id) AS record_id, 'tenant_default' AS tenant_id, 'vid_' || CAST(d.doc_id % 50 AS VARCHAR) AS video_id,
 CASE WHEN d.doc_id % 2 = 0 THEN 'default_segment' ELSE 'high_freq_event' END AS analysis_scale, (d.doc_id // 50) * 9000 AS segment_start_ms, (d.doc_id // 50) * 9000 + 12000 AS segment_end_ms,
 TIMESTAMP '2024-01-01' + to_milliseconds((d.doc_id // 50) * 9000) AS observed_start, TIMESTAMP '2024-01-01' + to_milliseconds((d.doc_id // 50) * 9000 + 12000) AS observed_end,
 d.source AS camera_id, d.lang AS location_id, split_part(d.text, chr(10), 1) AS static_text, substr(d.text, length(split_part(d.text, chr(10), 1)) + 2) AS dynamic_text,
 [d.lang, d.source, CASE WHEN d.n_chars < 500 THEN 'short' WHEN d.n_chars < 3000 THEN 'medium' ELSE 'long' END] AS tags, CASE WHEN d.doc_id % 3 = 0 THEN 'pol_a' ELSE 'pol_b' END AS access_policy_id,
 CASE WHEN l.toxic = 1 THEN 'restricted' WHEN l.quality = 1 THEN 'public' WHEN l.quality = 0 THEN 'confidential' ELSE 'internal' END AS security_level
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation vectors: embeddings, static or dynamic by the parity of the label."""
    return table(spark, sf_dir, "embeddings").select(
        F.format_string("doc_%08d", "vec_id").alias("record_id"), F.col("vec_id").alias("doc_id"), F.when(F.col("label") % 2 == 0, "static").otherwise("dynamic").alias("vector_type"), F.col("embedding").cast("array<double>").alias("embedding"), "label"
    )


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeline events: a user is a unit; signup starts, purchase finishes, error fails, the rest are instants."""
    phase = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "finish").when(F.col("event_type") == "error", "fail").otherwise("instant")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("unit_id"), F.col("ts").alias("occurred_at"), F.expr("unix_millis(CAST(ts AS TIMESTAMP))").alias("at_ms"), phase.alias("event_phase"), "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k")
    )


TIMELINE_SQL = """tl AS (SELECT event_id, user_id AS unit_id, ts AS occurred_at, epoch_us(ts) // 1000 AS at_ms, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' ELSE 'instant' END AS event_phase,
 event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


#: Names of the events of an analysis, by the last digit of the id.
EVENT_NAMES = ("unit_running", "unit_finished", "frame_select", "media_refs_built", "detector_gate", "vlm_scheduler_wait", "vlm_provider_call", "publication_finished", "job_started", "heartbeat")


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of an analysis: names by the id, phases by the id (instant where units and publications are told), ids of units, spans and calls that are empty now and then."""
    e = table(spark, sf_dir, "events")
    part = lambda c, n, k, prefix: F.when(F.col("event_id") % n != k, F.concat(F.lit(prefix), c.cast("string"))).otherwise("")
    name = F.get(F.array(*map(F.lit, EVENT_NAMES)), (F.col("event_id") % 10).cast("int"))
    turn = F.floor(F.col("event_id") / 10) % 5
    phase = F.when((F.col("event_id") % 10).isin(2, 3, 4, 5, 6), F.when(turn < 3, "start").when(turn == 3, "finish").otherwise("fail")).when(F.col("event_id") % 10 == 8, "start").otherwise("instant")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        "event_id",
        F.col("ts").alias("occurred_at"),
        F.expr("unix_millis(CAST(ts AS TIMESTAMP))").alias("at_ms"),
        name.alias("event_name"),
        phase.alias("event_phase"),
        part(F.col("user_id") % 20, 1, 1, "j").alias("job_id"),
        part(F.col("user_id"), 23, 0, "u").alias("unit_id"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string"))).alias("span_id"),
        part(F.col("user_id") % 70, 4, 0, "c").alias("model_call_id"),
        F.when(k % 3 == 0, "default_segment").when(k % 3 == 1, "high_freq_event").alias("analysis_scale"),
        F.when(k % 2 == 0, "segment").alias("unit_kind"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "").otherwise("ok").alias("status"),
        F.when(F.col("event_id") % 7 == 0, F.floor("value").cast("bigint")).alias("duration_ms"),
    )


ANALYSIS_SQL = f"""an0 AS (SELECT *, event_id // 10 % 5 AS turn, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
 an AS (SELECT event_id, ts AS occurred_at, epoch_us(ts) // 1000 AS at_ms, {list(EVENT_NAMES)}[event_id % 10 + 1] AS event_name,
 CASE WHEN event_id % 10 BETWEEN 2 AND 6 THEN CASE WHEN turn < 3 THEN 'start' WHEN turn = 3 THEN 'finish' ELSE 'fail' END WHEN event_id % 10 = 8 THEN 'start' ELSE 'instant' END AS event_phase,
 'j' || user_id % 20 AS job_id, CASE WHEN event_id % 23 <> 0 THEN 'u' || user_id ELSE '' END AS unit_id, CASE WHEN event_id % 3 = 0 THEN 's' || user_id % 50 END AS span_id, CASE WHEN event_id % 4 <> 0 THEN 'c' || user_id % 70 ELSE '' END AS model_call_id,
 CASE k % 3 WHEN 0 THEN 'default_segment' WHEN 1 THEN 'high_freq_event' ELSE 'unknown' END AS scale, CASE WHEN k % 2 = 0 THEN 'segment' ELSE 'unknown' END AS kind, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'unknown' ELSE 'ok' END AS outcome,
 CASE WHEN event_id % 7 = 0 THEN CAST(floor(value) AS BIGINT) END AS duration_ms FROM an0)"""


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion samples: a series for each user, scores from the events' values."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), F.expr("unix_millis(CAST(ts AS TIMESTAMP))").alias("ts_ms"), F.least(F.lit(1.0), F.col("value") / 200).alias("score"), "event_id")


MOTION_SQL = "mo AS (SELECT user_id AS series, epoch_us(ts) // 1000 AS ts_ms, least(1.0, value / 200) AS score, event_id FROM events)"


def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls: an order is a unit and a job, a line number an attempt."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").alias("attempt_count"), F.col("l_returnflag").alias("analysis_scale"), F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("duration_ms"), F.col("l_shipdate").alias("started_at")
    )


CALLS_SQL = "calls AS (SELECT l_orderkey AS job_id, l_orderkey AS unit_id, l_linenumber AS attempt_count, l_returnflag AS analysis_scale, l_linestatus AS status, l_extendedprice AS duration_ms, l_shipdate AS started_at FROM lineitem)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs: orders; the customer is the video."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("video_id"), F.col("o_orderstatus").alias("job_status"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("cost"), F.col("o_orderpriority").alias("priority"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos: customers; the nation is the camera."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id"), F.col("c_nationkey").alias("camera_id"), (F.col("c_acctbal") * 1000).cast("bigint").alias("duration_ms"))
