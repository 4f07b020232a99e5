"""Spans as a stream: starts joined with the finishes that follow them within a bound, and starts that never end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obspark.sources import views
from obspark.streaming.streams import drained, work_dir

EVENTS = "event_id long, unit_id long, at_ms long, ts timestamp, event_phase string"
#: A row of this unit in each direction moves the watermarks past all that is there.
NOBODY = -1


def paired(events: DataFrame, bound_ms: int, lateness: str) -> DataFrame:
    """Pairs (start_id, started_ms, end_id, ended_ms) of a start and each finish or fail of its unit within ``bound_ms`` after it; starts without one have null ends.

    Both sides keep their rows until the watermarks say that no partner can come, so state is bounded by
    lateness and bound. ``events`` is a stream that is read twice, once for either side.
    """
    at = F.col("ts")
    starts = events.filter("event_phase = 'start'").withWatermark("ts", lateness).select(F.col("unit_id").alias("unit"), F.col("event_id").alias("start_id"), F.col("at_ms").alias("started_ms"), at.alias("started"))
    ends = events.filter("event_phase IN ('finish', 'fail')").withWatermark("ts", lateness).select(F.col("unit_id").alias("unit_"), F.col("event_id").alias("end_id"), F.col("at_ms").alias("ended_ms"), at.alias("ended"))
    bound = F.expr(f"ended >= started AND ended <= started + INTERVAL {bound_ms} MILLISECOND AND unit = unit_ AND (ended_ms > started_ms OR end_id > start_id)")
    return starts.join(ends, bound, "left_outer").select("unit", "start_id", "started_ms", "end_id", "ended_ms")


def latest(pairs: DataFrame) -> DataFrame:
    """Of each finish the pair with the latest start before it, with its duration, and the starts that nothing ended."""
    ended = pairs.filter("end_id IS NOT NULL").groupBy("unit", "end_id", "ended_ms").agg(F.max(F.struct("started_ms", "start_id")).alias("s"))
    closed = ended.select("unit", "s.start_id", "end_id", (F.col("ended_ms") - F.col("s.started_ms")).alias("duration_ms"))
    open_ = pairs.filter("end_id IS NULL").select("unit", "start_id", F.lit(None).cast("long").alias("end_id"), F.lit(None).cast("long").alias("duration_ms"))
    return closed.unionByName(open_).filter(F.col("unit") != NOBODY)


def written_events(events: DataFrame, path: str, files: int) -> None:
    """Events (event_id, unit_id, at_ms, event_phase) as files in the order of time, and behind them rows of nobody, far ahead."""
    rows = events.select("event_id", "unit_id", "at_ms", F.timestamp_millis("at_ms").alias("ts"), "event_phase")
    rows.repartitionByRange(files, "at_ms").write.mode("append").parquet(path)
    far = F.timestamp_seconds(F.lit(4102444800))
    for _ in range(2):  # the first moves the watermarks, the second lets both sides look at them
        events.sparkSession.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(NOBODY).cast("long").alias("unit_id"), F.lit(4102444800000).alias("at_ms"), far.alias("ts"), F.explode(F.array(F.lit("start"), F.lit("finish"))).alias("event_phase")).coalesce(1).write.mode("append").parquet(path)


def spans(spark: SparkSession, sf_dir: str, bound_ms: int, files: int = 3) -> DataFrame:
    """Spans of all units, read from files of events as they come."""
    at = f"{work_dir(spark)}/events"
    written_events(views.timeline(spark, sf_dir), at, files)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 2).parquet(at)
    return latest(drained(paired(stream, bound_ms, "3650 days"), "append", ["unit", "start_id", "end_id"]))
