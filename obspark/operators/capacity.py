"""Capacity metrics: request counts, retries, latencies, video hours, estimates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obspark.functions import ranks


def group_count(df: DataFrame, column: str) -> DataFrame:
    """A2: counts by a column, nulls left out; an empty result if the table has no such column."""
    if column not in df.columns:
        return df.sparkSession.createDataFrame([], "value string, n long")
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def metric_source(tables: Mapping[str, DataFrame], name: str, columns: Sequence[str]) -> DataFrame | None:
    """The columns of a table, null where it lacks one; None if there is no such table."""
    df = tables.get(name)
    return None if df is None else df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns])


def distinct_counts(calls: DataFrame) -> DataFrame:
    """Jobs and calls."""
    return calls.agg(F.countDistinct("job_id").alias("jobs"), F.countDistinct("unit_id", "attempt_count").alias("calls"))


def gate_kpis(decisions: DataFrame) -> DataFrame:
    """Units, those sent to the model, those held back, and the share of the sent ones to 6 digits."""
    n = lambda c: F.count(F.when(c, 1))
    return decisions.agg(F.count("*").alias("total"), n(F.col("triggered")).alias("n_triggered"), n(~F.col("triggered")).alias("detector_only"), F.round(F.avg(F.col("triggered").cast("int")), 6).alias("positive_rate"))


def requests_by_video(calls: DataFrame, jobs: DataFrame) -> DataFrame:
    """Calls of each video; calls are counted by job before they meet the jobs."""
    return calls.groupBy("job_id").agg(F.count("*").alias("c")).join(jobs.select("job_id", "video_id"), "job_id").groupBy("video_id").agg(F.sum("c").alias("n"))


def requests_by_camera(calls: DataFrame, jobs: DataFrame, videos: DataFrame) -> DataFrame:
    """Calls of each camera."""
    return requests_by_video(calls, jobs).join(videos.select("video_id", "camera_id"), "video_id").groupBy("camera_id").agg(F.sum("n").alias("n"))


def retry_estimate(calls: DataFrame) -> DataFrame:
    """A3: over units, the attempts beyond the first."""
    return calls.groupBy("unit_id").agg(F.max("attempt_count").alias("m")).agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.col("m") - 1)), F.lit(0)).alias("retries"))


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """A4: nearest-rank percentiles of each group, as columns, and n."""
    place = lambda q: F.least(F.greatest(F.ceil(F.lit(q) * F.col("n")) - 1, F.lit(0)), F.col("n") - 1)
    return ranks.at_positions(df, by, value, {k: place(q) for k, q in quantiles.items()})


def video_hours(videos: DataFrame) -> DataFrame:
    """Hours of all videos with a positive duration."""
    return videos.filter("duration_ms > 0").agg(F.round(F.sum("duration_ms") / 3.6e6, 6).alias("hours"))


def job_wall(jobs: DataFrame, start: str, finish: str) -> DataFrame:
    """Seconds from the first start to the last finish, at least 0; null unless both are there."""
    both = F.col(start).isNotNull() & F.col(finish).isNotNull()
    seconds = F.max(F.unix_seconds(F.col(finish).cast("timestamp"))) - F.min(F.unix_seconds(F.col(start).cast("timestamp")))
    return jobs.filter(both).agg(F.when(seconds.isNotNull(), F.greatest(F.lit(0), seconds)).alias("wall_seconds"))


@dataclass(frozen=True)
class Plan:
    """What capacity is planned for, and what is known of a group of accelerators (None: not known)."""

    cameras: int
    window_hours: float = 1.0
    headroom: float = 0.7
    measured_rate: float | None = None
    effective_rate: float | None = None
    safety: float = 0.7
    accelerators: int | None = None
    memory_gb: float | None = None


# What a report says where inputs are missing.
NOTES = ("video_hours unavailable; cannot compute requests_per_camera_hour", "measured_req_s unavailable; provide --effective-req-s or wall-time input", "effective_req_s unavailable; cannot compute processing_time_hours")


def estimate(metrics: DataFrame, plan: Plan) -> DataFrame:
    """The twelve derived metrics and notes on what is missing for them, of one-row metrics (requests, hours, wall_seconds); what lacks an input, or divides by none, is null."""
    known = lambda v: F.lit(v).cast("double")
    positive = lambda c: F.when(c > 0, c)
    hourly = F.try_divide(F.col("requests").cast("double"), positive(F.col("hours")))
    production = hourly * plan.cameras
    realtime = production / 3600
    needed = F.try_divide(realtime, positive(known(plan.headroom)))
    measured = F.coalesce(known(plan.measured_rate), F.try_divide(F.col("requests").cast("double"), positive(F.col("wall_seconds").cast("double"))))
    effective = F.coalesce(known(plan.effective_rate), measured * plan.safety)
    groups = F.try_divide(needed, positive(effective))
    memory = known(plan.accelerators) * known(plan.memory_gb)
    derived = {
        "requests_per_camera_hour": hourly,
        "production_requests_per_hour": production,
        "production_requests": production * plan.window_hours,
        "required_realtime_rate": realtime,
        "required_rate_with_headroom": needed,
        "measured_rate": measured,
        "effective_rate": effective,
        "processing_hours": F.try_divide(production * plan.window_hours, positive(effective)) / 3600,
        "needed_groups": groups,
        "needed_accelerators": groups * known(plan.accelerators),
        "group_memory_gb": memory,
        "needed_memory_gb": groups * memory,
    }
    said = lambda when, note: F.when(when, F.lit(note))
    # a rate that is told is enough; without one, requests and time must give it
    notes = [
        said(hourly.isNull(), NOTES[0]), said(F.lit(plan.measured_rate is None) & F.coalesce(F.col("wall_seconds") <= 0, F.lit(True)), NOTES[1]),
        said(production.isNotNull() & F.coalesce(effective <= 0, F.lit(True)), NOTES[2]),
    ]
    return metrics.select("*", *[F.round(c, 6).alias(k) for k, c in derived.items()], F.array_compact(F.array(*notes)).alias("notes"))


def report(calls: DataFrame, jobs: DataFrame, videos: DataFrame, plan: Plan) -> DataFrame:
    """Q11: one row of requests, outcomes, retries, latencies, hours, wall time and the derived metrics."""
    one = lambda df: df.withColumn("_one", F.lit(1))
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    m = one(calls.agg(F.count("*").alias("requests"), n("succeeded").alias("succeeded"), n("failed").alias("failed")))
    latency = nearest_rank(calls, [], "duration_ms", {"p50": 0.5, "p95": 0.95}).select((F.col("p50") / 1000).alias("p50_s"), (F.col("p95") / 1000).alias("p95_s"))
    for df in (video_hours(videos), job_wall(jobs, "started_at", "finished_at"), retry_estimate(calls), latency):
        m = m.join(one(df), "_one", "left")
    return estimate(m.drop("_one"), plan)
