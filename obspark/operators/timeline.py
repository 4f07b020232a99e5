"""Timeline analytics: active series, rates, stage durations, unit breakdowns, summaries."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obspark.functions import ranks
from obspark.functions.text import event_category


def active_series(events: DataFrame, key: str, partition: Sequence[str] = ()) -> DataFrame:
    """How many keys are active after each event (event_phase, at_ms, event_id).

    A start of an active key and the end of an inactive one change nothing: per
    key, the state before comes from its last start or end, so changes are
    found in parallel. Running totals are of buckets of time first.
    """
    mark = F.when(F.col("event_phase") == "start", 1).when(F.col("event_phase").isin("finish", "fail"), 0)
    return running(events.withColumn("mark", mark).filter("mark IS NOT NULL"), key, partition)


def running(marks: DataFrame, key: str, partition: Sequence[str]) -> DataFrame:
    """How many keys are active after each change (mark: 1 if the key gets active, 0 if it ends)."""
    before = F.lag("mark").over(Window.partitionBy(*partition, key).orderBy("at_ms", "event_id"))
    deltas = marks.withColumn("delta", F.col("mark") - F.coalesce(before, F.lit(0))).filter("delta <> 0")
    return ranks.running_total(deltas, partition, "active").select(*partition, "at_ms", "event_id", "active")


def peak_active(events: DataFrame, key: str, partition: Sequence[str]) -> DataFrame:
    return active_series(events, key, partition).groupBy(*partition).agg(F.max("active").alias("peak"))


def event_rate(events: DataFrame) -> DataFrame:
    """Events of each second."""
    return events.groupBy((F.floor(F.col("at_ms") / 1000)).alias("second")).agg(F.count("*").alias("n"))


def stage_durations(events: DataFrame, key: Sequence[str]) -> DataFrame:
    """Duration of each finish and fail from the latest start before it of the same key (null without one), at least 0."""
    w = Window.partitionBy(*key).orderBy("at_ms", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.last(F.when(F.col("event_phase") == "start", F.col("at_ms")), ignorenulls=True).over(w)
    return events.withColumn("started_ms", start).filter(F.col("event_phase").isin("finish", "fail")).withColumn("duration_ms", F.when(F.col("started_ms").isNotNull(), F.greatest(F.lit(0), F.col("at_ms") - F.col("started_ms"))))


def latency_stats(df: DataFrame, by: str, value: str, stages: Sequence[str]) -> DataFrame:
    """Count, linearly interpolated p50, p90 and p99 (rounded half to even) and largest of each stage, also of stages without rows."""
    s = df.sparkSession.createDataFrame([(x,) for x in stages], f"{by} string")
    place = lambda q: (F.col("n") - 1) * F.lit(q)
    quantiles = {f"p{round(100 * q)}": q for q in (0.5, 0.9, 0.99)}
    ends = {f"{k}_{side}": f(place(q)) for k, q in quantiles.items() for side, f in (("a", F.floor), ("z", F.ceil))}
    found = ranks.at_positions(df, [by], value, ends | {"most": F.col("n") - 1})
    between = lambda k, q: F.bround(F.when(F.col(f"{k}_a") == F.col(f"{k}_z"), F.col(f"{k}_a").cast("double")).otherwise((F.ceil(place(q)) - place(q)) * F.col(f"{k}_a") + (place(q) - F.floor(place(q))) * F.col(f"{k}_z"))).cast("bigint")
    stats = found.select(by, "n", *[between(k, q).alias(k) for k, q in quantiles.items()], "most")
    return F.broadcast(s).join(stats, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def unit_breakdown(durations: DataFrame, stages: Sequence[str]) -> DataFrame:
    """A row for each unit with its last duration in each stage, the total and the slowest stage (the first wins ties)."""
    last = durations.filter("duration_ms IS NOT NULL").groupBy("unit_id", "stage").agg(F.max_by("duration_ms", F.struct("at_ms", "event_id")).alias("d"))
    wide = last.groupBy("unit_id").pivot("stage", list(stages)).agg(F.first("d"))
    most = F.greatest(*[F.coalesce(s, F.lit(-1)) for s in stages])
    slowest = None
    for s in stages:
        slowest = F.when(F.col(s) == most, s) if slowest is None else slowest.when(F.col(s) == most, s)
    return wide.withColumn("total_ms", sum((F.coalesce(s, F.lit(0)) for s in stages), F.lit(0))).withColumn("slowest_stage", slowest).withColumn("slowest_ms", most)


# The names of the series of a report: events that start and end a key, and the key's columns, the first that is not empty;
# a stage's key is active from a start to a finish or fail, other keys may start and end by an instant event, too.
KEYED = {
    "active_units": (("unit_running",), ("unit_finished",), ("unit_id", "span_id", "event_key")),
    "scheduler_waiters": (("vlm_scheduler_wait",), ("vlm_scheduler_wait",), ("model_call_id", "span_id", "event_key")),
    "outbound_vlm_calls": (("vlm_provider_call",), ("vlm_provider_call",), ("model_call_id", "span_id", "event_key")),
}
STAGED = {
    "pre_vlm_active": ("frame_select", "media_refs_built", "detector_gate"),
    "frame_select_active": ("frame_select",),
    "media_refs_build_active": ("media_refs_built",),
    "detector_gate_active": ("detector_gate",),
}
STAGE_KEY = ("span_id", "unit_id", "model_call_id", "event_key")
RATES = {"vlm_ready_rate_per_sec": "vlm_scheduler_wait", "provider_start_rate_per_sec": "vlm_provider_call"}
# Stages whose durations are told, and their names in a unit's breakdown.
STAGES = {
    "frame_select": "frame_select_ms",
    "media_refs_built": "media_refs_build_ms",
    "detector_gate": "detector_gate_ms",
    "vlm_scheduler_wait": "scheduler_wait_ms",
    "vlm_provider_call": "provider_wall_ms",
    "publication_finished": "publication_ms",
}
# What a bottleneck rule says.
SUPPLY = "High pre-VLM activity with low scheduler/provider activity: likely frame/media/decode supply bottleneck."
WAITING = "Scheduler waiters exceed outbound calls: local semaphore or min interval may be limiting provider starts."
BELOW_CAP = "Outbound VLM calls are far below configured VLM cap while units are active: inspect upstream supply and scheduler traces."
AT_CAP = "Outbound VLM calls reached configured cap: local VLM cap is saturated."
NO_RULE = "No single bottleneck rule fired; compare stage latency tables with concurrency curves."


def first_of(columns: Sequence[str]) -> Column:
    """the first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns])


def label(columns: Sequence[str] = ("unit_id", "scale_task_id", "task_id")) -> Column:
    """Name and phase of an event, and the first id that it has."""
    return F.concat_ws(" | ", "event_name", "event_phase", first_of(columns))


def projected(events: DataFrame) -> DataFrame:
    """Events with their category and known scale, kind and status."""
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias(c)
    return events.withColumns({"event_key": F.col("event_id").cast("string"), "category": event_category(F.col("event_name"))}).select("*", known("analysis_scale").alias("scale"), known("unit_kind").alias("kind"), known("status").alias("outcome"))


def marked(events: DataFrame) -> DataFrame:
    """Z3: a row for each change that an event makes to one of the active series: series, key, mark."""
    name, phase = F.col("event_name"), F.col("event_phase")
    change = lambda series, key, mark: F.when(mark.isNotNull(), F.struct(F.lit(series).alias("series"), first_of(key).alias("key"), mark.alias("mark")))
    each = []
    for series, (starts, ends, key) in KEYED.items():
        each.append(change(series, key, F.when(name.isin(*starts) & phase.isin("instant", "start"), 1).when(name.isin(*ends) & phase.isin("instant", "finish", "fail"), 0)))
    for series, names in STAGED.items():
        each.append(change(series, STAGE_KEY, F.when(name.isin(*names), F.when(phase == "start", 1).when(phase.isin("finish", "fail"), 0))))
    return events.select("*", F.inline(F.array_compact(F.array(*each))))


def peaks(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Z3: the peaks of all nine series of each group, 0 where a series has no event (one row, if ``by`` is empty)."""
    active = running(marked(events), "key", [*by, "series"]).groupBy(*by, "series").agg(F.max("active").alias("peak"))
    rate = lambda series, name: events.filter((F.col("event_name") == name) & (F.col("event_phase") == "start")).withColumn("series", F.lit(series))
    starts = functools.reduce(DataFrame.unionByName, [rate(*r) for r in RATES.items()])
    seconds = starts.groupBy(*by, "series", F.floor(F.col("at_ms") / 1000)).agg(F.count("*").alias("n")).groupBy(*by, "series").agg(F.max("n").alias("peak"))
    names = [*KEYED, *STAGED, *RATES]
    wide = active.unionByName(seconds).groupBy(*by).agg(*[F.coalesce(F.max(F.when(F.col("series") == s, F.col("peak"))), F.lit(0)).cast("bigint").alias(f"peak_{s}") for s in names])
    return wide


def grouped(events: DataFrame) -> DataFrame:
    """Each event once for its scale and once for its kind of unit."""
    each = F.array(F.struct(F.lit("analysis_scale").alias("grouping"), F.col("scale").alias("value")), F.struct(F.lit("unit_kind").alias("grouping"), F.col("kind").alias("value")))
    return projected(events).select("*", F.inline(each))


def group_summary(events: DataFrame) -> DataFrame:
    """Events, units, model calls and three peaks of each scale and of each kind of unit."""
    g, by = grouped(events), ["grouping", "value"]
    some = lambda c: F.countDistinct(F.nullif(F.col(c), F.lit("")))
    counts = g.groupBy(*by).agg(F.count("*").alias("event_count"), some("unit_id").alias("unit_count"), some("model_call_id").alias("model_call_count"))
    wanted = ["peak_active_units", "peak_pre_vlm_active", "peak_outbound_vlm_calls"]
    return counts.join(peaks(g, by).select(*by, *wanted), by, "left").select(*by, "event_count", "unit_count", "model_call_count", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in wanted])


def group_events(events: DataFrame) -> DataFrame:
    """Events by name of each scale and of each kind of unit."""
    return grouped(events).groupBy("grouping", "value", "event_name").agg(F.count("*").alias("n"))


def counts(events: DataFrame) -> DataFrame:
    """A10: events by name, category and status, in one pass."""
    each = F.array(*[F.struct(F.lit(k).alias("kind_of_count"), F.col(c).alias("value")) for k, c in (("event", "event_name"), ("category", "category"), ("status", "outcome"))])
    return projected(events).select(F.inline(each)).groupBy("kind_of_count", "value").agg(F.count("*").alias("n"))


def hints(summary: DataFrame, cap: int | None) -> DataFrame:
    """what the four rules on peaks say of a bottleneck, else the default."""
    before, waits, out, units = (F.coalesce(F.col(f"peak_{c}"), F.lit(0)) for c in ("pre_vlm_active", "scheduler_waiters", "outbound_vlm_calls", "active_units"))
    rules = [
        F.when((before > 0) & (waits == 0) & (out <= F.greatest(F.lit(1), F.floor(before / 4))), SUPPLY),
        F.when((waits > 0) & (out < waits), WAITING),
    ]
    if cap:
        rules += [F.when((out < max(1, cap // 4)) & (units > out), BELOW_CAP), F.when((out > 0) & (out >= cap), AT_CAP)]
    fired = F.array_compact(F.array(*rules))
    return summary.withColumn("hints", F.when(F.size(fired) == 0, F.array(F.lit(NO_RULE))).otherwise(fired))


def summary(events: DataFrame, cap: int | None = None) -> DataFrame:
    """One row on all events: range, counts, peaks, publications and hints; zeros and nulls without events."""
    some = lambda c: F.countDistinct(F.nullif(F.col(c), F.lit("")))
    one = lambda df: df.withColumn("_one", F.lit(1))
    told = events.agg(
        F.min("occurred_at").alias("start"), F.max("occurred_at").alias("end"), F.count("*").alias("event_count"), some("job_id").alias("job_count"), some("unit_id").alias("unit_count"),
        some("model_call_id").alias("model_call_count"), F.count(F.when(F.startswith("event_name", F.lit("publication")), 1)).alias("publication_write_count"),
    )
    every = one(peaks(projected(events)))
    return hints(one(told).join(every, "_one").drop("_one"), cap)


def stage_times(events: DataFrame) -> DataFrame:
    """Finished, failed and instant events of the stages with their duration: their own, else from the latest start of their key (null without one)."""
    keyed = projected(events).withColumn("stage_key", first_of(("span_id", "unit_id", "event_key")))
    w = Window.partitionBy("event_name", "stage_key").orderBy("at_ms", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.last(F.when(F.col("event_phase") == "start", F.col("at_ms")), ignorenulls=True).over(w)
    since = keyed.filter(F.col("event_name").isin(*STAGES)).withColumn("_start", start)
    known = F.coalesce("duration_ms", F.when(F.col("_start").isNotNull(), F.greatest(F.lit(0), F.col("at_ms") - F.col("_start"))))
    return since.withColumn("duration_ms", known).filter("event_phase <> 'start'").drop("_start")


def stage_latency(events: DataFrame) -> DataFrame:
    """Latencies of the six stages."""
    return latency_stats(stage_times(events), "event_name", "duration_ms", list(STAGES))


def unit_report(events: DataFrame) -> DataFrame:
    """A row for each unit that has a duration: its last one in each stage, its whole time, and the slowest of these (the stages' first in a tie)."""
    stages = [*STAGES.values(), "total_unit_ms"]
    of = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])
    each = stage_times(events).filter("duration_ms IS NOT NULL").select(F.nullif("unit_id", F.lit("")).alias("unit_id"), of[F.col("event_name")].alias("stage"), "duration_ms", "at_ms", "event_id")
    w = Window.partitionBy("unit_id").orderBy("at_ms", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    ran = events.filter(F.col("event_name").isin("unit_running", "unit_finished")).withColumn("_start", F.last(F.when(F.col("event_name") == "unit_running", F.col("at_ms")), ignorenulls=True).over(w))
    whole = ran.filter("event_name = 'unit_finished' AND _start IS NOT NULL AND event_phase <> 'start'").select(F.nullif("unit_id", F.lit("")).alias("unit_id"), F.lit("total_unit_ms").alias("stage"), F.greatest(F.lit(0), F.col("at_ms") - F.col("_start")).alias("duration_ms"), "at_ms", "event_id")
    last = each.unionByName(whole).filter("unit_id IS NOT NULL").groupBy("unit_id", "stage").agg(F.max_by("duration_ms", F.struct("at_ms", "event_id")).alias("d"))
    wide = last.groupBy("unit_id").pivot("stage", stages).agg(F.first("d"))
    most = F.greatest(*[F.coalesce(s, F.lit(-1)) for s in stages])
    return wide.withColumn("slowest_ms", most).withColumn("slowest_stage", F.coalesce(*[F.when(F.col(s) == F.col("slowest_ms"), s) for s in stages]))


def count_groupings(events: DataFrame, a: str, b: str) -> DataFrame:
    """Events, units and failures by each of two independent groupings, in one pass."""
    g = events.select(F.coalesce(F.col(a), F.lit("unknown")).alias("ga"), F.coalesce(F.col(b), F.lit("unknown")).alias("gb"), "unit_id", "event_phase")
    out = g.groupingSets([["ga"], ["gb"]], "ga", "gb").agg(F.count("*").alias("events"), F.countDistinct("unit_id").alias("units"), F.count(F.when(F.col("event_phase") == "fail", 1)).alias("failures"), F.grouping("ga").alias("g"))
    return out.select(F.when(F.col("g") == 0, a).otherwise(b).alias("grouping"), F.when(F.col("g") == 0, F.col("ga")).otherwise(F.col("gb")).alias("value"), "events", "units", "failures")


def exceeded(summary: DataFrame, rules: Sequence[tuple[str, int, str]], default: str) -> DataFrame:
    """Hints whose column exceeds its threshold, else the default one."""
    fired = F.array_compact(F.array(*[F.when(F.col(c) > t, hint) for c, t, hint in rules]))
    return summary.withColumn("hints", F.when(F.size(fired) == 0, F.array(F.lit(default))).otherwise(fired))
