"""Temporal planning: sliding windows, sample times, motion triggers, frame selection, dispatch order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obspark.functions import ranks

#: Samples of a task, about.
TASK_ROWS = 50_000


def default_segments(df: DataFrame, width_ms: int, overlap_ms: int) -> DataFrame:
    """G1: windows of each row's ``duration_ms``: starts a step apart, the last one clamped and none after it; window_index from 0."""
    if width_ms <= 0 or not 0 <= overlap_ms < width_ms:
        raise ValueError("windows need a positive width and a smaller overlap")
    step = width_ms - overlap_ms
    each = df.filter("duration_ms > 0").withColumn("segment_start_ms", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("duration_ms") - 1, F.lit(step).cast("bigint"))))
    kept = each.filter((F.col("segment_start_ms") == 0) | (F.col("segment_start_ms") + overlap_ms < F.col("duration_ms")))
    return kept.withColumn("segment_end_ms", F.least(F.col("segment_start_ms") + width_ms, F.col("duration_ms"))).withColumn("window_index", (F.col("segment_start_ms") / step).cast("bigint"))


def high_freq_windows(df: DataFrame, window_ms: int, overlap_ratio: float, min_ms: int) -> DataFrame:
    """Windows of each row's [start_ms, end_ms): one if it fits, else overlapping ones; none shorter than ``min_ms``."""
    step = max(1, int(window_ms * (1 - overlap_ratio)))
    span = df.filter("end_ms > start_ms")
    starts = F.when(F.col("end_ms") - F.col("start_ms") <= window_ms, F.array("start_ms")).otherwise(F.sequence(F.col("start_ms"), F.col("end_ms") - 1, F.lit(step).cast("bigint")))
    each = span.withColumn("window_start_ms", F.explode(starts))
    kept = each.filter((F.col("window_start_ms") == F.col("start_ms")) | (F.col("window_start_ms") - step + window_ms < F.col("end_ms")))
    return kept.withColumn("window_end_ms", F.least(F.col("window_start_ms") + window_ms, F.col("end_ms"))).filter(F.col("window_end_ms") - F.col("window_start_ms") >= min_ms)


def sample_timestamps(df: DataFrame, interval_ms: int) -> DataFrame:
    """Times from 0 below each row's ``duration_ms``."""
    return df.filter("duration_ms > 0").withColumn("timestamp_ms", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("duration_ms") - 1, F.lit(interval_ms).cast("bigint"))))


def uniform_timestamps(start: Column, end: Column, n: int) -> Column:
    """``n`` times inside a segment at equal distances (1: the middle)."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.floor(start + (end - start) / (n + 1) * i))


def median_step(samples: DataFrame) -> DataFrame:
    """Upper median of the distances of a series' samples, at least 1 (1 if there are fewer than two)."""
    w = Window.partitionBy("series").orderBy("ts_ms", "event_id")
    gaps = samples.select("series", (F.col("ts_ms") - F.lag("ts_ms").over(w)).alias("gap"))
    middle = ranks.at_positions(gaps, ["series"], "gap", {"middle": F.floor(F.col("n") / 2)})
    every = gaps.select("series").distinct().join(middle, "series", "left")
    return every.select("series", F.greatest(F.lit(1), F.coalesce("middle", F.lit(1))).alias("step_ms"))


def dealt_by_series(samples: DataFrame) -> DataFrame:
    """Samples by series in tasks whose size doesn't follow the table's: what follows sorts and groups them, and the windows that come of them, several times in one stage."""
    return samples.repartition(max(1, -(-samples.count() // TASK_ROWS)), "series")


def motion_triggers(samples: DataFrame, threshold: float, min_ms: int, merge_gap_ms: int, duration_ms: int | None = None) -> DataFrame:
    """Triggers of each series (series, ts_ms, score, event_id).

    A run of samples that reach the threshold lasts until the next sample of
    the series; runs with gaps up to ``merge_gap_ms`` merge; then short ones
    are extended, and clamped to ``duration_ms``. Series are independent: one
    shuffle of the samples, by series. Where a series ends within a run, its median step follows; that comes from
    the counts of its distances, which meet the runs.
    """
    w = Window.partitionBy("series").orderBy("ts_ms", "event_id")
    s = dealt_by_series(samples.select("series", "ts_ms", "event_id", "score")).select("*", (F.col("score") >= threshold).alias("hot")).withColumns({"next_ms": F.lead("ts_ms").over(w), "was": F.lag("hot").over(w)})
    s = s.withColumn("run", F.sum((F.col("hot") & ~F.coalesce("was", F.lit(False))).cast("int")).over(w))
    runs = s.filter("hot").groupBy("series", "run").agg(F.min("ts_ms").alias("a"), F.max("next_ms").alias("z"), F.max(F.when(F.col("next_ms").isNull(), F.col("ts_ms"))).alias("last_ms"), F.max("score").alias("peak"))
    counts = s.filter("next_ms IS NOT NULL").groupBy("series", (F.col("next_ms") - F.col("ts_ms")).alias("gap")).agg(F.count("*").alias("c"))
    by_gap = Window.partitionBy("series").orderBy("gap")
    ranked = counts.withColumns({"upto": F.sum("c").over(by_gap), "n": F.sum("c").over(Window.partitionBy("series"))})
    steps = ranked.filter("upto > floor(n / 2)").groupBy("series").agg(F.greatest(F.lit(1), F.min("gap")).alias("step_ms"))
    runs = runs.join(steps, "series", "left").withColumn("z", F.when(F.col("last_ms").isNotNull(), F.col("last_ms") + F.coalesce("step_ms", F.lit(1))).otherwise(F.col("z")))
    v = Window.partitionBy("series").orderBy("run")
    runs = runs.withColumn("island", F.sum(F.coalesce((F.col("a") - F.lag("z").over(v) > merge_gap_ms).cast("int"), F.lit(0))).over(v))
    out = runs.groupBy("series", "island").agg(F.min("a").alias("trigger_start_ms"), F.max("z").alias("z"), F.round(F.max("peak"), 6).alias("peak"))
    out = out.withColumn("trigger_end_ms", F.greatest("z", F.col("trigger_start_ms") + min_ms))
    if duration_ms is not None:
        out = out.filter(F.col("trigger_start_ms") < duration_ms).withColumn("trigger_end_ms", F.least("trigger_end_ms", F.lit(duration_ms))).filter("trigger_end_ms > trigger_start_ms")
    return out.select("series", "trigger_start_ms", "trigger_end_ms", "peak")


def trigger_rows(triggers: DataFrame, video: str = "series", reason: str = "motion") -> DataFrame:
    """Triggers as stored: the peak to 4 digits, and a key that is the same whenever the scan is repeated."""
    key = F.concat_ws(":", F.col(video).cast("string"), F.lit(reason), F.col("trigger_start_ms").cast("string"), F.col("trigger_end_ms").cast("string"))
    return triggers.select(key.alias("idempotency_key"), video, "trigger_start_ms", "trigger_end_ms", F.lit(reason).alias("reason"), (F.rint(F.col("peak") * 10000) / 10000).alias("peak"))


def trigger_windows(triggers: DataFrame, window_ms: int, overlap_ratio: float, min_ms: int) -> DataFrame:
    """High-frequency units of triggers, numbered trigger * 1000 + window; a window planned twice counts once."""
    t = triggers.withColumn("trigger_index", F.row_number().over(Window.partitionBy("series").orderBy("trigger_start_ms")) - 1)
    w = high_freq_windows(t.withColumns({"start_ms": F.col("trigger_start_ms"), "end_ms": F.col("trigger_end_ms")}), window_ms, overlap_ratio, min_ms)
    # the windows that were left out are a trigger's last ones, so the number follows from the start
    step = max(1, int(window_ms * (1 - overlap_ratio)))
    n = ((F.col("window_start_ms") - F.col("start_ms")) / step).cast("int")
    w = w.withColumn("window_index", F.col("trigger_index") * 1000 + n)
    return w.groupBy("series", "window_start_ms", "window_end_ms").agg(F.min("window_index").alias("window_index"))


def composite_score(motion: float = 0.5, scene: float = 0.3, quality: float = 0.2) -> Column:
    """weighted motion, scene change and sharpness (blur up to 500)."""
    return motion * F.col("motion") + scene * F.col("scene") + quality * F.least(F.col("blur"), F.lit(500.0)) / 500


def select_frames(frames: DataFrame, k: int, strategy: str = "bins_then_score", min_blur: float = 20.0, bins: int | None = None) -> DataFrame:
    """Up to ``k`` frames of each series (series, frame_index, timestamp_ms, motion, scene, blur, brightness).

    Blurred, dark and glaring frames don't count, unless no others are there.
    ``uniform`` takes every n/k-th, ``score`` the best, ``bins_then_score`` the
    best of each time bin, then the best of the rest.
    """
    whole = Window.partitionBy("series")
    time = whole.orderBy("timestamp_ms", "frame_index")
    f = frames.withColumn("ok", (F.col("blur") >= min_blur) & F.col("brightness").between(16, 240)).withColumn("score", composite_score())
    f = f.withColumns({"t0": F.min("timestamp_ms").over(whole), "t1": F.max("timestamp_ms").over(whole), "any_ok": F.max("ok").over(whole)}).filter("ok OR NOT any_ok")
    best = whole.orderBy(F.desc("score"), "frame_index")
    if strategy == "uniform":
        n = F.count("*").over(whole)
        f = f.withColumn("i", F.row_number().over(time) - 1).withColumn("n", n)
        # the j-th pick is number floor(j n / k): the least number at or above j n / k rounded down
        picks = F.transform(F.sequence(F.lit(0), F.least(F.lit(k), F.col("n")).cast("int") - 1), lambda j: F.floor(j * F.col("n") / F.least(F.lit(k), F.col("n"))))
        out = f.filter(F.array_contains(picks, F.col("i").cast("bigint")))
    elif strategy == "score":
        out = f.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
    else:
        nb = max(1, min(bins or k, k))
        f = f.withColumn("bin", F.least(F.lit(nb - 1), F.floor((F.col("timestamp_ms") - F.col("t0")) * nb / (F.col("t1") - F.col("t0") + 1)))).withColumn("in_bin", F.row_number().over(Window.partitionBy("series", "bin").orderBy(F.desc("score"), "frame_index")))
        order = whole.orderBy((F.col("in_bin") > 1).cast("int"), F.when(F.col("in_bin") == 1, F.col("bin")), F.desc("score"), "frame_index")
        out = f.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    return out.select("series", "frame_index", "timestamp_ms")


def dispatch_order(units: DataFrame, quota: int) -> DataFrame:
    """Fair interleave (is_high, ordinal from 0): ``quota`` high-frequency units, then one default; adds ``position``."""
    turn = F.when(F.col("is_high"), F.floor(F.col("ordinal") / quota)).otherwise(F.col("ordinal"))
    return units.withColumn("position", F.row_number().over(Window.partitionBy("job_id").orderBy(turn, (~F.col("is_high")).cast("int"), "ordinal")))
