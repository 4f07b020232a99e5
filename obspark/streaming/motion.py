"""Motion triggers as a stream: threshold runs, merged over gaps, told once each when no sample can change them any more."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from obspark.sources import views
from obspark.streaming.streams import drained, work_dir

SAMPLES = "series long, ts timestamp, ts_ms long, event_id long, score double, closing boolean"
TRIGGERS = "series long, trigger_start_ms long, trigger_end_ms long, peak double"
#: State stores with timers and several columns are RocksDB's.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Open:
    """What a series' samples so far leave open: the last sample, the run that it belongs to, and the trigger that waits for the gap behind it."""

    last_ms: int | None = None
    run_start: int | None = None
    run_peak: float | None = None
    start: int | None = None
    end: int | None = None
    peak: float | None = None


@dataclass(frozen=True)
class Rules:
    threshold: float
    min_ms: int
    merge_gap_ms: int


class Motion(StatefulProcessor):
    """Samples wait until the watermark has passed them, are taken in order, and drive runs and triggers.

    A row with ``closing`` ends its series: what is open is told, and the state goes.
    """

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts_ms long, event_id long, score double")
        self.open = handle.getValueState("open", "last_ms long, run_start long, run_peak double, start long, end long, peak double")
        self.steps = handle.getMapState("steps", "step long", "n long")

    def close(self) -> None:
        pass

    # triggers

    def _told(self, key: tuple, o: Open) -> tuple:
        out = (key[0], o.start, max(o.end, o.start + self.rules.min_ms), round(o.peak, 6))
        o.start = o.end = o.peak = None
        return out

    def _run_ends(self, o: Open, at: int) -> None:
        if o.start is not None:
            o.end, o.peak = max(o.end, at), max(o.peak, o.run_peak)
        else:
            o.start, o.end, o.peak = o.run_start, at, o.run_peak
        o.run_start = o.run_peak = None

    def _step(self, key: tuple, o: Open, at: int, score: float, steps: dict[int, int]) -> Iterator[tuple]:
        if o.last_ms is not None:
            steps[at - o.last_ms] = steps.get(at - o.last_ms, 0) + 1
        if score >= self.rules.threshold:
            if o.run_start is None:
                if o.start is not None and at - o.end > self.rules.merge_gap_ms:
                    yield self._told(key, o)
                o.run_start, o.run_peak = at, score
            else:
                o.run_peak = max(o.run_peak, score)
        elif o.run_start is not None:
            self._run_ends(o, at)
        o.last_ms = at

    def _median_step(self, steps: dict[int, int]) -> int:
        """Upper median of the distances of the samples, at least 1."""
        place = sum(steps.values()) // 2
        for step in sorted(steps):
            if place < steps[step]:
                return max(1, step)
            place -= steps[step]
        return 1

    def _advance(self, key: tuple, watermark: int, new: list[tuple], closing: bool) -> Iterator[pd.DataFrame]:
        waiting = [tuple(x) for x in self.waiting.get()] + new if self.waiting.exists() else new
        ready = sorted(x for x in waiting if closing or x[0] < watermark)
        later = [x for x in waiting if not (closing or x[0] < watermark)]
        o = Open(*self.open.get()) if self.open.exists() else Open()
        steps: dict[int, int] = {}
        told = []
        for at, _, score in ready:
            told += self._step(key, o, int(at), float(score), steps)
        if closing:
            if o.run_start is not None:
                known = {k[0]: n[0] for k, n in self.steps.iterator()} if self.steps.exists() else {}
                self._run_ends(o, o.last_ms + self._median_step({k: known.get(k, 0) + steps.get(k, 0) for k in {*known, *steps}}))
            if o.start is not None:
                told.append(self._told(key, o))
            for state in (self.waiting, self.open, self.steps):
                state.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        else:
            if o.start is not None and o.run_start is None and watermark > o.end + self.rules.merge_gap_ms:
                told.append(self._told(key, o))
            for k, n in steps.items():
                old = self.steps.getValue((k,)) if self.steps.containsKey((k,)) else (0,)
                self.steps.updateValue((k,), (old[0] + n,))
            if ready or new:
                self.waiting.put(later) if later else self.waiting.clear()
            self.open.update(tuple(asdict(o).values()))
            if later:
                self.handle.registerTimer(min(x[0] for x in later) + 1)
            if o.start is not None and o.run_start is None:
                self.handle.registerTimer(o.end + self.rules.merge_gap_ms + 1)
        if told:
            yield pd.DataFrame(told, columns=[c.split()[0] for c in TRIGGERS.split(", ")])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, closing = [], False
        for frame in rows:
            closing = closing or bool(frame["closing"].any())
            held = frame[~frame["closing"].astype(bool)]
            new += list(zip(held["ts_ms"].tolist(), held["event_id"].tolist(), held["score"].tolist(), strict=True))
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs(), new, closing)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs(), [], False)


def motion_stream(samples: DataFrame, rules: Rules, lateness: str) -> DataFrame:
    """Triggers of a stream of samples (see SAMPLES) that come at most ``lateness`` behind the latest one; later ones are left out."""
    return samples.withWatermark("ts", lateness).groupBy("series").transformWithStateInPandas(Motion(rules), TRIGGERS, "Append", "EventTime")


def written_samples(samples: DataFrame, path: str, files: int) -> None:
    """Samples (series, ts_ms, event_id, score) as files in no order, and behind them one that closes each series."""
    at = F.timestamp_millis("ts_ms")
    rows = samples.select("series", at.alias("ts"), "ts_ms", "event_id", "score", F.lit(False).alias("closing"))
    rows.repartition(files, F.xxhash64("event_id")).write.mode("append").parquet(path)
    ends = samples.groupBy("series").agg(F.max("ts_ms").alias("ts_ms"))
    ends.select("series", F.timestamp_seconds(F.lit(4102444800)).alias("ts"), "ts_ms", F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("closing")).coalesce(1).write.mode("append").parquet(path)


def motion_triggers(spark: SparkSession, sf_dir: str, rules: Rules, files: int = 4, lateness: str = "3650 days") -> DataFrame:
    """Triggers of all series, from files that hold each series' samples in no order."""
    at = f"{work_dir(spark)}/samples"
    written_samples(views.motion(spark, sf_dir), at, files)
    stream = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 2).parquet(at)
    return drained(motion_stream(stream, rules, lateness), "append", ["series", "trigger_start_ms"], {"spark.sql.streaming.stateStore.providerClass": PROVIDER})
