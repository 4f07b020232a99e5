"""Structured Streaming counterparts: event rates, gap-merged sessions, idempotent delivery.

Streams read the table's files and end when all are read (availableNow). Each
micro-batch writes what it has updated, with its number, to the shared folder;
the last update of a key counts. State is bounded by watermarks.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from obspark.sources import places

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{places.shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet*").option("recursiveFileLookup", "false").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


@contextlib.contextmanager
def _configured(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Settings of the session while a stream starts; it keeps them from then on."""
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drained(stream: DataFrame, mode: str, key: list[str], conf: dict[str, str] | None = None) -> DataFrame:
    """Runs a stream over all that is there, under the settings ``conf``; the last update of each key."""
    spark = stream.sparkSession
    at = work_dir(spark)

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is delivered again overwrites its own folder
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/number={number}")

    with _configured(spark, conf or {}):
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch int, number int").parquet(f"{at}/out")
    rest = [c for c in out.columns if c not in (*key, "batch", "number")]
    return out.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*key, "_last.*")


def event_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: events of each second, tumbling windows under a watermark."""
    counts = event_stream(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 second").alias("w")).agg(F.count("*").alias("n"))
    return drained(counts.select(F.unix_seconds("w.start").alias("second"), "n"), "update", ["second"])


def hopping_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of hopping windows of 12 hours every 9, aligned to the epoch."""
    counts = event_stream(spark, sf_dir).withWatermark("ts", "1 day").groupBy(F.window("ts", "12 hours", "9 hours").alias("w")).agg(F.count("*").alias("n"))
    return drained(counts.select(F.unix_seconds("w.start").alias("start_s"), "n"), "update", ["start_s"])


def distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without re-deliveries, by id within the watermark."""
    both = event_stream(spark, sf_dir)
    twice = both.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).drop("again")
    return drained(twice.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type"), "append", ["event_id"])


def sessions(spark: SparkSession, sf_dir: str, gap_ms: int, ttl_ms: int | None = None) -> DataFrame:
    """Sessions of each user: events whose distance is at most ``gap_ms``, and none that is more than ``ttl_ms`` after the first; one that times out leaves the state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(frames).sort_values("at_ms")
        now = list(state.get) if state.exists else None
        out = []
        for t in rows["at_ms"].tolist():
            if now is not None and t - now[1] <= gap_ms and (ttl_ms is None or t - now[0] <= ttl_ms):
                now = [now[0], max(now[1], t), now[2] + 1]
            else:
                if now is not None:
                    out.append((key[0], *now))
                now = [t, t, 1]
        out.append((key[0], *now))
        state.update(tuple(now))
        state.setTimeoutTimestamp(max(now[1] + gap_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "start_ms", "end_ms", "n"])

    events = event_stream(spark, sf_dir).withWatermark("ts", "30 days").withColumn("at_ms", F.unix_millis("ts"))
    out = events.groupBy("user_id").applyInPandasWithState(step, "user_id long, start_ms long, end_ms long, n long", "start_ms long, end_ms long, n long", "update", GroupStateTimeout.EventTimeTimeout)
    return drained(out, "update", ["user_id", "start_ms"])
