"""Streams against the batch operators on the same rows."""

import random

import pytest

from obspark.operators import temporal
from obspark.streaming import motion, spans, streams, upserts

#: The watermark begins at the epoch, so samples lie behind it.
BASE = 1_700_000_000_000
CONF = {"spark.sql.streaming.stateStore.providerClass": motion.PROVIDER}


def triggers(df):
    return sorted((r.series, r.trigger_start_ms, r.trigger_end_ms, round(r.peak, 6)) for r in df.collect())


def samples(spark, seed):
    rng = random.Random(seed)
    rows = []
    for s in range(6):
        at = BASE
        for _ in range(rng.choice([1, 2, 40])):
            at += rng.choice([0, 100, 100, 250, 3000])
            rows.append((s, at, len(rows), rng.choice([0.1, 0.2, 0.6, 0.9])))
    return spark.createDataFrame(rows, "series long, ts_ms long, event_id long, score double")


@pytest.mark.parametrize("seed", [1, 2])
def test_motion_triggers_from_shuffled_files(spark, tmp_path, seed):
    rules, df = motion.Rules(0.5, 300, 200), samples(spark, seed)
    motion.written_samples(df, str(tmp_path / "in"), 3)
    stream = spark.readStream.schema(motion.SAMPLES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.drained(motion.motion_stream(stream, rules, "10 days"), "append", ["series", "trigger_start_ms"], CONF)
    assert triggers(out) == triggers(temporal.motion_triggers(df, 0.5, 300, 200)) != []


def test_motion_triggers_by_timers(spark, tmp_path):
    """Samples almost in order: triggers come as soon as the watermark has passed them, before anything closes a series; each once."""
    rows = [(0, t, t, 0.9 if t % 10_000 < 3000 else 0.1) for t in range(BASE, BASE + 60_000, 500)]
    for k in range(6):
        part = rows[20 * k : 20 * k + 20]
        random.Random(k).shuffle(part)
        df = spark.createDataFrame(part, "series long, ts_ms long, event_id long, score double")
        df.selectExpr("series", "timestamp_millis(ts_ms) AS ts", "ts_ms", "event_id", "score", "false AS closing").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(motion.SAMPLES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.drained(motion.motion_stream(stream, motion.Rules(0.5, 300, 200), "5 seconds"), "append", ["series", "trigger_start_ms"], CONF)
    whole = spark.createDataFrame(rows, "series long, ts_ms long, event_id long, score double")
    want = triggers(temporal.motion_triggers(whole, 0.5, 300, 200))
    assert triggers(out) == want and len(want) == 6


# spans


def span_rows(seed, n=120):
    rng = random.Random(seed)
    return [(i, rng.randrange(4), BASE + rng.randrange(60) * 1000, rng.choice(["start", "start", "finish", "fail", "instant"])) for i in range(n)]


@pytest.mark.parametrize("seed, bound", [(1, 5000), (2, 20_000)])
def test_spans_equal_the_batch_rule_within_the_bound(spark, tmp_path, seed, bound):
    rows = span_rows(seed)
    spans.written_events(spark.createDataFrame(rows, "event_id long, unit_id long, at_ms long, event_phase string"), str(tmp_path / "in"), 3)
    stream = spark.readStream.schema(spans.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = spans.latest(streams.drained(spans.paired(stream, bound, "1 hour"), "append", ["unit", "start_id", "end_id"]))
    want, used = [], set()
    for i, u, at, phase in rows:
        if phase in ("finish", "fail"):
            before = [(a, j) for j, v, a, p in rows if p == "start" and v == u and (a, j) < (at, i) and at - a <= bound]
            used |= {j for _, j in before}
            if before:
                want.append((u, max(before)[1], i, at - max(before)[0]))
    want += [(u, i, -1, -1) for i, u, at, p in rows if p == "start" and i not in used]
    assert sorted(tuple(-1 if v is None else v for v in r) for r in out.collect()) == sorted(want)


# keyed upserts

ROW = "k long, v string, n int"


def table_of(spark, path):
    return upserts.KeyedTable(spark, str(path), ["k"], ["v"], "n")


def test_batches_once_each(spark, tmp_path):
    t, frame = table_of(spark, tmp_path), lambda rows: spark.createDataFrame(rows, ROW)
    first = frame([(1, "a", 0), (2, "b", 0), (2, "c", 1), (3, None, 0), (3, None, 5)])
    t.write(first, 0)
    second = frame([(1, "a", 2), (2, "x", 2), (3, "y", 2), (4, "d", 2)])
    # a writer that dies between its data and its commit leaves nothing that is read
    t.prepare(second, t.committed()[1])
    seen = lambda: (sorted(map(tuple, t.rows(ROW).collect()), key=str), sorted(map(tuple, t.conflicts(ROW).collect()), key=str))
    assert seen() == ([(1, "a", 0), (2, "b", 0), (3, None, 0)], [(2, "c", 1)])
    t.write(second, 1)
    after = seen()
    assert after == ([(1, "a", 0), (2, "b", 0), (3, None, 0), (4, "d", 2)], [(2, "c", 1), (2, "x", 2), (3, "y", 2)])
    t.write(second, 1)
    t.write(first, 0)
    assert seen() == after and t.committed()[0] == 1


def test_stream_that_is_killed_and_started_again(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(i, f"{i}" if k < 2 else "other", k) for i in range(k, k + 4)], ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t, calls = table_of(spark, tmp_path / "t"), []

    def dies(batch, number):
        calls.append(number)
        if len(calls) == 2:
            t.prepare(batch, t.committed()[1])
            raise RuntimeError("killed")
        t.write(batch, number)
        if len(calls) == 4:
            raise RuntimeError("killed after the commit")

    for _ in range(3):
        stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        try:
            stream.writeStream.foreachBatch(dies).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        except Exception as e:  # noqa: BLE001
            assert "killed" in str(e)
    assert calls == [0, 1, 1, 2, 2]
    assert sorted((r.k, r.v) for r in t.rows(ROW).collect()) == [(0, "0"), (1, "1"), (2, "2"), (3, "3"), (4, "4"), (5, "other")]
    assert sorted(r.k for r in t.conflicts(ROW).collect()) == [2, 3, 4]
