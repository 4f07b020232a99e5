"""Expected values of the operators, worked out by hand."""

import hashlib
import json
import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from obspark.functions import numeric, text, udfs
from obspark.operators import capacity, evaluate, pipeline, records, scope, search, temporal, timeline
from obspark.plans import lifecycle_queries


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


OBS = "record_id string, tenant_id string, video_id string, analysis_scale string, segment_start_ms long, segment_end_ms long, observed_start timestamp_ntz, observed_end timestamp_ntz, camera_id string, location_id string, static_text string, dynamic_text string, tags array<string>, access_policy_id string, security_level string"


def observations(spark, *items):
    import datetime

    base = datetime.datetime(2026, 6, 6, 21)
    out = []
    for i in items:
        d = {"tenant_id": "t", "video_id": "v", "analysis_scale": "default_segment", "segment_start_ms": 0, "segment_end_ms": 12000, "camera_id": "c", "location_id": "l", "static_text": "", "dynamic_text": "", "tags": [], "access_policy_id": "p", "security_level": "internal"} | i
        d["observed_start"] = base + datetime.timedelta(milliseconds=d["segment_start_ms"])
        d["observed_end"] = base + datetime.timedelta(milliseconds=d["segment_end_ms"])
        out.append(tuple(d[c.split()[0]] for c in OBS.split(", ")))
    return spark.createDataFrame(out, OBS)


ALL = scope.Scope("t", ("c",), ("l",), ("p",), "internal")


def test_scope_fails_closed(spark):
    df = observations(spark, {"record_id": "a"}, {"record_id": "b", "security_level": "confidential"}, {"record_id": "x", "tenant_id": "other"})
    assert rows(scope.authorized(df, ALL), "record_id") == [("a",)]
    for part in ("cameras", "locations", "policies"):
        assert scope.authorized(df, scope.Scope(**{**ALL.__dict__, part: ()})).count() == 0
    assert len(ALL.digest()) == 38 and ALL.digest() != scope.Scope(**{**ALL.__dict__, "principal": "ann"}).digest()
    with pytest.raises(PermissionError):
        scope.Scope("t", capabilities=()).require("observation.search")


def test_static_dynamic_hybrid(spark):
    df = observations(
        spark,
        {"record_id": "obs_a", "static_text": "person with backpack", "dynamic_text": "loitering near door"},
        {"record_id": "obs_b", "static_text": "person with bag", "dynamic_text": "walking", "segment_start_ms": 12000, "segment_end_ms": 24000},
        {"record_id": "obs_c", "static_text": "umbrella", "dynamic_text": "running quickly"},
    )
    for mode, query in (("static_attribute", "backpack"), ("dynamic_event", "loitering"), ("hybrid", "backpack loitering")):
        out = search.search(df, ALL, search.Request(query=query, mode=mode, top_k=5)).collect()
        assert [r["record_id"] for r in out] == ["obs_a"]
    # no term matches: substrings count, then all rows stay
    assert search.search(df, ALL, search.Request(query="ackpac", mode="static_attribute", top_k=5)).collect()[0]["record_id"] == "obs_a"
    assert search.search(df, ALL, search.Request(query="nowhere", top_k=5)).count() == 3
    with pytest.raises(ValueError):
        search.results(df, 101)


def test_scale_boost_and_filter(spark):
    df = observations(spark, {"record_id": "d", "static_text": "person"}, {"record_id": "h", "static_text": "person", "analysis_scale": "high_freq_event"})
    out = search.search(df, ALL, search.Request(query="person", preferred_scales=("high_freq_event",), top_k=5)).collect()
    assert [r["record_id"] for r in sorted(out, key=lambda r: r["rank"])] == ["h", "d"]
    assert rows(search.filter_by_scale(df, ["high_freq_event"]), "record_id") == [("h",)]
    assert search.filter_by_scale(df, []).count() == 2


def test_overlap(spark):
    df = observations(spark, {"record_id": "a"}, {"record_id": "b", "segment_start_ms": 6000, "segment_end_ms": 18000}, {"record_id": "far", "segment_start_ms": 60000, "segment_end_ms": 72000}, {"record_id": "touch", "segment_start_ms": 18000, "segment_end_ms": 20000})
    assert rows(search.overlapping(df, ALL, "a"), "record_id") == [("b",)]
    assert rows(search.overlapping(df, ALL, "missing"), "record_id") == []
    assert rows(search.overlap_pairs(df, 5000), "a", "b") == [("a", "b")]


def test_bm25_by_hand(spark):
    df = observations(spark, {"record_id": "a", "static_text": "x x y"}, {"record_id": "b", "static_text": "y"}, {"record_id": "c", "static_text": "z z"})
    got = {r["record_id"]: r["bm25"] for r in search.bm25(df, "static_text", "x").collect()}
    idf = math.log((3 - 1 + 0.5) / 1.5)
    assert got["a"] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2))) and got["b"] is None


def test_tag_filters(spark):
    df = observations(spark, {"record_id": "a", "tags": ["person", "backpack"]}, {"record_id": "b", "tags": ["person", "bag"]})
    assert rows(search.narrow_by_tags(df, ["backpack"]), "record_id") == [("a",)]
    assert rows(search.filtered(df, search.Filters(tags=("BACK",))), "record_id") == [("a",)]
    assert [tuple(r) for r in search.facet_tags(df).collect()] == [("person", 2), ("backpack", 1), ("bag", 1)]


def test_default_segments(spark):
    df = spark.createDataFrame([(1, 120000), (2, 0), (3, 5000)], "id int, duration_ms long")
    out = temporal.default_segments(df, 12000, 3000)
    assert out.filter("id = 1").count() == 13 and rows(out.filter("id = 3"), "segment_start_ms", "segment_end_ms") == [(0, 5000)]
    with pytest.raises(ValueError):
        temporal.default_segments(df, 1000, 1000)


@pytest.mark.parametrize(
    ("samples", "args", "expected"),
    [
        ([(0, 0.05), (500, 0.05), (1000, 0.8), (1500, 0.85), (2000, 0.9), (2500, 0.05), (3000, 0.04)], (0.4, 500, 600), [(1000, 2500, 0.9)]),
        ([(0, 0.9), (500, 0.1), (1000, 0.9), (1500, 0.1)], (0.4, 500, 1000), [(0, 1500, 0.9)]),
        ([(0, 0.1), (1000, 0.9), (1100, 0.1)], (0.4, 2000, 0), [(1000, 3000, 0.9)]),
    ],
)
def test_motion_triggers(spark, samples, args, expected):
    df = spark.createDataFrame([(1, t, s, i) for i, (t, s) in enumerate(samples)], "series int, ts_ms long, score double, event_id int")
    assert rows(temporal.motion_triggers(df, *args), "trigger_start_ms", "trigger_end_ms", "peak") == expected


def test_trigger_windows_are_many_small_tasks(spark, monkeypatch):
    """Tasks follow the samples; a trigger's windows are numbered without sorting them, and lose only their last ones."""
    samples = spark.createDataFrame([(k, t * 100, 1.0 if t % 20 < 7 + k % 5 else 0.0, t) for k in range(12) for t in range(60)], "series int, ts_ms long, score double, event_id int")
    plan = lambda: temporal.trigger_windows(temporal.motion_triggers(samples, 0.5, 300, 200), 250, 0.5, 100)
    want = rows(plan())
    monkeypatch.setattr(temporal, "TASK_ROWS", 90)
    assert rows(plan()) == want and plan().rdd.getNumPartitions() == 8
    numbered = {}
    for series, begin, _, index in want:
        numbered.setdefault((series, index // 1000), []).append((begin, index % 1000))
    assert all([i for _, i in sorted(x)] == list(range(len(x))) for x in numbered.values()) and max(map(len, numbered.values())) > 3


def test_dispatch(spark):
    df = spark.createDataFrame([(1, h, i) for h in (True, False) for i in range(5)], "job_id int, is_high boolean, ordinal int")
    out = temporal.dispatch_order(df, 2).orderBy("position").collect()
    assert "".join("H" if r["is_high"] else "D" for r in out) == "HHDHHDHDDD"


def test_frames(spark):
    df = spark.createDataFrame([(1, i, 100 * i, i / 10, 0.0, 100.0, 128.0) for i in range(10)], "series int, frame_index int, timestamp_ms long, motion double, scene double, blur double, brightness double")
    assert [r[0] for r in rows(temporal.select_frames(df, 5, "bins_then_score"), "frame_index")] == [1, 3, 5, 7, 9]
    assert [r[0] for r in rows(temporal.select_frames(df, 3, "score"), "frame_index")] == [7, 8, 9]
    assert [r[0] for r in rows(temporal.select_frames(df, 4, "uniform"), "frame_index")] == [0, 2, 5, 7]
    dark = df.withColumn("brightness", F.lit(0.0))
    assert temporal.select_frames(dark, 3, "score").count() == 3


def test_active_series_ignores_repeats(spark):
    e = [("a", "start"), ("a", "start"), ("b", "start"), ("c", "finish"), ("a", "finish"), ("a", "finish")]
    df = spark.createDataFrame([(k, p, i, i) for i, (k, p) in enumerate(e)], "unit_id string, event_phase string, at_ms long, event_id int")
    assert [r["active"] for r in timeline.active_series(df, "unit_id").orderBy("at_ms").collect()] == [1, 2, 1]


def test_stage_durations(spark):
    df = spark.createDataFrame([("u", "start", 10, 0), ("u", "start", 20, 1), ("u", "finish", 50, 2), ("u", "fail", 60, 3), ("w", "finish", 5, 4)], "unit_id string, event_phase string, at_ms long, event_id int")
    assert sorted(((r["unit_id"], r["duration_ms"]) for r in timeline.stage_durations(df, ["unit_id"]).collect()), key=str) == [("u", 30), ("u", 40), ("w", None)]


def test_capacity(spark):
    calls = spark.createDataFrame([("j", "u1", 1, 4000.0), ("j", "u2", 1, 6000.0), ("k", "u3", 2, 8000.0)], "job_id string, unit_id string, attempt_count int, duration_ms double")
    assert capacity.retry_estimate(calls).first()["retries"] == 1
    assert capacity.nearest_rank(calls, [], "duration_ms", {"p": 0.5}).first()["p"] == 6000
    assert capacity.group_count(calls, "missing").count() == 0
    assert capacity.video_hours(spark.createDataFrame([(3600000,), (1800000,), (None,)], "duration_ms long")).first()["hours"] == 1.5


def test_rollups(spark):
    u = spark.createDataFrame([(1, "d", "succeeded"), (1, "d", "failed"), (2, "d", "failed"), (3, "h", "failed"), (3, "d", "succeeded"), (4, "d", "skipped")], "job_id int, analysis_scale string, status string")
    assert rows(pipeline.job_status(pipeline.scale_status(u), "d")) == [(1, "partial_failed"), (2, "failed"), (3, "partial_failed"), (4, "failed")]


def test_publish_chains(spark):
    active = spark.createDataFrame([("old", 1, "x"), ("other", 2, "y")], "record_id string, k int, v string")
    new = spark.createDataFrame([("n1", 1, "a", 1), ("n2", 1, "b", 2), ("n3", 3, "c", 3)], "record_id string, k int, v string, seq int")
    now, history = pipeline.publish(active, new, ["k"], "job")
    assert rows(now, "record_id") == [("n2",), ("n3",), ("other",)]
    assert rows(history, "old_record_id", "replaced_by_record_id") == [("n1", "n2"), ("old", "n1")]


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", r, i + 1) for i, r in enumerate("abcd")], "query_id string, record_id string, rank int")
    rel = spark.createDataFrame([("q", "b"), ("q", "d"), ("none", "z")], "query_id string, record_id string")
    two = {r["query_id"]: tuple(r)[1:] for r in evaluate.metrics(ranked, rel, 2).collect()}
    assert two == {"q": (0.5, 0.5, 0.5), "none": (0.0, 0.0, 0.0)}
    assert evaluate.metrics(ranked, rel, 4).filter("query_id = 'q'").first()["recall"] == 1.0


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([], [])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(numeric.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_text_functions(spark):
    assert text.query_terms("Red, BAG hi-fi") == ["red", "bag"]
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ("",), ("none",), ("{bad",), ("{x}",)], "t string")
    assert [r[0] for r in df.select(text.model_status(F.col("t"))).collect()] == ["ok", "empty", "no_json", "no_json", "invalid_json"]


def test_motion_scores_and_embedding():
    frames = [bytes([10, 20, 30, 40]), bytes([10, 25, 20, 40])]
    assert udfs.motion_scores(frames) == [0.0, pytest.approx(15 / 1020)]
    v = udfs.embed_text("x")
    assert v == udfs.embed_text("x") and sum(a * a for a in v) == pytest.approx(1.0)


def test_permits(spark):
    df = spark.createDataFrame([(["ann"], [], [], ["ann"]), ([], ["guard"], [], []), ([], [], [], [])], "denied_principals array<string>, allowed_roles array<string>, allowed_groups array<string>, allowed_principals array<string>")
    assert [r[0] for r in df.select(scope.permits_principal("ann", ["guard"], [])).collect()] == [False, True, False]


def test_tokens_expire():
    token = f"rec:200.{udfs.sign('rec:200', 'k')}"
    assert udfs.verified_payload(token, "k", 100) == "rec:200"
    assert udfs.verified_payload(token, "k", 300) is None and udfs.verified_payload(token, "other", 100) is None and udfs.verified_payload(None, "k", 1) is None


def test_backup_and_revisions(spark, tmp_path):
    from obspark.operators import records

    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    records.backup({"t": df}, f"file://{tmp_path}/b")
    assert records.restore(spark, f"file://{tmp_path}/b")["t"].count() == 2
    df.limit(1).write.mode("overwrite").parquet(f"file://{tmp_path}/b/t")
    with pytest.raises(ValueError):
        records.restore(spark, f"file://{tmp_path}/b")
    records.write_revision(df, f"file://{tmp_path}/r", "1")
    with pytest.raises(Exception, match="exists"):
        records.write_revision(df, f"file://{tmp_path}/r", "1")


def test_job_and_scale_rules(spark):
    """A running scale leaves its job alone; a required scale of which all was skipped fails it."""
    units = [(1, "d", "skipped"), (1, "h", "succeeded"), (2, "d", "succeeded"), (2, "h", "failed"), (3, "d", "failed"), (3, "h", "running"), (4, "h", "failed"), (4, "h", "succeeded"), (5, "d", "succeeded"), (5, "h", "skipped"), (6, "d", "failed")]
    df = spark.createDataFrame([(j, s, st, i) for i, (j, s, st) in enumerate(units)], "job_id int, analysis_scale string, status string, unit_id int")
    scales = pipeline.scale_status(df)
    assert rows(scales, "job_id", "analysis_scale", "scale_status") == sorted([(1, "d", "succeeded"), (1, "h", "succeeded"), (2, "d", "succeeded"), (2, "h", "failed"), (3, "d", "failed"), (3, "h", "running"), (4, "h", "partial_failed"), (5, "d", "succeeded"), (5, "h", "succeeded"), (6, "d", "failed")])
    assert rows(pipeline.job_status(scales, "d")) == [(1, "failed"), (2, "partial_failed"), (3, "running"), (4, "partial_failed"), (5, "succeeded"), (6, "failed")]


def test_error_rules(spark):
    cases = [(["VlmProviderError"], None), (["MyProviderError", "VlmProviderError"], "x"), (["CustomProviderFault"], ""), (["X", "VlmSchemaValidationError"], ""), (["ValueError"], "separate rate 500"), (["OperationalError"], ""), (["IntegrityError", "OperationalError"], "busy"), (["RuntimeError"], "Database is LOCKED"), ([], None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, classes array<string>, message string")
    got = rows(df, "i", text.model_failure(F.col("classes")), text.model_retries(F.col("classes")), text.storage_retries(F.col("classes"), F.col("message")))
    bad, schema = "analysis_unit_failed", "vlm_schema_validation_failed"
    assert got == [(0, "vlm_provider_error", True, False), (1, "vlm_provider_error", True, False), (2, "vlm_provider_error", False, False), (3, schema, False, False), (4, bad, False, False), (5, bad, False, True), (6, bad, False, False), (7, bad, False, True), (8, bad, False, False)]


def test_redaction_rules(spark):
    import json

    df = spark.createDataFrame([("see /srv/media/a.mp4). and /x/y, end",), ("data:image/png;base64,AAAA= x",), ("A" * 130 + "==",), ("/a/b/",), ("plain / text",), ("zz " * 600,)], "t string")
    got = [r[0] for r in df.select(text.recorded(F.col("t"))).collect()]
    assert got == ["see <path:a.mp4> and <path:y> end", "<redacted-data-url> x", "<redacted-base64>", "<path:redacted>", "plain / text", ("zz " * 600)[:500] + "...<truncated>"]
    m = df.limit(1).select(text.recorded_fields(F.create_map(F.lit("API-Key"), F.lit("k"), F.lit("note"), F.lit("/q/w/e"))).alias("m")).first()["m"]
    assert m == {"API-Key": "<redacted>", "note": "<path:e>"}
    nested = {"a": {"api_key": 1, "list": ["/abs", "ok", {"note": "data:x"}]}, "image_bytes": [1], "long": "y" * 3000, "n": 2.5}
    shown = spark.createDataFrame([(json.dumps(nested),), ("no json",), (None,)], "t string").select(udfs.redacted_json("t")).collect()
    assert json.loads(shown[0][0]) == {"a": {"api_key": "[redacted]", "list": ["[redacted]", "ok", {"note": "[redacted]"}]}, "image_bytes": "[redacted]", "long": "[redacted-long-string]", "n": 2.5}
    assert shown[1][0] is None and shown[2][0] is None


def test_shown_numbers(spark):
    values = [3.0, 0.1234567, 1234567.891, 12.5, None, 1e-7, -2.0000000001, 1.5e-6]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(text.shown_number(F.col("v"))).collect()]
    assert got == ["n/a" if v is None else str(round(v)) if abs(v - round(v)) < 1e-9 else f"{v:.6g}" for v in values]


def test_positions_and_totals(spark):
    import random

    from obspark.functions import ranks

    rng = random.Random(3)
    data = [(g, rng.choice([1.5, 2.5, rng.random() * 1e6])) for g in "abc" for _ in range(rng.choice([1, 7, 300]))] + [("none", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r["g"]: tuple(r) for r in ranks.at_positions(df, ["g"], "v", {"first": F.lit(0), "middle": F.floor(F.col("n") / 2), "last": F.col("n") - 1}).collect()}
    for g in "abc":
        x = sorted(v for k, v in data if k == g)
        assert got[g] == (g, x[0], x[len(x) // 2], x[-1], len(x))
    assert set(got) == set("abc")
    deltas = [(rng.randrange(40_000_000), i, rng.choice([1, -1])) for i in range(400)]
    totals = ranks.running_total(spark.createDataFrame(deltas, "at_ms long, event_id long, delta int"), [], "total").collect()
    total, want = 0, {}
    for at, i, x in sorted(deltas):
        total += x
        want[i] = total
    assert {r["event_id"]: r["total"] for r in totals} == want


def test_state_changes(spark):
    states = spark.createDataFrame([(1, "queued", None, None), (2, "running", 5, None), (3, "succeeded", 1, 2), (4, "running", 1, None)], "id int, status string, started_at int, finished_at int")
    changes = spark.createDataFrame([(1, "running", 9), (2, "failed", 9), (3, "running", 9), (4, "running", 9)], "id int, to_status string, at int")
    assert rows(pipeline.transitioned(states, changes)) == [(1, "running", 9, None, False), (2, "failed", 5, 9, False), (3, "succeeded", 1, 2, True), (4, "running", 1, None, False)]


def test_gate_rules(spark):
    """Ratios over all signals of a type, failed ones too; forced units; no signals; the profile off."""
    kind = "unit_id string, signal_id int, signal_type string, frame_count int, frames array<struct<detections: array<struct<label: string, confidence: double>>>>"
    person, car, none = ([{"label": "person", "confidence": 0.9}],), ([{"label": "car", "confidence": 0.4}, {"label": "person", "confidence": 0.2}],), ([],)
    s = spark.createDataFrame([("a", 1, "object_detection", 2, [person, none]), ("a", 0, "object_detection", 2, [car]), ("b", 0, "object_detection", 4, [person, none, none]), ("c", 0, "motion", 1, [person])], kind)
    units = spark.createDataFrame([("a", ""), ("b", None), ("c", "manual"), ("d", "other")], "unit_id string, trigger_reason string")
    rules = [pipeline.Rule("person", "r1", min_positive_frame_ratio=0.25), pipeline.Rule("car", min_positive_frame_ratio=0.25, min_confidence=0.4), pipeline.Rule("car", "r3", min_positive_frame_ratio=0.0, min_confidence=0.99, action="suppress_vlm")]
    got = {r.unit_id: r for r in pipeline.gate_rules(units, s, rules, ["manual"]).collect()}
    assert [(k, got[k].triggered, got[k].action, got[k].matched_rules, got[k].ratios, got[k].reason) for k in "abcd"] == [
        ("a", True, "call_vlm", ["r1.positive_frame_ratio>=0.25", "car.positive_frame_ratio>=0.25"], {"person": 0.25, "car": 0.0}, "matched gate rules"),
        ("b", True, "call_vlm", ["r1.positive_frame_ratio>=0.25"], {"person": 0.25, "car": 0.0}, "matched gate rules"),
        ("c", True, "force_vlm", [], {"person": 0.0, "car": 0.0}, "force_vlm_on_trigger_reason:manual"),
        ("d", False, "suppress_vlm", [], {"person": 0.0, "car": 0.0}, "no gate rule matched"),
    ]
    dumped = lambda v: "sha256:" + hashlib.sha256(json.dumps(v, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert got["a"].evidence_hash == dumped([{"detections": x[0]} for x in (car, person, none)]) and got["d"].evidence_hash == dumped([])
    (off,) = {tuple(r)[1:3] for r in pipeline.gate_rules(units, s, rules, [], enabled=False).collect()}
    assert off == (True, "disabled")


def test_frame_features(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    frames = [rng.integers(0, 256, (9, 16)).astype(np.uint8) for _ in range(3)]
    frames.append(frames[-1])
    got = spark.createDataFrame([([f.tobytes() for f in frames],)], "f array<binary>").select(udfs.frame_features(16)("f").alias("x")).first()["x"]
    assert [round(r["brightness"], 6) for r in got] == [round(float(f.mean()), 6) for f in frames] and got[0]["scene"] == 0 and abs(got[3]["scene"]) < 1e-9 and got[1]["scene"] > 0
    flat = spark.createDataFrame([([bytes(144)],)], "f array<binary>").select(udfs.frame_features(16)("f").alias("x")).first()["x"][0]
    assert (flat["brightness"], flat["sharpness"]) == (0.0, 0.0)


def test_frames_of_many_lists_meet(spark, monkeypatch):
    """Lists of unequal lengths and frames of unequal sizes, a few frames at a time: as each list alone, in no more passes than there are sizes and pieces."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    lists = [[rng.integers(0, 256, 4 * h, np.uint8).tobytes() for h in hs] for hs in ([4, 4, 4], [], [1, 4], [2], [4, 4])]
    lists.insert(2, None)
    passes, real = [], udfs.frame_statistics
    monkeypatch.setattr(udfs, "frame_statistics", lambda x, w: passes.append(len(x)) or real(x, w))
    features = udfs.frame_features(4).func
    same = [0, 1, 2, 5]  # lists of one size of frames
    together = features(pa.array(lists, pa.list_(pa.binary()))).to_pylist()
    assert sorted(passes) == [1, 1, 6]
    assert together == [features(pa.array([x], pa.list_(pa.binary()))).to_pylist()[0] for x in lists] and together[2] is None
    monkeypatch.setattr(udfs, "FRAMES", 32)
    assert features(pa.array(lists, pa.list_(pa.binary())).slice(1)).to_pylist() == together[1:]
    whole = pa.array([lists[i] for i in same], pa.list_(pa.binary()))
    assert udfs.frame_motion.func(whole).to_pylist() == [None if lists[i] is None else pytest.approx(udfs.motion_scores(lists[i])) for i in same]


def test_records_of_model_outputs(spark):
    import datetime

    at = datetime.datetime(2026, 1, 1)
    videos = spark.createDataFrame([("v", "t", "c", "l", at, "p", "internal")], "video_id string, tenant_id string, camera_id string, location_id string, video_start timestamp_ntz, access_policy_id string, security_level string")
    outputs = spark.createDataFrame([("v", "d", 1000, 3000, "s", None, ["x"], "good", True, None), ("v", "d", 3000, 5000, "s", "dyn", ["x"], None, None, "suppressed")], "video_id string, analysis_scale string, segment_start_ms long, segment_end_ms long, static string, dynamic string, tags array<string>, quality string, alert boolean, gate string")
    a, b = pipeline.assembled(outputs, videos).orderBy("segment_start_ms").collect()
    assert (a["observed_start"], a["static_text"], a["dynamic_text"], a["tags"], a["attributes"]) == (at + datetime.timedelta(seconds=1), "s", "", ["x"], '{"quality":"good","alert":true}')
    assert (b["observed_end"], b["static_text"], b["tags"], b["attributes"]) == (at + datetime.timedelta(seconds=5), "", [], '{"detector_gate":"suppressed"}')


def test_provisioning_and_appends(spark):
    cameras = spark.createDataFrame([("c1", "one", "l1", "active")], "camera_id string, camera_name string, location_id string, status string")
    seen = spark.createDataFrame([("c1",), ("c2",), ("c2",), (None,)], "camera_id string")
    assert rows(pipeline.provisioned(cameras, seen)) == [("c1", "one", "l1", "active"), ("c2", "c2", "loc_auto_unregistered", "active")]
    none = "job_id int, created array<string>, updated array<string>, archived array<string>"
    jobs, new = spark.createDataFrame([(1, ["a"], [], None), (2, [], [], [])], none), spark.createDataFrame([(1, ["a"], ["b"], ["c"])], none)
    assert rows(pipeline.append_summary(jobs, new)) == [(1, ["a", "a"], ["b"], ["c"]), (2, [], [], [])]
    assert scope.Scope("t").capabilities == ("observation.search",)
    kinds = spark.createDataFrame([("admin",), ("service_account",), ("user",)], "t string").select("t", F.size(scope.capabilities(F.col("t"))).alias("n"))
    assert rows(kinds) == [("admin", 12), ("service_account", 6), ("user", 4)]


def test_late_dates(spark):
    from obspark.sources import views

    got = spark.range(1).select(views.after(F.lit(12_000_000 // 50 * 9000 * 1000))).first()[0]
    assert got.year > 2060


def test_logs_revisions_and_reports(spark, tmp_path):
    from pyspark.errors import AnalysisException

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    records.append_log(df, f"{tmp_path}/log")
    records.append_log(df, f"{tmp_path}/log")
    assert rows(spark.read.parquet(f"{tmp_path}/log")) == [(1, "a"), (1, "a"), (2, "b"), (2, "b")]
    records.write_revision(df, f"{tmp_path}/revisions", "c:0")
    with pytest.raises(AnalysisException):
        records.write_revision(df, f"{tmp_path}/revisions", "c:0")
    records.export_report(df, f"{tmp_path}/report")
    assert rows(spark.read.json(f"{tmp_path}/report")) == [(1, "a"), (2, "b")]
    records.backup({"t": df}, f"{tmp_path}/backup")
    assert rows(records.restore(spark, f"{tmp_path}/backup")["t"]) == [(1, "a"), (2, "b")]
    df.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/backup/t")
    with pytest.raises(ValueError, match="does not match"):
        records.restore(spark, f"{tmp_path}/backup")


def test_shared_folder(spark):
    from obspark.sources import places

    assert places.shared_dir(spark).startswith("file:")


def test_positions_beside_an_outlier(spark):
    """One value far beyond the others doesn't gather them in a range."""
    from obspark.functions import ranks

    df = spark.range(1, 2001).select(F.lit("a").alias("g"), F.when(F.col("id") == 2000, F.lit(10**13)).otherwise(F.col("id") * 10).alias("v"))
    got = ranks.at_positions(df, ["g"], "v", {"a": F.lit(0), "m": F.floor(F.col("n") / 2), "z": F.col("n") - 1}).first()
    assert (got.a, got.m, got.z, got.n) == (10, 10010, 10**13, 2000)
    share = (F.col("v") - 10).cast("double") / float(10**13 - 10)
    most = df.groupBy(F.floor(F.log1p(share * ranks.FINER) / math.log1p(ranks.FINER) * ranks.RANGES).alias("r")).count().agg(F.max("count")).first()[0]
    assert most < 40

def test_media_of_repeated_lines(spark, tmp_path):
    """Of several rows of an order's line the table's first counts, though Spark reads the longer file first."""
    (folder := tmp_path / "lineitem.parquet").mkdir()
    for name, first, n in (("a", 0, 1), ("b", 1, 60)):
        rows = [(o, v * 100 + o, 1, "N") for v in range(first, first + n) for o in range(25)]
        pq.write_table(pa.table(list(zip(*rows, strict=True)), ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"]), folder / f"{name}.parquet")
    media = lifecycle_queries._media_rows(spark, str(tmp_path)).collect()
    assert {r.unit_id: bytes(r.content).decode() for r in media} == {o: f"{o}/N" for o in range(25)}


def test_a_pool_is_cut_before_texts_meet_labels(spark, sf):
    """Rows after the pool's last place go below the join with the labels; repeated ids, equal and missing times are as in a plain sort."""
    from obspark.plans.search_queries import SCOPE
    from obspark.sources import views

    pool = search.candidate_pool(views.observations(spark, sf).hint("merge"), SCOPE, limit=7)
    plan = pool._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in plan[plan.index("LeftOuter") :].splitlines()[1]
    rows = [(f"r{i % 5}", None if i % 9 == 0 else f"2024-01-01 00:00:0{i % 3}", i) for i in range(40)]
    df = spark.createDataFrame(rows, "record_id string, at string, n int").select("record_id", F.col("at").cast("timestamp_ntz").alias("observed_start"), "n")
    who = scope.Scope("t", ("c",), ("l",), ("p",), "public")
    df = df.select("*", F.lit("t").alias("tenant_id"), F.lit("c").alias("camera_id"), F.lit("l").alias("location_id"), F.lit("p").alias("access_policy_id"), F.lit("public").alias("security_level"))
    for limit in (1, 6, 39, 50):
        got = [(r.observed_start, r.record_id) for r in search.candidate_pool(df, who, limit=limit).collect()]
        assert got == [(r.observed_start, r.record_id) for r in df.orderBy("observed_start", "record_id").limit(limit).collect()]
    assert search.candidate_pool(df.limit(0), who).count() == 0


def test_texts_are_those_of_the_observations(spark, tmp_path):
    """No join with labels is needed for texts, unless a document has several labels."""
    from obspark.sources import views

    docs = [(1, "a\nb c\nd", "en", "src1", 7), (2, None, "en", "src1", 0), (3, "one", "fr", "src2", 3), (None, "x\ny", "de", "src2", 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name, labels in (("once", [(1, 1, 0), (None, 0, 0), (None, 1, 1)]), ("several", [(1, 1, 0), (3, 0, 0), (3, 0, 1), (9, 1, 1), (9, 1, 1)])):
        at = tmp_path / name
        at.mkdir()
        (at / "documents.parquet").symlink_to(tmp_path / "documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        got, columns = views.texts(spark, str(at)), ("record_id", "static_text", "dynamic_text")
        assert sorted(map(str, got.collect())) == sorted(map(str, views.observations(spark, str(at)).select(*columns).collect()))
        assert ("Join" in got._jdf.queryExecution().optimizedPlan().toString()) == (name == "several")
