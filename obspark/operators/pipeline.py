"""Pipeline state: gate decisions, rollups, queue order, publish with history, upserts, transitions."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obspark.functions.canonical import json_hash

# Legal transitions of a unit's status.
TRANSITIONS = (("queued", "running"), ("running", "succeeded"), ("running", "failed"), ("running", "partial_failed"), ("running", "retry_scheduled"), ("retry_scheduled", "queued"), ("queued", "cancelled"), ("running", "cancelled"))


def positive_ratio(frames: DataFrame, label: str, min_confidence: float) -> DataFrame:
    """Per unit the share of frames with a detection of the label at the confidence, over the declared frame count (unit_id, frame_count, detections)."""
    hit = F.exists("detections", lambda d: (d["label"] == label) & (d["confidence"] >= min_confidence))
    return frames.groupBy("unit_id").agg((F.sum(hit.cast("int")) / F.max("frame_count")).alias("ratio"))


def gate_decision(df: DataFrame, min_ratio: float) -> DataFrame:
    """G8 with one rule: a force reason sends a unit to the model, then a matched rule, else it is suppressed (columns force_reason, ratio)."""
    forced = F.coalesce(F.col("force_reason"), F.lit("")) != ""
    matched = F.coalesce(F.col("ratio"), F.lit(0.0)) >= min_ratio
    return df.withColumn("triggered", forced | matched).withColumn("reason", F.when(forced, F.concat(F.lit("forced:"), "force_reason")).when(matched, "rule_matched").otherwise("suppressed"))


@dataclass(frozen=True)
class Rule:
    """A gate rule: enough frames of a signal type show the label."""

    label: str
    rule_id: str | None = None
    signal_type: str = "object_detection"
    min_positive_frame_ratio: float = 1.0
    min_confidence: float = 0.5
    action: str = "call_vlm"

    @property
    def name(self) -> str:
        return f"{self.rule_id or self.label}.positive_frame_ratio>={self.min_positive_frame_ratio}"


def gate_rules(units: DataFrame, signals: DataFrame, rules: Sequence[Rule], force_reasons: Sequence[str], enabled: bool = True) -> DataFrame:
    """Decision on each unit (unit_id, trigger_reason) by all rules: triggered, action, matched_rules, ratios (by label), reason, evidence_hash, rule_config_hash.

    ``signals`` has unit_id, signal_id (their order), signal_type, frame_count
    and frames, an array of structs whose field detections is an array of label and confidence. A rule's ratio is its
    positive frames over the declared frames of all signals of its type, whatever their status: a failed image marks its
    signal, and the other images still tell. Of rules of one label the last ratio is
    told. The evidence is the frames of all signals. With the profile off, every unit goes.
    """
    rule_hash = "sha256:" + hashlib.sha256(json.dumps([dataclasses.asdict(r) for r in rules], sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    hits = lambda r: F.size(F.filter("frames", lambda f: F.exists(f["detections"], lambda d: (d["label"] == r.label) & (d["confidence"] >= r.min_confidence))))
    of = lambda r, v: F.sum(F.when(F.col("signal_type") == r.signal_type, v))
    ratio = [F.coalesce(F.when(of(r, F.col("frame_count")) > 0, of(r, hits(r)) / of(r, F.col("frame_count"))), F.lit(0.0)).alias(f"_r{k}") for k, r in enumerate(rules)]
    order = F.array_sort(F.collect_list(F.struct("signal_id", "frames")))
    per = signals.groupBy("unit_id").agg(*ratio, F.flatten(F.transform(order, lambda x: x["frames"])).alias("_evidence"))
    out = units.join(per, "unit_id", "left").fillna(0.0, [f"_r{k}" for k in range(len(rules))])
    evidence = F.coalesce("_evidence", F.array().cast(signals.schema["frames"].dataType))
    met = [F.when(F.col(f"_r{k}") >= r.min_positive_frame_ratio, F.lit(r.name)) for k, r in enumerate(rules) if r.action == "call_vlm"]
    matched = F.array_compact(F.array(*met)) if met else F.array().cast("array<string>")
    last = {r.label: k for k, r in enumerate(rules)}
    ratios = F.map_from_arrays(F.array(*map(F.lit, last)), F.array(*[F.col(f"_r{k}") for k in last.values()])) if rules else F.lit(None)
    reason = F.coalesce("trigger_reason", F.lit(""))
    forced = reason.isin(*force_reasons) & (reason != "") if force_reasons else F.lit(False)
    if not enabled:
        fixed = {"triggered": F.lit(True), "action": F.lit("disabled"), "matched_rules": F.array().cast("array<string>"), "ratios": F.lit(None).cast("map<string,double>"), "reason": F.lit("pre_vlm_gate disabled"), "evidence_hash": F.lit("sha256:disabled"), "rule_config_hash": F.lit(None).cast("string")}
        return units.select("unit_id", *[v.alias(k) for k, v in fixed.items()])
    action = F.when(forced, "force_vlm").when(F.size("matched_rules") > 0, "call_vlm").otherwise("suppress_vlm")
    why = F.when(forced, F.concat(F.lit("force_vlm_on_trigger_reason:"), reason)).when(F.size("matched_rules") > 0, "matched gate rules").otherwise("no gate rule matched")
    hashed = F.concat(F.lit("sha256:"), json_hash(evidence, signals.schema["frames"].dataType))
    out = out.withColumn("matched_rules", matched).withColumn("action", action)
    return out.select("unit_id", (F.col("action") != "suppress_vlm").alias("triggered"), "action", "matched_rules", ratios.cast("map<string,double>").alias("ratios"), why.alias("reason"), hashed.alias("evidence_hash"), F.lit(rule_hash).alias("rule_config_hash"))


#: States in which a unit or scale still works.
OPEN = ("pending", "queued", "running")


def scale_status(units: DataFrame, keys: Sequence[str] = ("job_id", "analysis_scale")) -> DataFrame:
    """Tallies and status of each scale of a job; skipped units do no harm, one that is still open leaves it running."""
    n = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    t = units.groupBy(*keys).agg(n("succeeded").alias("succeeded"), n("failed").alias("failed"), n("skipped").alias("skipped"), n(*OPEN).alias("open"))
    done = F.when((F.col("failed") > 0) & (F.col("succeeded") > 0), "partial_failed").when(F.col("failed") > 0, "failed").otherwise("succeeded")
    return t.withColumn("scale_status", F.when(F.col("open") > 0, "running").otherwise(done))


def job_status(scales: DataFrame, required: str) -> DataFrame:
    """A job with a running scale runs; a required scale with units and no success fails it, a failure elsewhere fails it in part."""
    units = F.col("succeeded") + F.col("failed") + F.col("skipped") + F.col("open")
    open_ = F.bool_or(F.col("scale_status") == "running")
    none = F.bool_or((F.col("analysis_scale") == required) & (F.col("succeeded") == 0) & (units > 0))
    some = F.bool_or(F.col("scale_status").isin("failed", "partial_failed"))
    return scales.groupBy("job_id").agg(F.when(open_, "running").when(none, "failed").when(some, "partial_failed").otherwise("succeeded").alias("job_status"))


def reconcile_residual(units: DataFrame, job_id: Column) -> DataFrame:
    """Units of a job that still run when it ends have failed."""
    lost = (F.col("job_id") == job_id) & (F.col("status") == "running")
    return units.withColumn("error_code", F.when(lost, "analysis_unit_failed").otherwise(F.col("error_code"))).withColumn("status", F.when(lost, "failed").otherwise(F.col("status")))


def sweep_orphans(units: DataFrame, cutoff: Column, limit: int) -> DataFrame:
    """Units after the oldest ``limit`` of those that run since before the cutoff have failed; ``swept`` tells them."""
    stale = stale_running(units, cutoff, limit).select("unit_id", F.lit(True).alias("swept"))
    out = units.join(F.broadcast(stale), "unit_id", "left").withColumn("swept", F.coalesce("swept", F.lit(False)))
    return out.withColumn("error_code", F.when(F.col("swept"), "orphan_timeout").otherwise(F.col("error_code"))).withColumn("status", F.when(F.col("swept"), "failed").otherwise(F.col("status")))


def swept_jobs(units: DataFrame, required: str) -> DataFrame:
    """Status of the jobs that lost a unit in the sweep, from all of their units."""
    parents = units.filter("swept").select("job_id").distinct()
    return job_status(scale_status(units.join(parents, "job_id", "left_semi")), required)


def claim_order(tasks: DataFrame, now: Column, limit: int) -> DataFrame:
    """Due tasks that are queued, or running with a lapsed lease: higher priority first, then the earlier ones."""
    due = (F.col("next_run_at") <= now) & ((F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease_expires_at") < now)))
    return tasks.filter(due).orderBy(F.desc("priority"), "next_run_at", "task_id").limit(limit)


def stale_running(units: DataFrame, cutoff: Column, limit: int) -> DataFrame:
    """Units that run since before the cutoff, oldest first."""
    return units.filter((F.col("status") == "running") & F.col("started_at").isNotNull() & (F.col("started_at") < cutoff)).orderBy("started_at", "unit_id").limit(limit)


def illegal_transitions(changes: DataFrame) -> DataFrame:
    """Changes (from_status, to_status) that no rule allows; staying is none."""
    legal = changes.sparkSession.createDataFrame(list(TRANSITIONS), "from_status string, to_status string")
    return changes.filter("from_status <> to_status").join(F.broadcast(legal), ["from_status", "to_status"], "left_anti")


def transitioned(states: DataFrame, changes: DataFrame) -> DataFrame:
    """States (id, status, started_at, finished_at) after each one's change (id, to_status, at); those that no rule allows are told in ``refused``.

    Entering ``running`` stamps the start, once; leaving it for an end stamps
    the finish. A change to the same status is none.
    """
    legal = states.sparkSession.createDataFrame(list(TRANSITIONS), "status string, to_status string").withColumn("legal", F.lit(True))
    both = states.join(changes, "id", "left").join(F.broadcast(legal), ["status", "to_status"], "left")
    moves = F.coalesce(F.col("legal"), F.lit(False))
    ends = F.col("to_status").isin("succeeded", "failed", "partial_failed", "cancelled")
    return both.select(
        "id",
        F.when(moves, F.col("to_status")).otherwise(F.col("status")).alias("status"),
        F.when(moves & (F.col("to_status") == "running"), F.coalesce("started_at", "at")).otherwise(F.col("started_at")).alias("started_at"),
        F.when(moves & ends, F.col("at")).otherwise(F.col("finished_at")).alias("finished_at"),
        (F.col("to_status").isNotNull() & (F.col("to_status") != F.col("status")) & ~moves).alias("refused"),
    )


def append_summary(jobs: DataFrame, published: DataFrame) -> DataFrame:
    """Jobs (job_id, created, updated, archived: arrays of ids) with the ids of a publication behind their own, repeats kept."""
    kinds = ("created", "updated", "archived")
    new = published.select("job_id", *[F.col(k).alias(f"_{k}") for k in kinds])
    none = F.array().cast("array<string>")
    return jobs.join(new, "job_id", "left").select("job_id", *[F.concat(F.coalesce(k, none), F.coalesce(f"_{k}", none)).alias(k) for k in kinds])


def probed(videos: DataFrame, probes: DataFrame) -> DataFrame:
    """Videos (video_id, video_start, duration_ms, video_end, source_status) after a probe (video_id, probed_ms, error)."""
    both = videos.join(probes, "video_id", "left")
    ok = F.col("probed_ms").isNotNull() & F.col("error").isNull()
    end = F.timestamp_add("MILLISECOND", "probed_ms", "video_start")
    return both.select("video_id", "video_start", F.when(ok, F.col("probed_ms")).otherwise(F.col("duration_ms")).alias("duration_ms"), F.when(ok, end).otherwise(F.col("video_end")).alias("video_end"), F.when(F.col("error").isNotNull(), "failed").when(ok, "ready").otherwise(F.col("source_status")).alias("source_status"))


# The location of cameras that nobody registered.
AUTO_LOCATION, AUTO_LEVEL = "loc_auto_unregistered", "internal"


def auto_location(locations: DataFrame, provisioned_: DataFrame) -> DataFrame:
    """The locations (location_id, location_name, security_level, access_policy_id, status) with that of unregistered cameras, once a camera needs it."""
    asked = provisioned_.filter(F.col("location_id") == AUTO_LOCATION).limit(1)
    new = asked.select(F.lit(AUTO_LOCATION).alias("location_id"), F.lit(AUTO_LOCATION).alias("location_name"), F.lit(AUTO_LEVEL).alias("security_level"), F.lit(None).cast("string").alias("access_policy_id"), F.lit("active").alias("status"))
    return locations.unionByName(new.join(locations.select("location_id"), "location_id", "left_anti"))


def provisioned(cameras: DataFrame, seen: DataFrame) -> DataFrame:
    """The cameras (camera_id, camera_name, location_id, status) with a row for each of ``seen`` (camera_id) that nobody registered."""
    new = seen.select("camera_id").filter("camera_id IS NOT NULL").distinct().join(cameras.select("camera_id"), "camera_id", "left_anti")
    return cameras.unionByName(new.select("camera_id", F.col("camera_id").alias("camera_name"), F.lit(AUTO_LOCATION).alias("location_id"), F.lit("active").alias("status")))


def assembled(outputs: DataFrame, videos: DataFrame) -> DataFrame:
    """observation records from model outputs and what the system knows of their videos; a unit that the gate held back has empty texts and tags.

    ``outputs`` has video_id, analysis_scale, segment_start_ms, segment_end_ms,
    static, dynamic, tags, quality, alert and gate (null: the model answered);
    ``videos`` video_id, tenant_id, camera_id, location_id, video_start,
    access_policy_id, security_level.
    """
    held = F.col("gate").isNotNull()
    text = lambda c: F.when(held, "").otherwise(F.coalesce(c, F.lit("")))
    told = F.to_json(F.struct("quality", "alert"), {"ignoreNullFields": "false"})
    at = lambda c: F.timestamp_add("MILLISECOND", c, "video_start")
    return outputs.join(videos, "video_id").select(
        "tenant_id", "video_id", "analysis_scale", "segment_start_ms", "segment_end_ms", at("segment_start_ms").alias("observed_start"), at("segment_end_ms").alias("observed_end"), "camera_id", "location_id",
        text("static").alias("static_text"), text("dynamic").alias("dynamic_text"), F.when(held, F.array().cast("array<string>")).otherwise(F.col("tags")).alias("tags"),
        F.when(held, F.to_json(F.struct(F.col("gate").alias("detector_gate")))).otherwise(told).alias("attributes"), "access_policy_id", "security_level",
    )


MEDIA = "index int, sha256 string, sha256_error string, size_bytes long, frame_index int, timestamp_ms long, decode_backend string"


def media_manifest(media: DataFrame) -> DataFrame:
    """media and ordered_media_hash of each unit (unit_id): a short hash of its media in their order.

    ``media`` has index, content (null: it couldn't be read, and sha256_error says why), frame_index, timestamp_ms and decode_backend.
    """
    known = {"sha256": F.sha2("content", 256), "sha256_error": F.when(F.col("content").isNull(), F.col("sha256_error")), "size_bytes": F.octet_length("content").cast("long")}
    kind = T.ArrayType(T.StructType.fromDDL(MEDIA))
    entry = F.struct(*[known.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in kind.elementType.fields])
    listed = media.groupBy("unit_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.count("*").alias("media"))
    return listed.select("unit_id", "media", json_hash(F.col("entries"), kind, 16).alias("ordered_media_hash"))


# What an input's fingerprint holds.
FINGERPRINT = ("analysis_scale", "segment_start_ms", "segment_end_ms", "camera_id", "model_version", "prompt_version", "pipeline_version", "system_prompt_hash", "strict_retry_instruction_hash", "provider_options_hash", "ordered_media_hash")


def input_manifest(units: DataFrame, media: DataFrame, prompt: Column, retry_instruction: str) -> DataFrame:
    """the short hash of what a model is asked about each unit: its segment, versions, and the hashes of the prompt, of the provider's options and of its media.

    ``units`` has unit_id, the first seven columns of FINGERPRINT and provider_options (a map of strings); a unit without media has the hash of an empty list.
    """
    short = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    options = F.coalesce("provider_options", F.create_map().cast("map<string,string>"))
    none = hashlib.sha256(b"[]").hexdigest()[:16]
    told = units.join(media_manifest(media).drop("media"), "unit_id", "left").withColumns({
        "ordered_media_hash": F.coalesce("ordered_media_hash", F.lit(none)), "system_prompt_hash": short(prompt), "strict_retry_instruction_hash": short(F.lit(retry_instruction)), "provider_options_hash": json_hash(options, T.MapType(T.StringType(), T.StringType()), 16),
    })
    held = told.select("unit_id", F.struct(*FINGERPRINT).alias("fingerprint"))
    return held.select("unit_id", json_hash(F.col("fingerprint"), held.schema["fingerprint"].dataType, 16).alias("input_manifest_hash"), "fingerprint")


def latest(log: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The last state of each key from its log."""
    return log.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")).select(*key, "_last.*")


def upsert(active: DataFrame, new: DataFrame, key: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
    """K3 to K5: new rows replace active ones of the same key; of several new ones the last (``seq``) counts; ``kept`` columns stay as first written."""
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("seq")))).filter("_n = 1").drop("_n", "seq")
    old = active.select(*key, *[F.col(c).alias(f"_{c}") for c in kept], F.lit(1).alias("_had"))
    merged = last.join(old, list(key), "left")
    merged = merged.select(*[F.coalesce(f"_{c}", c).alias(c) if c in kept else F.col(c) for c in active.columns])
    return active.join(last.select(*key).distinct(), list(key), "left_anti").unionByName(merged)


def insert_new(active: DataFrame, new: DataFrame, key: Sequence[str], payload: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """K6: new keys (the first of each), and conflicts: keys that exist with another payload."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("seq"))).filter("_n = 1").drop("_n")
    fresh = first.join(active.select(*key), list(key), "left_anti")
    both = new.alias("n").join(active.alias("a"), list(key))
    differs = F.lit(False)
    for c in payload:
        differs = differs | ~F.col(f"n.{c}").eqNullSafe(F.col(f"a.{c}"))
    return fresh, both.filter(differs).select(*key).distinct()


def publish(active: DataFrame, new: DataFrame, key: Sequence[str], archived_by: str) -> tuple[DataFrame, DataFrame]:
    """The active table after new records (with ``seq``) are published, and the history rows.

    A record of a key that exists is archived with its snapshot; of several new
    ones each archives the one before it, in order.
    """
    chain = active.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(new.withColumn("seq", F.col("seq").cast("bigint")))
    touched = chain.join(new.select(*key).distinct(), list(key), "left_semi")
    w = Window.partitionBy(*key).orderBy("seq")
    linked = touched.withColumn("_next", F.lead("record_id").over(w))
    body = [c for c in active.columns]
    history = linked.filter(F.col("_next").isNotNull()).select(F.col("record_id").alias("old_record_id"), F.col("_next").alias("replaced_by_record_id"), F.lit(archived_by).alias("archived_by"), F.to_json(F.struct(*body)).alias("record_snapshot"))
    now = active.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(linked.filter(F.col("_next").isNull()).select(*body))
    return now, history
