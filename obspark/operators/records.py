"""Record-level operators: scans, response parsing, exports, diagnostics, sessions, model stand-ins, backup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obspark.functions.udfs import hash_embedding, playback_subject, playback_token
from obspark.operators import search
from obspark.operators.scope import Scope, authorized, authorized_videos

# Fields that an export never shows, and the longest lists of revisions and lives of sessions.
FORBIDDEN = ("source_uri", "clip_uri", "thumbnail_uri")
MOST_REVISIONS = 8
# Texts of the stand-in model, by bucket.
MOCK_TEXTS = ("empty scene", "one person walking", "two people talking", "vehicle passing", "person with bag")


def timeline_scan(events: DataFrame, since: Column | None = None, until: Column | None = None, limit: int = 100_000, **equal) -> DataFrame:
    """Events of a time window (both ends count), and of a job or trace (column=value), in their total order; a limit of 0 or less gives none."""
    if limit <= 0:
        return events.limit(0)
    if since is not None:
        events = events.filter(F.col("occurred_at") >= since)
    if until is not None:
        events = events.filter(F.col("occurred_at") <= until)
    order = [c for c in ("occurred_at", "created_at", "event_id") if c in events.columns]
    return equality_scan(events, order, limit, **equal)


def equality_scan(df: DataFrame, order: Sequence[str], limit: int, **filters) -> DataFrame:
    """Rows by optional equalities, ordered and limited; a filter of None restricts nothing."""
    for c, v in filters.items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    return df.orderBy(*order).limit(limit)


#: Order of the scans of dimensions and logs.
DIMENSIONS = {
    "locations": ("location_id",),
    "cameras": ("camera_id",),
    "videos": ("video_id",),
    "jobs": ("created_at", "job_id"),
    "scale_tasks": ("job_id", "analysis_scale"),
    "triggers": ("video_id", "trigger_start_ms"),
    "units": ("unit_id",),
    "call_logs": ("started_at", "unit_id", "attempt_count"),
    "gate_logs": ("unit_id",),
    "policies": ("policy_id",),
    "pending_tasks": ("next_run_at", "task_id"),
}


def dimension_scan(df: DataFrame, dimension: str, limit: int, **filters) -> DataFrame:
    """A page of a dimension in its order."""
    return equality_scan(df, DIMENSIONS[dimension], limit, **filters)


def vectors_of(vectors: DataFrame, ids: DataFrame, vector_type: str | None = None) -> DataFrame:
    """Vectors of the records of ``ids``, of one channel or all."""
    if vector_type is not None:
        vectors = vectors.filter(F.col("vector_type") == vector_type)
    return vectors.join(ids.select("record_id"), "record_id", "left_semi")


def reindex(records: DataFrame, vectors: DataFrame, channel: str, model_id: str, force: bool = False) -> DataFrame:
    """The vectors of a channel after records that the model has not embedded yet (with ``force``, all) are embedded.

    Resumable: what is there by the model is left alone, so a second run adds nothing.
    """
    mine = vectors.filter((F.col("vector_type") == channel) & (F.col("model_id") == model_id)).select("record_id")
    todo = records if force else records.join(mine, "record_id", "left_anti")
    new = todo.select("record_id", F.lit(channel).alias("vector_type"), hash_embedding(f"{channel}_text").alias("embedding"), F.lit(model_id).alias("model_id"))
    kept = vectors.join(new.select("record_id", "vector_type"), ["record_id", "vector_type"], "left_anti")
    return kept.select("record_id", "vector_type", "embedding", "model_id").unionByName(new)


def parsed_scores(df: DataFrame, body: str, documents: str) -> DataFrame:
    """A response's scores aligned to its documents by index; a missing index scores 0."""
    results = F.from_json(body, "struct<results: array<struct<index: int, score: double>>>")["results"]
    pairs = df.select("id", F.posexplode(documents).alias("position", "document"))
    scores = df.select("id", F.inline(results)).withColumnRenamed("index", "position")
    return pairs.join(scores, ["id", "position"], "left").select("id", "position", "document", F.coalesce("score", F.lit(0.0)).alias("score"))


def parsed_vectors(df: DataFrame, body: str, expected: str) -> DataFrame:
    """A response's vectors in the order of their index, and why it can't be used (null: it can): its count must be the expected one, its indexes 0 and up."""
    data = F.from_json(body, "struct<data: array<struct<index: int, embedding: array<double>>>>")["data"]
    sorted_ = F.array_sort(data)
    whole = F.transform(sorted_, lambda x: x["index"]) == F.transform(sorted_, lambda x, i: i)
    fault = F.when(data.isNull(), "no_data").when(F.size(data) != F.col(expected), "count").when(~whole, "index")
    return df.select("id", fault.alias("fault"), F.when(fault.isNull(), F.transform(sorted_, lambda x: x["embedding"])).alias("vectors"))


def call_error(status: Column) -> Column:
    """How an HTTP status of a detector counts (null: no error); too many requests and server errors may be tried again."""
    return F.when((status == 429) | (status >= 500), "retryable").when(status >= 400, "permanent")


def detections(df: DataFrame, body: str) -> DataFrame:
    """A detector's answer flattened: image by position, label, confidence and box of each annotation."""
    schema = "struct<responses: array<struct<annotations: array<struct<label: string, confidence: double, xs: array<double>, ys: array<double>>>>>>"
    images = df.select("id", F.posexplode(F.from_json(body, schema)["responses"]).alias("image", "r"))
    each = images.select("id", "image", F.inline_outer("r.annotations"))
    return each.select("id", "image", "label", "confidence", F.array_min("xs").alias("x0"), F.array_max("xs").alias("x1"), F.array_min("ys").alias("y0"), F.array_max("ys").alias("y1"))


def sanitized(df: DataFrame, scope: Scope, forbidden: Sequence[str] = FORBIDDEN) -> DataFrame:
    """Permitted rows without the forbidden columns."""
    return authorized(df, scope).drop(*forbidden)


def exported_videos(records: DataFrame, videos: DataFrame, scope: Scope) -> DataFrame:
    """Videos that exported records name and that the scope permits as well."""
    return authorized_videos(videos, scope).join(records.select("video_id").distinct(), "video_id", "left_semi")


def migration_export(records: DataFrame, videos: DataFrame, scope: Scope) -> tuple[DataFrame, DataFrame]:
    """Permitted records without what an export never shows, and the videos that they name, authorized anew."""
    kept = sanitized(records, scope)
    return kept, exported_videos(kept, videos, scope).drop(*FORBIDDEN)


def stripped(c: Column, forbidden: Sequence[str]) -> Column:
    """A map without its forbidden keys."""
    return F.map_filter(c, lambda k, _: ~k.isin(*forbidden))


def removed(c: Column, forbidden: Sequence[str]) -> Column:
    """The keys that ``stripped`` takes out, sorted."""
    return F.sort_array(F.array_except(F.map_keys(c), F.map_keys(stripped(c, forbidden))))


def failures(units: DataFrame) -> DataFrame:
    """Failed and skipped units, and those with an error code."""
    return units.filter(F.col("status").isin("failed", "skipped") | (F.coalesce("error_code", F.lit("")) != ""))


def diagnostics(jobs: DataFrame, scales: DataFrame, units: DataFrame, job_id) -> DataFrame:
    """Failed and skipped scales and units of a job, and those with an error code, with the job's status."""
    job = jobs.filter(F.col("job_id") == job_id).select("job_id", "job_status")
    s = failures(scales.withColumnRenamed("scale_status", "status")).select("job_id", "analysis_scale", F.lit(None).cast("long").alias("unit_id"), "status", "error_code")
    u = failures(units).select("job_id", "analysis_scale", F.col("unit_id").cast("long").alias("unit_id"), "status", "error_code")
    return s.unionByName(u).join(F.broadcast(job), "job_id")


def lapsed(contexts: DataFrame, now: Column) -> DataFrame:
    """Q15: contexts whose time is up turn expired."""
    return contexts.withColumn("status", F.when((F.col("status") == "active") & (F.col("expires_at") < now), "expired").otherwise(F.col("status")))


def usable(contexts: DataFrame, now: Column, idle_seconds: int, scope_hash: str, principal: str) -> DataFrame:
    """Q5: why a context can't be used (null: it can): another's, scope, status, age, idleness, revisions. Another's context is as if it did not exist."""
    idle = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_accessed_at").cast("timestamp"))
    return contexts.withColumn(
        "refusal",
        F.when(~F.col("principal_id").eqNullSafe(F.lit(principal)), "not_found").when(F.col("scope_hash") != scope_hash, "scope_changed").when(F.col("status") != "active", "not_active").when(F.col("expires_at") < now, "expired").when(idle > idle_seconds, "idle").when(F.col("revisions") >= MOST_REVISIONS, "too_many_revisions"),
    )


def refine(pool: DataFrame, revision: DataFrame, operation: str, request: search.Request, corpus: DataFrame, vectors: DataFrame | None = None, vector: Sequence[float] | None = None, head: int = 50, index: search.TextStatistics | None = None) -> DataFrame:
    """Re-ranks a revision's records (record_id) that the current pool still permits; statistics are as in ``search.rank``."""
    held = pool.join(revision.select("record_id"), "record_id", "left_semi")
    if operation == "narrow_by_tags":
        return search.rank(search.narrow_by_tags(held, request.tags), search.Request())
    if operation == "filter_by_analysis_scale":
        return search.rank(search.filter_by_scale(held, request.preferred_scales), request, corpus, index=index)
    if operation == "rerank_current_candidates":
        return search.rerank_head(search.rank(held, request, corpus, vectors, vector, index), request.query, head)
    modes = {"search_static_text": "static_attribute", "search_dynamic_text": "dynamic_event", "hybrid_search_text": "hybrid", "apply_rrf_fusion": "hybrid"}
    if operation not in modes:
        raise ValueError(f"no operation {operation}")
    return search.rank(held, search.Request(**{**request.__dict__, "mode": modes[operation]}), corpus, index=index)


def mock_observation(start_ms: Column) -> Column:
    """Text of the stand-in model by the second of a segment's start."""
    return F.element_at(F.array(*map(F.lit, MOCK_TEXTS)), (F.floor(start_ms / 1000) % len(MOCK_TEXTS)).cast("int") + 1)


def mock_detections(images: DataFrame, ratio: float) -> DataFrame:
    """The first round(n ratio), halves to even, images of each unit are positive."""
    w = Window.partitionBy("unit_id")
    n = F.bround(F.count("*").over(w) * ratio).cast("long")
    return images.withColumn("positive", F.row_number().over(w.orderBy("image_id")) <= n)


def trigrams(c: Column) -> Column:
    """distinct trigrams of a lower-cased text padded with blanks."""
    t = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """shared trigrams over all."""
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def details(df: DataFrame, scope: Scope, ids: Sequence[str]) -> DataFrame:
    """Details of records with a locator, for which the scope is asked again by its video."""
    found = search.by_ids(df, ids, scope)
    seen = authorized(df, scope).select("video_id").distinct().withColumn("may_locate", F.lit(True))
    out = found.join(seen, "video_id", "left")
    return out.withColumn("locator", F.when(F.col("may_locate"), F.concat_ws(":", "video_id", F.col("segment_start_ms").cast("string"), F.col("segment_end_ms").cast("string")))).drop("may_locate")


def locators(found: DataFrame, df: DataFrame, scope: Scope, principal: str, secret: str, now: Column, ttl_s: int = 300) -> DataFrame:
    """Locators of records (record_id): where and when, a signed token and its expiry; only of those that the scope permits now."""
    scope.require("observation.read_locator")
    live = authorized(df, scope).join(F.broadcast(found.select("record_id")), "record_id", "left_semi")
    expiry = F.unix_seconds(now.cast("timestamp")) + ttl_s
    subject = F.concat_ws(":", F.lit(principal), "record_id", expiry.cast("string"))
    return live.select("record_id", "video_id", "camera_id", "segment_start_ms", "segment_end_ms", F.col("observed_start").alias("absolute_start"), F.col("observed_end").alias("absolute_end"), playback_token(secret)(subject).alias("token"), expiry.alias("expires_s"))


def verified_playback(tokens: DataFrame, df: DataFrame, scope: Scope, principal: str, secret: str, now_s: float) -> DataFrame:
    """What may be played: genuine tokens that have not lapsed, of this principal, whose record the scope permits now."""
    scope.require("video.playback")
    told = tokens.select(playback_subject(secret, now_s)("token").alias("subject"))
    mine = told.filter(F.substring_index("subject", ":", 1) == principal).select(F.substring_index("subject", ":", -1).alias("record_id")).distinct()
    return authorized(df, scope).join(mine, "record_id", "left_semi").select("record_id", "video_id", "camera_id", "segment_start_ms", "segment_end_ms")


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and an order-free checksum of each table."""
    out = None
    for name, df in tables.items():
        h = F.sum(F.crc32(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})))
        one = df.agg(F.count("*").alias("n"), F.coalesce(h, F.lit(0)).alias("checksum")).withColumn("table_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def backup(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes the tables, and the manifest of what was written."""
    spark = None
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        spark = df.sparkSession
    m = manifest({name: spark.read.parquet(f"{path}/{name}") for name in tables})
    m.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return m


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Reads a backup; raises if a table does not match the manifest."""
    told = {r["table_name"]: (r["n"], r["checksum"]) for r in spark.read.json(f"{path}/manifest").collect()}
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in told}
    for r in manifest(tables).collect():
        if told[r["table_name"]] != (r["n"], r["checksum"]):
            raise ValueError(f"backup of {r['table_name']} does not match its manifest")
    return tables


def export_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_revision(candidates: DataFrame, path: str, revision_id: str) -> None:
    """K8: an immutable revision; one that exists is a conflict."""
    candidates.write.mode("errorifexists").parquet(f"{path}/revision_id={revision_id}")


def append_log(df: DataFrame, path: str) -> None:
    """K7: appends to a log."""
    df.write.mode("append").parquet(path)
