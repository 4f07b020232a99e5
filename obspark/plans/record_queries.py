"""Queries of record-level operators, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from obspark.operators import evaluate, records, scope, search
from obspark.plans.search_queries import BOTH, FUSED, HIT, JOINED, POOL, QUERY, SCOPE, SCOPED, VECTOR, VECTORS
from obspark.sources import views

GOLDEN = ("onre", "mit", "whou")


def _t(s, d, name):
    return views.table(s, d, name)


def _obs(s, d):
    return views.observations(s, d)


def _scores(s, d):
    k = F.col("p_partkey")
    body = F.concat(F.lit('{"results": [{"index": 1, "score": '), (k % 100 / 128).cast("string"), F.lit('}, {"index": 0, "score": 0.25}]}'))
    p = _t(s, d, "part").select(k.alias("id"), body.alias("body"), F.array("p_name", "p_brand", "p_type").alias("docs"))
    return records.parsed_scores(p, "body", "docs").select("id", "position", "score")


def _detections(s, d):
    k = F.col("p_partkey")
    one = F.concat(F.lit('{"annotations": [{"label": "person", "confidence": 0.5, "xs": [1, '), (k % 7).cast("string"), F.lit(', 3], "ys": [2, 4]}]}'))
    body = F.concat(F.lit('{"responses": ['), one, F.when(k % 2 == 0, ', {"annotations": []}').otherwise(""), F.lit("]}"))
    return records.detections(_t(s, d, "part").select(k.alias("id"), body.alias("body")), "body")


def _failures(s, d):
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "skipped").otherwise("succeeded")
    u = _t(s, d, "orders").select(F.col("o_orderkey").alias("unit_id"), F.col("o_custkey").alias("job_id"), status.alias("status"), F.when(F.col("o_orderkey") % 13 == 0, "E13").otherwise("").alias("error_code"))
    return records.failures(u)


def _contexts(s, d):
    return _t(s, d, "orders").select(
        F.col("o_orderkey").alias("context_id"), F.when(F.col("o_orderstatus") == "P", "closed").otherwise("active").alias("status"), F.expr("o_orderdate + INTERVAL 30 DAY").alias("expires_at"), F.col("o_orderdate").alias("last_accessed_at"),
        F.when(F.col("o_orderkey") % 10 == 0, "old").otherwise("now").alias("scope_hash"), F.when(F.col("o_custkey") % 4 != 0, "ann").alias("principal_id"), (F.col("o_orderkey") % 9).alias("revisions"),
    )


NOW = "1998-01-01 00:00:00"
_now = lambda: F.lit(NOW).cast("timestamp_ntz")
CONTEXTS_SQL = "cx AS (SELECT o_orderkey AS context_id, CASE WHEN o_orderstatus = 'P' THEN 'closed' ELSE 'active' END AS status, o_orderdate + INTERVAL 30 DAY AS expires_at, o_orderdate AS last_accessed_at, CASE WHEN o_orderkey % 10 = 0 THEN 'old' ELSE 'now' END AS scope_hash, CASE WHEN o_custkey % 4 <> 0 THEN 'ann' END AS principal_id, o_orderkey % 9 AS revisions FROM orders)"


def _revision(s, d):
    pool = search.candidate_pool(_obs(s, d), SCOPE)
    return pool, search.rank(pool, search.Request(query=QUERY), _obs(s, d)).filter("rank <= 60")


def _refine(s, d, operation, **k):
    pool, revision = _revision(s, d)
    return search.results(records.refine(pool, revision, operation, search.Request(query=QUERY, **k), _obs(s, d), views.vectors(s, d), VECTOR), 20)


def _refine_batch(s, d):
    """Q3: several operations on one revision, each on its own."""
    out = None
    for i, (operation, k) in enumerate((("search_static_text", {}), ("search_dynamic_text", {}), ("narrow_by_tags", {"tags": ("en",)}))):
        one = _refine(s, d, operation, **k).withColumn("step", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out.select("step", "rank", "record_id", "score")


REVISION = f"{POOL.replace('pool AS', 'pool0 AS')}, {BOTH.replace('FROM pool)', 'FROM pool0)')}, f0 AS (SELECT record_id, {FUSED} AS s {JOINED.replace('pool p', 'pool0 p')} WHERE {HIT}), rev AS (SELECT record_id FROM (SELECT *, row_number() OVER (ORDER BY s DESC, record_id) AS r FROM f0) WHERE r <= 60), pool AS (SELECT * FROM pool0 WHERE record_id IN (SELECT record_id FROM rev))"
_again = "rs2 AS (SELECT record_id, row_number() OVER (ORDER BY bm25 DESC, record_id) AS r FROM bs JOIN rev USING (record_id)), rd2 AS (SELECT record_id, row_number() OVER (ORDER BY bm25 DESC, record_id) AS r FROM bd JOIN rev USING (record_id))"


def _benchmark(s, d):
    """Q10: golden queries searched and measured."""
    obs = _obs(s, d)
    pool = search.candidate_pool(obs, SCOPE)
    ranked = None
    for term in GOLDEN:
        one = search.rank(pool, search.Request(query=term, mode="static_attribute", text="keyword"), obs).filter("rank <= 10").select(F.lit(term).alias("query_id"), "record_id", "rank")
        ranked = one if ranked is None else ranked.unionByName(one)
    return evaluate.metrics(ranked, evaluate.golden(obs, GOLDEN), 5).select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "reciprocal_rank")])


QUERIES = {
    "timeline_scan": lambda s, d: records.timeline_scan(views.timeline(s, d), F.lit("2024-01-03").cast("timestamp_ntz"), F.lit("2024-01-09").cast("timestamp_ntz"), 500).select("event_id", "occurred_at", "event_phase"),
    "audit_scan": lambda s, d: records.equality_scan(_t(s, d, "events"), ["ts", "event_id"], 100, user_id=7, event_type=None).select("event_id", "event_type"),
    "vector_fetch": lambda s, d: records.vectors_of(views.vectors(s, d), search.candidate_pool(_obs(s, d), SCOPE), "static").select("record_id", F.size("embedding").alias("dimension")),
    "reindex_run": lambda s, d: records.reindex(_obs(s, d), views.vectors(s, d).withColumn("model_id", F.when(F.col("doc_id") % 2 == 0, "mock").otherwise("old")), "static", "mock").groupBy("vector_type", "model_id").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("dimension")),
    "rerank_parse": _scores,
    "detector_parse": _detections,
    "sanitized_export": lambda s, d: records.sanitized(_obs(s, d).withColumn("source_uri", F.lit("secret")), SCOPE).select("record_id", "camera_id", "security_level"),
    "exported_videos": lambda s, d: records.exported_videos(scope.authorized(_obs(s, d), SCOPE), _obs(s, d).select("video_id", "tenant_id", "camera_id", "access_policy_id").distinct(), SCOPE).select("video_id").distinct(),
    "failure_details": _failures,
    "context_sweep": lambda s, d: records.lapsed(_contexts(s, d), _now()).select("context_id", "status"),
    "context_lifecycle": lambda s, d: records.usable(_contexts(s, d), _now(), 86400 * 20, "now", "ann").select("context_id", F.coalesce("refusal", F.lit("ok")).alias("refusal")),
    "refine_static": lambda s, d: _refine(s, d, "search_static_text"),
    "refine_hybrid": lambda s, d: _refine(s, d, "hybrid_search_text"),
    "refine_rerank": lambda s, d: _refine(s, d, "rerank_current_candidates"),
    "refine_batch": _refine_batch,
    "benchmark_run": _benchmark,
    "mock_observations": lambda s, d: _obs(s, d).select("record_id", records.mock_observation(F.col("segment_start_ms")).alias("text")),
    "mock_detections": lambda s, d: records.mock_detections(_t(s, d, "lineitem").select(F.col("l_orderkey").alias("unit_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("image_id")).distinct(), 0.5),
    "trigram_similarity": lambda s, d: _t(s, d, "part").select("p_partkey", F.round(records.trigram_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity")),
    "record_details": lambda s, d: records.details(_obs(s, d), SCOPE, ["doc_00000003", "doc_00000012", "doc_00000063"]).select("record_id", "locator"),
    "idempotency_keys": lambda s, d: _obs(s, d).select("record_id", F.concat_ws(":", "video_id", "analysis_scale", F.col("segment_start_ms").cast("string"), F.col("segment_end_ms").cast("string")).alias("idempotency_key")),
    "table_manifest": lambda s, d: records.manifest({n: _t(s, d, n) for n in views.TABLES}),
}


def _results_sql(order: str, frm: str, where: str) -> str:
    return f"SELECT rank, record_id, round(s, 6) AS score, substr(static_text, 1, 200) AS preview FROM (SELECT p.record_id, p.static_text, {order} AS s, row_number() OVER (ORDER BY {order} DESC, p.record_id) AS rank {frm} WHERE {where}) WHERE rank <= 20"


STATIC2 = _results_sql("1.0 / (rs2.r + 60)", "FROM pool p JOIN rs2 USING (record_id)", "true")
FUSED2 = "coalesce(1.0 / (rs2.r + 60), 0) + coalesce(1.0 / (rd2.r + 60), 0)"
FROM2 = "FROM pool p LEFT JOIN rs2 USING (record_id) LEFT JOIN rd2 USING (record_id)"
HYBRID2 = _results_sql(FUSED2, FROM2, "rs2.r IS NOT NULL OR rd2.r IS NOT NULL")

ORACLE_SQL = {
    "timeline_scan": f"WITH {views.TIMELINE_SQL} SELECT event_id, occurred_at, event_phase FROM tl WHERE occurred_at >= TIMESTAMP '2024-01-03' AND occurred_at <= TIMESTAMP '2024-01-09' ORDER BY occurred_at, event_id LIMIT 500",
    "audit_scan": "SELECT event_id, event_type FROM events WHERE user_id = 7 ORDER BY ts, event_id LIMIT 100",
    "vector_fetch": f"WITH {POOL} SELECT record_id, len(embedding) AS dimension FROM embeddings JOIN pool ON vec_id = doc_id WHERE label % 2 = 0",
    "reindex_run": "WITH v AS (SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'static' ELSE 'dynamic' END AS c, CASE WHEN vec_id % 2 = 0 THEN 'mock' ELSE 'old' END AS m FROM embeddings), n AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM v WHERE c = 'static' AND m = 'mock')), a AS (SELECT c, m FROM v WHERE NOT (c = 'static' AND vec_id IN (SELECT doc_id FROM n)) UNION ALL SELECT 'static', 'mock' FROM n) SELECT c AS vector_type, m AS model_id, count(*) AS n, 64 AS dimension FROM a GROUP BY ALL",
    "rerank_parse": "SELECT p_partkey AS id, position, CASE position WHEN 0 THEN 0.25 WHEN 1 THEN CAST(p_partkey % 100 AS DOUBLE) / 128 ELSE 0 END AS score FROM part, (SELECT unnest([0, 1, 2]) AS position)",
    "detector_parse": "SELECT p_partkey AS id, 0 AS image, 'person' AS label, CAST(0.5 AS DOUBLE) AS confidence, CAST(least(1, p_partkey % 7) AS DOUBLE) AS x0, CAST(greatest(3, p_partkey % 7) AS DOUBLE) AS x1, CAST(2 AS DOUBLE) AS y0, CAST(4 AS DOUBLE) AS y1 FROM part UNION ALL SELECT p_partkey, 1, NULL, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 2 = 0",
    "sanitized_export": f"WITH {SCOPED} SELECT record_id, camera_id, security_level FROM scoped",
    "exported_videos": f"WITH {SCOPED} SELECT DISTINCT video_id FROM scoped",
    "failure_details": "SELECT * FROM (SELECT o_orderkey AS unit_id, o_custkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'skipped' ELSE 'succeeded' END AS status, CASE WHEN o_orderkey % 13 = 0 THEN 'E13' ELSE '' END AS error_code FROM orders) WHERE status IN ('failed', 'skipped') OR error_code <> ''",
    "context_sweep": f"WITH {CONTEXTS_SQL} SELECT context_id, CASE WHEN status = 'active' AND expires_at < TIMESTAMP '{NOW}' THEN 'expired' ELSE status END AS status FROM cx",
    "context_lifecycle": f"WITH {CONTEXTS_SQL} SELECT context_id, CASE WHEN principal_id IS DISTINCT FROM 'ann' THEN 'not_found' WHEN scope_hash <> 'now' THEN 'scope_changed' WHEN status <> 'active' THEN 'not_active' WHEN expires_at < TIMESTAMP '{NOW}' THEN 'expired' WHEN epoch(TIMESTAMP '{NOW}') - epoch(last_accessed_at) > {86400 * 20} THEN 'idle' WHEN revisions >= 8 THEN 'too_many_revisions' ELSE 'ok' END AS refusal FROM cx",
    "refine_static": f"WITH {REVISION}, {_again} {STATIC2}",
    "refine_hybrid": f"WITH {REVISION}, {_again} {HYBRID2}",
    "refine_rerank": f"""WITH {REVISION}, {_again}, {VECTORS}, sv AS (SELECT record_id, max(s) AS s FROM sim WHERE s > 0 AND record_id IN (SELECT record_id FROM pool) GROUP BY 1), rv AS (SELECT record_id, row_number() OVER (ORDER BY s DESC, record_id) AS r FROM sv),
 f2 AS (SELECT p.record_id, p.static_text, {FUSED2} + coalesce(1.0 / (rv.r + 60), 0) AS s {FROM2} LEFT JOIN rv USING (record_id) WHERE rs2.r IS NOT NULL OR rd2.r IS NOT NULL OR rv.r IS NOT NULL),
 g2 AS (SELECT *, row_number() OVER (ORDER BY s DESC, record_id) AS rank FROM f2) SELECT rank, record_id, round(s, 6) AS score, substr(static_text, 1, 200) AS preview FROM g2 WHERE rank <= 20""",
    "refine_batch": f"""WITH {REVISION}, {_again} SELECT 0 AS step, rank, record_id, score FROM ({STATIC2}) UNION ALL SELECT 1, rank, record_id, score FROM ({STATIC2.replace('rs2', 'rd2')})
 UNION ALL SELECT 2, rank, record_id, round(1.0 / (rank + 60), 6) FROM (SELECT record_id, row_number() OVER (ORDER BY observed_start, record_id) AS rank FROM pool WHERE list_contains(tags, 'en')) WHERE rank <= 20""",
    "benchmark_run": f"""WITH {POOL}, q AS (SELECT unnest(['onre', 'mit', 'whou']) AS query_id), hit AS (SELECT query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY record_id) AS rank FROM q JOIN pool ON contains(lower(static_text), query_id)),
 rel AS (SELECT query_id, record_id FROM q JOIN obs ON contains(lower(static_text), query_id) OR list_contains([lower(x) for x in tags], query_id)), m AS (SELECT h.query_id, count(*) FILTER (WHERE rank <= 5) AS top, count(*) FILTER (WHERE rank <= 5 AND rel.record_id IS NOT NULL) AS hits, min(rank) FILTER (WHERE rel.record_id IS NOT NULL) AS first FROM hit h LEFT JOIN rel ON h.query_id = rel.query_id AND h.record_id = rel.record_id WHERE rank <= 10 GROUP BY 1),
 n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1) SELECT m.query_id, round(CAST(hits AS DOUBLE) / top, 6) AS precision, round(CAST(hits AS DOUBLE) / n, 6) AS recall, round(CAST(1.0 AS DOUBLE) / first, 6) AS reciprocal_rank FROM m JOIN n ON m.query_id = n.query_id""",
    "mock_observations": f"WITH {views.OBSERVATIONS_SQL} SELECT record_id, ['empty scene', 'one person walking', 'two people talking', 'vehicle passing', 'person with bag'][segment_start_ms // 1000 % 5 + 1] AS text FROM obs",
    "mock_detections": "WITH i AS (SELECT DISTINCT l_orderkey AS unit_id, l_linenumber * 1000000 + l_partkey AS image_id FROM lineitem) SELECT unit_id, image_id, row_number() OVER (PARTITION BY unit_id ORDER BY image_id) <= round_even(count(*) OVER (PARTITION BY unit_id) * 0.5, 0) AS positive FROM i",
    "record_details": f"WITH {SCOPED} SELECT record_id, video_id || ':' || CAST(segment_start_ms AS VARCHAR) || ':' || CAST(segment_end_ms AS VARCHAR) AS locator FROM scoped WHERE record_id IN ('doc_00000003', 'doc_00000012', 'doc_00000063')",
    "trigram_similarity": "WITH t AS (SELECT p_partkey, '  ' || lower(p_name) || ' ' AS a, '  ' || lower(p_type) || ' ' AS b FROM part), g AS (SELECT p_partkey, list_distinct([a[i:i + 2] for i in range(1, length(a) - 1)]) AS x, list_distinct([b[i:i + 2] for i in range(1, length(b) - 1)]) AS y FROM t) SELECT p_partkey, round(CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))), 6) AS similarity FROM g",
    "idempotency_keys": f"WITH {views.OBSERVATIONS_SQL} SELECT record_id, video_id || ':' || analysis_scale || ':' || CAST(segment_start_ms AS VARCHAR) || ':' || CAST(segment_end_ms AS VARCHAR) AS idempotency_key FROM obs",
}
