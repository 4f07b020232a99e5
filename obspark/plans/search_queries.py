"""Queries of scope, search, refinement and facets, each with the SQL of the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from obspark.functions.numeric import level_rank, vector_fault
from obspark.functions.text import keyword_score
from obspark.operators import evaluate, scope, search, text_store
from obspark.sources import places, views

CAMERAS = tuple(f"src{i}" for i in range(15))
SCOPE = scope.Scope("tenant_default", CAMERAS, ("en", "fr", "de"), ("pol_a", "pol_b"), "confidential", principal="ann")
FILTERS = search.Filters(scales=("default_segment", "high_freq_event"), time_start="2024-01-01 00:00:10", time_end="2024-01-01 04:00:00", tags=("SRC1",))
QUERY, TERMS = "onre mit edre", ("onre", "mit", "edre")

_IN = lambda values: ", ".join(f"'{v}'" for v in values)
SCOPED = f"""{views.OBSERVATIONS_SQL}, scoped AS (SELECT * FROM obs WHERE tenant_id = 'tenant_default' AND camera_id IN ({_IN(CAMERAS)}) AND location_id IN ('en', 'fr', 'de')
 AND access_policy_id IN ('pol_a', 'pol_b') AND security_level IN ('public', 'internal', 'confidential'))"""
POOL = f"{SCOPED}, pool AS (SELECT * FROM scoped ORDER BY observed_start, record_id LIMIT 1000)"


def keyword_sql(column: str) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({column}), '{t}') AS INT)" for t in TERMS) + ")"


def bm25_sql(name: str, column: str, terms: tuple[str, ...] = TERMS) -> str:
    """CTEs ``name``: record_id and bm25 of the rows of the pool where a term occurs, statistics of all observations."""
    tok = f"regexp_extract_all(strip_accents(lower({column})), '[\\p{{L}}\\p{{N}}]+')"
    stats = ", ".join(f"sum(CAST(list_contains(t, '{w}') AS INT)) AS d{i}" for i, w in enumerate(terms))
    score = " + ".join(
        f"greatest(1e-6, ln((n - d{i} + 0.5) / (d{i} + 0.5))) * len([x for x in t if x = '{w}']) * 2.2 / (len([x for x in t if x = '{w}']) + 1.2 * (1 - 0.75 + 0.75 * len(t) / mean))" for i, w in enumerate(terms)
    )
    some = " OR ".join(f"list_contains(t, '{w}')" for w in terms)
    return f"""{name}_t AS (SELECT record_id, {tok} AS t FROM obs), {name}_s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(len(t)) / CAST(count(*) AS DOUBLE) AS mean, {stats} FROM {name}_t),
 {name} AS (SELECT record_id, {score} AS bm25 FROM {name}_t, {name}_s WHERE ({some}) AND record_id IN (SELECT record_id FROM pool))"""


def ranks_sql(name: str, source: str, score: str) -> str:
    return f"{name} AS (SELECT record_id, row_number() OVER (ORDER BY {score} DESC, record_id) AS r FROM {source})"


BOTH = f"{bm25_sql('bs', 'static_text')}, {bm25_sql('bd', 'dynamic_text')}, {ranks_sql('rs', 'bs', 'bm25')}, {ranks_sql('rd', 'bd', 'bm25')}"
FUSED = "coalesce(1.0 / (rs.r + 60), 0) + coalesce(1.0 / (rd.r + 60), 0)"
JOINED = "FROM pool p LEFT JOIN rs USING (record_id) LEFT JOIN rd USING (record_id)"
HIT = "(rs.r IS NOT NULL OR rd.r IS NOT NULL)"

#: The query vector of the vector channel: fixed, with no zero.
VECTOR = [((i * 37) % 64 - 31.5) / 32 for i in range(64)]
VECTOR_SQL = "[" + ", ".join(f"CAST({v} AS DOUBLE)" for v in VECTOR) + "]"
COSINE = f"list_dot_product(v, {VECTOR_SQL}) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product({VECTOR_SQL}, {VECTOR_SQL})))"
VECTORS = f"vec AS (SELECT printf('doc_%08d', vec_id) AS record_id, CASE WHEN label % 2 = 0 THEN 'static' ELSE 'dynamic' END AS vector_type, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), sim AS (SELECT record_id, vector_type, {COSINE} AS s FROM vec)"


def _obs(spark, sf):
    return views.observations(spark, sf)


def _pool(spark, sf):
    return search.candidate_pool(_obs(spark, sf), SCOPE)


def _request(**k):
    return search.Request(query=QUERY, top_k=k.pop("top_k", 20), **k)


_KEPT: dict[tuple[str, str], text_store.TextStore] = {}


def kept_index(spark, sf) -> text_store.TextStore:
    """The text index of a folder's observations: built once for an application, as the ingestion would, then read by its searches."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _KEPT:
        _KEPT[key] = text_store.create(views.texts(spark, sf), f"{places.shared_dir(spark)}/text-{uuid.uuid4().hex}", ("static_text", "dynamic_text"))
    return _KEPT[key]


def _search(spark, sf, **k):
    return search.search(_obs(spark, sf), SCOPE, _request(**k), index=kept_index(spark, sf))


def _round(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _policies(spark, sf):
    """Policies from regions: who is allowed and denied follows the key."""
    lists = lambda k, v: F.when(F.col("r_regionkey").isin(*k), F.array(F.lit(v))).otherwise(F.array().cast("array<string>"))
    return views.table(spark, sf, "region").select(
        F.concat(F.lit("pol_"), F.col("r_regionkey").cast("string")).alias("policy_id"),
        F.element_at(F.array(*map(F.lit, ("public", "internal", "confidential", "restricted", "public"))), F.col("r_regionkey") + 1).alias("security_level"),
        lists((0, 3), "guard").alias("allowed_roles"),
        lists((1,), "night").alias("allowed_groups"),
        lists((2, 3), "ann").alias("allowed_principals"),
        lists((3,), "ann").alias("denied_principals"),
    )


POLICIES_SQL = """pol AS (SELECT 'pol_' || CAST(r_regionkey AS VARCHAR) AS policy_id, ['public', 'internal', 'confidential', 'restricted', 'public'][r_regionkey + 1] AS security_level, [0, 1, 2, 3, 0][r_regionkey + 1] AS lvl,
 CASE WHEN r_regionkey = 3 THEN false ELSE r_regionkey IN (2) OR r_regionkey IN (0) OR r_regionkey IN (1) END AS permitted FROM region)"""


def _locations(spark, sf):
    return views.table(spark, sf, "nation").select(F.concat(F.lit("loc_"), F.col("n_nationkey").cast("string")).alias("location_id"), F.concat(F.lit("pol_"), F.col("n_regionkey").cast("string")).alias("policy_id"))


def _cameras(spark, sf):
    k = F.col("s_suppkey")
    return views.table(spark, sf, "supplier").select(
        F.concat(F.lit("cam_"), k.cast("string")).alias("camera_id"), F.concat(F.lit("loc_"), F.col("s_nationkey").cast("string")).alias("location_id"), F.when(k % 3 == 0, F.concat(F.lit("pol_"), (k % 5).cast("string"))).otherwise("").alias("policy_id")
    )


CAMERAS_SQL = "cam AS (SELECT 'cam_' || CAST(s_suppkey AS VARCHAR) AS camera_id, 'loc_' || CAST(s_nationkey AS VARCHAR) AS location_id, CASE WHEN s_suppkey % 3 = 0 THEN 'pol_' || CAST(s_suppkey % 5 AS VARCHAR) ELSE '' END AS policy_id FROM supplier), loc AS (SELECT 'loc_' || CAST(n_nationkey AS VARCHAR) AS location_id, 'pol_' || CAST(n_regionkey AS VARCHAR) AS policy_id FROM nation)"


def _scope_resolution(spark, sf):
    out = scope.resolve_scope(_policies(spark, sf), _locations(spark, sf), _cameras(spark, sf), "ann", ["guard"], ["night"])
    return out.select(F.array_join("policies", ",").alias("policies"), F.array_join("locations", ",").alias("locations"), F.array_join("cameras", ",").alias("cameras"), "max_level")


def _video_policy(spark, sf):
    videos = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("video_id"), F.concat(F.lit("cam_"), (F.col("c_custkey") % 120).cast("string")).alias("camera_id"), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("pol_"), (F.col("c_custkey") % 5).cast("string"))).otherwise("").alias("policy_id"))
    return scope.inherited(videos, _cameras(spark, sf), _locations(spark, sf), "pol_default").select("video_id", "effective_policy")


def _overlap(spark, sf, pad):
    return search.overlapping(_obs(spark, sf), SCOPE, "doc_00000063", pad, 50).select("record_id", "segment_start_ms", "segment_end_ms")


def _overlap_sql(pad):
    return f"WITH {SCOPED}, t AS (SELECT * FROM scoped WHERE record_id = 'doc_00000063') SELECT c.record_id, c.segment_start_ms, c.segment_end_ms FROM scoped c, t WHERE c.video_id = t.video_id AND c.record_id <> t.record_id AND c.segment_start_ms < t.segment_end_ms + {pad} AND c.segment_end_ms > t.segment_start_ms - {pad} ORDER BY 2, 1 LIMIT 50"


def _cosine_topk(spark, sf):
    pool = _pool(spark, sf)
    scored = search.vector_scores(pool, views.vectors(spark, sf), VECTOR).filter("similarity IS NOT NULL")
    return _round(search.ranked(scored, "similarity", "rank").filter("rank <= 20").select("record_id", "rank", "similarity"), "similarity")


def _refine_scale(spark, sf):
    pool = search.filter_by_scale(_pool(spark, sf), ["high_freq_event"])
    return search.results(search.rank(pool, _request(), _obs(spark, sf)), 20)


def _head_tail(spark, sf):
    base = search.rank(_pool(spark, sf), _request(text="keyword"), _obs(spark, sf))
    return search.rerank_head(base, "the of " + QUERY, 15).filter("final_rank <= 25").select("record_id", "rank", "final_rank", "rerank_score")


KEYWORD_BOTH = f"""ks AS (SELECT record_id, {keyword_sql('static_text')} AS s FROM pool), kd AS (SELECT record_id, {keyword_sql('dynamic_text')} AS s FROM pool),
 rs AS (SELECT record_id, row_number() OVER (ORDER BY s DESC, record_id) AS r FROM ks WHERE s > 0), rd AS (SELECT record_id, row_number() OVER (ORDER BY s DESC, record_id) AS r FROM kd WHERE s > 0)"""


def _final_sql(ctes: str, score: str, joined: str, hit: str, k: int = 20) -> str:
    return f"WITH {POOL}, {ctes}, f AS (SELECT record_id, static_text, {score} AS s {joined} WHERE {hit}) SELECT rank, record_id, round(s, 6) AS score, substr(static_text, 1, 200) AS preview FROM (SELECT *, row_number() OVER (ORDER BY s DESC, record_id) AS rank FROM f) WHERE rank <= {k}"


QUERIES = {
    "scope_filter_count": lambda s, d: scope.authorized(_obs(s, d), SCOPE).agg(F.count("*").alias("n")),
    "empty_scope_denies": lambda s, d: scope.authorized(_obs(s, d), scope.Scope("tenant_default", (), ("en",), ("pol_a",), "restricted")).agg(F.count("*").alias("n")),
    "video_scope": lambda s, d: scope.authorized_videos(_obs(s, d), SCOPE).groupBy("video_id").agg(F.count("*").alias("n")),
    "lookup_by_ids": lambda s, d: search.by_ids(_obs(s, d), ["doc_00000003", "doc_00000012", "doc_00000077", "doc_99999999"], SCOPE).select("record_id", "camera_id", "security_level"),
    "list_by_video": lambda s, d: search.of_video(_obs(s, d), SCOPE, "vid_7").select("record_id", "segment_start_ms"),
    "candidate_pool_topn": lambda s, d: search.candidate_pool(_obs(s, d), SCOPE, FILTERS, 200).select("record_id", "observed_start", "camera_id"),
    "keyword_candidates": lambda s, d: scope.authorized(_obs(s, d), SCOPE).filter((keyword_score("static_text", ["onre"]) + keyword_score("dynamic_text", ["onre"])) > 0).orderBy("observed_start", "record_id").limit(100).select("record_id"),
    "keyword_rank": lambda s, d: search.results(search.rank(_pool(s, d), _request(mode="static_attribute", text="keyword")), 20),
    "dynamic_search": lambda s, d: _search(s, d, mode="dynamic_event"),
    "static_search": lambda s, d: _search(s, d, mode="static_attribute"),
    "hybrid_search": lambda s, d: _search(s, d),
    "no_query_rank": lambda s, d: search.search(_obs(s, d), SCOPE, search.Request(top_k=30)),
    "bm25_rank": lambda s, d: _round(search.bm25(_obs(s, d), "static_text", QUERY).filter("bm25 IS NOT NULL").select("record_id", "bm25"), "bm25"),
    "vector_cosine_topk": _cosine_topk,
    "vector_hybrid_rrf": lambda s, d: search.search(_obs(s, d), SCOPE, _request(), views.vectors(s, d), VECTOR, kept_index(s, d)),
    "tag_scale_boost_rank": lambda s, d: _search(s, d, tags=("SRC3", "long", "long"), preferred_scales=("high_freq_event",)),
    "narrow_by_tags": lambda s, d: search.results(search.rank(search.narrow_by_tags(_pool(s, d), ["en", "medium"]), search.Request()), 40),
    "filter_by_scale": _refine_scale,
    "cross_encoder_head_tail": _head_tail,
    "facets_tags": lambda s, d: search.facet_tags(_pool(s, d)),
    "facets_camera": lambda s, d: search.facet(_pool(s, d), "camera_id"),
    "facets_location": lambda s, d: search.facet(_pool(s, d), "location_id"),
    "facets_scale": lambda s, d: search.facet(_pool(s, d), "analysis_scale"),
    "facets_hour": lambda s, d: search.facet_hours(_pool(s, d)),
    "overlap_join": lambda s, d: _overlap(s, d, 0),
    "overlap_padded": lambda s, d: _overlap(s, d, 30000),
    "overlap_pairs": lambda s, d: search.overlap_pairs(_obs(s, d), 60000),
    "policy_permit": lambda s, d: _policies(s, d).select("policy_id", scope.permits_principal("ann", ["guard"], ["night"]).alias("permitted")),
    "scope_resolution": _scope_resolution,
    "policy_inheritance": _video_policy,
    "stricter_level": lambda s, d: _obs(s, d).select("record_id", scope.stricter(level_rank("security_level"), F.when(F.col("access_policy_id") == "pol_a", 1)).alias("effective_level")),
    "validate_vectors": lambda s, d: views.vectors(s, d).select("doc_id", F.coalesce(vector_fault(F.when(F.col("doc_id") % 7 == 0, F.slice("embedding", 1, 32)).when(F.col("doc_id") % 11 != 0, F.col("embedding")), 64), F.lit("ok")).alias("fault")),
    "reindex_pending": lambda s, d: _obs(s, d).select("record_id").join(views.vectors(s, d).filter("vector_type = 'static'").select("record_id"), "record_id", "left_anti"),
    "golden_queries": lambda s, d: evaluate.golden(_obs(s, d), ["onre", "mit", "src3", "whou"]),
}

ORACLE_SQL = {
    "scope_filter_count": f"WITH {SCOPED} SELECT count(*) AS n FROM scoped",
    "empty_scope_denies": "SELECT CAST(0 AS BIGINT) AS n",
    "video_scope": f"WITH {views.OBSERVATIONS_SQL} SELECT video_id, count(*) AS n FROM obs WHERE camera_id IN ({_IN(CAMERAS)}) AND access_policy_id IN ('pol_a', 'pol_b') GROUP BY video_id",
    "lookup_by_ids": f"WITH {SCOPED} SELECT record_id, camera_id, security_level FROM scoped WHERE record_id IN ('doc_00000003', 'doc_00000012', 'doc_00000077', 'doc_99999999')",
    "list_by_video": f"WITH {SCOPED} SELECT record_id, segment_start_ms FROM scoped WHERE video_id = 'vid_7' ORDER BY 2, 1 LIMIT 50",
    "candidate_pool_topn": f"WITH {SCOPED} SELECT record_id, observed_start, camera_id FROM scoped WHERE observed_end >= TIMESTAMP '2024-01-01 00:00:10' AND observed_start <= TIMESTAMP '2024-01-01 04:00:00' AND len([t for t in tags if contains(lower(t), 'src1')]) > 0 ORDER BY observed_start, record_id LIMIT 200",
    "keyword_candidates": f"WITH {SCOPED} SELECT record_id FROM scoped WHERE contains(lower(static_text), 'onre') OR contains(lower(dynamic_text), 'onre') ORDER BY observed_start, record_id LIMIT 100",
    "keyword_rank": f"WITH {POOL}, f AS (SELECT record_id, static_text, row_number() OVER (ORDER BY {keyword_sql('static_text')} DESC, record_id) AS rank FROM pool WHERE {keyword_sql('static_text')} > 0) SELECT rank, record_id, round(1.0 / (rank + 60), 6) AS score, substr(static_text, 1, 200) AS preview FROM f WHERE rank <= 20",
    "static_search": f"WITH {POOL}, {bm25_sql('bs', 'static_text')}, {ranks_sql('rs', 'bs', 'bm25')} SELECT r AS rank, record_id, round(1.0 / (r + 60), 6) AS score, substr(static_text, 1, 200) AS preview FROM rs JOIN pool USING (record_id) WHERE r <= 20",
    "dynamic_search": f"WITH {POOL}, {bm25_sql('bd', 'dynamic_text')}, {ranks_sql('rd', 'bd', 'bm25')} SELECT r AS rank, record_id, round(1.0 / (r + 60), 6) AS score, substr(static_text, 1, 200) AS preview FROM rd JOIN pool USING (record_id) WHERE r <= 20",
    "hybrid_search": _final_sql(BOTH, FUSED, JOINED, HIT),
    "no_query_rank": f"WITH {POOL} SELECT rank, record_id, round(1.0 / (rank + 60), 6) AS score, substr(static_text, 1, 200) AS preview FROM (SELECT *, row_number() OVER (ORDER BY observed_start, record_id) AS rank FROM pool) WHERE rank <= 30",
    "bm25_rank": f"WITH {views.OBSERVATIONS_SQL}, pool AS (SELECT * FROM obs), {bm25_sql('bs', 'static_text')} SELECT record_id, round(bm25, 6) AS bm25 FROM bs",
    "vector_cosine_topk": f"WITH {POOL}, {VECTORS}, m AS (SELECT record_id, max(s) AS s FROM sim WHERE s > 0 AND record_id IN (SELECT record_id FROM pool) GROUP BY 1) SELECT record_id, rank, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (ORDER BY s DESC, record_id) AS rank FROM m) WHERE rank <= 20",
    "vector_hybrid_rrf": _final_sql(
        f"{BOTH}, {VECTORS}, m AS (SELECT record_id, max(s) AS s FROM sim WHERE s > 0 AND record_id IN (SELECT record_id FROM pool) GROUP BY 1), {ranks_sql('rv', 'm', 's')}",
        f"{FUSED} + coalesce(1.0 / (rv.r + 60), 0)", f"{JOINED} LEFT JOIN rv USING (record_id)", "(rs.r IS NOT NULL OR rd.r IS NOT NULL OR rv.r IS NOT NULL)",
    ),
    "tag_scale_boost_rank": _final_sql(BOTH, f"{FUSED} + least(0.2, (CAST(list_contains([lower(t) for t in tags], 'src3') AS INT) + CAST(list_contains([lower(t) for t in tags], 'long') AS INT) * 2) * 0.05) + CASE WHEN analysis_scale = 'high_freq_event' THEN 0.1 ELSE 0.0 END", JOINED, HIT),
    "narrow_by_tags": f"WITH {POOL} SELECT rank, record_id, round(1.0 / (rank + 60), 6) AS score, substr(static_text, 1, 200) AS preview FROM (SELECT *, row_number() OVER (ORDER BY observed_start, record_id) AS rank FROM pool WHERE list_contains(tags, 'en') AND list_contains(tags, 'medium')) WHERE rank <= 40",
    "filter_by_scale": _final_sql(BOTH, FUSED, JOINED, HIT).replace("pool AS (SELECT * FROM scoped ORDER BY observed_start, record_id LIMIT 1000)", "pool AS (SELECT * FROM (SELECT * FROM scoped ORDER BY observed_start, record_id LIMIT 1000) WHERE analysis_scale = 'high_freq_event')"),
    "cross_encoder_head_tail": f"""WITH {POOL}, {KEYWORD_BOTH}, f AS (SELECT record_id, static_text, {FUSED} AS s {JOINED} WHERE {HIT}), g AS (SELECT *, row_number() OVER (ORDER BY s DESC, record_id) AS rank FROM f),
 h AS (SELECT *, CASE WHEN rank <= 15 THEN round(len(list_intersect(['the', 'of', 'onre', 'mit', 'edre'], regexp_split_to_array(lower(static_text), '\\s+'))) / 5.0, 6) END AS rerank_score FROM g)
 SELECT record_id, rank, final_rank, rerank_score FROM (SELECT *, row_number() OVER (ORDER BY CAST(rank > 15 AS INT), rerank_score DESC NULLS LAST, CASE WHEN rank > 15 THEN rank END, record_id) AS final_rank FROM h) WHERE final_rank <= 25""",
    "facets_tags": f"WITH {POOL}, t AS (SELECT record_id, unnest([1, 2, 3]) AS pos, unnest(tags) AS tag FROM pool), c AS (SELECT tag, count(*) AS n, min(record_id || CAST(pos AS VARCHAR)) AS first FROM t GROUP BY tag) SELECT tag, n FROM c ORDER BY n DESC, first LIMIT 10",
    "facets_camera": f"WITH {POOL} SELECT camera_id AS value, count(*) AS n FROM pool GROUP BY 1",
    "facets_location": f"WITH {POOL} SELECT location_id AS value, count(*) AS n FROM pool GROUP BY 1",
    "facets_scale": f"WITH {POOL} SELECT analysis_scale AS value, count(*) AS n FROM pool GROUP BY 1",
    "facets_hour": f"WITH {POOL} SELECT CAST(date_trunc('hour', observed_start) AS TIMESTAMP) AS bucket_start, count(*) AS n FROM pool GROUP BY 1",
    "overlap_join": _overlap_sql(0),
    "overlap_padded": _overlap_sql(30000),
    "overlap_pairs": f"WITH {views.OBSERVATIONS_SQL} SELECT a.video_id, a.record_id AS a, b.record_id AS b FROM obs a JOIN obs b ON a.video_id = b.video_id AND a.record_id < b.record_id AND a.segment_start_ms < b.segment_end_ms AND a.segment_end_ms > b.segment_start_ms",
    "policy_permit": f"WITH {POLICIES_SQL} SELECT policy_id, permitted FROM pol",
    "scope_resolution": f"""WITH {POLICIES_SQL}, {CAMERAS_SQL}, mine AS (SELECT * FROM pol WHERE permitted), wh AS (SELECT location_id FROM loc WHERE policy_id IN (SELECT policy_id FROM mine)), re AS (SELECT camera_id FROM cam WHERE policy_id IN (SELECT policy_id FROM mine) OR location_id IN (SELECT location_id FROM wh))
 SELECT (SELECT string_agg(policy_id, ',' ORDER BY policy_id) FROM mine) AS policies, (SELECT string_agg(location_id, ',' ORDER BY location_id) FROM wh) AS locations, (SELECT string_agg(camera_id, ',' ORDER BY camera_id) FROM re) AS cameras, (SELECT coalesce(max(lvl), 0) FROM mine) AS max_level""",
    "policy_inheritance": f"""WITH {CAMERAS_SQL}, v AS (SELECT c_custkey AS video_id, 'cam_' || CAST(c_custkey % 120 AS VARCHAR) AS camera_id, CASE WHEN c_custkey % 4 = 0 THEN 'pol_' || CAST(c_custkey % 5 AS VARCHAR) ELSE '' END AS policy_id FROM customer)
 SELECT v.video_id, coalesce(nullif(v.policy_id, ''), nullif(cam.policy_id, ''), nullif(loc.policy_id, ''), 'pol_default') AS effective_policy FROM v LEFT JOIN cam ON v.camera_id = cam.camera_id LEFT JOIN loc ON cam.location_id = loc.location_id""",
    "stricter_level": f"WITH {views.OBSERVATIONS_SQL} SELECT record_id, greatest(CASE security_level WHEN 'public' THEN 0 WHEN 'internal' THEN 1 WHEN 'confidential' THEN 2 ELSE 3 END, CASE WHEN access_policy_id = 'pol_a' THEN 1 ELSE 0 END) AS effective_level FROM obs",
    "validate_vectors": "SELECT vec_id AS doc_id, CASE WHEN vec_id % 7 = 0 THEN 'dimension' WHEN vec_id % 11 = 0 THEN 'missing' WHEN len(embedding) <> 64 THEN 'dimension' ELSE 'ok' END AS fault FROM embeddings",
    "reindex_pending": f"WITH {views.OBSERVATIONS_SQL} SELECT record_id FROM obs WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label % 2 = 0)",
    "golden_queries": f"WITH {views.OBSERVATIONS_SQL}, t AS (SELECT unnest(['onre', 'mit', 'src3', 'whou']) AS term) SELECT term AS query_id, record_id FROM t JOIN obs ON list_contains([lower(x) for x in tags], term) OR contains(lower(static_text), term)",
}
