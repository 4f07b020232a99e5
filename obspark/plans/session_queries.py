"""Queries of kept sessions, revisions, model answers and reindexing, each with the SQL of the same rows."""

from __future__ import annotations

import datetime
import functools
import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window

from obspark.operators import publication, reindex, search, sessions, validation
from obspark.operators.scope import Scope
from obspark.plans.lifecycle_queries import STARTED
from obspark.plans.search_queries import QUERY, SCOPE, SCOPED, kept_index
from obspark.sources import places, views

NOW = datetime.datetime(2024, 2, 1)


def _new(spark, kind):
    return f"{places.shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def _session(s, d):
    """A session: a search, two refinements of it and one of a refinement; each revision with its chain."""
    obs, request = views.observations(s, d), search.Request(query=QUERY, top_k=20, tags=("SRC3",), preferred_scales=("high_freq_event",))
    kept = sessions.Sessions(s, _new(s, "sessions"))
    index = kept_index(s, d)
    first = kept.start(obs, SCOPE, request, NOW, index=index)
    second = kept.refine(first["context_id"], first["revision_id"], "filter_by_analysis_scale", search.Request(query=QUERY, preferred_scales=("default_segment",), top_k=50), obs, SCOPE, NOW, index=index)
    kept.refine_batch(first["context_id"], [(second["revision_id"], "narrow_by_tags", search.Request(tags=("en",), top_k=50)), (first["revision_id"], "rerank_current_candidates", search.Request(query=QUERY, top_k=3))], obs, SCOPE, NOW, index=index)
    told = sessions.lineage(kept.revisions()).join(kept.revisions().select("revision_id", "candidate_count", "op_params"), "revision_id")
    default = kept.contexts().select("context_id", F.col("default_revision_id").alias("revision_id"), F.lit(True).alias("is_default"))
    return told.join(default, ["context_id", "revision_id"], "left").select("depth", "path", "candidate_count", F.coalesce("is_default", F.lit(False)).alias("is_default"))


SESSION_SQL = f"""WITH {STARTED} SELECT 0 AS depth, 'start' AS path, count(*) AS candidate_count, false AS is_default FROM cand
 UNION ALL SELECT 1, 'start/filter_by_analysis_scale', count(*), false FROM cand WHERE analysis_scale = 'default_segment'
 UNION ALL SELECT 2, 'start/filter_by_analysis_scale/narrow_by_tags', count(*), false FROM cand WHERE analysis_scale = 'default_segment' AND list_contains(tags, 'en')
 UNION ALL SELECT 1, 'start/rerank_current_candidates', least(3, count(*)), true FROM cand"""


def _lineage(s, d):
    """Revisions of many contexts: a customer is a context, its orders are revisions, each made of the one at half its place."""
    o = views.table(s, d, "orders")
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    own = o.select(F.col("o_custkey").cast("string").alias("context_id"), F.col("o_orderkey").cast("string").alias("revision_id"), F.lower(F.substring("o_orderpriority", 1, 1)).alias("op"), k.alias("k"))
    above = own.select("context_id", F.col("revision_id").alias("parent_revision_id"), F.col("k").alias("up"))
    return sessions.lineage(own.withColumn("up", F.floor(F.col("k") / 2)).join(above, ["context_id", "up"], "left"))


LINEAGE_SQL = """WITH RECURSIVE o AS (SELECT CAST(o_custkey AS VARCHAR) AS c, CAST(o_orderkey AS VARCHAR) AS r, lower(substr(o_orderpriority, 1, 1)) AS op, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
 p AS (SELECT a.*, b.r AS up FROM o a LEFT JOIN o b ON b.c = a.c AND b.k = a.k // 2),
 chain AS (SELECT r, c, r AS root, 0 AS depth, op AS path FROM p WHERE up IS NULL UNION ALL SELECT p.r, p.c, chain.root, chain.depth + 1, chain.path || '/' || p.op FROM p JOIN chain ON p.up = chain.r WHERE chain.depth < 7)
 SELECT r AS revision_id, c AS context_id, root AS root_revision_id, depth, path FROM chain"""


def _answers(s, d):
    """Answers of a model: whole ones, fenced ones, ones with prose or forbidden keys, wrong values, missing and unknown fields, broken ones, no objects."""
    k = F.col("p_partkey") % 9
    fields = {"static": F.col("p_name"), "dynamic": F.col("p_type")}
    made = lambda **more: F.to_json(F.struct(*[v.alias(n) for n, v in (fields | more).items()]))
    score = lambda x: F.struct(F.lit(x).alias("score"))
    fine = made(tags=F.array("p_brand"), quality=score(0.5))
    answer = (
        F.when(k == 0, fine).when(k == 1, F.concat(F.lit("```json\n"), fine, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Sure: "), fine, F.lit(" That is all.")))
        .when(k == 3, made(record_id=F.col("p_brand"))).when(k == 4, made(tags=F.array(F.lit(1), F.col("p_partkey")), quality=score(1.5)))
        .when(k == 5, F.to_json(F.struct(F.col("p_name").alias("static"), F.lit("x").alias("mood"), F.struct(F.lit("maybe").alias("alert")).alias("attr")))).when(k == 6, F.substring(fine, F.lit(1), F.length(fine) - 1)).when(k == 7, F.lit("[1, 2]")).otherwise(F.lit(" "))
    )
    return views.table(s, d, "part").select("p_partkey", answer.alias("answer"))


def _validated(s, d):
    out = validation.attempts(validation.validated(_answers(s, d), "answer"), ["p_partkey"])
    return out.withColumns({c: F.array_join(c, ",") for c in ("repair_actions", "validation_errors")})


_FINE = """'{"static":"' || p_name || '","dynamic":"' || p_type || '","tags":["' || p_brand || '"],"quality":{"score":0.5}}'"""
VALIDATION_SQL = f"""WITH a AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN {_FINE} WHEN 1 THEN '```json' || chr(10) || {_FINE} || chr(10) || '```' WHEN 2 THEN 'Sure: ' || {_FINE} || ' That is all.' WHEN 3 THEN '{{"static":"' || p_name || '","dynamic":"' || p_type || '","record_id":"' || p_brand || '"}}'
  WHEN 4 THEN '{{"static":"' || p_name || '","dynamic":"' || p_type || '","tags":[1,' || p_partkey || '],"quality":{{"score":1.5}}}}' WHEN 5 THEN '{{"static":"' || p_name || '","mood":"x","attr":{{"alert":"maybe"}}}}' WHEN 6 THEN substr({_FINE}, 1, length({_FINE}) - 1) WHEN 7 THEN '[1, 2]' ELSE ' ' END AS raw FROM part),
 f AS (SELECT p_partkey, trim(raw) AS raw, starts_with(trim(raw), '```') AS fenced, CASE WHEN starts_with(trim(raw), '```') THEN trim(regexp_replace(regexp_replace(trim(raw), '^[^\\n]*\\n', ''), '```$', ''), chr(10)) ELSE trim(raw) END AS t FROM a),
 j AS (SELECT *, CASE WHEN regexp_matches(t, '(?s)\\{{.*\\}}') THEN regexp_extract(t, '(?s)\\{{.*\\}}') ELSE t END AS j FROM f),
 v AS (SELECT *, CASE WHEN j <> '' AND json_valid(j) THEN j END AS ok FROM j),
 x AS (SELECT *, json_type(ok) AS kind, concat_ws(',', CASE WHEN fenced THEN 'strip_code_fence_start,strip_code_fence_end' END, CASE WHEN j <> t THEN 'extract_json_object' END, CASE WHEN json_extract(ok, '$.record_id') IS NOT NULL THEN 'strip_forbidden_field:record_id' END) AS actions,
  CASE WHEN json_type(ok) = 'OBJECT' THEN concat_ws(',', CASE WHEN json_extract(ok, '$.static') IS NULL THEN 'static:missing' END, CASE WHEN json_extract(ok, '$.dynamic') IS NULL THEN 'dynamic:missing' END,
   nullif(array_to_string([CAST('tags.' || i AS VARCHAR) || ':string_type' for i in range(0, CAST(coalesce(json_array_length(ok, '$.tags'), 0) AS BIGINT)) if json_type(ok, '$.tags[' || i || ']') <> 'VARCHAR'], ','), ''),
   CASE WHEN CAST(json_extract_string(ok, '$.quality.score') AS DOUBLE) > 1 THEN 'quality.score:less_than_equal' END, CASE WHEN json_extract_string(ok, '$.attr.alert') = 'maybe' THEN 'attr.alert:bool_parsing' END,
   nullif(array_to_string([k || ':extra_forbidden' for k in list_sort(json_keys(ok)) if k NOT IN ('static', 'dynamic', 'tags', 'quality', 'attr', 'record_id')], ','), '')) ELSE '' END AS errors FROM v),
 r AS (SELECT p_partkey, CASE WHEN ok IS NULL THEN 'json_parse_failed' WHEN kind <> 'OBJECT' THEN 'json_shape_failed' WHEN errors <> '' THEN 'schema_validation_failed' WHEN actions <> '' THEN 'repair_succeeded' ELSE 'passed' END AS status, actions, errors FROM x)
 SELECT p_partkey, status, actions <> '' AS repair_attempted, status = 'repair_succeeded' AS repair_succeeded, actions AS repair_actions, errors AS validation_errors FROM r"""

MANAGER = Scope(**{**SCOPE.__dict__, "capabilities": ("runtime.manage",)})


def _measured(texts):
    """A stand-in for a model: length, and how often e occurs."""
    return [[float(len(t)), float(t.count("e"))] for t in texts]


def _reindexed(s, d):
    """Vectors of all permitted records in ranges, by a run that is started twice."""
    table = reindex.VectorTable(s, _new(s, "vectors"))
    for _ in range(2):
        reindex.reindex(table, views.observations(s, d), MANAGER, {"static": "static_text", "dynamic": "dynamic_text"}, _measured, "measure-1", "nightly", range_rows=300_000)
    return table.vectors().select("record_id", "vector_type", F.element_at("embedding", 1).alias("length"), F.element_at("embedding", 2).alias("es"), "model_id")


_MEASURE = "CAST(length({0}) AS DOUBLE) AS length, CAST(length({0}) - length(replace({0}, 'e', '')) AS DOUBLE) AS es, 'measure-1' AS model_id"
REINDEX_SQL = f"""WITH {SCOPED} SELECT record_id, 'static' AS vector_type, {_MEASURE.format("coalesce(static_text, '')")} FROM scoped UNION ALL SELECT record_id, 'dynamic', {_MEASURE.format("coalesce(dynamic_text, '')")} FROM scoped"""

PUBLISHED = "record_id string, video_id string, segment_start_ms long, analysis_scale string, static_text string"


def _published(s, d):
    """Three publications of observations under their natural keys, the last of which repeats the second: what is active, archived, audited and told of the jobs."""
    obs = views.observations(s, d)
    kept = publication.Publications(s, _new(s, "published"), PUBLISHED, ["video_id", "segment_start_ms", "analysis_scale"])
    rows = lambda mark, where: obs.filter(where).select(F.concat("record_id", F.lit(mark)).alias("record_id"), "video_id", "segment_start_ms", "analysis_scale", "static_text", F.col("doc_id").alias("seq"))
    kept.publish("first", "job_a", "ann", rows("", "doc_id % 3 <> 0"))
    for _ in range(2):
        kept.publish("second", "job_b", "ann", rows("_b", "doc_id % 2 = 0"))
    audit = kept.audit().select(F.concat(F.lit("audit "), "publication_id").alias("kind"), "created", "updated", "archived")
    told = kept.summaries().select(F.concat(F.lit("summary "), "job_id").alias("kind"), *[F.size(k).cast("long").alias(k) for k in ("created", "updated", "archived")])
    active = kept.active().select(F.lit("active").alias("kind"), F.endswith("record_id", F.lit("_b")).alias("b")).groupBy("kind").agg(F.count(F.when(~F.col("b"), 1)).alias("created"), F.count(F.when(F.col("b"), 1)).alias("updated"), F.lit(0).cast("long").alias("archived"))
    history = kept.history().groupBy(F.concat(F.lit("history "), "archived_by").alias("kind")).agg(F.lit(0).cast("long").alias("created"), F.lit(0).cast("long").alias("updated"), F.count("*").alias("archived"))
    return functools.reduce(lambda x, y: x.unionByName(y), [audit, told, active, history])


#: Natural keys are unique in the observations but for what one publication repeats: of those each archives the one before it.
PUBLISHED_SQL = f"""WITH {views.OBSERVATIONS_SQL}, o AS (SELECT *, video_id || '/' || segment_start_ms || '/' || analysis_scale AS k FROM obs),
 a AS (SELECT k, count(*) AS n FROM o WHERE doc_id % 3 <> 0 GROUP BY k), b AS (SELECT k, count(*) AS n FROM o WHERE doc_id % 2 = 0 GROUP BY k),
 t AS (SELECT (SELECT count(*) FROM a) AS ca, (SELECT sum(n - 1) FROM a) AS ra, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS cb, (SELECT count(*) FROM b WHERE k IN (SELECT k FROM a)) AS ub, (SELECT sum(n - 1) FROM b) AS rb),
 r AS (SELECT 'audit first' AS kind, ca AS created, ra AS updated, ra AS archived FROM t UNION ALL SELECT 'summary job_a', ca, ra, ra FROM t UNION ALL SELECT 'audit second', cb, ub + rb, ub + rb FROM t UNION ALL SELECT 'summary job_b', cb, ub + rb, ub + rb FROM t
  UNION ALL SELECT 'active', ca - ub, cb + ub, 0 FROM t UNION ALL SELECT 'history first', 0, 0, ra FROM t WHERE ra > 0 UNION ALL SELECT 'history second', 0, 0, ub + rb FROM t)
 SELECT kind, CAST(created AS BIGINT) AS created, CAST(updated AS BIGINT) AS updated, CAST(archived AS BIGINT) AS archived FROM r"""

QUERIES = {"publish_atomic": _published, "search_session": _session, "revision_lineage": _lineage, "output_validation": _validated, "reindex_ranges": _reindexed}
ORACLE_SQL = {"publish_atomic": PUBLISHED_SQL, "search_session": SESSION_SQL, "revision_lineage": LINEAGE_SQL, "output_validation": VALIDATION_SQL, "reindex_ranges": REINDEX_SQL}
