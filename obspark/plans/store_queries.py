"""Queries of backups, logs, reports, capability gates and frame features, each with the SQL of the same rows."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obspark.functions import udfs
from obspark.operators import records, scope
from obspark.sources import places, views

SAVED = {"orders": ("o_orderkey", "o_totalprice"), "customer": ("c_custkey", "c_acctbal"), "supplier": ("s_suppkey", "s_acctbal"), "part": ("p_partkey", "p_partkey")}


def _new(spark, kind):
    return f"{places.shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def _restored(s, d):
    """Tables that were backed up and restored, checked against the manifest: rows, least and largest key, total of a column."""
    at = _new(s, "backup")
    records.backup({t: views.table(s, d, t) for t in SAVED}, at)
    each = [df.agg(F.count("*").alias("n"), F.min(SAVED[t][0]).alias("low"), F.max(SAVED[t][0]).alias("high"), F.round(F.sum(SAVED[t][1]).cast("double"), 2).alias("total")).withColumn("table_name", F.lit(t)) for t, df in records.restore(s, at).items()]
    return functools.reduce(DataFrame.unionByName, each)


RESTORED_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n, min({k}) AS low, max({k}) AS high, round(CAST(sum({v}) AS DOUBLE), 2) AS total FROM {t}" for t, (k, v) in SAVED.items())


def _logged(s, d):
    """A log of model calls that grows by two appends; calls and the last start of each scale and status."""
    at, calls = _new(s, "log"), views.model_calls(s, d)
    for odd in (1, 0):
        records.append_log(calls.filter(F.col("attempt_count") % 2 == odd), at)
    return s.read.schema(calls.schema).parquet(at).groupBy("analysis_scale", "status").agg(F.count("*").alias("n"), F.max("started_at").alias("last"))


def _reported(s, d):
    """A report of requests by scale, exported as JSON lines and read again."""
    at = _new(s, "report")
    told = views.model_calls(s, d).groupBy("analysis_scale").agg(F.count("*").alias("requests"), F.round(F.avg("duration_ms"), 3).alias("mean_ms"), F.count_distinct("job_id").alias("jobs"))
    records.export_report(told, at)
    return s.read.schema(told.schema).json(at)


#: What an operation asks for.
OPERATIONS = (("start_search", "observation.search"), ("playback", "video.playback"), ("rerun_analysis", "analysis.rerun"), ("reindex", "runtime.manage"), ("export_audit", "audit.read"), ("unknown", "nothing.like_this"))


def _gated(s, d):
    """Which operations each principal may do, by the capabilities of its type."""
    kind = F.when(F.col("c_custkey") % 10 == 0, "admin").when(F.col("c_custkey") % 10 < 3, "service_account").when(F.col("c_custkey") % 10 < 8, "user").otherwise("visitor")
    asked = F.array(*[F.struct(F.lit(o).alias("operation"), F.lit(c).alias("capability")) for o, c in OPERATIONS])
    each = views.table(s, d, "customer").select(F.col("c_custkey").alias("principal"), kind.alias("kind"), F.inline(asked))
    return each.select("principal", "kind", "operation", scope.may(F.col("kind"), F.col("capability")).alias("permitted"))


_CAN = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
GATED_SQL = f"""WITH p AS (SELECT c_custkey AS principal, CASE WHEN c_custkey % 10 = 0 THEN 'admin' WHEN c_custkey % 10 < 3 THEN 'service_account' WHEN c_custkey % 10 < 8 THEN 'user' ELSE 'visitor' END AS kind FROM customer),
 o AS (SELECT * FROM (VALUES {', '.join(f"('{o}', '{c}')" for o, c in OPERATIONS)}) t(operation, capability)),
 can AS (SELECT *, CASE kind WHEN 'admin' THEN {_CAN(scope.ADMIN_CAPABILITIES)} WHEN 'service_account' THEN {_CAN(scope.USER_CAPABILITIES + scope.SERVICE_CAPABILITIES)} ELSE {_CAN(scope.USER_CAPABILITIES)} END AS caps FROM p)
 SELECT principal, kind, operation, list_contains(caps, capability) AS permitted FROM can, o"""


def _frames(s, d):
    """Brightness, sharpness, change of scene and motion of three gray frames of four by four points for each part."""
    frames = F.array(*[F.unhex(F.md5(F.concat(c, F.col("p_partkey").cast("string")))) for c in ("p_name", "p_type", "p_brand")])
    # the table's few small files are few tasks, and the work is in the rows
    told = views.table(s, d, "part").repartition("p_partkey").select("p_partkey", frames.alias("frames")).select("p_partkey", udfs.frame_features(4)("frames").alias("f"), udfs.frame_motion("frames").alias("m"))
    each = told.select("p_partkey", F.posexplode(F.arrays_zip("f", "m")).alias("frame", "x"))
    return each.select("p_partkey", F.col("frame").cast("long").alias("frame"), *[F.round(F.col(f"x.f.{c}"), 6).alias(c) for c in ("brightness", "sharpness", "scene")], F.round("x.m", 6).alias("motion"))


#: Neighbours of a point of four by four, rows and columns mirrored at the edges.
_BESIDE = lambda i: [4 * (i // 4 - 1 if i // 4 else 1) + i % 4, 4 * (i // 4 + 1 if i // 4 < 3 else 2) + i % 4, 4 * (i // 4) + (i % 4 - 1 if i % 4 else 1), 4 * (i // 4) + (i % 4 + 1 if i % 4 < 3 else 2)]
_LAPLACE = "[" + ", ".join(" + ".join(f"x[{j + 1}]" for j in _BESIDE(i)) + f" - 4 * x[{i + 1}]" for i in range(16)) + "]"
FRAMES_SQL = f"""WITH h AS (SELECT p_partkey, unnest([0, 1, 2]) AS frame, unnest([md5(p_name || p_partkey), md5(p_type || p_partkey), md5(p_brand || p_partkey)]) AS h FROM part),
 b AS (SELECT p_partkey, frame, [CAST(CAST('0x' || h[2 * i + 1:2 * i + 2] AS INT) AS DOUBLE) for i in range(16)] AS x FROM h),
 g AS (SELECT *, [len([v for v in x if floor(v / 8) = k]) / 16.0 - 1 / 32.0 for k in range(32)] AS a, {_LAPLACE} AS l FROM b),
 w AS (SELECT *, lag(a) OVER p AS pa, lag(x) OVER p AS px FROM g WINDOW p AS (PARTITION BY p_partkey ORDER BY frame))
 SELECT p_partkey, CAST(frame AS BIGINT) AS frame, round(list_avg(x), 6) AS brightness, round(list_var_pop(l), 6) AS sharpness,
 CASE WHEN pa IS NULL THEN 0.0 ELSE round(greatest(0.0, 1 - list_dot_product(CAST(a AS DOUBLE[]), CAST(pa AS DOUBLE[])) / sqrt(list_dot_product(CAST(a AS DOUBLE[]), CAST(a AS DOUBLE[])) * list_dot_product(CAST(pa AS DOUBLE[]), CAST(pa AS DOUBLE[])))), 6) END AS scene,
 CASE WHEN px IS NULL THEN 0.0 ELSE round(list_avg([abs(x[i] - px[i]) for i in range(1, 17)]) / 255, 6) END AS motion FROM w"""

QUERIES = {"backup_restore": _restored, "appended_log": _logged, "exported_report": _reported, "capability_gate": _gated, "frame_features": _frames}
ORACLE_SQL = {
    "backup_restore": RESTORED_SQL,
    "appended_log": f"WITH {views.CALLS_SQL} SELECT analysis_scale, status, count(*) AS n, max(started_at) AS last FROM calls GROUP BY 1, 2",
    "exported_report": f"WITH {views.CALLS_SQL} SELECT analysis_scale, count(*) AS requests, round(avg(duration_ms), 3) AS mean_ms, count(DISTINCT job_id) AS jobs FROM calls GROUP BY 1",
    "capability_gate": GATED_SQL,
    "frame_features": FRAMES_SQL,
}
