"""Search sessions that are kept: contexts, immutable revisions with their parents, candidates, audit."""

from __future__ import annotations

import dataclasses
import datetime
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obspark.operators import records, search
from obspark.operators.scope import Scope
from obspark.sources import places

CONTEXTS = "context_id string, principal_id string, scope_hash string, dataset_revision string, default_revision_id string, status string, created_at timestamp_ntz, last_accessed_at timestamp_ntz, expires_at timestamp_ntz, seq long"
REVISIONS = "revision_id string, context_id string, parent_revision_id string, op string, op_params string, candidate_count long, facets string, created_at timestamp_ntz"
CANDIDATES = "revision_id string, record_id string, rank int, score double"
AUDIT = "event_type string, principal_id string, resource_scope_hash string, context_id string, record_ids array<string>, candidates long"


class Refused(Exception):
    """Why a session can't be used: the first argument is the reason."""


@dataclasses.dataclass(frozen=True)
class Limits:
    ttl_seconds: int = 1800
    idle_seconds: int = 600
    revisions: int = records.MOST_REVISIONS
    top_k: int = 100


class Sessions:
    """Sessions at a path, as logs that are only appended to; of a context its last state counts.

    A revision's candidates are written before the revision itself, and the context's pointer to it comes
    last, so what breaks off in between is never seen. Revisions never change: one that exists is a conflict.
    """

    def __init__(self, spark: SparkSession, path: str, dataset_revision: str = "v1", limits: Limits = Limits()):
        self.spark, self.path, self.dataset_revision, self.limits = spark, path.rstrip("/"), dataset_revision, limits

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, name: str, rows: Sequence[tuple], schema: str) -> None:
        self.spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    # contexts

    def contexts(self) -> DataFrame:
        columns = [c.split()[0] for c in CONTEXTS.split(", ")]
        last = self._read("contexts", CONTEXTS).groupBy("context_id").agg(F.max_by(F.struct(*columns[1:]), "seq").alias("s"))
        return last.select("context_id", *[f"s.{c}" for c in columns[1:]])

    def get(self, context_id: str) -> dict | None:
        row = self.contexts().filter(F.col("context_id") == context_id).first()
        return row.asDict() if row else None

    def _put(self, state: dict, **changes) -> dict:
        new = state | changes | {"seq": state.get("seq", -1) + 1}
        self._append("contexts", [tuple(new[c.split()[0]] for c in CONTEXTS.split(", "))], CONTEXTS)
        return new

    def create(self, scope: Scope, now: datetime.datetime) -> dict:
        state = dict.fromkeys(c.split()[0] for c in CONTEXTS.split(", "))
        return self._put(state | {"seq": -1}, context_id=f"ctx_{uuid.uuid4().hex}", principal_id=scope.principal, scope_hash=scope.digest(), dataset_revision=self.dataset_revision, status="active", created_at=now, last_accessed_at=now, expires_at=now + datetime.timedelta(seconds=self.limits.ttl_seconds))

    def close(self, context_id: str) -> None:
        state = self.get(context_id)
        if state is not None:
            self._put(state, status="closed")

    def expire(self, now: datetime.datetime) -> int:
        """Q15: active contexts whose time is up turn expired; how many."""
        up = self.contexts().filter((F.col("status") == "active") & (F.col("expires_at") < F.lit(now).cast("timestamp_ntz")))
        late = up.withColumn("status", F.lit("expired")).withColumn("seq", F.col("seq") + 1).select(*[c.split()[0] for c in CONTEXTS.split(", ")])
        n = late.count()
        if n:
            late.write.mode("append").parquet(f"{self.path}/contexts")
        return n

    def active(self, context_id: str, scope: Scope, now: datetime.datetime) -> dict:
        """Q5: the context, if this principal may go on with it now; a changed scope closes it."""
        state = self.get(context_id)
        if state is None or state["principal_id"] != scope.principal:
            raise Refused("not_found")
        if state["scope_hash"] != scope.digest():
            self.close(context_id)
            raise Refused("scope_changed")
        if state["status"] != "active":
            raise Refused("not_active")
        if now > state["expires_at"] or now > state["last_accessed_at"] + datetime.timedelta(seconds=self.limits.idle_seconds):
            self.expire(now)
            raise Refused("expired" if now > state["expires_at"] else "idle")
        return state

    # revisions

    def revisions(self) -> DataFrame:
        return self._read("revisions", REVISIONS)

    def count(self, context_id: str) -> int:
        return self.revisions().filter(F.col("context_id") == context_id).count()

    def revision(self, revision_id: str) -> dict | None:
        row = self.revisions().filter(F.col("revision_id") == revision_id).first()
        return row.asDict() if row else None

    def candidates(self, revision_id: str) -> DataFrame:
        return self._read(f"candidates/revision_id={revision_id}", CANDIDATES.replace("revision_id string, ", "")).withColumn("revision_id", F.lit(revision_id))

    def audit(self) -> DataFrame:
        return self._read("audit", AUDIT)

    def _keep(self, state: dict, parent: str | None, op: str, params: dict, ordered: DataFrame, df: DataFrame, scope: Scope, now: datetime.datetime, revision_id: str | None = None) -> dict:
        """Writes candidates, then the revision, then the pointer to it, and the audit row."""
        revision_id = revision_id or f"rev_{uuid.uuid4().hex}"
        if self.revision(revision_id) is not None:
            raise Refused("conflict")
        rows = ordered.select("record_id", "rank", F.round("final_score", 6).alias("score"))
        rows.write.mode("overwrite").parquet(f"{self.path}/candidates/revision_id={revision_id}")
        kept = self.candidates(revision_id)
        # top_k bounds what the driver sees
        ids = [r["record_id"] for r in kept.orderBy("rank").collect()]
        facets = sorted((r["facet"], r["value"], r["n"]) for r in search.revision_facets(df, scope, kept).collect())
        self._append("revisions", [(revision_id, state["context_id"], parent, op, json.dumps(params, sort_keys=True), len(ids), json.dumps(facets, ensure_ascii=True), now)], REVISIONS)
        self._put(state, default_revision_id=revision_id, last_accessed_at=now)
        self._append("audit", [("query", scope.principal, scope.digest(), state["context_id"], ids, len(ids))], AUDIT)
        return self.revision(revision_id)

    def start(self, df: DataFrame, scope: Scope, request: search.Request, now: datetime.datetime, **channels) -> dict:
        """Q1: a new context and its first revision, the ``top_k`` results of the search."""
        scope.require("observation.search")
        top = search.checked(request.top_k, self.limits.top_k)
        ordered = search.rank(search.candidate_pool(df, scope, request.filters), request, df, **channels).filter(F.col("rank") <= top)
        return self._keep(self.create(scope, now), None, "start", {"query_text": request.query, "search_mode": request.mode, "top_k": top}, ordered, df, scope, now)

    def refine(self, context_id: str, base_revision_id: str, operation: str, request: search.Request, df: DataFrame, scope: Scope, now: datetime.datetime, **channels) -> dict:
        """Q2: a revision made of what another one of the context holds and the scope still permits; it becomes the default."""
        scope.require("observation.search")
        state = self.active(context_id, scope, now)
        base = self.revision(base_revision_id)
        if base is None or base["context_id"] != context_id:
            raise Refused("not_found")
        kept = self.candidates(base_revision_id)
        # top_k bounds these ids, which reach the scan, so that no join below shuffles other texts
        held = search.by_ids(df, [r["record_id"] for r in kept.select("record_id").collect()], scope)
        ordered = records.refine(held, kept, operation, request, df, **channels)
        top, place = min(request.top_k, self.limits.top_k), "final_rank" if operation == "rerank_current_candidates" else "rank"
        if self.count(context_id) >= self.limits.revisions:
            raise Refused("limit_exceeded")
        ordered = ordered.withColumn("rank", F.col(place)).filter(F.col("rank") <= top)
        params = {"query_text": request.query, "tags": list(request.tags), "analysis_scales": list(request.preferred_scales), "top_k": top}
        return self._keep(state, base_revision_id, operation, params, ordered, df, scope, now)

    def refine_batch(self, context_id: str, steps: Sequence[tuple[str, str, search.Request]], df: DataFrame, scope: Scope, now: datetime.datetime, **channels) -> list[dict]:
        """Q3: several refinements (base revision, operation, request), one after the other, each a revision of its own."""
        return [self.refine(context_id, base, op, request, df, scope, now, **channels) for base, op, request in steps]

    def facets(self, context_id: str, df: DataFrame, scope: Scope, now: datetime.datetime) -> DataFrame:
        """Q4: facets of the default revision, of what the scope permits now."""
        state = self.active(context_id, scope, now)
        return search.revision_facets(df, scope, self.candidates(state["default_revision_id"]))


def lineage(revisions: DataFrame, most: int = records.MOST_REVISIONS) -> DataFrame:
    """K8: each revision (revision_id, context_id, parent_revision_id, op) with the chain that leads to it: root_revision_id, depth, path of operations.

    Chains are at most ``most`` long. Each round joins a piece of a chain with the piece above it, so pieces
    double and rounds are few; they are written to the shared folder. A revision whose parent is missing or belongs
    to another context is reached by none.
    """
    spark, place = revisions.sparkSession, f"{places.shared_dir(revisions.sparkSession)}/lineage-{uuid.uuid4().hex}"
    pieces = revisions.select("revision_id", "context_id", F.col("parent_revision_id").alias("up"), F.col("revision_id").alias("root_revision_id"), F.lit(0).alias("depth"), F.col("op").alias("path"))
    for number in range((most - 1).bit_length()):
        pieces.write.parquet(f"{place}/{number}")
        kept = spark.read.schema(pieces.schema).parquet(f"{place}/{number}")
        above = kept.select("context_id", F.col("revision_id").alias("up"), *[F.col(c).alias(f"_{c}") for c in ("up", "root_revision_id", "depth", "path")])
        longer = kept.filter("up IS NOT NULL").join(above, ["context_id", "up"])
        longer = longer.select("revision_id", "context_id", F.col("_up").alias("up"), F.col("_root_revision_id").alias("root_revision_id"), (F.col("depth") + 1 + F.col("_depth")).alias("depth"), F.concat("_path", F.lit("/"), "path").alias("path"))
        pieces = kept.filter("up IS NULL").unionByName(longer)
    return pieces.filter(F.col("up").isNull() & (F.col("depth") < most)).drop("up")
