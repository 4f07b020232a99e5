"""Publications of records, all or nothing: records, history, text index, the job's summary and an audit row become visible together."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obspark.operators import pipeline
from obspark.operators.text_store import TextStore

HISTORY = "old_record_id string, replaced_by_record_id string, archived_by string, record_snapshot string"
SUMMARY = "job_id string, created array<string>, updated array<string>, archived array<string>"
AUDIT = "event_type string, principal_id string, publication_id string, job_id string, created long, updated long, archived long"
_MANIFEST = "n long, publication_id string, part string, index_delta string, created long, updated long, archived long"


@dataclass(frozen=True)
class Published:
    created: int
    updated: int
    archived: int


class Publications:
    """Published records at a path, in parts, of which a manifest row makes each visible.

    A record of a natural key that exists is archived with a snapshot and replaced, also one of the same publication (record ids
    are new ones). The part, and the
    delta of the text index, are written before the manifest row; a publication that breaks off before it
    leaves nothing that is read, one that breaks off behind it is completed by the next (``recover``). A publication whose id
    is known does nothing again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Sequence[str], index: TextStore | None = None):
        self.spark, self.path, self.schema, self.key, self.index = spark, path.rstrip("/"), schema, list(key), index

    def manifest(self) -> list:
        """One row for each publication, the oldest first."""
        try:
            return self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifest").orderBy("n").collect()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []

    def _read(self, kind: str, schema: str) -> DataFrame:
        read = [self.spark.read.schema(schema).parquet(f"{self.path}/{r['part']}/{kind}").withColumn("_at", F.lit(r["n"])) for r in self.manifest()]
        return functools.reduce(DataFrame.unionByName, read) if read else self.spark.createDataFrame([], f"{schema}, _at long")

    def active(self) -> DataFrame:
        """The last published record of each natural key."""
        rest = [c for c in self.spark.createDataFrame([], self.schema).columns if c not in self.key]
        last = self._read("records", self.schema).groupBy(*self.key).agg(F.max_by(F.struct(*rest), "_at").alias("_r"))
        return last.select(*self.key, *[f"_r.{c}" for c in rest])

    def history(self) -> DataFrame:
        return self._read("history", HISTORY).drop("_at")

    def audit(self) -> DataFrame:
        return self._read("audit", AUDIT).drop("_at")

    def summaries(self) -> DataFrame:
        """What each job has published: ids that were created, updated and archived, in the order of its publications."""
        kinds = ("created", "updated", "archived")
        listed = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(k).alias("ids")))), lambda x: x["ids"])).alias(k) for k in kinds]
        return self._read("summary", SUMMARY).groupBy("job_id").agg(*listed)

    def prepare(self, publication_id: str, job_id: str, principal: str, new: DataFrame) -> tuple[str, str | None, Published]:
        """Writes the part and the index delta of a publication of ``new`` (the schema's columns and seq); nothing reads them yet."""
        part = f"part-{uuid.uuid4().hex}"
        at, active = f"{self.path}/{part}", self.active()
        now, history = pipeline.publish(active, new, self.key, publication_id)
        changed = now.join(new.select(*self.key).distinct(), self.key, "left_semi")
        changed.write.parquet(f"{at}/records")
        history.write.parquet(f"{at}/history")
        written = self.spark.read.schema(self.schema).parquet(f"{at}/records")
        gone = self.spark.read.schema(HISTORY).parquet(f"{at}/history").select(F.col("old_record_id").alias("record_id"))
        later = self.spark.read.schema(HISTORY).parquet(f"{at}/history").select(F.col("replaced_by_record_id").alias("record_id"), F.lit("updated").alias("kind"))
        told = new.select("record_id").join(later, "record_id", "left").select("record_id", F.coalesce("kind", F.lit("created")).alias("kind")).unionByName(gone.withColumn("kind", F.lit("archived")))
        ids = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("record_id")))).alias(k)
        told.agg(ids("created"), ids("updated"), ids("archived")).select(F.lit(job_id).alias("job_id"), "*").write.parquet(f"{at}/summary")
        n = self.spark.read.schema(SUMMARY).parquet(f"{at}/summary").select(*[F.size(k) for k in ("created", "updated", "archived")]).first()
        result = Published(*n)
        self.spark.createDataFrame([("publication", principal, publication_id, job_id, *n)], AUDIT).coalesce(1).write.parquet(f"{at}/audit")
        delta = None
        if self.index is not None:
            out = gone.join(written.select("record_id"), "record_id", "left_anti")
            delta = self.index._write(written, out, self.index.deltas()[1])
        return part, delta, result

    def commit(self, publication_id: str, part: str, delta: str | None, result: Published) -> None:
        """Makes a publication visible, then its index delta."""
        n = len(self.manifest())
        row = self.spark.createDataFrame([(n, publication_id, part, delta, result.created, result.updated, result.archived)], _MANIFEST).coalesce(1)
        row.write.mode("errorifexists").json(f"{self.path}/manifest/p={n}")
        self.recover()

    def recover(self) -> None:
        """Gives the index the delta of the last publication, if it hasn't got it yet."""
        rows = self.manifest()
        if self.index is None or not rows or rows[-1]["index_delta"] is None:
            return
        v, deltas = self.index.deltas()
        if rows[-1]["index_delta"] not in deltas:
            self.index._commit(v + 1, [*deltas, rows[-1]["index_delta"]])

    def publish(self, publication_id: str, job_id: str, principal: str, new: DataFrame) -> Published:
        """Publishes records and tells how many were created, updated and archived."""
        self.recover()
        for r in self.manifest():
            if r["publication_id"] == publication_id:
                return Published(r["created"], r["updated"], r["archived"])
        part, delta, result = self.prepare(publication_id, job_id, principal, new)
        self.commit(publication_id, part, delta, result)
        return result
