"""Q14, K3: vectors of all records, made range by range with a progress log, so that a run that breaks off goes on behind its last committed range."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obspark.operators.scope import Scope, authorized

#: Texts that the embedder gets at once, and rows of a range.
BATCH, RANGE = 64, 100_000
VECTORS = "record_id string, vector_type string, embedding array<double>, model_id string"
PROGRESS = "run string, range int, part string, scanned long, reindexed long, skipped long, written long"
_PLAN = "run string, range int, low string"


@dataclass(frozen=True)
class Result:
    scanned: int
    reindexed: int
    skipped: int
    vectors_written: int


class VectorTable:
    """Vectors at a path: parts that the progress log names; of several vectors of a record and channel the last part's counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).json(f"{self.path}/{name}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def progress(self) -> DataFrame:
        return self._read("progress", f"{PROGRESS}, at int")

    def parts(self) -> list[str]:
        """Committed parts, the oldest first: a name for each range of a run."""
        return [r["part"] for r in self.progress().orderBy("at").select("part").collect()]

    def vectors(self) -> DataFrame:
        read = [self.spark.read.schema(VECTORS).parquet(f"{self.path}/{p}").withColumn("at", F.lit(k)) for k, p in enumerate(self.parts())]
        if not read:
            return self.spark.createDataFrame([], VECTORS)
        last = functools.reduce(DataFrame.unionByName, read).groupBy("record_id", "vector_type").agg(F.max_by(F.struct("embedding", "model_id"), "at").alias("v"))
        return last.select("record_id", "vector_type", "v.*")

    # a run

    def plan(self, run: str) -> list[tuple[int, str | None]]:
        rows = self._read("plans", _PLAN).filter(F.col("run") == run).orderBy("range").collect()
        return [(r["range"], r["low"]) for r in rows]

    def begin(self, run: str, records: DataFrame, range_rows: int) -> list[tuple[int, str | None]]:
        """The ranges of keys of a run: a row each, written once, so that a run that goes on has the same ones."""
        known = self.plan(run)
        if known:
            return known
        n = max(1, -(-records.count() // range_rows))
        dealt = records.select("record_id").repartitionByRange(n, "record_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("record_id").alias("low"))
        lows = [r["low"] for r in dealt.orderBy("low").collect()]
        rows = [(run, k, None if k == 0 else low) for k, low in enumerate(lows)] or [(run, 0, None)]
        self.spark.createDataFrame(rows, _PLAN).coalesce(1).write.mode("append").json(f"{self.path}/plans")
        return self.plan(run)

    def commit(self, run: str, number: int, part: str, result: Result) -> None:
        at = self.progress().count()
        row = self.spark.createDataFrame([(run, number, part, result.scanned, result.reindexed, result.skipped, result.vectors_written, at)], f"{PROGRESS}, at int").coalesce(1)
        row.write.mode("errorifexists").json(f"{self.path}/progress/n={at}")


def embedded(pending: DataFrame, embed: Callable[[Sequence[str]], list[list[float]]], model_id: str, batch: int = BATCH) -> DataFrame:
    """Vectors of texts (record_id, vector_type, text), ``batch`` texts at a time."""

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            for a in range(0, b.num_rows, batch):
                x = b.slice(a, batch)
                made = embed([t or "" for t in x.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([x.column("record_id"), x.column("vector_type"), pa.array(made, pa.list_(pa.float64())), pa.array([model_id] * x.num_rows)], names=[c.split()[0] for c in VECTORS.split(", ")])

    return pending.select("record_id", "vector_type", "text").mapInArrow(task, VECTORS)


def _within(low: str | None, high: str | None) -> Column:
    c = F.col("record_id")
    return (F.lit(True) if low is None else c >= low) & (F.lit(True) if high is None else c < high)


def reindex(table: VectorTable, df: DataFrame, scope: Scope, channels: dict[str, str], embed: Callable[[Sequence[str]], list[list[float]]], model_id: str, run: str, force: bool = False, range_rows: int = RANGE) -> Result:
    """Embeds the channels (vector type to text column) of all records that the scope permits, and tells what was done.

    A channel that is stored under the same model is skipped, unless ``force``. Each range of keys is written
    and then committed; started again under the same ``run``, it goes on behind what is committed, and what a broken range has
    written is never read.
    """
    scope.require("runtime.manage")
    spark, mine = table.spark, authorized(df, scope)
    ranges = table.begin(run, mine, range_rows)
    done = {r["range"] for r in table.progress().filter(F.col("run") == run).select("range").collect()}
    for k, (number, low) in enumerate(ranges):
        if number in done:
            continue
        here = _within(low, ranges[k + 1][1] if k + 1 < len(ranges) else None)
        rows = mine.filter(here)
        each = rows.select("record_id", F.inline(F.array(*[F.struct(F.lit(t).alias("vector_type"), F.col(c).alias("text")) for t, c in channels.items()])))
        current = table.vectors().filter(here).filter(F.col("model_id") == model_id).select("record_id", "vector_type")
        pending = each if force else each.join(current, ["record_id", "vector_type"], "left_anti")
        part = f"part-{uuid.uuid4().hex}"
        embedded(pending, embed, model_id).write.parquet(f"{table.path}/{part}")
        new = spark.read.schema(VECTORS).parquet(f"{table.path}/{part}").agg(F.count("*").alias("n"), F.count_distinct("record_id").alias("r")).first()
        scanned = rows.count()
        table.commit(run, number, part, Result(scanned, new["r"], scanned * len(channels) - new["n"], new["n"]))
    total = table.progress().filter(F.col("run") == run).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("scanned", "reindexed", "skipped", "written")]).first()
    return Result(*total)
