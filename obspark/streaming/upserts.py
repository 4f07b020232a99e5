"""Keyed rows from a stream, each batch committed once, with conflicts of payload set aside."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obspark.streaming.streams import event_stream, work_dir


class KeyedTable:
    """A table at a path into which batches insert rows of new keys.

    A batch writes its rows and its conflicts under a name of its own, then a
    manifest row with its number and the table's parts: that row is what makes
    it part of the table. A batch whose number is committed does nothing, and what a batch
    that broke off has written is never read. A key that exists keeps its row; one that comes again with
    another payload is a conflict, within a batch, too.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], payload: Sequence[str], order: str):
        self.spark, self.path, self.key, self.payload, self.order = spark, path, list(key), list(payload), order

    def committed(self) -> tuple[int, list[str]]:
        """The last batch and the parts of the table."""
        try:
            last = self.spark.read.schema("batch long, parts array<string>").json(f"{self.path}/manifest").orderBy(F.desc("batch")).first()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last = None
        return (last["batch"], last["parts"]) if last else (-1, [])

    def _parts(self, kind: str, parts: Sequence[str], schema: str) -> DataFrame:
        read = [self.spark.read.schema(schema).parquet(f"{self.path}/{p}/{kind}") for p in parts]
        return functools.reduce(DataFrame.unionByName, read) if read else self.spark.createDataFrame([], schema)

    def rows(self, schema: str) -> DataFrame:
        return self._parts("rows", self.committed()[1], schema)

    def conflicts(self, schema: str) -> DataFrame:
        """Rows whose payload is not that of their key in the table."""
        return self._parts("conflicts", self.committed()[1], schema)

    def prepare(self, batch: DataFrame, parts: Sequence[str]) -> str:
        """Writes the rows and conflicts of a batch under a new name; nothing reads them yet."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)
        name = f"part-{uuid.uuid4().hex}"
        known = self._parts("rows", parts, schema).select(*self.key, *[F.col(c).alias(f"_{c}") for c in self.payload], F.lit(True).alias("_known"))
        # all rows of a key meet what the table has of it, which comes before them
        w = Window.partitionBy(*self.key).orderBy(self.order, *self.payload)
        both = batch.join(known, self.key, "left").withColumn("_n", F.row_number().over(w))
        held = [F.when(F.col("_known"), F.col(f"_{c}")).otherwise(F.first(c).over(w)).alias(c) for c in self.payload]
        differs = functools.reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(F.col(f"_h.{c}")) for c in self.payload])
        marked = both.withColumn("_h", F.struct(*held)).withColumn("_new", F.col("_known").isNull() & (F.col("_n") == 1)).withColumn("_differs", differs)
        marked.filter("_new").select(*batch.columns).write.parquet(f"{self.path}/{name}/rows")
        marked.filter("_differs").select(*batch.columns).write.parquet(f"{self.path}/{name}/conflicts")
        return name

    def commit(self, number: int, parts: Sequence[str]) -> None:
        row = self.spark.createDataFrame([(number, list(parts))], "batch long, parts array<string>").coalesce(1)
        row.write.mode("errorifexists").json(f"{self.path}/manifest/number={number}")

    def write(self, batch: DataFrame, number: int) -> None:
        """The writer of a stream's batches (for foreachBatch)."""
        last, parts = self.committed()
        if number <= last:
            return
        self.commit(number, [*parts, self.prepare(batch, parts)])


def keyed_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The events, delivered twice (every tenth with another value the second time): the table of events and the conflicts."""
    events = event_stream(spark, sf_dir).withColumn("delivery", F.explode(F.array(F.lit(0), F.lit(1))))
    again = events.withColumn("value", F.when((F.col("delivery") == 1) & (F.col("event_id") % 10 == 0), F.col("value") + 1).otherwise(F.col("value"))).select("event_id", "event_type", "value", "delivery")
    at = work_dir(spark)
    table = KeyedTable(spark, f"{at}/table", ["event_id"], ["event_type", "value"], "delivery")
    again.writeStream.foreachBatch(table.write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    schema = "event_id long, event_type string, value double, delivery int"
    return table.rows(schema), table.conflicts(schema)
