"""What the corpus operators share: shared-folder tables, word shingles, union of links."""

from __future__ import annotations

import gc
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obspark.sources import places

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SHINGLE_BASE = np.uint64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def stash(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes the rows as a table to the shared folder and reads them back."""
    spark = df.sparkSession
    path = f"{places.shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows (of some 16 bytes) up to which a list of sought keys is broadcast; beyond it, the sought rows are shuffled.
FEW = 1 << 20


def sought(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame] | None:
    """The rows whose key is listed (distinct keys) and the others, without a shuffle; None if the list is too long for that."""
    if keys.count() > FEW:
        return None
    listed = F.broadcast(keys.select(key))
    return rows.join(listed, key, "left_semi"), rows.join(listed, key, "left_anti")


#: Rows of a key beyond which it meets a broadcast list.
HOT = 1000


def listed(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """The rows whose key is listed in ``keys`` (distinct keys ``on``, and the number n of their rows), with left_anti the others, with inner or left joined to them.

    Keys of many rows meet a broadcast list, so that none of them gathers in a
    task; the others are shuffled.
    """
    wanted = keys if how in ("inner", "left") else keys.select(*on)
    hot = keys.filter(F.col("n") > HOT).select(*wanted.columns)
    if not 0 < hot.count() <= FEW:
        return rows.join(wanted, on, how)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keys.filter(F.col("n") <= HOT).select(*wanted.columns), on, how)
    return rest if how == "left_anti" else rest.unionByName(rows.join(F.broadcast(hot), on, "inner" if how == "left" else how))


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that have ended, now instead of whenever the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Deletes stashed tables that nothing reads any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word to 64-bit hash, forgotten as a whole when it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = WordHashes()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of the word shingles of a text, in order, repeats kept.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A
    text of fewer words than ``width`` gives its whole sequence as one shingle;
    a text without words (or null) gives none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(width, len(w))
    h = np.full(len(w) - n + 1, np.uint64(n), np.uint64)
    for i in range(n):
        h = mix(h * SHINGLE_BASE + w[i : len(w) - n + 1 + i])
    return h


def components(edges: DataFrame, label: str) -> DataFrame:
    """Components of the nodes that ``edges`` (a, b: long) link: (id, component), each named by one of its nodes.

    Each round every node hooks to the neighbour of the least hash, if that is
    less than its own (another hash each round, so chains shrink by a share,
    too); hooked nodes become one and their edges are drawn together, equal
    ones once. Work shrinks with the edges; rounds are written to the shared
    folder.
    """
    edges = stash(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}-edges")
    names = stash(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id")), f"{label}-names")
    number = 0
    while edges.limit(1).count():
        h = lambda c: F.xxhash64(F.lit(number), F.col(c))  # noqa: B023, E731  used within the round
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(h("b").alias("h"), F.col("b").alias("id"))).alias("m"))
        hooks = stash(least.filter(F.col("m.h") < h("a")).select("a", F.col("m.id").alias("to")), f"{label}-hooks")
        moved = names.join(hooks.withColumnRenamed("a", "component"), "component", "left")
        fresh = stash(moved.select("id", F.coalesce("to", "component").alias("component")), f"{label}-names")
        e = edges.join(hooks.withColumnRenamed("to", "x"), "a", "left").join(hooks.select(F.col("a").alias("b"), F.col("to").alias("y")), "b", "left")
        e = e.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).filter("a <> b")
        drawn = stash(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}-edges")
        discard(edges, names, hooks)
        edges, names, number = drawn, fresh, number + 1
    return names


def sliced(frames: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches of the same rows: texts may be long."""
    for b in frames:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def batches(frames: Iterator[pa.RecordBatch], *columns: str) -> Iterator:
    """Tuples of the named columns as lists, of few rows at a time."""
    for b in sliced(frames):
        yield tuple(b.column(c).to_pylist() for c in columns)


#: Bounds of ranges that lie in one list, when a row's range is looked up.
STEP = 256


def range_buckets(rows: DataFrame, rows_per_bucket: int = 1000, most: int = STEP * STEP, wrap: bool = False) -> DataFrame:
    """Deals rows (with non-null columns _key and _tie) to buckets that are ranges of (_key, _tie), with the neighbours' edge rows.

    Adds _bucket and _side: 0 for a bucket's own rows, -1 for the last row of
    the bucket before it and 1 for the first row of the next one (after the
    last, with ``wrap``, of the first). Sorted by (_bucket, _side, _key, _tie),
    a bucket shows each row beside both its neighbours, wherever the bounds lie;
    so results don't depend on them. Bounds come from a hash-drawn sample of
    bounded size; the driver sees that and two keys of each bucket. A row finds
    its bucket by lists of STEP bounds and, before them, the list of their
    first ones.
    """
    spark = rows.sparkSession
    keys = rows.select("_key", "_tie")
    types = dict(rows.dtypes)
    n = min(most, max(1, keys.count() // rows_per_bucket))
    drawn = sorted(tuple(r) for r in keys.orderBy(F.xxhash64("_key", "_tie")).limit(8 * n).collect())
    bounds = sorted(set(drawn[8::8]))
    lists = [[{"k": k, "t": t} for k, t in bounds[a : a + STEP]] for a in range(0, len(bounds), STEP)]
    at = f"struct<k:{types['_key']},t:{types['_tie']}>"
    fixed = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    below = lambda c: F.size(F.filter(c, lambda b: b <= F.struct(F.col("_key").alias("k"), F.col("_tie").alias("t"))))
    coarse = below(fixed([x[0] for x in lists], f"array<{at}>"))
    bucket = F.when(coarse == 0, 0).otherwise((coarse - 1) * STEP + below(F.element_at(fixed(lists, f"array<array<{at}>>"), coarse))) if bounds else F.lit(0)
    edges = keys.withColumn("_bucket", bucket).groupBy("_bucket").agg(F.min(F.struct("_key", "_tie")).alias("a"), F.max(F.struct("_key", "_tie")).alias("z")).orderBy("_bucket").collect()
    lent: dict[tuple, list[tuple[int, int]]] = {}
    for x, y in zip(edges, edges[1:], strict=False):
        lent.setdefault(tuple(y["a"]), []).append((x["_bucket"], 1))
        lent.setdefault(tuple(x["z"]), []).append((y["_bucket"], -1))
    if wrap and edges:
        lent.setdefault(tuple(edges[0]["a"]), []).append((edges[-1]["_bucket"], 1))
    small = spark.createDataFrame([(*k, v) for k, v in lent.items()], f"_key {types['_key']}, _tie {types['_tie']}, _lent array<struct<_bucket:int,_side:int>>")
    own = F.array(F.struct(bucket.alias("_bucket"), F.lit(0).alias("_side")))
    both = rows.join(F.broadcast(small), ["_key", "_tie"], "left").withColumn("_at", F.explode(F.when(F.col("_lent").isNull(), own).otherwise(F.concat(own, F.col("_lent")))))
    return both.withColumns({"_bucket": F.col("_at._bucket"), "_side": F.col("_at._side")}).drop("_at", "_lent").repartition("_bucket").sortWithinPartitions("_bucket", "_side", "_key", "_tie")


def keep_rows(docs: DataFrame, decide) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts ``decide`` (list of texts to booleans) keeps; no shuffle."""

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(frames):
            yield b.filter(pa.array(decide(b.column("text").to_pylist()), pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
