"""A text index that is kept: a log of deltas, merged on read, compacted now and then.

A delta holds what some records' indexing changed: postings with positions,
dealt to buckets by term and sorted by it, so a query's terms prune buckets
and row groups; the records that it replaces or takes out; and signed counts of documents by
term and of records and tokens by channel. Data are written first; a version, a list of deltas, makes them
visible. A posting is dead if a later delta names its record. So a
search reads the postings of its terms, the counts of its terms and a few totals, and never the corpus.

Postings are stored and shuffled in blocks: a term's postings in some thousands of texts, made where the texts are. They go once to the
tasks that write a bucket; a large bucket is written by many tasks, each sorted. Documents by term are counted over the written blocks.
Ids and places of a block and words of a document are one string each, as most of the time of a write goes to the elements of arrays.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obspark.functions.text import folded, query_terms, runs
from obspark.operators.search import inverse_frequency, saturated

BUCKETS = 64
#: How postings, documents and counts are compressed.
CODEC = "zstd"
#: Deltas from which a write compacts the log.
MOST_DELTAS = 8
#: Record ids that are broadcast at most; more of them, and the rows that they meet, are shuffled.
MOST_SENT = 1 << 20

#: Words: each once, with blanks between them.
_DOCS = "record_id string, channel string, tokens long, words string"
#: A block: n postings of a term; places has those of each of record_ids (escaped, a line each), with commas between them, and blanks between records.
_BLOCKS = "term string, channel string, n int, record_ids string, places string"
_COUNTS = "term string, channel string, documents long, bucket int"
_TOTALS = "channel string, records long, tokens long"


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _block(terms: pa.DictionaryArray, channels: pa.Array, record_ids: pa.Array, positions: pa.ListArray) -> pa.RecordBatch:
    """Blocks (_BLOCKS) of the postings of a batch (ids are escaped), in the order of the batch within a block."""
    channel = channels.dictionary_encode()
    code = channel.indices.to_numpy().astype(np.int64) * len(terms.dictionary) + terms.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.diff(code[order], prepend=-1))
    offsets = np.append(first, len(code)).astype(np.int32)
    held = positions.take(pa.array(order))
    upto = np.concatenate(([0], np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False))))
    of = pa.array(order[first])
    places = _joined(_joined(held.flatten().cast(pa.string()), upto, ","), offsets, " ")
    cols = [terms.dictionary.take(terms.indices.take(of)), channels.take(of), pa.array(np.diff(offsets)), _joined(record_ids.take(pa.array(order)), offsets, "\n"), places]
    return pa.RecordBatch.from_arrays(cols, names=_names(_BLOCKS))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _joined(values: pa.StringArray, offsets: np.ndarray, mark: str) -> pa.StringArray:
    """The values from each offset up to the next one, as one string."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values), mark)


def _escaped(ids: pa.Array) -> pa.Array:
    """Ids without line ends; a null one is a single percent sign."""
    return pc.fill_null(pc.replace_substring(pc.replace_substring(ids, "%", "%25"), "\n", "%0A"), "%")


def _unescaped(c: Column) -> Column:
    return F.when(c != "%", F.replace(F.replace(c, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


#: Bytes of ASCII letters and digits.
_INSIDE = np.array([chr(i).isalnum() and i < 128 for i in range(256)])


def _plain(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """Runs of letters and digits of ASCII texts (null: empty), and their number in each."""
    x = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
    data = np.frombuffer(x.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    inside = _INSIDE[data]
    bound = np.zeros(len(data) + 1, bool)
    bound[at] = True
    begins = np.flatnonzero(inside & (bound[:-1] | ~np.concatenate(([False], inside))[:-1]))
    ends = np.flatnonzero(inside & (bound[1:] | ~np.concatenate((inside, [False]))[1:])) + 1
    upto = np.concatenate(([0], np.cumsum(ends - begins))).astype(np.int32)
    return pa.StringArray.from_buffers(len(begins), pa.py_buffer(upto), pa.py_buffer(data[inside])), np.diff(np.searchsorted(begins, at))


def _found(frame: pa.RecordBatch) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of texts (x: folded and ASCII, or t: the tokens of any other), the row and the place of each, and their number in each row."""
    plain, few = _plain(frame.column("x"))
    lists = frame.column("t")
    more = lists.value_lengths().fill_null(0).to_numpy()
    rows = np.arange(frame.num_rows)
    row = np.concatenate((np.repeat(rows, few), np.repeat(rows, more)))
    place = np.concatenate([np.arange(1, n.sum() + 1) - np.repeat(np.cumsum(n) - n, n) for n in (few, more)])
    return pa.concat_arrays([plain, lists.flatten()]).dictionary_encode(), row, place, few + more


def _once(words: pa.DictionaryArray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of tokens by row and word that keeps their own within both, and where in it each word of a row begins."""
    key = row * np.int64(len(words.dictionary)) + words.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    return order, np.flatnonzero(np.diff(key[order], prepend=-1))


def _indexed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the postings of texts (record_id, channel, x, t)."""
    for frame in frames:
        words, row, place, _ = _found(frame)
        if not len(words):
            continue
        order, first = _once(words, row)
        at, of = pa.array(order[first]), pa.array(row[order[first]])
        positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
        yield _block(pa.DictionaryArray.from_arrays(words.indices.take(at), words.dictionary), frame.column("channel").take(of), _escaped(frame.column("record_id")).take(of), positions)


def _recorded(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (_DOCS) of texts (record_id, channel, x, t)."""
    for frame in frames:
        words, row, _, sizes = _found(frame)
        order, first = _once(words, row)
        at = order[first]
        each = words.dictionary.take(words.indices.take(pa.array(at)))
        cols = [frame.column("record_id"), frame.column("channel"), pa.array(sizes.astype(np.int64)), _joined(each, np.searchsorted(row[at], np.arange(frame.num_rows + 1)), " ")]
        yield pa.RecordBatch.from_arrays(cols, names=_names(_DOCS))


def _regrouped(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of postings (term, channel, record_id, positions)."""
    for frame in frames:
        if frame.num_rows:
            yield _block(frame.column("term").dictionary_encode(), frame.column("channel"), _escaped(frame.column("record_id")), frame.column("positions"))


def _each(blocks: DataFrame) -> DataFrame:
    """The postings of blocks: term, channel, record_id, positions, bucket and seq."""
    one = F.zip_with(F.split("record_ids", "\n"), F.split("places", " "), lambda r, p: F.struct(_unescaped(r).alias("record_id"), F.split(p, ",").cast("array<int>").alias("positions")))
    return blocks.select("term", "channel", F.inline(one), "bucket", "seq")


def _listed(words: Column) -> Column:
    """The words of a document as an array."""
    return F.filter(F.split(words, " "), lambda w: w != "")


def _sent(ids: DataFrame) -> DataFrame:
    """Distinct record ids (and columns) as a join takes them: broadcast unless they are many."""
    return F.broadcast(ids) if ids.count() <= MOST_SENT else ids


class TextStore:
    """The index of a table's text channels at a path; every read sees one version."""

    def __init__(self, spark: SparkSession, path: str, channels: Sequence[str]):
        self.spark, self.path, self.channels = spark, path.rstrip("/"), tuple(channels)

    # versions

    def versions(self) -> DataFrame:
        return self.spark.read.schema("v int, deltas array<string>").json(f"{self.path}/versions")

    def deltas(self) -> tuple[int, list[str]]:
        """The live version and its deltas, oldest first; the driver sees a row of at most MOST_DELTAS names."""
        last = self.versions().orderBy(F.desc("v")).first()
        return (last["v"], last["deltas"]) if last else (-1, [])

    def _commit(self, v: int, deltas: list[str]) -> None:
        """Makes deltas visible; another writer's version of the same number is a conflict."""
        row = self.spark.createDataFrame([(v, deltas)], "v int, deltas array<string>").coalesce(1)
        row.write.mode("errorifexists").json(f"{self.path}/versions/n={v}")

    def _table(self, name: str, schema: str, deltas: Sequence[str]) -> DataFrame:
        """A table of some deltas, with ``seq``, the place of each row's delta."""
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{d}/{name}").withColumn("seq", F.lit(k)) for k, d in enumerate(deltas)]
        return functools.reduce(DataFrame.unionByName, parts)

    # writing

    def _words(self, records: DataFrame) -> DataFrame:
        """Texts of records, folded (null: empty): x if they are ASCII then, else their tokens t."""
        each = F.array(*[F.struct(F.lit(c).alias("channel"), F.coalesce(c, F.lit("")).alias("text")) for c in self.channels])
        rows = records.select("record_id", F.inline(each)).select("record_id", "channel", folded("text").alias("x"))
        plain = F.octet_length("x") == F.length("x")
        return rows.select("record_id", "channel", F.when(plain, F.col("x")).alias("x"), F.when(~plain, runs(F.col("x"))).alias("t"))

    def _write(self, new: DataFrame | None, gone: DataFrame | None, deltas: list[str]) -> str:
        """Writes a delta: postings of the new records, and what they and the records that go replace."""
        name = f"delta-{uuid.uuid4().hex}"
        at = f"{self.path}/{name}"
        docs = None
        if new is not None:
            long = self._words(new)
            docs = long.mapInArrow(_recorded, _DOCS)
            self._sorted(long.mapInArrow(_indexed, _BLOCKS), f"{at}/postings", "channel")
        if gone is not None:
            out = gone.select("record_id").distinct() if new is None else gone.select("record_id").distinct().join(new.select("record_id"), "record_id", "left_anti")
            empty = out.select("record_id", F.lit(None).cast("string").alias("channel"), F.lit(None).cast("long").alias("tokens"), F.lit(None).cast("string").alias("words"))
            docs = empty if docs is None else docs.unionByName(empty)
        docs.write.parquet(f"{at}/docs", compression=CODEC)
        docs = self.spark.read.schema(_DOCS).parquet(f"{at}/docs")
        changed = docs.filter("channel IS NOT NULL").select("channel", F.lit(1).cast("long").alias("records"), "tokens")
        counts = None if new is None else self._blocks(name, 0).groupBy("term", "channel").agg(F.sum("n").alias("documents"))
        if deltas:
            replaced = self._live_docs(deltas).join(_sent(docs.select("record_id").distinct()), "record_id", "left_semi")
            changed = changed.unionByName(replaced.select("channel", F.lit(-1).cast("long").alias("records"), (-F.col("tokens")).alias("tokens")))
            less = replaced.select("channel", F.explode(_listed(F.col("words"))).alias("term")).groupBy("term", "channel").agg((-F.count("*")).alias("documents"))
            counts = less if counts is None else counts.unionByName(less).groupBy("term", "channel").agg(F.sum("documents").alias("documents")).filter("documents <> 0")
        elif counts is None:
            counts = self.spark.createDataFrame([], "term string, channel string, documents long")
        self._sorted(counts, f"{at}/counts", "channel")
        changed.groupBy("channel").agg(F.sum("records").alias("records"), F.sum("tokens").alias("tokens")).coalesce(1).write.parquet(f"{at}/totals")
        return name

    def _sorted(self, rows: DataFrame, path: str, then: str) -> None:
        """Writes rows by bucket, each file sorted; a large bucket is several tasks and files."""
        rows.withColumn("bucket", _bucket(F.col("term"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "channel", then).write.partitionBy("bucket").parquet(path, compression=CODEC)

    def upsert(self, records: DataFrame) -> None:
        """Indexes records (record_id, once each, and the channels), for the first time or again."""
        v, deltas = self.deltas()
        self._commit(v + 1, [*deltas, self._write(records, None, deltas)])
        if len(deltas) + 1 >= MOST_DELTAS:
            self.compact()

    def delete(self, ids: DataFrame) -> None:
        """Takes records (record_id) out; those that aren't there do no harm."""
        v, deltas = self.deltas()
        self._commit(v + 1, [*deltas, self._write(None, ids, deltas)])

    def compact(self) -> None:
        """Writes the log as one delta with the same content."""
        v, deltas = self.deltas()
        name = f"delta-{uuid.uuid4().hex}"
        self._live_docs(deltas).write.parquet(f"{self.path}/{name}/docs", compression=CODEC)
        near = self._live_postings(deltas).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "channel", "record_id").drop("bucket")
        self._sorted(near.mapInArrow(_regrouped, _BLOCKS), f"{self.path}/{name}/postings", "channel")
        self._sorted(self._table("counts", _COUNTS, deltas).groupBy("term", "channel").agg(F.sum("documents").alias("documents")).filter("documents <> 0"), f"{self.path}/{name}/counts", "channel")
        self._table("totals", _TOTALS, deltas).groupBy("channel").agg(F.sum("records").alias("records"), F.sum("tokens").alias("tokens")).coalesce(1).write.parquet(f"{self.path}/{name}/totals")
        self._commit(v + 1, [name])

    # reading

    def _without_later(self, rows: DataFrame, deltas: Sequence[str]) -> DataFrame:
        """Rows (with seq) whose record no later delta names."""
        if len(deltas) < 2:
            return rows.drop("seq")
        later = self._table("docs", _DOCS, deltas).filter("seq > 0").groupBy("record_id").agg(F.max("seq").alias("last"))
        return rows.join(_sent(later), "record_id", "left").filter("last IS NULL OR last <= seq").drop("last", "seq")

    def _live_docs(self, deltas: Sequence[str]) -> DataFrame:
        return self._without_later(self._table("docs", _DOCS, deltas), deltas).filter("channel IS NOT NULL").select("record_id", "channel", "tokens", "words")

    def _live_postings(self, deltas: Sequence[str], terms: Sequence[str] | None = None, channel: str | None = None) -> DataFrame:
        rows = functools.reduce(DataFrame.unionByName, [self._blocks(d, k) for k, d in enumerate(deltas)])
        if terms is not None:
            rows = self._pruned(rows, terms)
        if channel is not None:
            rows = rows.filter(F.col("channel") == channel)
        return self._without_later(_each(rows), deltas)

    def _blocks(self, delta: str, k: int) -> DataFrame:
        """A delta's blocks, which one of deletions lacks."""
        schema = f"{_BLOCKS}, bucket int"
        found = self.spark.read.schema(schema).option("recursiveFileLookup", "false").option("ignoreMissingFiles", "true")
        try:
            rows = found.parquet(f"{self.path}/{delta}/postings")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], schema)
        return rows.withColumn("seq", F.lit(k))

    @staticmethod
    def _pruned(rows: DataFrame, terms: Sequence[str]) -> DataFrame:
        """Rows of the terms: their buckets prune folders, the terms row groups."""
        if not terms:
            return rows.limit(0)
        listed = F.array(*map(F.lit, dict.fromkeys(terms)))
        spark = rows.sparkSession
        buckets = sorted({r[0] for r in spark.range(1).select(F.explode(F.transform(listed, _bucket))).collect()})
        return rows.filter(F.col("bucket").isin(*buckets) & F.col("term").isin(*dict.fromkeys(terms)))

    def postings(self, terms: Sequence[str], channel: str) -> DataFrame:
        """Live postings of the terms: term, record_id, positions."""
        return self._live_postings(self.deltas()[1], terms, channel).select("term", "record_id", "positions")

    def every_posting(self) -> DataFrame:
        """All live postings: term, channel, record_id, positions."""
        return self._live_postings(self.deltas()[1]).drop("bucket")

    def documents(self) -> DataFrame:
        """Live records: record_id, channel, tokens, words."""
        return self._live_docs(self.deltas()[1]).withColumn("words", _listed(F.col("words")))

    def frequencies(self, terms: Sequence[str] | None = None) -> DataFrame:
        """How many live records have each term: term, channel, documents."""
        rows = self._table("counts", _COUNTS, self.deltas()[1])
        rows = rows if terms is None else self._pruned(rows, terms)
        return rows.groupBy("term", "channel").agg(F.sum("documents").alias("documents")).filter("documents <> 0")

    def statistics(self, columns: Sequence[str], terms: Sequence[str]) -> Column:
        """what ``search.text_statistics`` computes from the corpus, from the stored counts: a scalar subquery over a few rows."""
        distinct = list(dict.fromkeys(terms))
        deltas = self.deltas()[1]
        rows = self._pruned(self._table("counts", _COUNTS, deltas), distinct)
        of = lambda c, t: F.coalesce(F.sum(F.when((F.col("channel") == c) & (F.col("term") == t), F.col("documents"))), F.lit(0))
        sums = rows.agg(*[of(c, t).alias(f"d_{c}_{i}") for c in columns for i, t in enumerate(distinct)])
        total = lambda c, k: F.coalesce(F.sum(F.when(F.col("channel") == c, F.col(k))), F.lit(0))
        totals = self._table("totals", _TOTALS, deltas).agg(total(columns[0], "records").alias("n"), *[total(c, "tokens").alias(f"length_{c}") for c in columns])
        return totals.crossJoin(sums).select(F.struct("*").alias("s")).scalar()

    def relevance(self, channel: str, query: str, candidates: DataFrame) -> DataFrame:
        """record_id and BM25 of the candidates (record_id) that have a term of the query, by the statistics of the whole index."""
        terms = query_terms(query)
        distinct = list(dict.fromkeys(terms))
        if not terms:
            return candidates.select("record_id", F.lit(None).cast("double").alias("bm25")).limit(0)
        hits = self.postings(distinct, channel).join(candidates.select("record_id"), "record_id", "left_semi").groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("term", F.size("positions")))).alias("tf"))
        sizes = self.documents().filter(F.col("channel") == channel).select("record_id", "tokens")
        scored = hits.join(sizes, "record_id").withColumn("_st", self.statistics([channel], terms))
        of = lambda name: F.col(f"_st.{name}").cast("double")
        mean = F.coalesce(F.nullif(of(f"length_{channel}") / F.greatest(F.lit(1.0), of("n")), F.lit(0.0)), F.lit(1.0))
        score = F.lit(0.0)
        for t in terms:
            tf = F.coalesce(F.try_element_at("tf", F.lit(t)), F.lit(0))
            score = score + inverse_frequency(of("n"), of(f"d_{channel}_{distinct.index(t)}")) * saturated(tf, F.col("tokens"), mean)
        return scored.select("record_id", score.alias("bm25"))

    def occurrences(self, channel: str, words: Sequence[str], candidates: DataFrame) -> DataFrame:
        """Where candidates (record_id) have the words: record_id, at (an array of pos and word in order), for ``cover_density``."""
        hits = self.postings(words, channel).join(candidates.select("record_id"), "record_id", "left_semi")
        return hits.groupBy("record_id").agg(F.array_sort(F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct(p.alias("pos"), F.col("term").alias("word")))))).alias("at"))


def create(records: DataFrame, path: str, channels: Sequence[str]) -> TextStore:
    """A new index of all ``records``."""
    store = TextStore(records.sparkSession, path, channels)
    store._commit(0, [store._write(records, None, [])])
    return store
