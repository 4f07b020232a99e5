"""Operator 5: MinHash fingerprints, and the join of their bands.

A fingerprint holds, for each of a number of universal hash functions
(a x + b mod 2^64, a odd), the smallest value over a text's five-word shingles,
of which it keeps 16 mixed bits. The likeness of two fingerprints, the share of
equal values, estimates the Jaccard similarity of the shingle sets.

The query needs each document beside its successor: rows are dealt to ranges of
doc_id, each with its successor's first row, so the texts are shuffled once and
no window spans the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obspark.llm import common

PERMUTATIONS, WORDS, BANDS = 128, 5, 32
#: Members of a band that meet in one cell, about.
BLOCK = 500
#: Pairs that a task verifies, about, and tasks that the pairs of one text are dealt to.
PAIRS, SHARES = 1000, 16
_RNG = np.random.default_rng(20)
A = _RNG.integers(0, 2**63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
B = _RNG.integers(0, 2**63, PERMUTATIONS, np.uint64)
#: The values of a text without words.
NONE = np.full(PERMUTATIONS, 0xFFFF, np.uint16)


#: Shingles that are hashed at a time, in a table that is kept: fresh memory would take longer than the hashing.
PIECE = 256
_TABLE = np.empty((PIECE, PERMUTATIONS), np.uint64)


def signature(text: str | None) -> np.ndarray:
    """16 bits for each permutation; a text without words has all bits set."""
    return hashed(common.shingles(text, WORDS))


def hashed(x: np.ndarray) -> np.ndarray:
    """The signature of a text of these shingles."""
    if not len(x):
        return NONE
    low = None
    for i in range(0, len(x), PIECE):
        part = x[i : i + PIECE, None]
        table = _TABLE[: len(part)]
        np.multiply(part, A, out=table)
        np.add(table, B, out=table)
        low = np.minimum.reduce(table, axis=0) if low is None else np.minimum(low, np.minimum.reduce(table, axis=0))
    return (common.mix(low) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def hexed(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def edit(text: str, following: str) -> str:
    """The last quarter of a text replaced by the beginning of the next one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row of ``docs`` (doc_id, text; others are ignored) and of its text edited with the next row's.

    Null texts count as empty. Rows with equal ids follow each other by a hash
    of their texts; a null id comes first. A single row follows itself; an
    empty table gives no rows.
    """

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        last = None  # bucket, id, text, signature

        def emit(now):
            bucket, doc, text, sig = last
            edited = edit(text, now[2])
            esig = signature(edited)
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            rows.append((doc, len(text), sha, hexed(sig), hexed(esig), likeness(sig, esig), likeness(sig, now[3])))

        def flush():
            nonlocal rows
            cols, rows = list(zip(*rows, strict=True)) or [()] * 7, []
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for part in common.batches(frames, "_bucket", "_side", "doc_id", "text"):
            for bucket, side, doc, text in zip(*part, strict=True):
                if side < 0:
                    continue
                if side > 0 and (last is None or last[0] != bucket):
                    continue  # a second row that could follow
                now = (bucket, doc, text or "", signature(text))
                if last is not None and last[0] == bucket:
                    emit(now)
                last = None if side > 0 else now
            if rows:
                yield flush()

    ready = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("_key"), F.xxhash64("text").alias("_tie"))
    dealt = common.range_buckets(ready, wrap=True)
    return dealt.select("_bucket", "_side", "doc_id", "text").mapInArrow(task, SCHEMA)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS) -> DataFrame:
    """Links (a, b, jaccard) between near-duplicate rows of ``docs`` (doc_id, text), a < b.

    Copies of a text link to its smallest id. Of the different texts, those
    every two that share a signature band link, if the Jaccard similarity of
    their shingle sets, counted exactly, reaches the threshold; so the pairs to
    verify grow with the square of a family of different texts (``near_classes``
    does without them). Rows without words link with nothing; equal ids do not
    link.
    """
    reps, copies = representatives(docs)
    met = in_cells(banded(reps, bands), "doc_id").filter("a < b and (_lo = _hi or _s <> _t)")
    near = verified(met.select("a", "b").distinct(), reps, threshold)
    words = copies.join(reps.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(F.col("doc_id").alias("a")), "a", "left_semi")
    return words.unionByName(near)


def representatives(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The row of the smallest id of each text (doc_id, text), and the links of its copies to it (a, b, jaccard)."""
    texts = docs.filter("text is not null and doc_id is not null").select("doc_id", "text").withColumn("sha", F.sha2("text", 256))
    first = texts.groupBy("sha").agg(F.min("doc_id").alias("a"))
    copies = texts.select("sha", F.col("doc_id").alias("b")).join(first, "sha").filter("a < b and a <> b").select("a", "b", F.lit(1.0).alias("jaccard")).distinct()
    reps = texts.join(first.select("sha", F.col("a").alias("doc_id")), ["sha", "doc_id"]).dropDuplicates(["sha"]).select("doc_id", "text")
    return reps, copies


def band_keys(x: np.ndarray, bands: int) -> list[int]:
    """The band keys of a text of these shingles, none if it has no words."""
    s, per = hashed(x), PERMUTATIONS // bands
    return [] if s is NONE else [xxhash.xxh64_intdigest(s[k * per : (k + 1) * per].tobytes(), k) - (1 << 63) for k in range(bands)]


def banded(reps: DataFrame, bands: int) -> DataFrame:
    """The band keys of each text with words: rows (doc_id, band)."""

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.batches(frames, "doc_id", "text"):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([band_keys(common.shingles(t, WORDS), bands) for t in texts], pa.list_(pa.int64()))], names=["doc_id", "bands"])

    return reps.mapInArrow(task, "doc_id long, bands array<long>").select("doc_id", F.explode("bands").alias("band"))


def marked(docs: DataFrame, bands: int) -> DataFrame:
    """One pass over the texts: doc_id, row (a short hash of the text), sha (a long one; null text: null), size (different shingles) and bands (empty: no words) of each row."""
    schema = "doc_id long, row long, sha binary, size long, bands array<long>"

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows, texts in common.batches(frames, "doc_id", "row", "text"):
            shas = [None if t is None else hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
            sizes, keys = zip(*((len(np.unique(x)), band_keys(x, bands)) for x in (common.shingles(t, WORDS) for t in texts)), strict=True)
            cols = [pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(shas, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(task, schema)


def in_cells(keyed: DataFrame, *columns: str) -> DataFrame:
    """Members of a band (doc_id, band, and ``columns``) beside each other: a and b with their columns; a block of a large band meets every other in a cell of its own."""
    sizes = keyed.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = common.listed(keyed, sizes, ["band"], "inner").withColumn("_blocks", F.ceil(F.col("n") / BLOCK))
    dealt = dealt.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.col("_blocks"))).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    cells = dealt.select("band", F.least("_s", "_o").alias("_lo"), F.greatest("_s", "_o").alias("_hi"), "_s", *dict.fromkeys(("doc_id", *columns)))
    more = [c for c in columns if c != "doc_id"]
    left = cells.select("band", "_lo", "_hi", "_s", F.col("doc_id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in more])
    right = cells.select("band", "_lo", "_hi", F.col("_s").alias("_t"), F.col("doc_id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in more])
    return left.join(right, ["band", "_lo", "_hi"])


def may_be_near(threshold: float) -> Column:
    """Whether sets of size_a and size_b can be as alike: no two are more so than their sizes."""
    return F.least("size_a", "size_b") >= F.lit(threshold - 1e-9) * F.greatest("size_a", "size_b")


def dealt_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) dealt to tasks by their number, as they are few bytes but much work; those of one text in a task follow each other."""
    n = pairs.count() // PAIRS + 1
    return pairs.repartition(min(n, 1 << 14), "a", F.pmod(F.xxhash64("b"), F.lit(SHARES))).sortWithinPartitions("a")


class Sets(dict):
    """Text to its shingle set, forgotten as a whole when texts and sets get large: pairs of one text are often near each other."""

    most, size = 1 << 25, 0

    def __missing__(self, text: str) -> np.ndarray:
        x = np.unique(common.shingles(text, WORDS))
        self.size += len(text) + x.nbytes
        if self.size > self.most:
            self.clear()
            self.size = len(text) + x.nbytes
        self[text] = x
        return x


def verified(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) of texts those whose shingle sets are as alike: a, b, jaccard."""

    def verify(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Sets()
        for a, b, x, y in common.batches(frames, "a", "b", "x", "y"):
            out = []
            for s, t in zip(x, y, strict=True):
                s, t = held[s], held[t]
                both = len(np.intersect1d(s, t, True))
                out.append(both / max(1, len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(out, pa.float64())], names=["a", "b", "jaccard"])

    full = pairs.join(reps.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b").join(reps.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")
    return full.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long, jaccard double").filter(F.col("jaccard") >= threshold)


def near_classes(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS) -> DataFrame:
    """doc_id, class_id (the smallest doc_id that links reach) and links (verified ones of the text) of each row of ``docs`` (doc_id, text).

    Links are those of ``near_duplicates``, but a family of near copies costs
    about as many pairs as it has members: first each text meets the least one
    of each of its bands; components of what verifies follow, and only texts of
    different components that share a band are paired after that. Pairs whose
    sizes alone refute them are not read. Copies of a
    text share its class and count one link to it each. Rows with a null id or
    text, or without words, are classes of their own. Equal ids with different
    texts share a class. An empty table gives no rows.
    """
    rows = common.stash(marked(docs, bands), "marked")
    texts = rows.filter("sha is not null and doc_id is not null")
    least = common.stash(texts.groupBy("sha").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")), "least")
    copies = common.listed(texts.select("sha", F.col("doc_id").alias("b")), least.filter("n > 1"), ["sha"], "inner").filter("a < b").select("a", "b", F.lit(1.0).alias("jaccard")).distinct()
    reps = common.listed(texts, least, ["sha"], "inner").filter("doc_id = a and size(bands) > 0").select("doc_id", "row", "sha", "size", "bands")
    reps = common.stash(reps, "reps")
    again = reps.groupBy("sha").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() > 0  # rows that are repeated with their id
    keyed = (reps.dropDuplicates(["sha"]) if again else reps).select("doc_id", "size", F.explode("bands").alias("band"))
    heads = keyed.groupBy("band").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    shared = common.stash(common.listed(keyed, common.stash(heads, "heads"), ["band"], "inner").select("doc_id", "size", "band", "a"), "shared")
    met = common.stash(shared.select("doc_id").distinct(), "met")
    met = F.broadcast(met) if met.count() <= common.FEW else met
    chosen = reps.select("doc_id", "row").join(met, "doc_id", "left_semi").distinct()
    chosen = F.broadcast(chosen) if chosen.count() <= common.FEW else chosen
    near = docs.select("doc_id", "text").withColumn("row", F.xxhash64("text")).join(chosen, ["doc_id", "row"], "left_semi")
    near = common.stash((near.dropDuplicates(["doc_id", "row"]) if again else near).select("doc_id", "text"), "texts")
    star = shared.filter("doc_id > a").select("a", F.col("doc_id").alias("b"), F.col("size").alias("size_b")).distinct()
    star = star.join(reps.select(F.col("doc_id").alias("a"), F.col("size").alias("size_a")), "a").filter(may_be_near(threshold)).select("a", "b").distinct()
    star = common.stash(star, "star")
    first = common.stash(verified(dealt_pairs(star), near, threshold), "first-links")
    label = common.components(first.select("a", "b"), "first")
    named = common.stash(shared.select("doc_id", "size", "band").join(label.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "named")
    mixed = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("band", "n")
    open_ = common.listed(named, common.stash(mixed, "mixed"), ["band"])
    rest = in_cells(open_, "component", "size").filter("a < b and component_a <> component_b").filter(may_be_near(threshold)).select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
    rest = common.stash(rest, "rest")
    second = common.stash(verified(dealt_pairs(rest), near, threshold), "second-links")
    links = first.unionByName(second)
    label = common.components(links.select("a", "b"), "classes")
    own = copies.select(F.col("b").alias("doc_id"), F.col("a").alias("first"))
    counted = links.unionByName(copies).select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("links"))
    least = label.groupBy("component").agg(F.min("id").alias("class_id"))
    of = label.join(least, "component").select(F.col("id").alias("first"), "class_id")
    out = rows.select("doc_id", (F.size("bands") > 0).alias("words")).join(own, "doc_id", "left")
    out = out.withColumn("first", F.when(F.col("words"), F.coalesce("first", "doc_id"))).join(of, "first", "left").join(counted, "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "first", "doc_id").alias("class_id"), F.when(F.col("words"), F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("links"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash fingerprints of all documents and of their edited texts."""
    return fingerprint_edits(common.documents(spark, sf_dir))


def minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicate documents, by the bands of their fingerprints."""
    return near_classes(common.documents(spark, sf_dir))
