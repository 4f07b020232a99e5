"""Operator 2: exact n-gram Jaccard join with a count-vector R-tree.

A set's tokens (word shingles) are hashed into groups; the vector of its group
counts is a point, and the sum of the coordinate minima of two points bounds
the overlap of their sets. Points lie in R-trees whose boxes keep coordinate
maxima, so whole boxes fall to the same bound; what survives is verified on
the sets themselves.

The trees are spread by tokens: under a global order of tokens, two sets whose
similarity reaches the threshold share a token of their prefixes (of n tokens,
the first n - ceil(threshold n) + 1), so the sets of one token's list are the
points of one tree, and no link is lost. Frequent tokens come last in the
order, by a count sketch over all rows, so they seldom stand in a prefix.

Equal sets are one point. Lists of up to LEAF points are a single leaf, all its
pairs are candidates. In longer lists each point is first paired with the
list's least point and one other; components of what verifies follow,
and only pairs between different components are then searched in the tree: a
group of n copies gives about n candidates a token instead of n squared. Lists
beyond SPLIT points are searched block against block in different tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obspark.llm import common

GROUPS = 256
LEAF, FAN, CHAIN = 8, 32, 64
SPLIT = 4096
#: Rows of a token's list that a task looks at together.
TOGETHER = 1 << 16
#: Counters of the sketch, and of one of its rows.
SKETCH, SKETCH_ROW = 1 << 18, 1 << 12
CEILING = 255


def token_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(common.shingles(text, words))


def vector(s: np.ndarray) -> np.ndarray:
    """Group counts of a set; a count at the ceiling stands for any larger one."""
    return np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=GROUPS), CEILING).astype(np.uint8)


def set_ids(s: np.ndarray) -> int:
    """A 64-bit id of a set, whatever the order of its tokens."""
    x = common.mix(s).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(common.mix(np.array([x]))[0].astype(np.int64))


def needed(a, b, percent: int):
    """Least overlap of two sets of these sizes that link: 100 i >= percent (a + b - i)."""
    return -(-(percent * (a + b)) // (100 + percent))


def minima(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima; where both counts are at the ceiling, the sum is without bound."""
    low = np.minimum(x, y)
    return np.where((low == CEILING).any(axis=1), np.int64(1 << 40), low.sum(axis=1, dtype=np.int64))


def bound_holds(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the summed coordinate minima of points allow the overlap that a link needs."""
    return (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (minima(x, y) >= needed(a, b, percent))


class RTree:
    """Points packed by size and by the coordinate that varies most, in boxes of coordinate maxima and least and largest sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        slabs = np.array_split(np.argsort(sizes, kind="stable"), max(1, int((len(sizes) / FAN) ** 0.5)))
        widest = int(points.astype(np.float32).var(axis=0).argmax()) if len(points) else 0
        self.order = np.concatenate([s[np.argsort(points[s, widest], kind="stable")] for s in slabs])
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > FAN:
            p, low, high = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.maximum.reduceat(p, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def search(self, points: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, indexed point) that the bound lets through."""
        out_q, out_p = [], []
        for begin in range(0, len(sizes), 256):
            q = np.arange(begin, min(begin + 256, len(sizes)))
            top = len(self.levels[-1][1])
            qs, ns = np.repeat(q, top), np.tile(np.arange(top), len(q))
            for level in range(len(self.levels) - 1, -1, -1):
                box, low, high = self.levels[level]
                keep = []
                for a in range(0, len(qs), 8192):
                    x, n = qs[a : a + 8192], ns[a : a + 8192]
                    nearest = np.clip(sizes[x], low[n], high[n])  # the size in the box that needs least of the bound on sizes
                    fits = 100 * np.minimum(sizes[x], nearest) >= percent * np.maximum(sizes[x], nearest)
                    least = np.maximum(low[n], -(-percent * sizes[x] // 100))
                    keep.append(fits & (minima(points[x], box[n]) >= needed(sizes[x], least, percent)))
                keep = np.concatenate(keep) if keep else np.zeros(0, bool)
                qs, ns = qs[keep], ns[keep]
                if level:
                    size = len(self.levels[level - 1][1])
                    qs = np.repeat(qs, FAN)
                    ns = (ns[:, None] * FAN + np.arange(FAN)).ravel()
                    qs, ns = qs[ns < size], ns[ns < size]
            out_q.append(qs)
            out_p.append(self.order[ns])
        return (np.concatenate(out_q), np.concatenate(out_p)) if out_q else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _runs(frames: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Column arrays of each run of equal first column, from rows sorted by it (runs may span batches)."""
    held: list[list[np.ndarray]] = []

    def joined() -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*held, strict=True)]

    for b in frames:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
        cuts = np.flatnonzero(np.diff(cols[0])) + 1
        edges = [0, *cuts.tolist(), b.num_rows]
        if held and held[-1][0][-1] != cols[0][0]:
            yield joined()
            held = []
        for a, z in zip(edges, edges[1:], strict=False):
            if a:
                yield joined()
                held = []
            held.append([c[a:z] for c in cols])
    if held:
        yield joined()


def _pieces(frames: Iterator[pa.RecordBatch], columns: list[str], most: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs as ``_runs`` gives them, but those of more than ``most`` rows in pieces: the number of the piece in its run, and its arrays."""
    held: list[list[np.ndarray]] = []
    number, size = 0, 0

    def joined() -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*held, strict=True)]

    for b in frames:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
        edges = [0, *(np.flatnonzero(np.diff(cols[0])) + 1).tolist(), b.num_rows]
        last = held[-1][0][-1] if held else None
        for a, z in zip(edges, edges[1:], strict=False):
            if held and cols[0][a] != last:
                yield number, joined()
                held, number, size = [], 0, 0
            elif held and size >= most:
                yield number, joined()
                held, number, size = [], number + 1, 0
            held.append([c[a:z] for c in cols])
            size, last = size + z - a, cols[0][a]
    if held:
        yield number, joined()


def _emit(rows: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    cols = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=names)


def row_hash(key: str = "doc_id"):
    """Rows are found again by a hash of id and text: ids may be null or repeat."""
    return F.xxhash64(key, "text", F.length("text"))


def linked_rows(docs: DataFrame, words: int, percent: int, key: str = "doc_id") -> DataFrame:
    """doc_id, row (see ``row_hash``), n, component (a long that names it; null without words) of each row of ``docs`` (doc_id, text)."""
    spark, together = docs.sparkSession, TOGETHER
    texts = docs.select(F.col(key).alias("doc_id"), "text", row_hash(key).alias("row"))

    # 1. sizes, ids and points of the sets, and the sketch of token counts
    def describe(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.int64)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
        names = ["doc_id", "row", "n", "node", "data", "part"]
        for ids, hashes, ts in common.batches(frames, "doc_id", "row", "text"):
            rows = []
            for i, h, t in zip(ids, hashes, ts, strict=True):
                s = token_set(t, words)
                if len(s):
                    np.add.at(sketch, (s & np.uint64(SKETCH - 1)).astype(np.int64), 1)
                rows.append((i, h, len(s), set_ids(s) if len(s) else None, vector(s).tobytes() if len(s) else None, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        parts = [(None, None, 0, None, zlib.compress(sketch[a : a + SKETCH_ROW].astype("<i8").tobytes(), 1), a // SKETCH_ROW) for a in range(0, SKETCH, SKETCH_ROW) if sketch[a : a + SKETCH_ROW].any()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), types, strict=True)], names=names)

    described = common.stash(texts.mapInArrow(describe, "doc_id long, row long, n long, node long, data binary, part int"), "sets")
    sets = described.filter("part is null").select("doc_id", "row", "n", "node")

    def add(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for part, data in common.batches(frames, "part", "data"):
            for p, d in zip(part, data, strict=True):
                x = np.frombuffer(zlib.decompress(d), "<i8")
                total[p] = total[p] + x if p in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["part", "data"])

    # each part is summed in its own task, after sums of groups of tasks: the driver gets SKETCH counters, whatever the input
    counted = np.zeros(SKETCH, np.int64)
    grouped = described.filter("part is not null").select("part", "data", (F.spark_partition_id() % 64).alias("of")).repartition("part", "of").mapInArrow(add, "part int, data binary")
    for r in grouped.repartition("part").mapInArrow(add, "part int, data binary").collect():
        counted[r["part"] * SKETCH_ROW : (r["part"] + 1) * SKETCH_ROW] = np.frombuffer(zlib.decompress(r["data"]), "<i8")
    #: classes of frequency, relative to the mean counter, come before the hash in the order of tokens
    rank = np.clip(np.log2(np.maximum(counted, 1) / max(1.0, counted.mean())) * 2, 0, 63).astype(np.uint64)
    shared = spark.sparkContext.broadcast(rank.astype(np.uint8))

    # 2. prefix tokens of every set
    def prefixes(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        told: set[int] = set()  # texts whose copies need not be told again by this task
        for hashes, ts in common.batches(frames, "row", "text"):
            keys, nodes, sizes = [], [], []
            for h, t in zip(hashes, ts, strict=True):
                if h in told:
                    continue
                told.add(h)
                if len(told) > 30_000:
                    told.clear()
                s = token_set(t, words)
                if not len(s):
                    continue
                n = len(s)
                p = n - -(-percent * n // 100) + 1
                order = (classes[(s & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6))
                keys.append(s[np.argpartition(order, p - 1)[:p]] if p < n else s)
                nodes.append(np.full(p, set_ids(s), np.int64))
                sizes.append(np.full(p, n, np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes))], names=["key", "node", "n"])

    copies = texts.select(F.xxhash64("text", F.length("text")).alias("row"), "text")
    listed = copies.mapInArrow(prefixes, "key long, node long, n int")
    w = Window.partitionBy("key")
    lists = listed.withColumn("least", F.min("node").over(w)).withColumn("most", F.max("node").over(w)).filter("least <> most").select("key", "node", "n").sortWithinPartitions("key", "node")

    # 3. candidates: all pairs of short lists, a star and a chain of long ones; the rows of long lists are kept (b null)
    def candidates(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # of this task; another task's repeats fall to distinct()
        out: list[tuple] = []
        n_out = 0
        listed_row = lambda key, node, n: (np.full(len(node), key), node, np.full(len(node), -1), n, np.zeros(len(node), np.int64))
        centres = few = none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for number, (key_, node, n) in _pieces(frames, ["key", "node", "n"], together):
            node, first = np.unique(node, return_index=True)
            n = n[first].astype(np.int64)
            if number:  # nodes come in order, so the centres of a very long list are its first ones
                new = ~np.isin(node, np.concatenate((centres[0], few[0])))
                for part in (few, (node[new], n[new])):
                    out.append(listed_row(key_[0], *part))
                    n_out += len(part[0])
                node, n = (np.concatenate((c, x[new])) for c, x in zip(centres, (node, n), strict=True))
                few = none
            elif len(node) <= LEAF:
                few = (node, n)  # listed once it shows that more follow
            else:
                few = none
            if not number or len(centres[0]) < 2:
                centres = (node[:2], n[:2])
            m = len(node)
            if m < 2:
                continue
            if m <= LEAF and not number:
                i, j = np.triu_indices(m, 1)
            elif number:
                rest = np.arange(1, m)
                i, j = np.concatenate((np.zeros(m - 1, np.int64), np.ones(m - 2, np.int64))), np.concatenate((rest, rest[1:]))
            else:
                rest = np.arange(1, m)
                # in long lists the two least points are the centres, in shorter ones each point also meets the next
                i, j = np.concatenate((np.zeros(m - 1, np.int64), rest[:-1] if m <= CHAIN else np.ones(m - 2, np.int64))), np.concatenate((rest, rest[1:]))
                out.append(listed_row(key_[0], node, n))
                n_out += m
            fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            new = [(a, b) for a, b in zip(node[i[fits]].tolist(), node[j[fits]].tolist(), strict=True) if (a, b) not in seen]
            if new:
                seen.update(new)
                if len(seen) > 100_000:
                    seen.clear()
                ab = np.array(new, np.int64)
                out.append((np.zeros(len(ab), np.int64), ab[:, 0], np.ones(len(ab), np.int64), np.zeros(len(ab), np.int64), ab[:, 1]))
                n_out += len(ab)
            if n_out > 50_000:
                yield _emit(out, ["key", "a", "kind", "n", "b"])
                out, n_out = [], 0
        yield _emit(out, ["key", "a", "kind", "n", "b"])

    found = common.stash(lists.mapInArrow(candidates, "key long, a long, kind long, n long, b long"), "candidates")
    common.release(spark)  # the lists are the largest shuffle
    points = described.filter("node is not null").groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("data").alias("point"))
    points = common.stash(points, "points")

    def bounded(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, GROUPS) for c in ("x", "y"))
            ok = bound_holds(x, y, *(b.column(c).to_numpy() for c in ("na", "nb")), percent)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    def near(pairs: DataFrame, label: str) -> DataFrame:
        """Of distinct pairs of nodes, those that the bound of the points lets through."""
        left = points.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("point").alias("x"))
        right = points.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("point").alias("y"))
        return common.stash(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(bounded, "a long, b long"), f"{label}-near")

    def check(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, s = None, None
        for a, b, x, y in common.batches(frames, "a", "b", "x", "y"):
            out = []
            for i, j, t, u in zip(a, b, x, y, strict=True):
                if i != last:
                    last, s = i, token_set(t, words)
                v = token_set(u, words)
                both = len(np.intersect1d(s, v, True))
                if 100 * both >= percent * (len(s) + len(v) - both):
                    out.append((i, j))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def gathered(named: DataFrame, label: str) -> DataFrame:
        """One text of each set that pairs name; few of them are sought by a broadcast, more by a shuffle of the texts."""
        ends = named.select(F.col("a").alias("node")).unionByName(named.select(F.col("b").alias("node"))).distinct()
        ends = common.stash(ends.join(points.select("node", "row"), "node"), f"{label}-ends")
        sought = F.broadcast(ends) if ends.count() <= common.FEW else ends
        return common.stash(texts.select("row", "text").join(sought, "row").select("node", "text").dropDuplicates(["node"]), f"{label}-texts")

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        """Of pairs of nodes, those whose sets link."""
        bodies = gathered(pairs, label)
        both = pairs.join(bodies.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").join(bodies.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
        links = common.stash(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), f"{label}-links")
        common.discard(bodies)
        return links

    long = found.filter("kind = -1").select("key", F.col("a").alias("node"), "n")
    pairs = near(found.filter("kind = 1").select("a", "b").distinct(), "first")
    first = verified(pairs, "first")
    label = common.components(first, "first")
    named = lambda df, c: df.join(label.select(F.col("id").alias(c), F.col("component").alias("_c")), c, "left").withColumn("_c", F.coalesce("_c", c))

    # 4. pairs between components within long lists, by the trees
    tagged = named(long, "node").withColumnRenamed("_c", "component")
    mixed = tagged.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).filter("lo <> hi").select("key", "m")
    blocks = F.ceil(F.col("m") / SPLIT).cast("int")
    held = tagged.join(mixed, "key")
    # a pair is told by the least list that both are in, so each row brings its point's lesser lists
    lists_of = held.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    open_ = held.join(lists_of, "node").withColumn("lesser", F.filter("keys", lambda k: k < F.col("key"))).withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a list of several blocks is searched as pairs of blocks, each pair on its own
    spread = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "node", "n", "component", "lesser", (F.col("mine") <= F.col("other")).cast("long").alias("lower"), (F.col("mine") >= F.col("other")).cast("long").alias("upper")
    )
    spread = spread.join(points.select("node", "point"), "node")

    def search(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, node, n, comp, lower, upper, point, lesser in _runs(frames, ["cell", "node", "n", "component", "lower", "upper", "point", "lesser"]):
            x = np.frombuffer(b"".join(point), np.uint8).reshape(-1, GROUPS)
            p, q = np.flatnonzero(lower == 1), np.flatnonzero(upper == 1)
            if not len(p) or not len(q):
                continue
            i, j = RTree(x[p], n[p].astype(np.int64)).search(x[q], n[q].astype(np.int64), percent)
            i, j = q[i], p[j]
            ok = comp[i] != comp[j]
            if lower.all() and upper.all():  # one block with itself: each pair comes twice
                ok &= node[i] < node[j]
            i, j = i[ok], j[ok]
            lists = {r: frozenset(lesser[r].tolist()) for r in np.unique(np.concatenate((i, j))).tolist()}
            ok = np.fromiter((lists[u].isdisjoint(lists[v]) for u, v in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
            a, b = node[i[ok]], node[j[ok]]
            yield _emit([(np.minimum(a, b), np.maximum(a, b))], ["a", "b"])

    common.release(spark)
    cross = common.stash(spread.repartition("cell").sortWithinPartitions("cell").select("cell", "node", "n", "component", "lower", "upper", "point", "lesser").mapInArrow(search, "a long, b long").distinct(), "cross")
    if cross.limit(1).count():
        second = verified(near(cross.join(pairs, ["a", "b"], "left_anti"), "second"), "second")
        drawn = named(named(second, "a").withColumnRenamed("_c", "x"), "b").select(F.col("x").alias("a"), F.col("_c").alias("b"))
        more = common.components(drawn, "second")
        joined = label.join(more.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        # nodes that only the second round links
        label = joined.unionByName(more.join(label, "id", "left_anti").select("id", "component"))

    common.discard(found, pairs, points, cross)
    return sets.join(label.select(F.col("id").alias("node"), "component"), "node", "left").select("doc_id", "row", "n", F.coalesce("component", "node").alias("component"))


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text; others are ignored).

    Two rows link when 100 times the overlap of their sets of word shingles is
    at least ``percent`` times the size of the union; component_id is the
    smallest doc_id that links reach. Rows without words (null, empty, white
    space) have no tokens and link with nothing: their component is themselves.
    Texts shorter than a shingle are one token. Rows with equal ids and texts
    are equal sets. Sets are told apart by 64-bit hashes of their tokens. An
    empty table gives no rows.
    """
    member = linked_rows(docs, words, percent, key)
    least = member.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    several = common.listed(member.withColumnRenamed("n", "n_shingles"), common.stash(least.filter("n > 1"), "least"), ["component"], "left")
    return several.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, any others), all columns: of each component of links (see ``jaccard_components``) one row.

    The smallest doc_id stays, of several rows with it (or without an id, where
    no row has one) the one of the least hash of id and text. Rows equal in both
    are one, whatever their other columns hold; of these the row of the least
    hash of all columns stays. Rows without words link with nothing, so they
    stay. An empty table gives an empty one.
    """
    columns, name, full = docs.columns, common.unused(docs, "row"), common.unused(docs, "whole")
    member = linked_rows(docs, words, percent).select("doc_id", "row", "component").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("component").alias("component"), F.count("*").alias("times"))
    member = common.stash(member, "members")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = member.filter("component is not null").groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    others = common.listed(member, common.stash(first, "first-rows"), ["component"], "inner").filter(F.col("row") != F.col("first.row"))
    told = others.select("row", F.lit(False).alias("again")).unionByName(member.filter("times > 1").select("row", F.lit(True).alias("again")))
    told = common.stash(told.groupBy(F.col("row").alias(name)).agg(F.min("again").alias("again")), "told")
    rows = docs.withColumn(name, row_hash())
    parts = common.sought(rows, told, name)
    rest = parts[1] if parts else rows.join(told, name, "left_anti")
    again = told.filter("again").select(name)
    twice = rows.join(F.broadcast(again) if again.count() <= common.FEW else again, name, "left_semi")
    hashes = [c for c, t in docs.dtypes if not t.startswith("map")]
    one = twice.withColumn(full, F.xxhash64(*hashes)).groupBy(name).agg(F.min_by(F.struct(*columns), full).alias(full)).select(*[F.col(f"{full}.{c}").alias(c) for c in columns])
    return rest.select(*columns).unionByName(one)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under Jaccard similarity 0.85 of four-word shingles."""
    return jaccard_components(common.documents(spark, sf_dir))
