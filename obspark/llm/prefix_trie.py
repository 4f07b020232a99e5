"""Operator 11: the prefix trie of conversations, from their sorted order.

Every conversation becomes a key: the hashes of its turns, one after the other.
The keys are sorted by ranges, so equal beginnings lie side by side, and each
row gets the length of the prefix (lcp) it shares with the row before it. The nodes of the
trie at which something branches or ends are the intervals of that array: for a
value v all rows between the nearest smaller values to its left and right. That
is the Cartesian tree of the array, equal values merged. It is built in
parallel: each range runs a stack over its own values, and what reaches over a
range's edge looks for its nearest smaller value first among the minima of the ranges (a
number each) and then in that range's own chain of minima. Sums over a node's rows are
differences of running sums; the depths between a node and its parent hold the same rows and are
filled in from the turns.

No key, conversation or node gathers rows in a task: keys hold as many turns as tell
conversations apart, turns are grouped by 64, positions are counted by ranges
of turn numbers first, and equal conversations are spread over ranges by id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obspark.llm import common

#: Turns of a block, bytes of a turn's hash, turn numbers of a range in which positions are counted.
BLOCK, SYMBOL, NUMBERS = 64, 16, 4096
#: Conversations of a range, ranges at most (beyond that they grow), ids in a piece of a list.
ROWS, RANGES, IDS = 20_000, 65_536, 4096
NOTHING = hashlib.sha256(b"").hexdigest()


def copied_turns(conv_id) -> F.Column:
    """How many first turns a conversation takes from the first of its five."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def rebuilt(conversations: DataFrame, group: int = 5) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: their turns (c, p, symbol, size), and all of them with their lengths (c, length), turnless ones included.

    Of conversation c - c % group the first ``copied_turns`` come first, then c's
    own turns behind as many of its own. Turns of one number go by the hash of role and text.
    """
    role, text = (F.coalesce(x, F.lit("")) for x in ("role", "text"))
    symbol = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    bucket = F.coalesce(F.floor(F.col("turn") / NUMBERS), F.lit(-(1 << 62))).cast("long")
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), symbol.alias("symbol"), F.octet_length(text).cast("long").alias("size")).withColumn("bucket", bucket)
    sums = rows.groupBy("c", "bucket").agg(F.count("*").alias("n"))
    buckets = common.stash(sums.select("c", "bucket", "n", (F.sum("n").over(Window.partitionBy("c").orderBy("bucket")) - F.col("n")).alias("before")), "trie-buckets")
    base = F.col("c") - F.col("c") % group
    own = buckets.groupBy("c").agg(F.sum("n").alias("n")).withColumn("base", base).withColumn("h", F.when(F.col("base") == F.col("c"), 0).otherwise(copied_turns(F.col("c"))))
    own = common.stash(own, "trie-conversations")
    first = own.select(F.col("c").alias("base"), F.col("n").alias("there"))
    convs = own.join(first, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    copies = own.filter("h > 0").groupBy(F.col("base").alias("c")).agg(F.collect_list(F.struct(F.col("c").alias("c"), "h")).alias("copies"))  # of at most 2 * group conversations
    told = convs.select("c", "h", "taken").join(copies, "c", "left")
    places = buckets.select("c", "bucket", "before").join(told, "c")
    at = rows.join(places, ["c", "bucket"]).withColumn("at", F.col("before") + F.row_number().over(Window.partitionBy("c", "bucket").orderBy(F.asc_nulls_first("turn"), "symbol")) - 1)
    kind = "array<struct<c:bigint,p:bigint>>"
    mine = F.when(F.col("at") >= F.col("h"), F.array(F.struct(F.col("c").alias("c"), (F.col("at") - F.col("h") + F.col("taken")).alias("p")))).otherwise(F.array()).cast(kind)
    lent = F.transform(F.filter(F.coalesce("copies", F.array().cast("array<struct<c:bigint,h:bigint>>")), lambda k: k["h"] > F.col("at")), lambda k: F.struct(k["c"].alias("c"), F.col("at").alias("p"))).cast(kind)
    turns = at.select(F.inline(F.concat(mine, lent)), "symbol", "size")
    return turns, convs.select("c", "length")


def in_blocks(turns: DataFrame) -> DataFrame:
    """Turns by 64: c, block, symbols (their hashes, joined), sizes, before (bytes of the turns before each within the block), off (bytes before the block), x and y (hashes of the block in its place)."""
    held = turns.groupBy("c", F.floor(F.col("p") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("p", "symbol", "size"))).alias("t"))
    joined = F.unhex(F.array_join(F.transform("t", lambda t: F.hex(t["symbol"])), ""))
    before = F.transform(F.sequence(F.lit(1), F.size("sizes")), lambda i: F.aggregate(F.slice("sizes", F.lit(1), i - 1), F.lit(0).cast("long"), lambda a, x: a + x))
    rows = held.select("c", "block", joined.alias("symbols"), F.transform("t", lambda t: t["size"]).alias("sizes")).withColumn("before", before)
    total = F.element_at("before", -1) + F.element_at("sizes", -1)
    rows = rows.withColumn("off", F.sum(total).over(Window.partitionBy("c").orderBy("block")) - total)
    return rows.withColumns({"x": F.xxhash64("block", "symbols"), "y": F.xxhash64(F.lit(1), "symbols", "block")})


def sort_keys(blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each conversation: c, length, total (bytes), x and y (hashes of the whole), key and sizes of the turns in it.

    A key holds all turns up to one block; of longer conversations, the first
    64, 128, 256 ... turns that no different conversation begins with.
    """
    whole = blocks.groupBy("c").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.max(F.col("off") + F.element_at("before", -1) + F.element_at("sizes", -1)).alias("total"), F.max("block").alias("last"))
    whole = common.stash(convs.join(whole, "c", "left").fillna(0, ["x", "y", "total", "last"]), "trie-wholes")
    band = F.when(F.col("block") == 0, 0).otherwise(F.floor(F.log2(F.col("block").cast("double"))) + 1).cast("int")
    long = whole.filter("last > 0").select("c", F.struct("x", "y", "length").alias("w"))
    bands = blocks.select("c", band.alias("band"), "x", "y").join(long.select("c"), "c", "left_semi").groupBy("c", "band").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    up = Window.partitionBy("c").orderBy("band")
    begun = bands.select("c", "band", F.bit_xor("x").over(up).alias("px"), F.bit_xor("y").over(up).alias("py")).join(long, "c")
    shared = begun.groupBy("band", "px", "py").agg(F.min("w").alias("lo"), F.max("w").alias("hi")).filter("lo <> hi").select("band", "px", "py")
    shared = begun.join(shared, ["band", "px", "py"]).groupBy("c").agg((F.max("band") + 1).alias("bands"))
    used = F.when(F.col("last") == 0, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.coalesce("bands", F.lit(0)))).cast("long")
    named = whole.join(shared, "c", "left").withColumn("used", used)
    parts = blocks.join(named.select("c", "used"), "c").filter("block < used").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("block", "symbols", "sizes"))).alias("b"))
    key = F.unhex(F.array_join(F.transform("b", lambda b: F.hex(b["symbols"])), ""))
    parts = parts.select("c", key.alias("key"), F.flatten(F.transform("b", lambda b: b["sizes"])).alias("sizes"))
    empty = {"key": F.coalesce("key", F.lit(b"")), "sizes": F.coalesce("sizes", F.array().cast("array<bigint>"))}
    return named.select("c", "length", "total", "x", "y").join(parts, "c", "left").withColumns(empty)


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // SYMBOL
    return int(np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))[0]) // SYMBOL


@dataclass
class Row:
    """A conversation in sorted order."""

    c: int
    length: int
    total: int
    whole: tuple
    key: bytes
    sizes: list[int]

    def after(self, other: Row) -> tuple[int, int, bool, bool]:
        """Shared turns and their bytes, whether both are equal, and whether nothing continues the row before."""
        if self.whole == other.whole:
            return self.length, self.total, True, False
        n = common_turns(self.key, other.key)
        return n, sum(self.sizes[:n]), False, n < other.length


_SORTED = "range int, idx long, c long, length long, lcp long, shared long, equal boolean, ends boolean, total long, x long, y long, key binary, sizes array<long>"
_SORTED_KINDS = (pa.int32(), *[pa.int64()] * 5, pa.bool_(), pa.bool_(), *[pa.int64()] * 3, pa.binary(), pa.list_(pa.int64()))


def _batch(rows: list[tuple], kinds: tuple, schema: str) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])


def _emitted(rows: Iterator[tuple], kinds: tuple, schema: str, most: int = 5000) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield _batch(held, kinds, schema)
            held = []
    yield _batch(held, kinds, schema)


def _rows(frames: Iterator[pa.RecordBatch]) -> Iterator[Row]:
    for c, n, total, x, y, key, sizes in common.batches(frames, "c", "length", "total", "x", "y", "key", "sizes"):
        for v in zip(c, n, total, zip(x, y, n, strict=True), key, sizes, strict=True):
            yield Row(*v)


def sorted_rows(keys: DataFrame, ranges: int) -> DataFrame:
    """Conversations by ranges of (key, length, c): range, idx, c, length, and how each compares with the row before it in its range.

    The first row of a range has no such values; first and last rows keep their keys.
    """

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId()

        def told() -> Iterator[tuple]:
            before: Row | None = None
            waiting: tuple = ()
            for i, r in enumerate(_rows(frames)):
                if before is not None:
                    yield (*waiting, *((before.total, *before.whole[:2], before.key, before.sizes) if i == 1 else (None,) * 5))
                waiting = (own, i, r.c, r.length, *(r.after(before) if before is not None else (None,) * 4))
                before = r
            if before is not None:
                yield (*waiting, before.total, *before.whole[:2], before.key, before.sizes)

        yield from _emitted(told(), _SORTED_KINDS, _SORTED)

    # a conversation of one block may be all that a longer one's key holds: the shorter one comes first
    return keys.repartitionByRange(ranges, "key", "length", "c").sortWithinPartitions("key", "length", "c").mapInArrow(task, _SORTED)


def edge_rows(rows: DataFrame) -> DataFrame:
    """How the first row of each range compares with the last one of the range before: two rows a range, in one task."""
    schema = "range int, lcp long, shared long, equal boolean, ends boolean"

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[tuple]:
            before: Row | None = None
            for at, idx, c, n, total, x, y, key, sizes in common.batches(frames, "range", "idx", "c", "length", "total", "x", "y", "key", "sizes"):
                for k, i, *v, xx, yy, kk, ss in zip(at, idx, c, n, total, x, y, key, sizes, strict=True):
                    r = Row(*v, (xx, yy, v[1]), kk, ss)
                    if i == 0:
                        yield (k, *(r.after(before) if before is not None else (-1, 0, False, False)))
                    before = r

        yield from _emitted(told(), (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()), schema)

    return rows.filter("key IS NOT NULL").drop("lcp", "shared", "equal", "ends").repartition(1).sortWithinPartitions("range", "idx").mapInArrow(task, schema)


@dataclass
class Ranges:
    """A few numbers of each range that has rows, in order: what is known beyond a range's edges."""

    number: np.ndarray
    lcp: np.ndarray
    shared: np.ndarray
    equal: np.ndarray
    ends: np.ndarray
    least: np.ndarray  # least lcp
    least_c: np.ndarray
    start: np.ndarray  # position of the first row
    shared_before: np.ndarray
    ends_before: np.ndarray
    run: np.ndarray  # position at which the last run of equal rows that begins here begins, or -1
    rows: int
    all_shared: int
    all_ends: int

    @staticmethod
    def of(rows: DataFrame) -> Ranges:
        sums = rows.groupBy("range").agg(F.count("*").alias("n"), F.min("lcp").alias("least"), F.min("c").alias("c"), F.sum("shared").alias("shared"), F.sum(F.col("ends").cast("long")).alias("ends"), F.max(F.when(~F.col("equal"), F.col("idx"))).alias("run"))
        got = sums.join(edge_rows(rows).select("range", F.struct("lcp", "shared", "equal", "ends").alias("e")), "range").orderBy("range").collect()
        col = lambda f, kind=np.int64: np.array([f(r) for r in got], kind)
        n, shared, ends = col(lambda r: r.n), col(lambda r: (r.shared or 0) + r.e.shared), col(lambda r: (r.ends or 0) + r.e.ends)
        start = np.cumsum(n) - n
        run = np.array([s + r.run if r.run is not None else (-1 if r.e.equal else s) for s, r in zip(start.tolist(), got, strict=True)], np.int64)
        least = col(lambda r: min(r.e.lcp, r.least if r.least is not None else r.e.lcp))
        return Ranges(col(lambda r: r.range), col(lambda r: r.e.lcp), col(lambda r: r.e.shared), col(lambda r: r.e.equal, bool), col(lambda r: r.e.ends, bool), least, col(lambda r: r.c), start, np.cumsum(shared) - shared, np.cumsum(ends) - ends, run, int(n.sum()), int(shared.sum()), int(ends.sum()))

    def left(self, k: int, v: int) -> int:
        """The nearest range before ``k`` that holds a value below ``v``."""
        return int(np.flatnonzero(self.least[:k] < v)[-1])

    def right(self, k: int, v: int) -> int | None:
        hit = np.flatnonzero(self.least[k + 1 :] < v)
        return k + 1 + int(hit[0]) if len(hit) else None


#: What is known of a row at a node's edge: position, conversation, length, lcp, first row of the same node in its range, running sums.
EDGE = ("pos", "c", "length", "lcp", "f", "shared", "ends", "least")
_PIECES = "kind string, f long, v long, k long, ended long, least long, " + ", ".join(f"{s}_{e} long" for s in ("l", "r") for e in EDGE) + ", want_l int, want_r int, at int, ids string"
_PIECE_KINDS = (pa.string(), *[pa.int64()] * (5 + 2 * len(EDGE)), *[pa.int32()] * 3, pa.string())
_NONE = (None,) * len(EDGE)


class Sweep:
    """The stack over the rows of one range; gives pieces: nodes, leaves, chains of minima, and runs of equal conversations."""

    def __init__(self, info: Ranges, k: int):
        self.info, self.k = info, k
        self.stack: list[dict] = []
        self.i, self.shared, self.ends = int(info.start[k]), int(info.shared_before[k]), int(info.ends_before[k])
        self.least: int | None = None
        self.before: tuple | None = None
        self.run, self.run_ids, self.run_pieces = None, [], 0

    def node(self, e: dict, right: tuple | None) -> tuple:
        info, k, v, least = self.info, self.k, e["v"], e["least"]
        want_l = want_r = None
        if e["l"] is None:
            want_l = info.left(k, v)
            least = min([least, *info.least_c[want_l + 1 : k].tolist()])
        if right is None:
            want_r = info.right(k, v)
            least = min([least, *info.least_c[k + 1 : want_r].tolist()])
            if want_r is None:
                right = (info.rows, None, None, -1, None, info.all_shared, info.all_ends + 1, None)
        return ("node", e["f"], v, e["k"], e["ended"], least, *(e["l"] or _NONE), *(right or _NONE), want_l, want_r, k, None)

    def leaf(self, row: tuple, lcp: int, f: int | None) -> Iterator[tuple]:
        """A row that alone has its last turns; ``lcp`` and ``f`` are of the row after it."""
        own = max(row[3], lcp)
        if own < row[2]:
            parent = row[4] if row[3] >= lcp else f
            yield ("leaf", parent if own >= 0 else None, own, None, None, row[1], *row, *_NONE, None, None, self.k, None)

    def add(self, c: int, length: int, lcp: int, shared: int, equal: bool, ends: bool) -> Iterator[tuple]:
        i, stack, before = self.i, self.stack, self.before
        was = self.shared
        self.shared += shared
        self.ends += ends
        left = before
        least = before[1] if before else None
        popped = []
        while stack and stack[-1]["v"] > lcp:
            e = stack.pop()
            popped.append(e)
            left, least = e["l"], e["least"]
            if stack:
                stack[-1]["least"] = min(stack[-1]["least"], least)
        if stack and stack[-1]["v"] == lcp:
            e = stack[-1]
            e["k"] += 1
            e["ended"] += length == lcp
            e["least"] = min(e["least"], c)
        else:
            e = {"v": lcp, "l": left, "f": i, "k": 1, "ended": int(length == lcp), "least": c if least is None else min(least, c)}
            stack.append(e)
            if left is None and (before is None or popped):
                yield ("first", None, lcp, None, None, None, i, None, None, lcp, i, was, self.ends, self.least, *_NONE, None, None, self.k, None)
        row = (i, c, length, lcp, e["f"], self.shared, self.ends, None)
        e["last"] = row
        edge = (i, c, length, lcp, e["f"], was, self.ends, None)
        for p in popped:
            yield self.node(p, edge)
        if before:
            yield from self.leaf(before, lcp, e["f"])
        yield from self.runs(i, c, equal)
        self.before, self.i = row, i + 1
        self.least = c if self.least is None else min(self.least, c)

    def runs(self, i: int, c: int, equal: bool) -> Iterator[tuple]:
        """Ids of equal conversations, by the position at which their run begins."""
        if not equal:
            yield from self.run_end(False)
            self.run, self.run_pieces = i, 0
        elif self.run is None:
            self.run = int(self.info.run[: self.k].max())
            self.run_pieces = 1
        self.run_ids.append((i, c))
        if len(self.run_ids) == IDS:
            self.run_pieces += 1
            yield self.ids()

    def ids(self, whole: bool = False) -> tuple:
        text = ",".join(str(c) for _, c in self.run_ids)
        at = self.run_ids[0][0]
        self.run_ids = []
        return ("ends" if whole else "ids", self.run, at, None, None, None, *_NONE, *_NONE, None, None, self.k, hashlib.sha256(text.encode()).hexdigest() if whole else text)

    def run_end(self, goes_on: bool) -> Iterator[tuple]:
        if self.run_ids and (self.run_pieces or goes_on):
            yield self.ids()
        elif len(self.run_ids) > 1:
            yield self.ids(True)
        self.run_ids = []

    def close(self) -> Iterator[tuple]:
        info, k = self.info, self.k
        more = k + 1 < len(info.start)
        if self.before:
            yield from self.leaf(self.before, int(info.lcp[k + 1]) if more else -1, int(info.start[k + 1]) if more else None)
        yield from self.run_end(more and bool(info.equal[k + 1]))
        above: int | None = None
        for e in reversed(self.stack):
            # the rows from this value's last place to the end of the range are those of the entry above it
            from_last = e["last"][1] if above is None else above
            yield ("last", None, e["v"], None, None, None, *e["last"][:-1], from_last, *_NONE, None, None, k, None)
            e["least"] = above = min(e["least"], from_last)
            if e["v"] >= 0:
                yield self.node(e, None)


def pieces(rows: DataFrame, info: Ranges) -> DataFrame:
    """Nodes, leaves, chains and runs of each range of ``sorted_rows``."""
    of = {int(n): k for k, n in enumerate(info.number)}

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[tuple]:
            sweep: Sweep | None = None
            for at, *cols in common.batches(frames, "range", "c", "length", "lcp", "shared", "equal", "ends"):
                for n, c, length, lcp, shared, equal, ends in zip(at, *cols, strict=True):
                    if sweep is None or sweep.k != of[n]:
                        if sweep is not None:
                            yield from sweep.close()
                        k = of[n]
                        sweep = Sweep(info, k)
                        lcp, shared, equal, ends = int(info.lcp[k]), int(info.shared[k]), bool(info.equal[k]), bool(info.ends[k])
                    yield from sweep.add(c, length, lcp, shared, equal, ends)
            if sweep is not None:
                yield from sweep.close()

        yield from _emitted(told(), _PIECE_KINDS, _PIECES)

    dealt = rows.select("range", "idx", "c", "length", "lcp", "shared", "equal", "ends").repartition(max(1, len(info.start)), "range")
    return dealt.sortWithinPartitions("range", "idx").mapInArrow(task, _PIECES)


def resolved(nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """Nodes of one range, and those that reach over its edges with the rows at both ends looked up in other ranges' chains."""
    names = {s: [f"{s}_{e}" for e in EDGE] for s in ("l", "r")}
    edge = F.struct(*[F.col(f"l_{e}").alias(e) for e in EDGE])
    # rightmost smaller values end a range, so they answer requests from its right, which look to their left; and the other way round
    entries = chains.select(F.col("at").alias("range"), F.when(F.col("kind") == "last", "l").otherwise("r").alias("side"), "v", F.lit(1).alias("order"), F.lit(None).cast("long").alias("f"), edge.alias("edge"))
    asks = [nodes.filter(f"want_{s} IS NOT NULL").select(F.col(f"want_{s}").alias("range"), F.lit(s).alias("side"), "v", F.lit(0).alias("order"), "f", F.lit(None).cast(entries.schema["edge"].dataType).alias("edge")) for s in ("l", "r")]
    below = F.last("edge", ignorenulls=True).over(Window.partitionBy("range", "side").orderBy("v", "order").rowsBetween(Window.unboundedPreceding, 0))
    found = entries.unionByName(asks[0]).unionByName(asks[1]).withColumn("edge", below).filter("f IS NOT NULL")
    open_ = nodes.filter("want_l IS NOT NULL OR want_r IS NOT NULL")
    for s in ("l", "r"):
        mine = found.filter(F.col("side") == s).select("f", F.col("edge").alias(f"found_{s}"))
        open_ = open_.join(mine, "f", "left").withColumns({f"{s}_{e}": F.coalesce(f"{s}_{e}", F.col(f"found_{s}.{e}")) for e in EDGE}).drop(f"found_{s}")
    open_ = open_.withColumn("least", F.least("least", "l_least", "r_least"))
    kept = ["f", "v", "k", "ended", "least", *names["l"], *names["r"]]
    return nodes.filter("want_l IS NULL AND want_r IS NULL").select(*kept).unionByName(open_.select(*kept))


def ended_ids(runs: DataFrame) -> DataFrame:
    """Hashes of the lists of ids of equal conversations (l, ends): pieces of lists that several ranges hold are hashed one after the other."""

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[tuple]:
            now, h = None, None
            for run, ids in ((r, t) for b in common.sliced(frames, 64) for r, t in zip(b.column("f").to_pylist(), b.column("ids").to_pylist(), strict=True)):
                if h is None or run != now:
                    if h is not None:
                        yield now, h.hexdigest()
                    now, h = run, hashlib.sha256(ids.encode())
                else:
                    h.update(f",{ids}".encode())
            if h is not None:
                yield now, h.hexdigest()

        yield from _emitted(told(), (pa.int64(), pa.string()), "l long, ends string")

    hashed = runs.filter("kind = 'ids'").select("f", "v", "ids").repartition("f").sortWithinPartitions("f", "v").mapInArrow(task, "l long, ends string")
    return runs.filter("kind = 'ends'").select(F.col("f").alias("l"), F.col("ids").alias("ends")).unionByName(hashed)


def branches(found: DataFrame) -> DataFrame:
    """Nodes and leaves with what holds for all the depths from their parent (without it) down to their own: c (of any of their conversations), first and last depth, members, sums, parent's id."""
    node, leaf = found.filter("kind = 'node'"), found.filter("kind = 'leaf'")
    flat = common.stash(resolved(node, found.filter("kind IN ('first', 'last')")), "trie-nodes")
    up = F.greatest("l_lcp", "r_lcp")
    parent = F.when(up >= 0, F.when(F.col("l_lcp") >= F.col("r_lcp"), F.col("l_f")).otherwise(F.col("r_f")))
    one = flat.groupBy("l_pos", "v").agg(F.sum("k").alias("k"), F.sum("ended").alias("ended"), *[F.first(c).alias(c) for c in ("least", "l_c", "l_length", "l_lcp", "l_f", "l_shared", "l_ends", "r_pos", "r_lcp", "r_f", "r_shared", "r_ends")])
    ended = F.col("ended") + (F.col("l_length") == F.col("v")).cast("long")
    inner = one.withColumn("ended", ended).select(
        F.col("l_c").alias("c"), up.alias("above"), F.col("v").alias("depth"), (F.col("r_pos") - F.col("l_pos")).alias("n"), "least", "ended", (F.col("k") + 1 - F.col("ended")).alias("children"), (F.col("r_ends") - F.col("l_ends")).alias("leaves"), (F.col("r_shared") - F.col("l_shared")).alias("shared"), parent.alias("parent"), F.col("l_pos").alias("l")
    )
    lists = ended_ids(found.filter("kind IN ('ids', 'ends')"))
    listed = inner.filter("ended > 1").join(lists, "l", "left")
    single = F.when(F.col("ended") == 1, F.sha2(F.col("c").cast("string"), 256)).otherwise(NOTHING)
    both = listed.unionByName(inner.filter("ended <= 1").withColumn("ends", single))
    outer = leaf.select(F.col("l_c").alias("c"), F.col("v").alias("above"), F.col("l_length").alias("depth"), F.lit(1).alias("n"), F.col("l_c").alias("least"), F.lit(1).alias("ended"), F.lit(0).alias("children"), F.lit(1).alias("leaves"), F.lit(0).alias("shared"), F.col("f").alias("parent"), F.col("l_pos").alias("l"), F.sha2(F.col("l_c").cast("string"), 256).alias("ends"))
    names = flat.select(F.col("f").alias("parent"), F.col("least").alias("parent_conv_id"))
    return both.unionByName(outer).join(names, "parent", "left").drop("parent", "l", "ended")


def filled(branch: DataFrame, blocks: DataFrame) -> DataFrame:
    """All nodes: each depth of each branch, from the blocks of turns of one of its conversations, and the root."""
    stretch = 1 << 16
    low, high = F.floor(F.greatest("above", F.lit(0)) / BLOCK), F.floor((F.col("depth") - 1) / BLOCK)
    wide = branch.filter("depth > 0").withColumns({"low": low, "high": high}).withColumn("part", F.explode(F.sequence(F.floor(F.col("low") / stretch), F.floor(F.col("high") / stretch))))
    dealt = wide.withColumn("block", F.explode(F.sequence(F.greatest(F.col("low"), F.col("part") * stretch), F.least(F.col("high"), F.col("part") * stretch + stretch - 1)))).drop("low", "high", "part")
    rows = dealt.join(blocks.select("c", "block", "before", "off"), ["c", "block"]).select("*", F.posexplode("before").alias("i", "b")).withColumn("p", F.col("block") * BLOCK + F.col("i")).filter("p >= above and p < depth")
    last = F.col("p") + 1 == F.col("depth")
    out = rows.select(
        F.col("least").alias("conv_id"), (F.col("p") + 1).alias("depth"), F.when(F.col("p") == F.col("above"), F.col("parent_conv_id")).otherwise(F.col("least")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("shared") - (F.col("n") - 1) * (F.col("off") + F.col("b"))).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(NOTHING).alias("ends_sha256"),
    )
    at_root = F.col("depth") == 0
    root = branch.filter("above < 0").select(F.col("least").alias("conv_id"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(at_root, F.col("children")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("shared").alias("saved_tokens"), F.when(at_root, F.col("ends")).otherwise(NOTHING).alias("ends_sha256"))
    both = out.unionByName(root)
    return both.select(*[F.col(c).cast("long").alias(c) if c != "ends_sha256" else F.col(c) for c in both.columns])


def trie(turns: DataFrame, convs: DataFrame, rows: int = ROWS) -> DataFrame:
    """The nodes of the prefix trie of conversations, from their turns (c, p: position from 0, symbol: 16 bytes, size) and lengths (c, length).

    A row for each distinct sequence of first turns (see ``prefix_trie``);
    ``rows`` are the conversations of a range.
    """
    blocks = common.stash(in_blocks(turns), "trie-blocks")
    keys = common.stash(sort_keys(blocks, convs), "trie-keys")
    ranges = min(RANGES, max(1, math.ceil(keys.count() / rows)))
    order = common.stash(sorted_rows(keys, ranges), "trie-order")
    info = Ranges.of(order)
    found = common.stash(pieces(order, info), "trie-pieces")
    return filled(branches(found), blocks)


def prefix_trie(conversations: DataFrame, rows: int = ROWS) -> DataFrame:
    """The prefix trie of rebuilt ``conversations`` (conv_id, turn, role, text), a row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts count as empty. Turns go by number, null first; those of
    one number by the MD5 hash of role and text; repeated rows are turns of their
    own. Rows without a conv_id belong to no conversation and are left out. Texts
    count whole. Other columns are ignored; an empty table has no conversations, so no rows.
    """
    return trie(*rebuilt(conversations), rows)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
