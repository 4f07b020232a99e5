"""Operator 9: repeated byte strings by merging Burrows-Wheeler transforms of shards.

Every window of ``length`` bytes picks an anchor, the byte string of GRAM bytes
in it of the least hash, the leftmost among equals; equal windows pick equal
anchors. Consecutive windows with the same anchor are a segment. Segments are
grouped by anchor: a segment that occurs twice is repeated whole, and only
segments that share an anchor but differ are compared.

These are compared by their suffixes. Symbols are blocks of length / DEPTH
bytes, so that a suffix's first DEPTH symbols are a window. The segments of
some anchors are split into shards; a shard's suffixes are sorted and give its
transform. The transforms are merged without sorting the suffixes again: an
interleave of the shards, at first by shard, is refined by one symbol a round
(the rows are dealt stably by their preceding symbols), and a boundary between
neighbours that a round makes is their longest common prefix. Neighbours that
have none after DEPTH rounds are a repeated interval.

A group of segments is merged in one task, so groups of many bytes are first
dealt out: windows that hold their anchor at relative positions lo to hi share
the bytes around it, and equal windows hold it at the same position, so a
segment is cut into cells of positions and each cell joins the others that
share these bytes. Cells of a group that are equal as a whole are repeated and
one of them goes on; those that nothing shares drop out; what is still large
is cut again, down to single windows. So a row becomes a few in each step and
only while others share its bytes. Texts are shuffled by row only, twice: to cut
out segments and to remove what repeats.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obspark.llm import common

LENGTH, DEPTH, GRAM = 400, 10, 64
#: Windows of a text that are looked at together, bytes of segments that are merged together, strings of a shard.
PIECE, CHUNK, SHARD = 1 << 19, 48_000, 32
#: Bytes of a group of segments that one task merges; larger groups are dealt out first.
MERGED = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
LOW = np.uint64((1 << 20) - 1)
PLACE, SIZE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


@functools.lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    n = PIECE + (1 << 16)
    up = np.full(n, BASE, np.uint64)
    down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def sums(x: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any stretch of bytes follows."""
    s = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * powers()[0][: len(x)], out=s[1:])
    return s


def stretch(s: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes between ``begin`` and ``end``."""
    return common.mix((s[end] - s[begin]) * powers()[1][begin])


def window_minima(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by running minima of blocks from both sides."""
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(v)] = v
    blocks = padded.reshape(-1, width)
    front = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], front[width - 1 : width - 1 + n])


def anchor_size(length: int) -> int:
    """Bytes of an anchor: GRAM, or a quarter of a shorter window."""
    return min(GRAM, max(1, length // 4))


def segments(x: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Segments of a text: anchor hash, content hash, first and last window, place of the anchor."""
    gram = anchor_size(length)
    out: list[tuple[np.ndarray, ...]] = []
    for off in range(0, len(x) - length + 1, PIECE):
        y = x[off : off + PIECE + length - 1]
        s = sums(y)
        at = np.arange(len(y) - gram + 1)
        h = stretch(s, at, at + gram)
        m = window_minima((h & ~LOW) | at.astype(np.uint64), length - gram + 1)
        first = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
        last = np.append(first[1:], len(m)) - 1
        p = (m[first] & LOW).astype(np.int64)
        content = common.mix(stretch(s, first, last + length) + (p - first).astype(np.uint64) * PLACE + (last - first).astype(np.uint64) * SIZE)
        out.append((h[p].view(np.int64), content.view(np.int64), first + off, last + off, p + off))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


def merged_spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that half-open intervals cover."""
    if not len(begin):
        return begin, end
    o = np.argsort(begin, kind="stable")
    b, reach = begin[o], np.maximum.accumulate(end[o])
    new = np.concatenate(([True], b[1:] > reach[:-1]))
    return b[new], reach[np.append(np.flatnonzero(new)[1:], len(b)) - 1]


# Transforms


def transform(code: np.ndarray, follow: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes of a shard's strings, and the symbol before each (0: none).

    ``code`` has a symbol (from 1) for each node, ``follow`` the node after it,
    or len(code) + t at the end of string t; ``ends`` is the last node of each
    string. Ends differ and are ordered by string.
    """
    n, t = len(code), len(ends)
    rank = np.concatenate((code + t, np.arange(t)))
    step = np.concatenate((follow, n + np.arange(t)))
    while True:
        pair = rank * np.int64(n + t + code.max() + 1 if n else 1) + np.where(np.arange(n + t) < n, rank[step], 0)
        order = np.argsort(pair, kind="stable")
        new = np.empty(n + t, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(pair[order][1:] != pair[order][:-1])))
        rank, step = new, step[step]
        if rank[order[-1]] == n + t - 1:
            break
    before = np.zeros(n + t, np.int64)
    inner = follow < n
    before[follow[inner]] = code[inner]
    before[n:] = code[ends]
    return order, before[order]


def merge(shards: list[tuple[np.ndarray, int]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of shards' transforms (symbols, number of strings) to ``depth`` symbols, and common prefixes.

    Returns the shard of each merged row and the longest common prefix of each
    row with the one above (``depth`` if at least that).
    """
    z = np.concatenate([np.full(len(b), i, np.int32) for i, (b, _) in enumerate(shards)])
    if len(shards) < 256:
        z = z.astype(np.uint8)
    all_symbols = np.concatenate([b for b, _ in shards])
    if not len(all_symbols) or all_symbols.max() < 65536:
        all_symbols = all_symbols.astype(np.uint16)
    ends = np.concatenate([np.full(t, i, z.dtype) for i, (_, t) in enumerate(shards)])
    t, n = len(ends), len(z)
    lcp = np.full(n, depth, np.int64)
    lcp[0] = 0
    block = np.zeros(n, np.int64)
    symbol = np.empty(n, all_symbols.dtype)
    for k in range(depth):
        symbol[np.argsort(z, kind="stable")] = all_symbols
        perm = np.argsort(symbol, kind="stable")[t:]
        s, b = symbol[perm], block[perm]
        edge = np.ones(n, bool)
        edge[t + 1 :] = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
        z = np.concatenate((ends, z[perm]))
        lcp[edge & (lcp == depth)] = k
        block = np.cumsum(edge)
    return z, lcp


def repeated_windows(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, which of its windows' strings start at another place of the segments, too."""
    block = length // DEPTH if length % DEPTH == 0 else 1
    depth = length // block
    sizes = np.array([len(p) for p in parts])
    x = np.frombuffer(b"".join(parts), np.uint8)
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    # a symbol at each place with a whole block of its segment ahead
    places = [base[i] + np.arange(n - block + 1) for i, n in enumerate(sizes)]
    s = sums(x) if len(x) <= PIECE else None
    flat = np.concatenate(places)
    if s is not None:
        hashes = stretch(s, flat, flat + block)
    else:
        hashes = np.concatenate([stretch(sums(y), np.arange(len(y) - block + 1), np.arange(len(y) - block + 1) + block) for y in (np.frombuffer(p, np.uint8) for p in parts)])
    codes = np.unique(hashes, return_inverse=True)[1] + 1
    counts = sizes - block + 1
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    shards, owners = [], []
    for a in range(0, len(parts), SHARD):
        z = min(a + SHARD, len(parts))
        lo, hi = starts[a], starts[z - 1] + counts[z - 1]
        code = codes[lo:hi]
        follow = np.arange(hi - lo) + block
        tails = []
        for i in range(a, z):  # of each segment, the strings of its ``block`` alignments end in its last places
            end = starts[i] + counts[i] - lo
            width = min(block, counts[i])
            follow[end - width : end] = hi - lo + sum(map(len, tails)) + np.arange(width)
            tails.append(np.arange(end - width, end))
        ends = np.concatenate(tails)
        order, before = transform(code, follow, ends)
        shards.append((before, len(ends)))
        owners.append(np.where(order < hi - lo, order + lo, -1))
    z, lcp = merge(shards, depth)
    node = np.empty(len(z), np.int64)
    node[np.argsort(z, kind="stable")] = np.concatenate(owners)
    same = lcp >= depth
    repeated = same | np.append(same[1:], False)
    hit = np.zeros(len(codes), bool)
    hit[node[repeated & (node >= 0)]] = True
    return [hit[starts[i] : starts[i] + n - length + 1] for i, n in enumerate(sizes)]


# Spark

FOUND = "anchor long, content long, row long, first long, last long, at long, weight long"
PIECES = "key long, content long, row long, first long, last long, at long, settled boolean, bytes binary"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def cells(row: int, first: int, last: int, at: int, settled: bool, data: bytes, shift: int, length: int) -> Iterator[tuple]:
    """A piece cut into cells of 2^shift places of its anchor: rows of PIECES, keyed by the bytes that all windows of the cell hold."""
    span = length - anchor_size(length) + 1
    for c in range((at - last) >> shift, ((at - first) >> shift) + 1):
        lo, hi = c << shift, min((c + 1) << shift, span) - 1
        a, z = max(first, at - hi), min(last, at - lo)
        inner = data[at - lo - first : at - hi - first + length]
        part = data[a - first : z - first + length]
        key, content = xxhash.xxh64_intdigest(inner, shift << 16 | c), xxhash.xxh64_intdigest(part, at - a)
        yield key - (1 << 63), content - (1 << 63), row, a, z, at, settled, part


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Stretches (row, first, last: windows) of ``rows`` (row, text) that repeat; ``row`` tells rows apart by their contents."""
    names = [c.split()[0] for c in FOUND.split(", ")]

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.batches(frames, "row", "text"):
            out: list[list[np.ndarray]] = []
            for row, text in zip(ids, texts, strict=True):
                anchor, content, first, last, place = segments(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8), length)
                if not len(anchor):
                    continue
                _, at, inverse, n = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
                if len(at) < len(content):  # a segment that repeats within the text is one row, and its places are stretches
                    twice = n[inverse] > 1
                    b, e = merged_spans(first[twice], last[twice] + 1)
                    zero = np.zeros(len(b), np.int64)
                    out.append([zero, zero, np.full(len(b), row), b, e - 1, zero, zero])
                out.append([anchor[at], content[at], np.full(len(at), row), first[at], last[at], place[at], n])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=names)

    def fetch(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the segments."""
        for ids, texts, cuts in common.batches(frames, "row", "text", "cuts"):
            out: list[tuple] = []
            for row, text, mine in zip(ids, texts, cuts, strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                out += [(c["anchor"], 0, row, c["first"], c["last"], c["at"], c["settled"], raw[c["first"] : c["last"] + length]) for c in mine]
                if len(out) > 20_000:
                    yield _table(out, PIECES)
                    out = []
            yield _table(out, PIECES)

    def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, int, bytes]] = []  # of whole groups
        group: list[tuple[int, int, bytes]] = []
        key, open_, size = None, False, 0

        def close() -> None:
            nonlocal group, open_, size
            if len(group) > 1 and open_:
                waiting.extend(group)
                size += sum(len(g[2]) for g in group)
            group, open_ = [], False

        def settle() -> pa.RecordBatch:
            nonlocal waiting, size
            spans: list[np.ndarray] = []
            for (row, first, _), hit in zip(waiting, repeated_windows([w[2] for w in waiting], length), strict=True) if waiting else ():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                spans.append(np.stack([np.full(len(edge) // 2, row), edge[::2] + first, edge[1::2] - 1 + first]))
            cols = np.concatenate(spans, axis=1) if spans else np.zeros((3, 0), np.int64)
            waiting, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols.astype(np.int64)], names=["row", "first", "last"])

        for part in common.batches(frames, "key", "row", "first", "settled", "bytes"):
            for k, row, first, settled, data in zip(*part, strict=True):
                if k != key:
                    close()
                    key = k
                    if size >= CHUNK:
                        yield settle()
                group.append((row, first, data))
                open_ |= not settled
        close()
        yield settle()

    def merged(pieces: DataFrame) -> DataFrame:
        dealt = pieces.select("key", "row", "first", "settled", "bytes").repartition("key").sortWithinPartitions("key")
        return dealt.mapInArrow(compare, "row long, first long, last long")

    def divided(pieces: DataFrame, shift: int) -> DataFrame:
        def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in common.batches(frames, "row", "first", "last", "at", "settled", "bytes"):
                yield _table([x for p in zip(*part, strict=True) for x in cells(*p, shift, length)], PIECES)

        return pieces.select("row", "first", "last", "at", "settled", "bytes").mapInArrow(task, PIECES)

    # 1. segments, and those that occur whole at several places
    found = common.stash(rows.select("row", "text").mapInArrow(cut, FOUND), "segments")
    spans = [found.filter("weight = 0").select("row", "first", "last")]
    shared = common.stash(found.filter("weight > 0").groupBy("anchor").agg(F.sum("weight").alias("n")).filter("n > 1"), "anchors")
    alike = common.stash(common.listed(found.filter("weight > 0"), shared, ["anchor"]), "shared")
    at = F.struct("row", "first", "last", "at")
    groups = common.stash(alike.groupBy("anchor", "content").agg(F.sum("weight").alias("n"), F.min(at).alias("place")), "contents")
    spans.append(common.listed(alike, groups.filter("n > 1").select("anchor", "content", "n"), ["anchor", "content"]).select("row", "first", "last"))

    # 2. the bytes of one segment of each content, of anchors with several contents
    variety = groups.groupBy("anchor").agg(F.count("*").alias("n"), F.min("n").alias("least")).filter("n > 1 and least = 1").select("anchor", "n")
    unlike = common.listed(groups, common.stash(variety, "variety"), ["anchor"]).select("anchor", (F.col("n") > 1).alias("settled"), "place.*")
    wanted = common.stash(unlike.groupBy("row").agg(F.collect_list(F.struct("anchor", "first", "last", "at", "settled")).alias("cuts")), "wanted")
    texts = rows.select("row", "text")
    held = ((common.sought(texts, wanted, "row") or (texts,))[0]).join(wanted, "row").dropDuplicates(["row"])
    pieces = common.stash(held.select("row", "text", "cuts").mapInArrow(fetch, PIECES), "pieces")

    # 3. small groups are merged, large ones dealt out by what their windows share
    shift, stale = (length - anchor_size(length) + 1).bit_length(), [found, shared, alike, groups, wanted, pieces]
    while True:
        large = pieces.groupBy("key").agg(F.sum(F.length("bytes")).alias("size")).filter(F.col("size") > MERGED).select("key")
        large = common.stash(large, "large")
        stale.append(large)
        if not large.limit(1).count():
            spans.append(merged(pieces))
            break
        dealt = common.sought(pieces, large, "key") or (pieces.join(large, "key", "left_semi"), pieces.join(large, "key", "left_anti"))
        spans.append(merged(dealt[1]))
        shift = max(0, shift - 2)
        parts = common.stash(divided(dealt[0], shift), "cells")
        each = parts.groupBy("key", "content").agg(F.count("*").alias("n"), F.max("settled").alias("settled"), F.min(at).alias("place"), F.first("bytes").alias("bytes"))
        each = common.stash(each, "kinds")
        spans.append(common.listed(parts.filter("not settled").select("key", "content", "row", "first", "last"), each.filter("n > 1").select("key", "content", "n"), ["key", "content"]).select("row", "first", "last"))
        open_ = each.groupBy("key").agg(F.count("*").alias("n"), F.max((F.col("n") == 1) & ~F.col("settled")).alias("open")).filter("n > 1 and open").select("key", "n")
        left = common.listed(each, common.stash(open_, "open"), ["key"])
        pieces = common.stash(left.select("key", F.lit(0).cast("long").alias("content"), "place.*", (F.col("settled") | (F.col("n") > 1)).alias("settled"), "bytes"), "pieces")
        stale += [parts, each, pieces]
    out = common.stash(functools.reduce(DataFrame.unionByName, spans), "spans")
    common.discard(*stale)
    return out


def with_stretches(docs: DataFrame, length: int, name: str) -> DataFrame:
    """Rows of ``docs``, all columns, with the windows that repeat as the column ``name`` (null: none)."""
    # rows with equal id and text are told apart by nothing and share their stretches, which count for each
    row = common.unused(docs, "row")
    rows = docs.withColumn(row, F.xxhash64("doc_id", "text", F.length("text")))
    found = repeated_spans(rows.select(F.col(row).alias("row"), "text"), length)
    gathered = common.stash(found.groupBy(F.col("row").alias(row)).agg(F.collect_set(F.struct("first", "last")).alias(name)), "stretches")
    parts = common.sought(rows, gathered, row)
    if parts is None:
        return rows.join(gathered, row, "left").drop(row)
    hit, rest = parts
    return hit.join(gathered, row).unionByName(rest.withColumn(name, F.lit(None).cast(gathered.schema[name].dataType))).drop(row)


def cut_text(text: str | None, stretches: list[dict] | None, length: int) -> tuple[bytes, np.ndarray, np.ndarray, bytes]:
    """A text's bytes, the begins and ends of what goes, and what is kept."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    mine = stretches or []
    b, e = merged_spans(np.array([m["first"] for m in mine], np.int64), np.array([m["last"] + length for m in mine], np.int64))
    edges = [0, *np.stack([b, e], 1).ravel().tolist(), len(raw)]
    return raw, b, e, b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Removes each byte that a string of ``length`` bytes covers which starts at another place, too.

    ``docs`` has doc_id and text, others are ignored; returns doc_id, n_bytes,
    spans (first byte, end), n_removed and kept (binary) of each row. Places
    are of all rows, matches never cross rows, and strings are judged on the
    input. Null and empty texts, and texts shorter than ``length``, lose
    nothing; repeated rows are each other's copies. An empty table gives no
    rows.
    """
    both = with_stretches(docs.select("doc_id", "text"), length, "stretches")

    def keep(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        for ids, texts, stretches in common.batches(frames, "doc_id", "text", "stretches"):
            out = []
            for i, text, mine in zip(ids, texts, stretches, strict=True):
                raw, b, e, kept = cut_text(text, mine, length)
                out.append((i, len(raw), [{"first": x, "end": y} for x, y in zip(b.tolist(), e.tolist(), strict=True)], len(raw) - len(kept), kept))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), span, pa.int64(), pa.binary()), strict=True)], names=["doc_id", "n_bytes", "spans", "n_removed", "kept"])

    return both.select("doc_id", "text", "stretches").mapInArrow(keep, "doc_id long, n_bytes long, spans array<struct<first:long, end:long>>, n_removed long, kept binary")


def without_repeats(docs: DataFrame, length: int) -> DataFrame:
    """``docs`` with all columns and the shortened texts, n_chars (if any) counted anew.

    Bytes of a character that a cut has split go with it. A row whose text is
    repeats alone goes; one that was empty or null stays as it is. Repeated
    rows are each other's copies, whatever their other columns hold, which may
    have any names. An empty table gives an empty one.
    """
    columns, schema = docs.columns, docs.schema
    name = common.unused(docs, "stretches")
    both = with_stretches(docs, length, name).select(*columns, name)

    def rewrite(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(frames):
            texts = [cut_text(t, m, length)[3].decode("utf-8", "ignore") if m else t for t, m in zip(b.column("text").to_pylist(), b.column(name).to_pylist(), strict=True)]
            cols = [b.column(c) for c in columns]
            cols[columns.index("text")] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                k = columns.index("n_chars")
                cols[k] = pa.array([o if not m else len(t) for t, m, o in zip(texts, b.column(name).to_pylist(), cols[k].to_pylist(), strict=True)], cols[k].type)
            stays = [not m or bool(t.strip()) for t, m in zip(texts, b.column(name).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=columns).filter(pa.array(stays, pa.bool_()))

    return both.mapInArrow(rewrite, schema)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the strings of 400 bytes that occur again; ``text`` is what is left, a character that a cut splits as U+FFFD."""
    out = remove_repeats(common.documents(spark, sf_dir))
    left = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), left)
