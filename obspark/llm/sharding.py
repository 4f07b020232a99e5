"""Operator 7: balanced label propagation of linked documents into shards.

Documents of equal texts are one weighted node; nodes are linked by hubs, values
that several of them share (here the hashes of all their lines, so near copies
share most of theirs). Labels start from a hash of a node's least hub, as far as shards have room. Each round
every hub counts the rows of its nodes in each shard by their present labels, every
node sums the shares of its hubs, and wishes for the shard where
most of its neighbours are. Moves are admitted under quotas: single rows swap between two
shards as far as both directions go, all others go to the best shard that has room, as far as that goes, the larger gains
first. Half of the nodes, drawn anew each round, may move, so that neighbours don't
pass each other. Rounds go on until neither half makes the cut fall by a hundredth.

Law ``rows``: counts are at most one apart. Documents without links carry no
edge, so filling with them cuts none. The driver sees a few numbers of each shard or pair of shards, and
the groups of over an eighth of a shard, which are placed first and stay; a group that no shard has
room for is split. Hubs and nodes are aggregated
before they are shuffled, and numbering adds up counts of small buckets, so no key's rows meet in
one task.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obspark.llm import common

SHARDS = 24
#: Rows of a bucket when rows are numbered.
BUCKET = 10_000
#: Groups of more than this part of a shard are placed before the rounds, by size.
LARGE = 8
#: Rounds of propagation at most, and the share by which the cut must fall for another round of either half.
ROUNDS, LEAST_FALL = 20, 0.01


def numbered(rows: DataFrame, group: list[str], total: int, name: str) -> DataFrame:
    """Numbers the rows of each group from 0, by a hash of the id, without gathering a group.

    Rows fall into buckets by a range of the hash of (group, id); a bucket's
    first number is the sum of the counts of the buckets before it.
    """
    buckets = max(1, total // BUCKET)
    h = F.xxhash64(*group, F.col("id"))
    rows = rows.withColumn("_h", h).withColumn("_b", F.pmod(F.shiftrightunsigned("_h", 20), F.lit(buckets)))
    counts = rows.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*group).orderBy("_b")
    before = counts.select(*group, "_b", (F.sum("_n").over(w) - F.col("_n")).alias("_from"))
    inner = Window.partitionBy(*group, "_b").orderBy("_h", "id", "row")
    return (
        rows.withColumn("_k", F.row_number().over(inner) - 1)
        .join(before, [*group, "_b"])
        .withColumn(name, F.col("_from") + F.col("_k"))
        .drop("_h", "_b", "_n", "_from", "_k")
    )


def line_hubs(text: Column) -> Column:
    """The hashes of all different lines of a text, blank ones left out: what near copies share."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def lay(hub, n: int, wish: int, room: list[int]) -> list[tuple]:
    """Pieces (hub, first, past, shard) of a group of ``n`` rows, taken from ``room``.

    The wish counts if it holds the whole group; else the tightest shard that
    does; a group that none holds fills the roomiest shards, so as few as can be.
    """
    pieces, at = [], 0
    while at < n:
        fits = [s for s, r in enumerate(room) if r >= n - at]
        if not fits:
            s = max(range(len(room)), key=lambda s: (room[s], s == wish, -s))
        elif wish in fits and not at:
            s = wish
        else:
            s = min(fits, key=lambda s: (room[s], s))
        k = min(room[s], n - at)
        pieces.append((hub, at, at + k, s))
        room[s] -= k
        at += k
    return pieces


def _listed(values: list[int]) -> Column:
    """A constant array: one literal, however many values."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def within(rows: DataFrame, key: str, quota: list[int], left: int, first: Column) -> DataFrame:
    """Adds ok: whether a row's ``n``, added to those of its ``key`` (a number below the quotas') before it, stays within the key's quota.

    The order is by ``first``, then a hash; sums are taken over small buckets.
    """
    h = F.xxhash64("node", F.lit(len(quota)))
    rows = rows.withColumns({"_h": h, "_c": first, "_b": F.pmod(F.shiftrightunsigned(h, 20), F.lit(max(1, left // BUCKET)))})
    sums = rows.groupBy(key, "_c", "_b").agg(F.sum("n").alias("_n"))
    before = sums.select(key, "_c", "_b", (F.sum("_n").over(Window.partitionBy(key).orderBy("_c", "_b")) - F.col("_n")).alias("_from"))
    inner = Window.partitionBy(key, "_c", "_b").orderBy("_h", "node").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_k", F.sum("n").over(inner)).join(before, [key, "_c", "_b"], "left")
    ok = F.col("_from") + F.col("_k") <= F.get(_listed(quota), F.col(key))
    return summed.withColumn("ok", F.coalesce(ok, F.lit(False))).drop("_h", "_c", "_b", "_from", "_k")


def started(nodes: DataFrame, room: list[int]) -> tuple[DataFrame, list[tuple]]:
    """First labels of nodes (node, n, seed): (node, n, shard), and pieces (node, first, past, shard) of those that no shard had room for; takes from ``room``.

    Each wishes for a shard by its seed, then for one drawn in proportion to room,
    round after round, the larger first, until only what fits no shard whole is left: fewer nodes than shards.
    """
    shards, pending, settled, number = len(room), nodes.select("node", "n", "seed"), None, 0
    while (left := pending.count()) > shards:
        h = F.xxhash64("node", F.lit(number))
        most = max(range(shards), key=lambda s: room[s])
        holds = lambda s: F.get(_listed(room), s) >= F.col("n")
        drawn = F.size(F.filter(_listed(list(accumulate(room))), lambda x: x <= F.pmod(h, F.lit(sum(room)).cast("long"))))
        wishes = [F.pmod(F.xxhash64("seed"), F.lit(shards)).cast("int")] * (number == 0) + [drawn, F.lit(most)]
        wished = pending.withColumn("to", F.coalesce(*[F.when(holds(s), s) for s in wishes]))
        marked = common.stash(within(wished, "to", room, left, -F.floor(F.log2("n"))), "started")
        for s, n in marked.filter("ok").groupBy("to").agg(F.sum("n")).collect():
            room[s] -= n
        now = marked.filter("ok").select("node", "n", F.col("to").alias("shard"))
        settled = now if settled is None else settled.unionByName(now)
        pending, number = marked.filter("not ok").select("node", "n", "seed"), number + 1
    pieces = [p for g in pending.orderBy(F.desc("n"), "node").collect() for p in lay(g["node"], g["n"], -1, room)]
    split = {p[0] for p in pieces if p[1]}
    whole = [(p[0], p[2], p[3]) for p in pieces if p[0] not in split]
    kind = nodes.schema["node"].dataType.simpleString()
    last = nodes.sparkSession.createDataFrame(whole, f"node {kind}, n long, shard int")
    return last if settled is None else settled.unionByName(last), [p for p in pieces if p[0] in split]


@dataclass
class Propagated:
    """Labels (node, n, shard) of the round with the least cut, and the cuts, the start's first."""

    labels: DataFrame
    cuts: list[float] = field(default_factory=list)


def hub_shares(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Each hub's rows (m), and how many of them each shard has by its nodes' labels (held: an array of shard and k)."""
    held = links.join(labels.select("node", "n", "shard"), "node").groupBy("hub", "shard").agg(F.sum("n").alias("k"))
    return held.groupBy("hub").agg(F.sum("k").alias("m"), F.collect_list(F.struct("shard", "k")).alias("held"))


def cut_of(shares: DataFrame) -> float:
    """Over all hubs, the rows that a row of the hub misses in its own shard, on average: 0 if every hub lies in one shard."""
    inside = F.aggregate("held", F.lit(0.0), lambda a, x: a + x["k"].cast("double") * x["k"])
    return float(shares.agg(F.coalesce(F.sum(F.round(F.col("m") - inside / F.col("m"), 6)), F.lit(0.0))).first()[0])


def propagate(links: DataFrame, labels: DataFrame, room: list[int], fixed: DataFrame | None = None, rounds: int = ROUNDS, hot: DataFrame | None = None) -> Propagated:
    """Label propagation over ``links`` (node, hub) of ``labels`` (node, n, shard) under the room of each shard, which it keeps up to date; with ``hot``, the hubs of several nodes (hub, n), ``links`` have no others.

    Each round counts votes from the present labels, so a move changes what the next round sees. It ends when in two rounds, one
    for either half of the nodes, the cut has fallen by less than LEAST_FALL; labels of a round in which it rose are not kept. Nodes of
    ``fixed`` vote, but stay. What a round caches can be made again from the labels and links, which are written.
    """
    shards = len(room)
    all_of = lambda df: df if fixed is None else df.unionByName(fixed)
    if hot is None:
        hot = common.stash(links.groupBy("hub").agg(F.count("*").alias("n")).filter("n > 1"), "hubs")
        links = common.stash(common.listed(links, hot, ["hub"]), "links")
    out, number, idle = Propagated(labels), 0, 0
    shares = common.stash(hub_shares(links, all_of(labels)), "shares")
    out.cuts.append(cut_of(shares))
    while number < rounds and out.cuts[-1] > 0 and idle < 2:
        wishes = common.stash(gains(links, hot, shares, out.labels, room, number), "wishes")
        moved = common.stash(admitted(wishes, room), "moved")
        flows = moved.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()
        number, idle = number + 1, idle + 1
        if flows:
            told = moved.select("node", "to")
            fresh = common.stash(out.labels.join(told, "node", "left").select("node", "n", F.coalesce("to", "shard").alias("shard")), "labels")
            after = common.stash(hub_shares(links, all_of(fresh)), "shares")
            cut = cut_of(after)
            if cut < out.cuts[-1]:
                for r in flows:
                    room[r["shard"]] += r["n"]
                    room[r["to"]] -= r["n"]
                idle = idle if cut > (1 - LEAST_FALL) * out.cuts[-1] else 0
                out.labels, fresh, shares, after = fresh, out.labels, after, shares
                out.cuts.append(cut)
            common.discard(fresh, after)
        common.discard(wishes, moved)
        common.release(links.sparkSession)
    common.discard(shares)
    return out


def gains(links: DataFrame, hot: DataFrame, shares: DataFrame, labels: DataFrame, room: list[int], number: int) -> DataFrame:
    """Nodes of the round's half that gain by a move: (node, n, shard, to, gain, pair, free, free_gain), the last two of the best shard that has room."""
    shards = len(room)
    # what a hub tells a node: the share of its rows in each shard, and (as shard -1) the share of one row
    told = F.concat(F.transform("held", lambda x: F.struct(x["shard"].alias("s"), (x["k"] / F.col("m")).alias("x"))), F.array(F.struct(F.lit(-1).alias("s"), (1 / F.col("m")).alias("x"))))
    each = common.listed(links, shares.select("hub", told.alias("told")).join(hot, "hub"), ["hub"], "inner").select("node", F.inline("told"))
    sums = each.groupBy("node", "s").agg(F.round(F.sum("x"), 9).alias("x")).groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("s", "x"))).alias("votes"))
    drawn = F.pmod(F.xxhash64("node", F.lit(number // 2)), F.lit(2)) == number % 2
    of = lambda s: F.coalesce(F.try_element_at("votes", s), F.lit(0.0))
    here = labels.filter(drawn).join(sums, "node").withColumn("own", of(F.lit(-1))).withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), of))
    each = F.transform("v", lambda x, s: F.struct(x.alias("x"), (-F.pmod(F.xxhash64(F.col("node"), s), F.lit(1 << 20))).alias("h"), s.alias("s")))
    best, free = F.array_max(each), F.array_max(F.filter(each, lambda x: F.get(_listed(room), x["s"]) >= F.col("n")))
    now = F.get("v", F.col("shard")) - F.col("n") * F.col("own")  # its own rows don't hold a node back
    wish = here.withColumns({"to": best["s"], "gain": best["x"] - now, "free": free["s"], "free_gain": free["x"] - now}).filter("gain > 1e-6")
    return wish.select("node", "n", "shard", "to", "gain", (F.col("shard") * shards + F.col("to")).alias("pair"), "free", "free_gain")


def admitted(wishes: DataFrame, room: list[int]) -> DataFrame:
    """The moves (node, n, shard, to) that quotas admit: single rows swap with others of the opposite wish; the rest goes to the best shard with room, as far as that goes."""
    shards, size = len(room), lambda gain: -F.floor(F.log2(gain) * 4)
    flow = {(r["shard"], r["to"]): r["n"] for r in wishes.filter("n = 1").groupBy("shard", "to").agg(F.count("*").alias("n")).collect()}
    quota = [min(flow.get((i, j), 0), flow.get((j, i), 0)) for i in range(shards) for j in range(shards)]
    total = sum(flow.values())
    swaps = within(wishes.filter("n = 1"), "pair", quota, total, size("gain"))
    others = swaps.filter("not ok").drop("ok").unionByName(wishes.filter("n > 1")).filter("free_gain > 1e-6")
    moved = within(others, "free", room, max(1, total), size("free_gain")).filter("ok").withColumn("to", F.col("free"))
    return swaps.filter("ok").unionByName(moved).select("node", "n", "shard", "to")


def linked_rows(rows: DataFrame, total: int, labels: DataFrame, pieces: list[tuple], large: list[tuple]) -> DataFrame:
    """Rows (id, row, shard) of labelled nodes (node, shard), of large ones (pieces of them), and of those that were split. Large nodes meet broadcast tables only."""
    spark, kind = rows.sparkSession, rows.schema["node"].dataType.simpleString()
    told = large + pieces
    split = {p[0] for p in told if p[1]}
    table = lambda x, *columns: F.broadcast(spark.createDataFrame(x, ", ".join([f"node {kind}", *columns])))
    whole = table([(h, s) for h, _, _, s in told if h not in split], "shard int")
    parts = table([p for p in told if p[0] in split], "first long", "past long", "shard int")
    out = rows.join(whole, "node").select("id", "row", "shard")
    if split:
        counted = numbered(rows.join(table([(h,) for h in split]), "node", "left_semi"), ["node"], total, "k")
        cut = counted.join(parts, "node").filter((F.col("k") >= F.col("first")) & (F.col("k") < F.col("past")))
        out = out.unionByName(cut.select("id", "row", "shard"))
    others = rows.join(table([(h,) for h in {p[0] for p in told}]), "node", "left_anti")
    return out.unionByName(others.join(labels.select("node", "shard"), "node").select("id", "row", "shard"))


def placed(rows: DataFrame, links: DataFrame, target: list[int]) -> tuple[DataFrame, list[tuple], list[tuple], list[int], Propagated]:
    """Labels of the nodes of ``rows`` (id, row, node) that are linked or hold several rows, pieces of those that were split or are large, and the room that is left."""
    shards, room = len(target), list(target)
    bound = sum(target) // shards // LARGE
    sizes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n"))
    hot = common.stash(links.groupBy("hub").agg(F.count("*").alias("n")).filter("n > 1"), "hubs")
    links = common.stash(common.listed(links, hot, ["hub"]), "links")
    linked = links.groupBy("node").agg(F.min("hub").alias("seed"))
    nodes = common.stash(sizes.join(linked, "node", "left").filter("n > 1 OR seed IS NOT NULL").select("node", "n", F.coalesce("seed", F.xxhash64("node")).alias("seed")), "nodes")
    # fewer than LARGE for each shard
    heavy = nodes.filter(F.col("n") > max(1, bound)).orderBy(F.desc("n"), "node").collect()
    large = [p for g in heavy for p in lay(g["node"], g["n"], -1, room)]
    labels, pieces = started(nodes.filter(F.col("n") <= max(1, bound)), room)
    labels = common.stash(labels, "labels")
    first = [(node, past - at, s) for node, at, past, s in large + pieces if at == 0]
    fixed = rows.sparkSession.createDataFrame(first, f"node {rows.schema['node'].dataType.simpleString()}, n long, shard int")
    found = propagate(links, labels, room, fixed, hot=hot)
    return found.labels, pieces, large, room, found


def shard_rows(nodes: DataFrame, shards: int = SHARDS, hubs: str | None = None) -> DataFrame:
    """Shard and slot of each row of ``nodes`` (id, hub, further columns kept; columns named shard or slot are replaced).

    Rows of one hub (a null one is none) stay together wherever a shard has room for them. ``hubs`` names an array column of values by
    which hubs are linked; neighbours are drawn to one shard. Rows with equal ids are rows of their own, each with a slot. An empty table gives
    an empty one; with fewer rows than shards some shards stay empty.
    """
    mark, others = common.unused(nodes, "row"), [c for c in nodes.columns if c.lower() not in ("shard", "slot")]
    nodes = common.stash(nodes.select(*others).withColumn(mark, F.monotonically_increasing_id()), "rows")
    total = nodes.count()
    target = [total // shards + (s < total % shards) for s in range(shards)]
    rows = nodes.select("id", F.col(mark).alias("row"), F.col("hub").alias("node"))
    several = F.array().cast("array<bigint>") if hubs is None else F.col(hubs)
    links = nodes.filter("hub IS NOT NULL").select(F.col("hub").alias("node"), F.explode(several).alias("hub")).distinct()
    labels, pieces, large, room, _ = placed(rows, common.stash(links, "hub-links"), target)
    kept = common.stash(linked_rows(rows, total, labels, pieces, large), "kept")
    rest = rows.select("id", "row").join(kept.select("row"), "row", "left_anti").withColumn("_all", F.lit(0))
    place = F.lit(shards - 1)
    for s, b in reversed(list(enumerate(accumulate(room)))):
        place = F.when(F.col("at") < b, s).otherwise(place)
    fill = numbered(rest, ["_all"], total, "at").select("id", "row", place.cast("int").alias("shard"))
    labels = common.stash(kept.unionByName(fill), "shards")
    slots = numbered(labels, ["shard"], total, "slot").select(F.col("row").alias(mark), "shard", "slot")
    return nodes.join(slots, mark).drop(mark, *([hubs] if hubs else []))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal counts, equal texts together, near copies where quotas allow; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    nodes = common.documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"),
        F.sha2(text, 256).alias("hub"),
        line_hubs(text).alias("lines"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    out = shard_rows(nodes, hubs="lines")
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
