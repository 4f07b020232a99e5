"""Relevance by cover density with quoted phrases, alternatives and exclusions, and trigram similarity over whole tables."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weight of a word without a label, what similarity adds, and the least similarity of a match.
WORD_WEIGHT, SIMILARITY_WEIGHT, LEAST_SIMILARITY = 0.1, 0.05, 0.3
_WORD = re.compile(r"[^\W_]+")
_PIECE = re.compile(r'-?"[^"]*"?|[^\s"]+')


@dataclass(frozen=True)
class Clause:
    """Words that follow each other; one that is excluded must not occur."""

    words: tuple[str, ...]
    excluded: bool = False


def parse(query: str) -> list[list[Clause]]:
    """Alternatives (between ``or``) of clauses that must hold together: words, "phrases", and both behind a minus.

    A word with marks inside (``a-b``) is the phrase of its parts; pieces without letters and digits are dropped.
    """
    groups: list[list[Clause]] = [[]]
    for piece in _PIECE.findall(query):
        if piece.lower() == "or":
            groups.append([])
            continue
        words = tuple(_WORD.findall(piece.lower()))
        if words:
            groups[-1].append(Clause(words, piece.startswith("-")))
    return [g for g in groups if g]


def words_of(groups: list[list[Clause]]) -> list[str]:
    return list(dict.fromkeys(w for g in groups for c in g for w in c.words))


def text_words(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits, accents kept; a null text has none."""
    low = F.lower(F.col(c) if isinstance(c, str) else c)
    return F.coalesce(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def occurrences(words: Column, sought: Sequence[str]) -> Column:
    """Where the sought words are: an array of (pos, word), positions from 1."""
    each = F.transform(words, lambda w, i: F.struct((i + 1).alias("pos"), w.alias("word")))
    return F.filter(each, lambda x: x["word"].isin(*sought)) if sought else F.filter(each, lambda x: F.lit(False))


def _ends_here(at: Column, entry: Column, i: Column, clause: Clause) -> Column:
    """A clause ends at an entry if its words stand at the positions before."""
    hold = entry["word"] == clause.words[-1]
    for back in range(1, len(clause.words)):
        before = F.get(at, i - back)
        hold = hold & F.coalesce((before["pos"] == entry["pos"] - back) & (before["word"] == clause.words[-1 - back]), F.lit(False))
    return hold


def _all(conditions: Sequence[Column]) -> Column:
    return functools.reduce(lambda x, y: x & y, conditions, F.lit(True))


def matches(at: Column, groups: list[list[Clause]]) -> Column:
    """Whether a text with these occurrences satisfies an alternative."""
    there = lambda c: F.exists(F.transform(at, lambda e, i: _ends_here(at, e, i, c)), lambda x: x)
    return functools.reduce(lambda x, y: x | y, [_all([~there(c) if c.excluded else there(c) for c in g]) for g in groups], F.lit(False))


def cover_density(at: Column, groups: list[list[Clause]]) -> Column:
    """Sum over the minimal covers of the query: a tenth for each, divided by one more than its words that the query doesn't have.

    A cover is a stretch of text that satisfies an alternative and holds no
    shorter one. One sweep over the occurrences keeps, for each clause, where it
    began last: the latest start of a cover that ends here is, over the
    alternatives, the largest of their least clause starts; it is a new cover if it lies
    behind the start of the cover before. An alternative whose excluded clause the text holds
    has no covers.
    """
    clauses = list(dict.fromkeys(c for g in groups for c in g if not c.excluded))
    if not clauses:
        return F.lit(0.0)
    there = lambda c: F.exists(F.transform(at, lambda e, i: _ends_here(at, e, i, c)), lambda x: x)
    none = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("i"))
    steps = F.transform(at, lambda e, i: F.struct(e["pos"].alias("pos"), i.alias("i"), *[_ends_here(at, e, i, c).alias(f"c{k}") for k, c in enumerate(clauses)]))

    def step(state: Column, s: Column) -> Column:
        n = lambda k: len(clauses[k].words) - 1
        last = [F.when(s[f"c{k}"], F.struct((s["pos"] - n(k)).alias("pos"), (s["i"] - n(k)).alias("i"))).otherwise(state[f"b{k}"]) for k in range(len(clauses))]
        starts = []
        for g in groups:
            kept = [last[clauses.index(c)] for c in g if not c.excluded]
            if not kept:
                continue
            start = F.least(*kept) if len(kept) > 1 else kept[0]
            out = [there(c) for c in g if c.excluded]
            starts.append(F.when(_all([~x for x in out]), start).otherwise(none) if out else start)
        best = F.greatest(*starts) if len(starts) > 1 else starts[0]
        new = best["pos"] > state["start"]
        noise = (s["pos"] - best["pos"]) - (s["i"] - best["i"])
        score = state["score"] + F.when(new, F.lit(WORD_WEIGHT) / (1 + noise)).otherwise(0.0)
        return F.struct(F.when(new, best["pos"]).otherwise(state["start"]).alias("start"), score.alias("score"), *[x.alias(f"b{k}") for k, x in enumerate(last)])

    begin = F.struct(F.lit(0).alias("start"), F.lit(0.0).alias("score"), *[none.alias(f"b{k}") for k in range(len(clauses))])
    return F.aggregate(steps, begin, step, lambda s: s["score"])


def word_trigrams(words: Column) -> Column:
    """Distinct trigrams of words, each padded with two blanks before and one behind."""
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of)))


def _shared(x: Column, y: Column) -> Column:
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(x) + F.size(y) - both).cast("double")), F.lit(0.0))


def text_relevance(candidates: DataFrame, column: str, query: str) -> DataFrame:
    """The candidates (other rows are never looked at) that match the query or are similar to it, with cover_density, similarity and relevance."""
    groups = parse(query)
    asked = word_trigrams(text_words(F.lit(query)))
    words = candidates.withColumn("_w", text_words(column)).withColumn("_at", occurrences(F.col("_w"), words_of(groups)))
    scored = words.withColumn("_m", matches(F.col("_at"), groups)).withColumn("similarity", _shared(word_trigrams(F.col("_w")), asked)).filter(F.col("_m") | (F.col("similarity") >= LEAST_SIMILARITY))
    scored = scored.withColumn("cover_density", cover_density(F.col("_at"), groups))
    return scored.withColumn("relevance", F.col("cover_density") + SIMILARITY_WEIGHT * F.col("similarity")).drop("_w", "_at", "_m")


#: Texts, and distinct trigram sets of queries, of a block.
BLOCK = 8192
#: Ids of queries of a block, about, and those that a task hands on at once.
IDS, HANDED = 1 << 20, 1 << 18
#: Tasks, at most, for the groups of blocks.
TASKS = 2000
#: Trigrams, and texts, that are counted at once.
WIDE, TALL = 2048, 1024


def _codes(grams: Column) -> Column:
    """Trigrams as numbers, 21 bits for each character."""
    code = lambda g, i: F.ascii(F.substring(g, i, 1)).cast("long")
    return F.transform(grams, lambda g: F.shiftleft(code(g, 1), 42) + F.shiftleft(code(g, 2), 21) + code(g, 3))


def _held(lists: pa.Array, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of sets, and (row, place in the sorted ``grams``) of each member that is there."""
    flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    place = np.minimum(np.searchsorted(grams, flat), len(grams) - 1)
    there = grams[place] == flat
    return sizes, np.repeat(np.arange(len(sizes)), sizes)[there], place[there]


def _alike(sets: pa.Array, asked: pa.Array, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of texts and of queries whose sets are as alike, and their similarity: shared trigrams are counted by products of 0-1 matrices."""
    grams = np.unique(asked.flatten().to_numpy())
    n, q_row, q_gram = _held(asked, grams)
    for at in range(0, len(sets), TALL):
        sizes, row, gram = _held(sets.slice(at, TALL), grams)
        shared = np.zeros((len(n), len(sizes)), np.float32)  # whole numbers, exact
        for first in range(0, len(grams), WIDE):
            wide = min(WIDE, len(grams) - first)
            x, y = np.zeros((len(n), wide), np.float32), np.zeros((wide, len(sizes)), np.float32)
            now, sought = (gram >= first) & (gram < first + wide), (q_gram >= first) & (q_gram < first + wide)
            x[q_row[sought], q_gram[sought] - first] = 1
            y[gram[now] - first, row[now]] = 1
            shared += x @ y
        # Most pairs are too far apart to be tested exactly; the small allowance is for float32.
        near = np.add.outer(n.astype(np.float32), sizes.astype(np.float32)) * np.float32(least / (1 + least) * (1 - 1e-5))
        j, i = np.nonzero(shared >= near)
        both = shared[j, i].astype(np.float64)
        similarity = both / (sizes[i] + n[j] - both)
        kept = similarity >= least
        yield at + i[kept], j[kept], similarity[kept]


def _dealt(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """Texts (id, grams) and distinct trigram sets of queries (grams, query_ids) by the group where they meet, each group in a partition of its own (up to TASKS)."""
    blocks = lambda n, size: max(1, -(-n // size))
    among = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grams = lambda c: _codes(word_trigrams(text_words(c)))
    parts = blocks(queries.count(), IDS)  # a set with very many queries is several rows
    asked = queries.select(F.struct("query_id").alias("query"), F.sort_array(grams("query")).alias("grams"), among(parts, "query", F.monotonically_increasing_id()).alias("part")).filter(F.size("grams") > 0)
    asked = asked.groupBy("grams", "part").agg(F.collect_list("query").alias("queries"))
    several, many = blocks(texts.count(), BLOCK), max(parts, blocks(asked.count(), BLOCK))
    x = texts.filter("text IS NOT NULL").select(among(several, "text", F.monotonically_increasing_id()).alias("t"), "id", "text").withColumn("q", every(many))
    # Few rows, but each is repeated for all blocks of texts: several tasks do that.
    y = asked.repartition(min(TASKS, several), "grams", "part").select(among(many, "grams", "part").alias("q"), "grams", F.col("queries.query_id").alias("query_ids")).withColumn("t", every(several))
    both = x.unionByName(y, allowMissingColumns=True).withColumn("group", F.col("t") * many + F.col("q")).repartitionById(min(TASKS, several * many), F.col("group"))
    return both.select("group", "id", F.when(F.col("query_ids").isNull(), grams("text")).otherwise(F.col("grams")).alias("grams"), "query_ids")


def similar_texts(texts: DataFrame, queries: DataFrame, least: float = LEAST_SIMILARITY, digits: int | None = None) -> DataFrame:
    """all pairs of a text (id, text) and a query (query_id, query) whose trigrams are as alike (``least`` > 0): query_id, id, similarity (rounded to ``digits``).

    Queries of one trigram set are compared once, and their ids stay together until the end. Texts and sets are dealt to blocks of
    about BLOCK rows; each block of texts meets each block of sets in a group of its own, where shared trigrams are counted for all
    pairs at once. So a text is sent once for each block of sets (as it is, it is shorter than its trigrams), a task holds one block
    of either, what is alike leaves it in pieces of about HANDED ids, and pairs are never shuffled: they are rows only at the end.
    """
    dealt = _dealt(texts, queries)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        x, y = rows.filter(pc.is_null(rows["query_ids"])), rows.filter(pc.is_valid(rows["query_ids"]))
        if not x.num_rows or not y.num_rows:
            return
        one = lambda c: pa.concat_arrays(c.chunks)
        ids, query_ids = one(x["id"]), one(y["query_ids"])
        lengths = np.diff(query_ids.offsets.to_numpy())
        for i, j, similarity in _alike(one(x["grams"]), one(y["grams"]), least):
            piece = np.cumsum(lengths[j]) // HANDED
            for some in np.split(np.arange(len(j)), np.flatnonzero(np.diff(piece)) + 1):
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(j[some])), ids.take(pa.array(i[some])), pa.array(similarity[some])], ["query_ids", "id", "similarity"])

    of = lambda c: dealt.schema[c].dataType.simpleString()
    found = dealt.groupBy("group").applyInArrow(task, f"query_ids {of('query_ids')}, id {of('id')}, similarity double")
    if digits is not None:
        found = found.withColumn("similarity", F.round("similarity", digits))
    return found.select(F.explode("query_ids").alias("query_id"), "id", "similarity")
