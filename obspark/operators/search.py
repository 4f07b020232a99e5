"""Authorized hybrid search: bounded pool, text and vector channels, rank fusion, refinement, facets.

The scope filter and the structured filters come before everything else, so
they reach the scan; the pool's limit is part of the semantics and bounds what
the single-partition ranks see, whatever the table's size.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obspark.functions.numeric import cosine
from obspark.functions.text import keyword_score, query_terms, tokens
from obspark.operators.scope import Scope, authorized

POOL = 1000
# Fixed values of the fusion: rank constant, boosts and their caps; BM25's constants.
RANK_K, TAG_BOOST, SCALE_BOOST, BOOST_CAP = 60, 0.05, 0.1, 0.2
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@dataclass(frozen=True)
class Filters:
    """Structured filters; an empty list restricts nothing."""

    cameras: Sequence[str] = ()
    locations: Sequence[str] = ()
    videos: Sequence[str] = ()
    scales: Sequence[str] = ()
    tags: Sequence[str] = ()
    time_start: str | None = None
    time_end: str | None = None


def _containing(value: str):
    return lambda x: F.contains(F.lower(x), F.lit(value))


def _equal(value: str):
    return lambda x: x == F.lit(value)


def filtered(df: DataFrame, f: Filters) -> DataFrame:
    """Membership, overlap with a time range (ends count), tag substrings."""
    for column, values in (("camera_id", f.cameras), ("location_id", f.locations), ("video_id", f.videos), ("analysis_scale", f.scales)):
        if values:
            df = df.filter(F.col(column).isin(*values))
    if f.time_start:
        df = df.filter(F.col("observed_end") >= F.lit(f.time_start).cast("timestamp_ntz"))
    if f.time_end:
        df = df.filter(F.col("observed_start") <= F.lit(f.time_end).cast("timestamp_ntz"))
    for tag in f.tags:
        df = df.filter(F.exists("tags", _containing(tag.lower())))
    return df


def candidate_pool(df: DataFrame, scope: Scope, f: Filters = Filters(), limit: int = POOL) -> DataFrame:
    """What scope and filters leave, the earliest ``limit`` of it.

    The last place of the pool is found first, from times and ids; only rows up to it are read whole, so that no join
    below shuffles the texts of all others.
    """
    held, order = filtered(authorized(df, scope), f), ("observed_start", "record_id")
    place = F.struct(*order)
    last = held.select(*order).orderBy(*order).limit(limit).agg(F.max(place)).scalar()
    return held.filter(place <= last).orderBy(*order).limit(limit)


def by_ids(df: DataFrame, ids: Sequence[str], scope: Scope) -> DataFrame:
    """Records of the ids under the scope; no ids, no rows."""
    return authorized(df, scope).filter(F.col("record_id").isin(*ids) if ids else F.lit(False))


def ranked(df: DataFrame, score: Column | str, name: str, key: str = "record_id") -> DataFrame:
    """Dense ranks from 1, higher scores first, ids break ties; rows without a score have no rank."""
    s = F.col(score) if isinstance(score, str) else score
    return df.withColumn(name, F.when(s.isNotNull(), F.row_number().over(Window.orderBy(F.desc_nulls_last(s), key))))


def text_statistics(corpus: DataFrame, columns: Sequence[str], terms: Sequence[str]) -> Column:
    """a struct of the rows (n) and, for each channel, its tokens (length_) and the rows that have each term (d_): one pass over the corpus.

    It is a scalar subquery: nothing runs before the search that it is part of.
    """
    distinct = list(dict.fromkeys(terms))
    arrays = corpus.select(*[tokens(c).alias(c) for c in columns])
    sums = [F.count("*").alias("n")]
    for c in columns:
        sums.append(F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(f"length_{c}"))
        sums += [F.coalesce(F.sum(F.array_contains(c, t).cast("int")), F.lit(0)).alias(f"d_{c}_{i}") for i, t in enumerate(distinct)]
    return arrays.agg(*sums).select(F.struct("*").alias("s")).scalar()


class TextStatistics(Protocol):
    """What a text index tells about its corpus."""

    def statistics(self, columns: Sequence[str], terms: Sequence[str]) -> Column:
        """A struct as ``text_statistics`` gives it."""


def inverse_frequency(n: Column, d: Column) -> Column:
    """weight of a term that d of n rows have."""
    return F.greatest(F.lit(LEAST_IDF), F.log((n - d + 0.5) / (d + 0.5)))


def saturated(tf: Column, size: Column, mean: Column) -> Column:
    """a term's frequency in a text of ``size`` tokens."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


def bm25(df: DataFrame, column: str, query: str, corpus: DataFrame | None = None, statistics: Column | None = None) -> DataFrame:
    """rows of ``df`` with ``bm25`` of the channel ``column`` (null: no term occurs).

    Statistics are of the whole ``corpus`` (``df`` by default); a term that the
    query repeats counts again.
    """
    terms = query_terms(query)
    if not terms:
        return df.withColumn("bm25", F.lit(None).cast("double"))
    statistics = statistics if statistics is not None else text_statistics(df if corpus is None else corpus, [column], terms)
    of = lambda name: F.col(f"_st.{name}").cast("double")
    mean = F.coalesce(F.nullif(of(f"length_{column}") / F.greatest(F.lit(1.0), of("n")), F.lit(0.0)), F.lit(1.0))
    distinct = list(dict.fromkeys(terms))
    total = F.lit(0.0)
    for t in terms:
        tf = F.size(F.filter("_t", _equal(t)))
        total = total + inverse_frequency(of("n"), of(f"d_{column}_{distinct.index(t)}")) * saturated(tf, F.size("_t"), mean)
    scored = df.withColumn("_t", F.coalesce(tokens(column), F.array().cast("array<string>"))).withColumn("_st", statistics)
    return scored.withColumn("bm25", F.when(F.arrays_overlap("_t", F.array(*map(F.lit, distinct))), total)).drop("_t", "_st")


def keyword(df: DataFrame, column: str, query: str) -> DataFrame:
    """rows with ``keyword``, the number of query terms that the channel contains (null: none)."""
    return df.withColumn("keyword", F.nullif(keyword_score(column, query_terms(query)), F.lit(0)))


def vector_scores(pool: DataFrame, vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    """Rows with ``similarity``, the larger of the channels' cosines where positive (null: no vector).

    Vectors are restricted to the pool's records before any is scored.
    """
    q = F.array(*map(F.lit, map(float, query)))
    near = vectors.join(F.broadcast(pool.select("record_id")), "record_id", "left_semi").withColumn("s", cosine(F.col("embedding"), q)).filter("s > 0")
    return pool.join(near.groupBy("record_id").agg(F.max("s").alias("similarity")), "record_id", "left")


@dataclass(frozen=True)
class Request:
    """A search; ``mode`` is static_attribute, dynamic_event or hybrid."""

    query: str = ""
    mode: str = "hybrid"
    tags: Sequence[str] = ()
    preferred_scales: Sequence[str] = ()
    filters: Filters = field(default_factory=Filters)
    top_k: int = 20
    text: str = "bm25"


def rank(pool: DataFrame, request: Request, corpus: DataFrame | None = None, vectors: DataFrame | None = None, vector: Sequence[float] | None = None, index: TextStatistics | None = None) -> DataFrame:
    """Q6: ranks a pool: channels, fallback, boosts, fusion, order. Adds rank, final_score and the channel ranks.

    A text channel that matches nothing falls back to counting substrings.
    Rows that no channel matches go, unless none matches any. Without a query,
    the order is by time and id. Corpus statistics come from a kept ``index``, or are counted over the corpus.
    """
    if not query_terms(request.query):
        w = Window.orderBy("observed_start", "record_id")
        out = pool.withColumn("rank_static", F.row_number().over(w)).withColumn("rank_dynamic", F.lit(None).cast("int")).withColumn("rank_vector", F.lit(None).cast("int"))
        out = out.withColumns({"tag_boost": F.lit(0.0), "scale_boost": F.lit(0.0), "final_score": F.lit(1.0) / (F.col("rank_static") + RANK_K)})
        return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("final_score"), "record_id")))
    channels = {"static_attribute": ("static",), "dynamic_event": ("dynamic",)}.get(request.mode, ("static", "dynamic"))
    columns, terms = [f"{c}_text" for c in channels], query_terms(request.query)
    statistics = None if request.text != "bm25" else index.statistics(columns, terms) if index is not None else text_statistics(pool if corpus is None else corpus, columns, terms)
    out = pool
    for c in ("static", "dynamic"):
        if c not in channels:
            out = out.withColumn(f"rank_{c}", F.lit(None).cast("int"))
            continue
        text = f"{c}_text"
        out = keyword(bm25(out, text, request.query, corpus, statistics) if request.text == "bm25" else out.withColumn("bm25", F.lit(None).cast("double")), text, request.query)
        found = F.max(F.col("bm25").isNotNull()).over(Window.partitionBy())
        out = out.withColumn("_s", F.when(found, F.col("bm25")).otherwise(F.col("keyword").cast("double"))).drop("bm25", "keyword")
        out = ranked(out, "_s", f"rank_{c}").drop("_s")
    if vectors is not None and vector is not None:
        out = ranked(vector_scores(out, vectors, vector), "similarity", "rank_vector").drop("similarity")
    else:
        out = out.withColumn("rank_vector", F.lit(None).cast("int"))
    matched = F.coalesce("rank_static", "rank_dynamic", "rank_vector").isNotNull()
    out = out.withColumn("_m", matched).withColumn("_any", F.max("_m").over(Window.partitionBy())).filter("_m OR NOT _any").drop("_m", "_any")
    return fused(out, request)


def fused(df: DataFrame, request: Request) -> DataFrame:
    """Reciprocal ranks of the channels, capped boosts (tag_boost, scale_boost), and the final rank."""
    part = lambda c: F.coalesce(F.lit(1.0) / (F.col(c) + RANK_K), F.lit(0.0))
    low = F.transform("tags", lambda t: F.lower(t))
    tag = sum((F.array_contains(low, t.lower()).cast("int") for t in request.tags), F.lit(0)) * TAG_BOOST
    scale = F.when(F.col("analysis_scale").isin(*request.preferred_scales), SCALE_BOOST).otherwise(0.0) if request.preferred_scales else F.lit(0.0)
    out = df.withColumn("tag_boost", F.least(F.lit(BOOST_CAP), tag)).withColumn("scale_boost", F.least(F.lit(BOOST_CAP), scale))
    out = out.withColumn("final_score", part("rank_static") + part("rank_dynamic") + part("rank_vector") + F.col("tag_boost") + F.col("scale_boost"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("final_score"), "record_id")))


def checked(top_k: int, most: int = 100) -> int:
    """How many results are wanted, if that is allowed."""
    if not 1 <= top_k <= most:
        raise ValueError(f"limit_exceeded: top_k must be from 1 to {most}")
    return top_k


def results(ranked_: DataFrame, top_k: int) -> DataFrame:
    """The first ``top_k`` with a preview of 200 characters."""
    return ranked_.filter(F.col("rank") <= checked(top_k)).select("rank", "record_id", F.round("final_score", 6).alias("score"), F.substring("static_text", 1, 200).alias("preview"))


def detailed(ranked_: DataFrame, top_k: int) -> DataFrame:
    """The first ``top_k`` with scale, times, preview, and what each channel and boost adds to the score, to 6 digits."""
    part = lambda c: F.round(F.lit(1.0) / (F.col(c) + RANK_K), 6)
    detail = F.struct(*[part(f"rank_{c}").alias(c) for c in ("static", "dynamic", "vector")], F.round("tag_boost", 6).alias("tag_boost"), F.round("scale_boost", 6).alias("scale_boost"))
    return ranked_.filter(F.col("rank") <= checked(top_k)).select("rank", "record_id", F.round("final_score", 6).alias("score"), detail.alias("detail"), F.substring("static_text", 1, 200).alias("preview"), "analysis_scale", "observed_start", "observed_end")


def search(df: DataFrame, scope: Scope, request: Request, vectors: DataFrame | None = None, vector: Sequence[float] | None = None, index: TextStatistics | None = None) -> DataFrame:
    """Q1: scope, pool, ranking and top-k; corpus statistics are of all rows, as a text index has them."""
    scope.require("observation.search")
    return results(rank(candidate_pool(df, scope, request.filters), request, df, vectors, vector, index), request.top_k)


@dataclass(frozen=True)
class Started:
    """A search that has started: its results, the candidates of its first revision, their facets, and what the audit log gets."""

    results: DataFrame
    candidates: DataFrame
    facets: DataFrame
    audit: DataFrame


def start(df: DataFrame, scope: Scope, request: Request, context_id: str, vectors: DataFrame | None = None, vector: Sequence[float] | None = None) -> Started:
    """Q1, Q4, K8: a search with its first revision, facets of it and an audit row.

    The order is cut to ``top_k`` first: the revision, the facets and the audit's record ids are of what the search returns.
    """
    scope.require("observation.search")
    ordered = rank(candidate_pool(df, scope, request.filters), request, df, vectors, vector).filter(F.col("rank") <= checked(request.top_k))
    candidates = detailed_candidates(ordered, context_id)
    audit = candidates.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "record_id"))), lambda x: x["record_id"]).alias("record_ids"))
    audit = audit.select(F.lit("query").alias("event_type"), F.lit(scope.principal).alias("principal_id"), F.lit(scope.digest()).alias("resource_scope_hash"), F.lit(context_id).alias("context_id"), "record_ids", F.size("record_ids").cast("long").alias("candidates"))
    return Started(detailed(ordered, request.top_k), candidates, revision_facets(df, scope, candidates), audit)


def detailed_candidates(ordered: DataFrame, context_id: str, revision: int = 0) -> DataFrame:
    """K8: candidates of a revision."""
    return ordered.select(F.lit(f"{context_id}:{revision}").alias("revision_id"), "record_id", "rank", F.round("final_score", 6).alias("score"))


def revision_facets(df: DataFrame, scope: Scope, candidates: DataFrame) -> DataFrame:
    """Facets (facet, value, n) of the candidates that the scope still permits: all cameras, locations, scales and hours, and the most frequent tags."""
    held = authorized(df, scope).join(F.broadcast(candidates.select("record_id")), "record_id", "left_semi")
    columns = (("camera", "camera_id"), ("location", "location_id"), ("scale", "analysis_scale"))
    each = F.array(*[F.struct(F.lit(k).alias("facet"), F.col(c).alias("value")) for k, c in columns], F.struct(F.lit("hour").alias("facet"), F.date_format("observed_start", "yyyy-MM-dd HH:00").alias("value")))
    counted = held.select(F.inline(each)).groupBy("facet", "value").agg(F.count("*").alias("n"))
    return counted.unionByName(facet_tags(held).select(F.lit("tag").alias("facet"), F.col("tag").alias("value"), "n"))


def of_video(df: DataFrame, scope: Scope, video_id: str, limit: int = 50, after: tuple[int, str] | None = None) -> DataFrame:
    """Permitted records of a video by their start, a page of ``limit`` after the last row (start, id) of the page before."""
    rows = authorized(df, scope).filter(F.col("video_id") == video_id)
    if after is not None:
        rows = rows.filter((F.col("segment_start_ms") > after[0]) | ((F.col("segment_start_ms") == after[0]) & (F.col("record_id") > after[1])))
    return rows.orderBy("segment_start_ms", "record_id").limit(limit)


def mentioning(df: DataFrame, scope: Scope, query: str, limit: int = 100) -> DataFrame:
    """Permitted records whose texts or tags have a term of the query as a substring, the earliest first."""
    terms = query_terms(query)
    tagged = F.exists("tags", lambda t: functools.reduce(lambda x, y: x | y, [F.contains(F.lower(t), F.lit(q)) for q in terms], F.lit(False)))
    hit = (keyword_score("static_text", terms) + keyword_score("dynamic_text", terms) > 0) | tagged
    return authorized(df, scope).filter(hit).orderBy("observed_start", "record_id").limit(limit)


def narrow_by_tags(df: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Rows that have all tags, exactly."""
    return df.filter(F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0)


def filter_by_scale(df: DataFrame, scales: Sequence[str]) -> DataFrame:
    """Q2e, P9: rows of the scales; none given, all rows."""
    return df.filter(F.col("analysis_scale").isin(*scales)) if scales else df


def rerank_score(query: str, text: Column) -> Column:
    """the share of the query's words that a text has, to 6 digits."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.lit(query)), r"\s+"), lambda x: x != ""))
    mine = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")
    return F.round(F.size(F.array_intersect(words, mine)) / F.size(words), 6)


def rerank_head(ranked_: DataFrame, query: str, top_n: int) -> DataFrame:
    """The first ``top_n`` by the reranker's score of the static text, the rest as they were."""
    out = ranked_.withColumn("rerank_score", F.when(F.col("rank") <= top_n, rerank_score(query, F.col("static_text"))))
    w = Window.orderBy((F.col("rank") > top_n).cast("int"), F.desc_nulls_last("rerank_score"), F.when(F.col("rank") > top_n, F.col("rank")), "record_id")
    return out.withColumn("final_rank", F.row_number().over(w))


def facet_tags(df: DataFrame, most: int = 10) -> DataFrame:
    """The most frequent tags; ties by first appearance (record, then position)."""
    t = df.select("record_id", F.posexplode("tags").alias("pos", "tag"))
    first = F.min(F.struct("record_id", "pos"))
    return t.groupBy("tag").agg(F.count("*").alias("n"), first.alias("first")).orderBy(F.desc("n"), "first").limit(most).select("tag", "n")


def facet(df: DataFrame, column: str) -> DataFrame:
    """Counts by a column."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def facet_hours(df: DataFrame) -> DataFrame:
    """Counts by hour of the observed start."""
    return df.groupBy(F.date_trunc("hour", "observed_start").cast("timestamp_ntz").alias("bucket_start")).agg(F.count("*").alias("n"))


def overlapping(df: DataFrame, scope: Scope, record_id: str, pad_ms: int = 0, limit: int = 50) -> DataFrame:
    """Other permitted records of the same video whose interval overlaps the record's, widened by ``pad_ms``; touching is no overlap."""
    mine = authorized(df, scope)
    t = mine.filter(F.col("record_id") == record_id).select("video_id", F.col("segment_start_ms").alias("s"), F.col("segment_end_ms").alias("e"))
    hit = mine.join(F.broadcast(t), "video_id").filter((F.col("record_id") != record_id) & (F.col("segment_start_ms") < F.col("e") + pad_ms) & (F.col("segment_end_ms") > F.col("s") - pad_ms))
    return hit.orderBy("segment_start_ms", "record_id").limit(limit)


def overlap_results(df: DataFrame, scope: Scope, record_id: str, pad_ms: int = 0, limit: int = 50) -> DataFrame:
    """Q8: what overlaps a record, as results: the position is the rank, the score is 0."""
    w = Window.orderBy("segment_start_ms", "record_id")
    return overlapping(df, scope, record_id, pad_ms, limit).select(F.row_number().over(w).alias("rank"), "record_id", F.lit(0.0).alias("score"), F.substring("static_text", 1, 200).alias("preview"), "analysis_scale", "observed_start", "observed_end")


def overlap_pairs(df: DataFrame, cell_ms: int, pad_ms: int = 0) -> DataFrame:
    """J3 as a self join of a whole table: pairs (a, b), a < b, of a video that overlap.

    Intervals are dealt to cells of time, so that a long video spreads over
    many tasks; a pair counts in the cell where the later one starts.
    """
    span = df.select("video_id", "record_id", F.col("segment_start_ms").alias("s"), (F.col("segment_end_ms") + pad_ms).alias("e"))
    cells = span.withColumn("cell", F.explode(F.sequence(F.floor(F.col("s") / cell_ms), F.floor((F.col("e") - 1) / cell_ms))))
    a, b = cells.alias("a"), cells.alias("b")
    cond = (F.col("a.video_id") == F.col("b.video_id")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.record_id") < F.col("b.record_id")) & (F.col("a.s") < F.col("b.e")) & (F.col("a.e") > F.col("b.s")) & (F.col("a.cell") == F.floor(F.greatest("a.s", "b.s") / cell_ms))
    return a.join(b, cond).select(F.col("a.video_id").alias("video_id"), F.col("a.record_id").alias("a"), F.col("b.record_id").alias("b"))
