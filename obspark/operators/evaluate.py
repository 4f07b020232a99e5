"""Retrieval evaluation: golden queries, precision, recall, reciprocal rank, experiment arms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def golden(df: DataFrame, terms: Sequence[str]) -> DataFrame:
    """a row (query_id, record_id) for each term and record that has it as a tag or in the static text; terms without records have none."""
    low = F.transform("tags", lambda t: F.lower(t))
    hits = [F.when(F.array_contains(low, t) | F.contains(F.lower("static_text"), F.lit(t)), F.lit(t)) for t in terms]
    return df.select(F.explode(F.array_compact(F.array(*hits))).alias("query_id"), "record_id")


def metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query precision@k (of what was returned, up to k), recall@k and reciprocal rank over the whole list.

    ``ranked`` has query_id, record_id, rank; ``relevant`` query_id, record_id.
    Queries without a relevant record have recall 0; those of ``relevant`` that
    returned nothing have zeros.
    """
    marked = ranked.join(relevant.withColumn("rel", F.lit(1)), ["query_id", "record_id"], "left")
    per = marked.groupBy("query_id").agg(F.count(F.when(F.col("rank") <= k, 1)).alias("top"), F.count(F.when((F.col("rank") <= k) & (F.col("rel") == 1), 1)).alias("hits"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"))
    sizes = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    out = per.join(sizes, "query_id", "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("query_id", zero(F.try_divide(F.col("hits").cast("double"), "top")).alias("precision"), zero(F.try_divide(F.col("hits").cast("double"), "n_relevant")).alias("recall"), zero(1.0 / F.col("first")).alias("reciprocal_rank"))


def mean_metrics(per_query: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means to 6 digits; without queries, zeros."""
    return per_query.groupBy(*by).agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in ("precision", "recall", "reciprocal_rank")], F.count("*").alias("queries"))


def best_arm(means: DataFrame) -> DataFrame:
    """The arm of the highest mean reciprocal rank; the first arm wins ties (columns arm, position)."""
    return means.agg(F.max_by("arm", F.struct(F.col("reciprocal_rank"), -F.col("position"))).alias("best_arm"))


def ranked_lists(df: DataFrame, query: str, order: Sequence) -> DataFrame:
    """Ranks from 1 within each query."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
