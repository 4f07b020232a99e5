"""Running totals and exact positions without gathering a group in one task."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a group's values; positions are counted by range first. Near the least value they are finer, by up to this factor.
RANGES, FINER = 4096, float(1 << 40)
#: Time of a bucket of running totals, in ms.
BUCKET_MS = 3_600_000


def running_total(deltas: DataFrame, by: Sequence[str], name: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Adds the running total of ``delta`` in the order (at_ms, event_id) within ``by``: sums by bucket of time first, then within a bucket."""
    b = deltas.withColumn("_b", F.floor(F.col("at_ms") / bucket_ms))
    sums = b.groupBy(*by, "_b").agg(F.sum("delta").alias("_s"))
    before = sums.select(*by, "_b", (F.sum("_s").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_s")).alias("_from"))
    inner = Window.partitionBy(*by, "_b").orderBy("at_ms", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn("_k", F.sum("delta").over(inner)).join(before, [*by, "_b"]).withColumn(name, F.col("_from") + F.col("_k")).drop("_b", "_k", "_from")


def at_positions(df: DataFrame, by: Sequence[str], value: str, positions: Mapping[str, Column]) -> DataFrame:
    """For each group, n and the values at ``positions`` (from 0, of the sorted non-null values, as functions of the column n), as columns.

    The counts of ranges of values, aggregated where the rows are, tell in which
    range a position lies; only the rows of those ranges are shuffled, counted
    by distinct value, and numbered. Ranges widen with the distance from the least value, in proportion to it, so
    a value far beyond the others doesn't put them all into one.
    """
    by = list(by) or ["_all"]
    rows = df if by != ["_all"] else df.withColumn("_all", F.lit(0))
    values = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    groups = values.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    share = F.try_divide((F.col("_v") - F.col("_lo")).cast("double"), (F.col("_hi") - F.col("_lo")).cast("double"))
    ranged = values.join(groups, by).withColumn("_r", F.least(F.lit(RANGES - 1), F.floor(F.log1p(F.coalesce(share, F.lit(0.0)) * FINER) / math.log1p(FINER) * RANGES)))
    sums = ranged.groupBy(*by, "_r").agg(F.count("*").alias("_s"), F.first("n").alias("n"))
    after = F.sum("_s").over(Window.partitionBy(*by).orderBy("_r"))
    wanted = F.inline(F.array(*[F.struct(F.lit(k).alias("_name"), p.cast("bigint").alias("_p")) for k, p in positions.items()]))
    sought = sums.withColumn("_after", after).withColumn("_before", F.col("_after") - F.col("_s")).select("*", wanted)
    sought = sought.filter("_p >= _before AND _p < _after").groupBy(*by, "_r", "_before").agg(F.collect_list(F.struct("_name", "_p")).alias("_at"))
    counts = ranged.join(sought, [*by, "_r"]).groupBy(*by, "_r", "_v").agg(F.count("*").alias("_c"), F.first("n").alias("n"), F.first("_before").alias("_before"), F.first("_at").alias("_at"))
    numbered = counts.withColumn("_k", F.col("_before") + F.sum("_c").over(Window.partitionBy(*by, "_r").orderBy("_v")))
    hit = numbered.select(*by, "n", "_v", "_k", "_c", F.inline("_at")).filter("_p < _k AND _p >= _k - _c")
    return hit.groupBy(*by, "n").agg(*[F.max(F.when(F.col("_name") == k, F.col("_v"))).alias(k) for k in positions]).select(*by, *positions, "n").drop("_all")
