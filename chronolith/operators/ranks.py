"""Ranks and running sums over an order, without one task for all rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Ranges for each shuffle partition, and sampled rows for each range.
RANGES, PER_RANGE = 2, 32
#: Rows up to which one range serves.
ONE_RANGE = 200_000
#: Rows that make a range worth its task, and ranges there are at least.
RANGE_ROWS, LEAST_RANGES = 25_000, 8

#: Share of the rows on each side of a percentile among which it is looked for: thrice percentile_approx's error.
NEAR = 0.0003


def splitters(rows: DataFrame, keys: Sequence[str], total: int) -> list[tuple]:
    """Keys that part the rows' order into ranges of about equal size, from a sample of bounded size.

    They only deal rows to tasks; no result depends on which they are.
    """
    if total <= ONE_RANGE:
        return []
    ranges = min(RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(LEAST_RANGES, total // RANGE_ROWS))
    most = 2 * ranges * PER_RANGE
    sample = rows.select(*keys).sample(min(1.0, ranges * PER_RANGE / max(total, 1)), 17).limit(most)
    ordered = list(dict.fromkeys(map(tuple, sample.orderBy(*keys).collect())))
    step = max(1, len(ordered) // ranges)
    return ordered[step::step]


def range_of(rows: DataFrame, keys: Sequence[str], cuts: list[tuple]) -> Column:
    """How many of the cuts a row's keys reach; NULL comes first, as it does in a sort."""
    kinds = {k: rows.schema[k].dataType for k in keys}
    literals = [F.struct(*[F.lit(v).cast(kinds[k]).alias(k) for k, v in zip(keys, cut)]) for cut in cuts]
    at = F.struct(*[F.col(k).alias(k) for k in keys])
    return F.size(F.filter(F.array(*literals), lambda c: c <= at))


def dealt(rows: DataFrame, keys: Sequence[str], cuts: list[tuple]) -> DataFrame:
    """The rows with their ``range_``: of a single fraction by binary search, else by comparison with each cut."""
    if [rows.schema[k].dataType for k in keys] != [DoubleType()]:
        return rows.withColumn("range_", range_of(rows, keys, cuts))
    finite = [c for (c,) in cuts if c is not None and math.isfinite(c)]
    if not finite:
        return rows.withColumn("range_", range_of(rows, keys, cuts))
    found = Bucketizer(splits=[-math.inf, *finite, math.inf], inputCol=keys[0], outputCol="range_", handleInvalid="keep").transform(rows)
    return found.withColumn("range_", F.when(F.col(keys[0]).isNull(), 0).otherwise(F.col("range_").cast("int")))


def running(rows: DataFrame, keys: Sequence[str], values: Sequence[str], total: int) -> DataFrame:
    """The rows with ``before_V`` for each value: its sum over all rows with smaller keys, of which no two rows share any.

    ``total`` is about the number of rows, to size the sample; up to ONE_RANGE rows are
    one task's.  Of more, each range is summed by its own task; the ranges' totals, one
    row each, are summed in one.
    """
    cuts = splitters(rows, keys, total)
    if not cuts:
        all_before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({f"before_{v}": F.coalesce(F.sum(v).over(all_before), F.lit(0)) for v in values})
    by_range = dealt(rows, keys, cuts)
    inside = Window.partitionBy("range_").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = by_range.groupBy("range_").agg(*[F.sum(v).alias(f"all_{v}") for v in values])
    earlier = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("range_", *[F.coalesce(F.sum(f"all_{v}").over(earlier), F.lit(0)).alias(f"start_{v}") for v in values])
    summed = by_range.withColumns({f"before_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    joined = summed.join(F.broadcast(starts), "range_")
    return joined.withColumns({f"before_{v}": F.col(f"before_{v}") + F.col(f"start_{v}") for v in values}).drop("range_", *[f"start_{v}" for v in values])


def quantiles(rows: DataFrame, keys: Sequence[str], column: str, p: float, name: str, total: int | None = None) -> DataFrame:
    """Each group's exact discrete ``p`` percentile of a column: the least value that a share ``p`` of it does not exceed.

    Ranks come from counts by value, so a group is spread over as many tasks as its
    values need.  Groups without a value are missing.  ``total`` is about the number of
    rows, counted if not given.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    ranked = running(counts, [*keys, column], ["n"], rows.count() if total is None else total)
    groups = ranked.groupBy(*keys).agg(F.min("before_n").alias("first_"), F.sum("n").alias("size_"))
    joined = ranked.join(groups, [*keys]) if keys else ranked.join(F.broadcast(groups))
    reached = joined.where(F.col("before_n") + F.col("n") - F.col("first_") >= p * F.col("size_") - 1e-9 * F.col("size_"))
    return reached.groupBy(*keys).agg(F.min(column).cast("double").alias(name))


def near_quantiles(rows: DataFrame, keys: Sequence[str], column: str, p: float, name: str) -> DataFrame:
    """What ``quantiles`` finds, with percentile_approx to look near and counts to decide.

    Approximate percentiles on both sides of ``p`` part a group's values into three
    bands.  The bands' counts say exactly which of them holds the percentile, the middle one
    unless the approximation missed, and only that band's values are counted one by one.
    """
    sides = [max(0.0, p - NEAR), min(1.0, p + NEAR)]
    value = F.col(column)
    present = rows.where(value.isNotNull()).select(*keys, column)
    meet = lambda df, one: df.join(one, [*keys]) if keys else df.join(F.broadcast(one))
    cuts = present.groupBy(*keys).agg(F.percentile_approx(column, sides).alias("cuts_"))
    low, high = F.get("cuts_", F.lit(0)), F.get("cuts_", F.lit(1))
    band = F.when(value < low, 0).when(value <= high, 1).otherwise(2)
    banded = meet(present, cuts)
    counts = banded.groupBy(*keys).agg(*[F.count_if(band == i).alias(f"n{i}_") for i in range(3)], F.first("cuts_").alias("cuts_"))
    below, within = F.col("n0_"), F.col("n0_") + F.col("n1_")
    size = within + F.col("n2_")
    wanted = p * size - 1e-9 * size
    chosen = F.when((below > 0) & (below >= wanted), 0).when((within > 0) & (within >= wanted), 1).otherwise(2)
    placed = counts.select(*keys, "cuts_", wanted.alias("wanted_"), chosen.alias("chosen_"), F.when(chosen == 0, 0).when(chosen == 1, below).otherwise(within).alias("start_"))
    inside = meet(present, placed).where(band == F.col("chosen_")).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"), F.first("wanted_").alias("wanted_"), F.first("start_").alias("start_"))
    upto = Window.partitionBy(*keys).orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = inside.withColumn("upto_", F.col("start_") + F.sum("n").over(upto)).where("upto_ >= wanted_")
    return reached.groupBy(*keys).agg(F.min(column).cast("double").alias(name))
