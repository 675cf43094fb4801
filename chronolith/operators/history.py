"""Strictly point-in-time history of an entity.

For an entity's edge to an item at time t, the priors cover the entity's items at
times before t; items of the same time are never prior.  Edges are first summed to
one row per entity and time, which map tasks combine; the running sums then go over
an entity's distinct times, few even for an entity with a third of all edges, and
come back to the edges by an equality join that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FILM, HIGH_SCORE, Columns

PRIORS = ("prior_movie_count", "prior_average_rating", "prior_total_votes", "prior_highly_rated_movie_count")


def timed_edges(edges: DataFrame, items: DataFrame, c: Columns = FILM) -> DataFrame:
    """Distinct entity-item edges with non-null keys, with the item's time and measures."""
    # each key by its own filter, as joins infer them, so that all uses of the edges have one plan
    pairs = edges.select(c.item, c.entity).where(F.col(c.item).isNotNull() & F.col(c.entity).isNotNull()).distinct()
    return pairs.join(items.select(c.item, c.time, c.score, c.weight), c.item)


def entity_history(edges: DataFrame, items: DataFrame, c: Columns = FILM, high: float = HIGH_SCORE) -> DataFrame:
    """One row per (item, entity) with its four priors.

    An edge without a time has none and is prior to nothing.  Items without a score
    count, but not in the mean.
    """
    rows = timed_edges(edges, items, c)
    # no filter on the time here: both uses of the rows then read the same exchanges
    timed = F.col(c.time).isNotNull()
    yearly = rows.groupBy(c.entity, c.time).agg(
        F.count(c.time).alias("n"),
        F.count(F.when(timed, F.col(c.score))).alias("n_scored"),
        F.sum(F.when(timed, F.col(c.score))).alias("scores"),
        F.sum(F.when(timed, F.col(c.weight))).alias("weights"),
        F.count_if(timed & (F.col(c.score) >= high)).alias("n_high"),
    )
    before = Window.partitionBy(c.entity).orderBy(c.time).rowsBetween(Window.unboundedPreceding, -1)
    past = yearly.select(c.entity, c.time, *[F.sum(x).over(before).alias(x) for x in ("n", "n_scored", "scores", "weights", "n_high")])
    return rows.join(past, [c.entity, c.time], "left").select(
        c.item, c.entity, c.time, c.score, c.weight,
        F.coalesce("n", F.lit(0)).cast("long").alias(PRIORS[0]),
        F.try_divide(F.col("scores").cast("double"), F.col("n_scored")).alias(PRIORS[1]),
        F.coalesce(F.col("weights").cast("long"), F.lit(0)).alias(PRIORS[2]),
        F.coalesce("n_high", F.lit(0)).cast("long").alias(PRIORS[3]),
    )


def entity_history_by_window(edges: DataFrame, items: DataFrame, c: Columns = FILM, high: float = HIGH_SCORE) -> DataFrame:
    """The same by one range frame over the edges; a hot entity is one task here.

    Rows without a time would be each other's peers in the frame, so they go apart.
    """
    rows = timed_edges(edges, items, c)
    frame = Window.partitionBy(c.entity).orderBy(c.time).rangeBetween(Window.unboundedPreceding, -1)
    priors = [
        F.count(F.lit(1)).over(frame),
        F.try_divide(F.sum(c.score).over(frame).cast("double"), F.count(c.score).over(frame)),
        F.coalesce(F.sum(c.weight).over(frame).cast("long"), F.lit(0)),
        F.count_if(F.col(c.score) >= high).over(frame),
    ]
    none = [F.lit(0).cast("long"), F.lit(None).cast("double"), F.lit(0).cast("long"), F.lit(0).cast("long")]
    own = [c.item, c.entity, c.time, c.score, c.weight]
    timed = rows.where(F.col(c.time).isNotNull()).select(*own, *[p.alias(n) for p, n in zip(priors, PRIORS)])
    return timed.unionByName(rows.where(F.col(c.time).isNull()).select(*own, *[p.alias(n) for p, n in zip(none, PRIORS)]))
