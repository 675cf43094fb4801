"""Descriptive questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import bucket, with_decade
from ..functions.labels import hit
from .explode import explode_tags
from .ranks import near_quantiles, quantiles, running


def with_medians(rows: DataFrame, keys: Sequence[str], out: list[Column], medians: dict[str, str], exact: bool) -> DataFrame:
    """The groups' aggregates and medians (name -> column): by percentile_approx and counts around it, or by ranks."""
    found, total = rows.groupBy(*keys).agg(*out), rows.count() if exact else 0
    for name, column in medians.items():
        one = quantiles(rows, keys, column, 0.5, name, total) if exact else near_quantiles(rows, keys, column, 0.5, name)
        found = found.join(one, [*keys], "left")
    return found


def genre_decade_stats(movies: DataFrame, exact: bool = False) -> DataFrame:
    """Films, median rating and votes of each decade and genre."""
    rows = explode_tags(with_decade(movies)).where(F.col("decade").isNotNull())
    out = [F.count(F.lit(1)).alias("film_count"), F.sum("num_votes").alias("total_votes")]
    return with_medians(rows, ["decade", "genre"], out, {"median_rating": "average_rating", "median_votes": "num_votes"}, exact).orderBy("decade", F.desc("film_count"))


def runtime_bucket_stats(movies: DataFrame, *, bucket_minutes: int = 15, min_runtime: int = 40, max_runtime: int = 240, min_films: int = 50, exact: bool = False) -> DataFrame:
    """A fixed-width profile of runtimes; buckets with few films go."""
    rows = movies.where(F.col("runtime_minutes").between(min_runtime, max_runtime)).withColumn("runtime_bucket", bucket(F.col("runtime_minutes"), bucket_minutes))
    out = [F.count(F.lit(1)).alias("film_count"), F.avg("average_rating").alias("mean_rating"), F.sum("num_votes").alias("total_votes")]
    return with_medians(rows, ["runtime_bucket"], out, {"median_rating": "average_rating"}, exact).where(F.col("film_count") >= min_films).orderBy("runtime_bucket")


def rating_anomalies(movies: DataFrame, *, high_rating: float = 8.0, vote_percentile: float = 0.10, exact: bool = False) -> DataFrame:
    """Well rated films with few votes.  The cut is one row of the same plan; an empty table's cut is 0."""
    one = quantiles(movies, [], "num_votes", vote_percentile, "q") if exact else near_quantiles(movies, [], "num_votes", vote_percentile, "q")
    cut = one.agg(F.coalesce(F.max("q"), F.lit(0.0)).alias("vote_cut_used"))
    rows = movies.join(F.broadcast(cut), F.col("num_votes") <= F.col("vote_cut_used")).where(F.col("average_rating") >= high_rating)
    names = ("tconst", "primary_title", "start_year", "average_rating", "num_votes", "runtime_minutes", "vote_cut_used")
    return rows.select(*names).orderBy(F.desc("average_rating"), "num_votes", "tconst")


def director_prior_vs_rating(movies: DataFrame) -> DataFrame:
    names = ("tconst", "primary_title", "start_year", "average_rating", "num_votes", "director_prior_rating_mean", "director_prior_movie_count_mean", "director_prior_votes_sum")
    return movies.where("director_prior_rating_mean IS NOT NULL").select(*names)


def correlation(df: DataFrame, x: str, y: str) -> float | None:
    """Pearson's r over rows with both; None if undefined."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return rows.agg(F.corr(x, y)).first()[0]


def director_prior_correlation(movies: DataFrame) -> float | None:
    return correlation(movies, "director_prior_rating_mean", "average_rating")


def signal_lift(labeled: DataFrame, *, signal_col: str, label_col: str = "is_hit", buckets: int = 4, tie_break: Sequence[str] = ()) -> DataFrame:
    """Outcome rate and lift over the base rate in equal-count bands of a signal.

    Bands need ranks.  Ranks come from counts: rows are summed by signal value (and
    tie break), running sums by ranges of the values give each value's range of
    ranks, and ``ntile`` of a rank is arithmetic.  Without a tie break, rows of equal
    signal that straddle a band edge share their mean outcome.
    """
    if buckets < 2:
        raise ValueError("at least two bands are needed")
    rows = labeled.where(F.col(signal_col).isNotNull() & F.col(label_col).isNotNull())
    keys = [signal_col, *tie_break]
    values = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label_col).cast("double")).alias("hits"))
    total, base = rows.agg(F.count(F.lit(1)), F.avg(F.col(label_col).cast("double"))).first()
    placed = running(values, keys, ["n"], total).withColumnRenamed("before_n", "first").withColumn("base", F.lit(base).cast("double"))
    small, extra = total // buckets, total % buckets
    edge = lambda band: (band - 1) * small + F.least(band - 1, F.lit(extra))  # noqa: E731  ranks before a band
    bands = placed.withColumn("signal_band", F.explode(F.sequence(F.lit(1), F.lit(buckets))))
    low, high = edge(F.col("signal_band")), edge(F.col("signal_band") + 1)
    taken = F.least(F.col("first") + F.col("n"), high) - F.greatest(F.col("first"), low)
    bands = bands.withColumn("taken", taken).where("taken > 0")
    share = F.col("taken") / F.col("n")
    out = bands.groupBy("signal_band").agg(
        F.sum("taken").cast("long").alias("film_count"), F.min(signal_col).alias("signal_min"), F.max(signal_col).alias("signal_max"),
        (F.sum(F.col(signal_col) * F.col("taken")) / F.sum("taken")).alias("signal_mean"), (F.sum(F.col("hits") * share) / F.sum("taken")).alias("outcome_rate"), F.max("base").alias("base"),
    )
    return out.withColumn("lift_vs_eligible", F.try_divide("outcome_rate", F.nullif("base", F.lit(0.0)))).drop("base").orderBy("signal_band")


def seeded_sample(df: DataFrame, columns: Sequence[str], fraction: float, seed: int) -> DataFrame:
    """About a share of the rows, the same for the same partitions and seed, without replacement."""
    return df.select(*columns).sample(False, fraction, seed)


def label_rate(df: DataFrame, label_col: str = "is_hit") -> DataFrame:
    return df.agg(F.avg(label_col).alias("base_rate"))


def label_grid(movies: DataFrame, ratings: Sequence[float] = (6.5, 7.0, 7.5), votes: Sequence[int] = (500, 1000, 5000)) -> DataFrame:
    """The hit rate for every pair of minimums, from one aggregation."""
    pairs = [(r, v) for r in ratings for v in votes]
    rate = lambda r, v: F.avg(hit(F.col("average_rating"), F.col("num_votes"), r, v))
    one = movies.agg(*[rate(r, v).alias(f"g{i}") for i, (r, v) in enumerate(pairs)])
    cells = [F.struct(F.lit(float(r)).alias("rating_min"), F.lit(v).cast("long").alias("votes_min"), F.col(f"g{i}").alias("hit_rate")) for i, (r, v) in enumerate(pairs)]
    return one.select(F.inline(F.array(*cells)))


def genre_summary(stats: DataFrame, top: int = 8, min_films: int = 50) -> DataFrame:
    """For the genres with most films: first and last qualifying decade, their medians, the change, all films."""
    totals = stats.groupBy("genre").agg(F.sum("film_count").alias("film_total"))
    leading = totals.orderBy(F.desc("film_total"), "genre").limit(top)
    fit = stats.where(F.col("film_count") >= min_films).groupBy("genre").agg(F.min("decade").alias("first_decade"), F.max("decade").alias("last_decade"), F.min_by("median_rating", "decade").alias("first_median"), F.max_by("median_rating", "decade").alias("last_median"))
    return leading.join(fit, "genre").withColumn("rating_change", F.col("last_median") - F.col("first_median"))


def top_tags(movies: DataFrame, n: int = 15, tags: str = "genres", name: str = "genre") -> DataFrame:
    return explode_tags(movies, tags, name).groupBy(name).agg(F.count(F.lit(1)).alias("film_count")).orderBy(F.desc("film_count"), name).limit(n)


def decade_profile(movies: DataFrame) -> DataFrame:
    rows = with_decade(movies).where("decade IS NOT NULL")
    return rows.groupBy("decade").agg(F.count(F.lit(1)).alias("film_count"), F.avg("average_rating").alias("mean_rating"), F.avg("num_votes").alias("mean_votes")).orderBy("decade")


def null_profile(df: DataFrame) -> DataFrame:
    """Rows and NULLs of every column, from one aggregation: column_name, rows, nulls."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    return one.select("rows", F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(df.columns)]))).select("column_name", "rows", "nulls")


def summary(movies: DataFrame) -> DataFrame:
    return movies.agg(F.count(F.lit(1)).alias("rows"), F.avg("average_rating").alias("mean_rating"), F.avg("num_votes").alias("mean_votes"), F.min("start_year").alias("min_year"), F.max("start_year").alias("max_year"))
