"""Joins that build and enrich the item table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FILM, Columns

# The award columns that default to 0 and to false.
AWARD_COUNTS = (
    "oscar_nomination_count", "oscar_win_count", "best_picture_nomination_count", "best_picture_win_count", "acting_nomination_count",
    "acting_win_count", "directing_nomination_count", "directing_win_count", "writing_nomination_count", "writing_win_count",
)
AWARD_FLAGS = ("was_oscar_nominated", "was_oscar_winner", "best_picture_nominated", "best_picture_won")


def rated_movies(titles: DataFrame, ratings: DataFrame) -> DataFrame:
    """Titles with a rating row, eight columns; NULL ratings stay."""
    joined = titles.join(ratings, "tconst")
    names = {"primaryTitle": "primary_title", "originalTitle": "original_title", "startYear": "start_year", "runtimeMinutes": "runtime_minutes", "genres": "genres", "averageRating": "average_rating", "numVotes": "num_votes"}
    return joined.select("tconst", *[F.col(a).alias(b) for a, b in names.items()])


def restrict(edges: DataFrame, items: DataFrame, item: str = FILM.item) -> DataFrame:
    """Edges of known items: a semi join, which needs no distinct; Spark broadcasts the ids if they are few."""
    return edges.join(items.select(item), item, "left_semi")


def attach_names(edges: DataFrame, names: DataFrame, c: Columns = FILM, columns: tuple[str, ...] = ("primary_name", "birth_year")) -> DataFrame:
    return edges.join(names.select(c.entity, *columns), c.entity, "left")


def attach_known_people(edges: DataFrame, known: DataFrame, c: Columns = FILM) -> DataFrame:
    """Edges with ``is_known_person``; adaptive execution broadcasts the lookup if its bytes, measured as it runs, are few."""
    joined = edges.join(known.select(c.entity, "is_known_person"), c.entity, "left")
    return joined.withColumn("is_known_person", F.coalesce("is_known_person", F.lit(False)))


def zero_counts(name: str) -> Column | None:
    """Counts and sums default to 0, known flags to false; means and maxima stay NULL."""
    if name.endswith(("_count", "_sum")):
        return F.coalesce(F.col(name), F.lit(0))
    return F.coalesce(F.col(name), F.lit(False)) if name.startswith("has_known_") else None


def zero_awards(name: str) -> Column | None:
    """Award counts default to 0, award flags to false; ceremonies stay NULL."""
    if name in AWARD_COUNTS:
        return F.coalesce(F.col(name), F.lit(0)).cast("long")
    return F.coalesce(F.col(name), F.lit(False)) if name in AWARD_FLAGS else None


def enrich(base: DataFrame, features: DataFrame, key: str, default: Callable[[str], Column | None]) -> DataFrame:
    """Every base row once, with the features or their defaults."""
    joined = base.join(features, key, "left")
    filled = {c: v for c in features.columns if c != key and (v := default(c)) is not None}
    return joined.withColumns(filled) if filled else joined


def enriched_movies(movies: DataFrame, features: DataFrame) -> DataFrame:
    return enrich(movies, features, "tconst", zero_counts)


def awards_enriched_movies(movies: DataFrame, awards: DataFrame) -> DataFrame:
    return enrich(movies, awards, "tconst", zero_awards)
