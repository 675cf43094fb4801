"""Multi-valued fields to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BEST_PICTURE

ITEM_ID = r"^tt\d+$"


def explode_tags(df: DataFrame, tags: str = "genres", name: str = "genre") -> DataFrame:
    """One row per non-empty tag; rows without tags go."""
    return df.withColumn(name, F.explode(tags)).where(F.col(name) != "")


def explode_ids(df: DataFrame, ids: Column, name: str, pattern: str = ITEM_ID, sep: str = r"\|") -> DataFrame:
    """One row per trimmed id of a separated list that fits the pattern; the rest of the row repeats."""
    return df.withColumn(name, F.explode(F.split(ids, sep))).withColumn(name, F.trim(name)).where(F.col(name).rlike(pattern))


def winner(flag: Column) -> Column:
    """True for ``true`` in any case and with spaces around, else false, never NULL."""
    return F.coalesce(F.lower(F.trim(flag)) == "true", F.lit(False))


def award_nominations(df: DataFrame) -> DataFrame:
    """One row per nomination and film id, with category flags (NULL where the class is)."""
    rows = explode_ids(df, F.col("FilmId"), "tconst")
    return rows.select(
        "tconst", F.col("Ceremony").try_cast("int").alias("ceremony"), F.col("Year").alias("award_year"), F.col("Class").alias("award_class"),
        F.col("CanonicalCategory").alias("canonical_category"), F.col("Category").alias("category"), F.col("Film").alias("film_title_raw"),
        F.col("Name").alias("nominee_name"), F.col("Nominees").alias("nominees"), F.col("NomineeIds").alias("nominee_ids_raw"),
        winner(F.col("Winner")).alias("is_winner"), F.col("Detail").alias("detail"), F.col("Note").alias("note"),
        F.col("CanonicalCategory").isin(*BEST_PICTURE).alias("is_best_picture_category"),
        (F.col("Class") == "Acting").alias("is_acting_category"), (F.col("Class") == "Directing").alias("is_directing_category"), (F.col("Class") == "Writing").alias("is_writing_category"),
    )
