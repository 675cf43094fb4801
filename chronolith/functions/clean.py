"""Null marks, lenient casts, list fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schemas import NULL_MARK, RELEVANT_ROLES


def null_marks(df: DataFrame, mark: str = NULL_MARK) -> DataFrame:
    """Every string that is exactly the mark becomes NULL; other columns stay."""
    texts = {f.name for f in df.schema if isinstance(f.dataType, StringType)}
    return df.select([F.nullif(F.col(c), F.lit(mark)).alias(c) if c in texts else F.col(c) for c in df.columns])


def try_casts(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast the named columns; what does not parse is NULL."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def list_field(text: Column, sep: str = ",") -> Column:
    """A separated list as an array, elements as they are; NULL for NULL or blank text."""
    return F.when(text.isNull() | (F.trim(text) == ""), F.lit(None)).otherwise(F.split(text, sep))


def cast_titles(df: DataFrame) -> DataFrame:
    return try_casts(df, {"isAdult": "int", "startYear": "int", "endYear": "int", "runtimeMinutes": "int"})


def cast_ratings(df: DataFrame) -> DataFrame:
    return try_casts(df, {"averageRating": "double", "numVotes": "long"})


def cast_principals(df: DataFrame) -> DataFrame:
    return try_casts(df, {"ordering": "int"})


def cast_names(df: DataFrame) -> DataFrame:
    return try_casts(df, {"birthYear": "int", "deathYear": "int"})


def name_fields(df: DataFrame) -> DataFrame:
    """Renamed person fields, professions and known titles as arrays."""
    renamed = {"primaryName": "primary_name", "birthYear": "birth_year", "deathYear": "death_year", "primaryProfession": "primary_profession", "knownForTitles": "known_for_titles"}
    df = df.withColumnsRenamed(renamed)
    return df.withColumns({c: list_field(F.col(c)) for c in ("primary_profession", "known_for_titles")})


def genre_field(df: DataFrame) -> DataFrame:
    return df.withColumn("genres", list_field(F.col("genres")))


def only(df: DataFrame, column: str, *values: str) -> DataFrame:
    """Rows whose column is one of the values; NULL is not."""
    return df.where(F.col(column).isin(*values))


def movies_only(df: DataFrame) -> DataFrame:
    return only(df, "titleType", "movie")


def relevant_principals(df: DataFrame) -> DataFrame:
    return only(df, "category", *RELEVANT_ROLES)


def prepare_titles(df: DataFrame) -> DataFrame:
    return df.transform(null_marks).transform(cast_titles).transform(movies_only).transform(genre_field)


def prepare_ratings(df: DataFrame) -> DataFrame:
    return df.transform(null_marks).transform(cast_ratings)


def prepare_principals(df: DataFrame) -> DataFrame:
    return df.transform(null_marks).transform(cast_principals).transform(relevant_principals)


def prepare_names(df: DataFrame) -> DataFrame:
    return df.transform(null_marks).transform(cast_names).transform(name_fields)


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def with_decade(df: DataFrame, year_col: str = "start_year") -> DataFrame:
    return df.withColumn("decade", decade(F.col(year_col)))


def bucket(value: Column, width: int) -> Column:
    """The lower edge of a fixed-width bucket."""
    return (F.floor(value / width) * width).cast("int")
