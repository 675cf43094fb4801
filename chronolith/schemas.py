"""Source schemas and domain defaults.  Every source field is read as a nullable string."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StringType, StructField, StructType


def text_schema(names: str) -> StructType:
    return StructType([StructField(n, StringType(), True) for n in names.split()])


# Field names of the published source files.
TITLES = text_schema("tconst titleType primaryTitle originalTitle isAdult startYear endYear runtimeMinutes genres")
RATINGS = text_schema("tconst averageRating numVotes")
PRINCIPALS = text_schema("tconst ordering nconst category job characters")
NAMES = text_schema("nconst primaryName birthYear deathYear primaryProfession knownForTitles")
AWARDS = text_schema("Ceremony Year Class CanonicalCategory Category Film FilmId Name Nominees NomineeIds Winner Detail Note Citation")

# Roles, thresholds and categories that decide results.
NULL_MARK = r"\N"
RELEVANT_ROLES = ("actor", "actress", "director", "writer", "producer", "composer", "cinematographer", "editor")
CAST_ROLES = ("actor", "actress")
FEATURE_VERSION = 2
HIGH_SCORE = 7.0
KNOWN_ITEMS, KNOWN_WEIGHT, KNOWN_SCORE = 10, 100_000, 7.0
BEST_PICTURE = ("BEST PICTURE", "UNIQUE AND ARTISTIC PICTURE")
HIT_SCORE, HIT_WEIGHT = 7.0, 1000
SCORE_RANGE, YEAR_RANGE = (1, 10), (1870, 2035)
TOP_GENRES = ("Drama", "Comedy", "Action", "Romance", "Crime", "Thriller", "Horror", "Adventure", "Documentary", "Animation")


@dataclass(frozen=True)
class Columns:
    """Which columns hold the item, the entity, its role, the time and the two measures."""

    item: str = "tconst"
    entity: str = "nconst"
    role: str = "category"
    time: str = "start_year"
    score: str = "average_rating"
    weight: str = "num_votes"


FILM = Columns()
