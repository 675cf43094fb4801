"""The driver's tables seen as items, edges, tagged items, award rows and scored rows.

The expressions are plain SQL that Spark and DuckDB read alike, so a query and its
SQL start from the same columns.  Scores are whole numbers and weights whole units,
so sums are exact in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (table, expressions)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "items": ("orders", (
        "o_orderkey AS tconst",
        "o_orderpriority AS primary_title",
        "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END AS start_year",
        "CAST(o_custkey % 260 AS INTEGER) AS runtime_minutes",
        "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST((o_orderkey * 7 + o_custkey) % 10 + 1 AS BIGINT) END AS average_rating",
        "CAST(floor(o_totalprice) AS BIGINT) AS num_votes",
    )),
    "edges": ("lineitem", (
        "l_orderkey AS tconst",
        "l_suppkey AS nconst",
        "CASE l_linenumber % 9 WHEN 0 THEN 'actor' WHEN 1 THEN 'actress' WHEN 2 THEN 'director' WHEN 3 THEN 'writer' WHEN 4 THEN 'producer' WHEN 5 THEN 'composer' WHEN 6 THEN 'director' WHEN 7 THEN 'self' ELSE NULL END AS category",
    )),
    "tagged": ("part", (
        "p_partkey AS tconst",
        "p_name AS primary_title",
        "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(1950 + p_size AS INTEGER) END AS start_year",
        "CAST(CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE p_partkey * 3 % 260 END AS INTEGER) AS runtime_minutes",
        "CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE CAST(p_partkey * 7 % 10 + 1 AS BIGINT) END AS average_rating",
        "CAST(floor(p_retailprice * 3) AS BIGINT) AS num_votes",
        "CASE WHEN p_partkey % 37 = 0 THEN '' WHEN p_partkey % 41 = 0 THEN NULL ELSE replace(p_name, ' ', ',') END AS genre_list",
    )),
    "award_rows": ("events", (
        "CAST(event_id % 90 + 1 AS VARCHAR(10)) AS Ceremony",
        "'1999' AS Year",
        "CASE event_id % 4 WHEN 0 THEN 'Acting' WHEN 1 THEN 'Directing' WHEN 2 THEN 'Writing' ELSE NULL END AS Class",
        "CASE event_id % 5 WHEN 0 THEN 'BEST PICTURE' WHEN 1 THEN 'UNIQUE AND ARTISTIC PICTURE' WHEN 2 THEN NULL ELSE 'OTHER' END AS CanonicalCategory",
        "event_type AS Category",
        "'film' AS Film",
        "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN concat('tt', CAST(user_id AS VARCHAR(20)), '| tt', CAST(user_id + 1 AS VARCHAR(20)), ' |x', CAST(user_id AS VARCHAR(20))) ELSE concat('tt', CAST(user_id AS VARCHAR(20))) END AS FilmId",
        "'n' AS Name",
        "'m' AS Nominees",
        "'i' AS NomineeIds",
        "CASE event_type WHEN 'purchase' THEN ' True' WHEN 'click' THEN '' ELSE NULL END AS Winner",
        "'d' AS Detail",
        "'o' AS Note",
    )),
    "scored": ("orders", (
        "o_orderkey AS tconst",
        "CAST(year(o_orderdate) AS INTEGER) AS start_year",
        "CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_totalprice > 300000 THEN 1 ELSE 0 END AS label",
        "CAST(o_custkey % 100 AS DOUBLE) / 100 AS positive_score",
    )),
    # the raw files, every field a string, NULL as the mark
    "raw_titles": ("orders", (
        "CAST(o_orderkey AS VARCHAR(20)) AS tconst",
        "CASE WHEN o_orderkey % 6 = 0 THEN 'short' ELSE 'movie' END AS titleType",
        "o_orderpriority AS primaryTitle",
        "o_orderstatus AS originalTitle",
        "'0' AS isAdult",
        "CASE WHEN o_orderkey % 10 = 0 THEN concat(chr(92), 'N') ELSE CAST(year(o_orderdate) AS VARCHAR(20)) END AS startYear",
        "concat(chr(92), 'N') AS endYear",
        "CASE WHEN o_orderkey % 11 = 0 THEN concat(chr(92), 'N') WHEN o_orderkey % 13 = 0 THEN 'x1' ELSE CAST(o_custkey % 260 AS VARCHAR(20)) END AS runtimeMinutes",
        "CASE WHEN o_orderkey % 7 = 0 THEN concat(chr(92), 'N') WHEN o_orderkey % 3 = 0 THEN 'Drama,Comedy' ELSE 'Drama' END AS genres",
    )),
    # a quote that never ends, which a reader must not follow over fields
    "raw_quotes": ("orders", (
        "CAST(o_orderkey AS VARCHAR(20)) AS tconst",
        "CASE WHEN o_orderkey % 19 = 0 THEN concat('\"unclosed ', o_orderpriority) ELSE o_orderpriority END AS averageRating",
        "CAST(o_custkey AS VARCHAR(20)) AS numVotes",
    )),
    "raw_ratings": ("orders", (
        "CAST(o_orderkey AS VARCHAR(20)) AS tconst",
        "CASE WHEN o_orderkey % 17 = 0 THEN concat(chr(92), 'N') ELSE CAST((o_orderkey * 7 + o_custkey) % 10 + 1 AS VARCHAR(20)) END AS averageRating",
        "CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(20)) AS numVotes",
    )),
    "raw_principals": ("lineitem", (
        "CAST(l_orderkey AS VARCHAR(20)) AS tconst",
        "CAST(l_linenumber AS VARCHAR(20)) AS ordering",
        "CAST(l_suppkey AS VARCHAR(20)) AS nconst",
        "CASE l_linenumber % 9 WHEN 0 THEN 'actor' WHEN 1 THEN 'actress' WHEN 2 THEN 'director' WHEN 3 THEN 'writer' WHEN 4 THEN 'producer' WHEN 5 THEN 'composer' WHEN 6 THEN 'director' WHEN 7 THEN 'self' ELSE concat(chr(92), 'N') END AS category",
        "concat(chr(92), 'N') AS job",
        "concat('[', l_returnflag, ']') AS characters",
    )),
    "raw_names": ("supplier", (
        "CAST(s_suppkey AS VARCHAR(20)) AS nconst",
        "s_name AS primaryName",
        "CASE WHEN s_suppkey % 4 = 0 THEN concat(chr(92), 'N') ELSE CAST(1900 + s_nationkey AS VARCHAR(20)) END AS birthYear",
        "CASE WHEN s_suppkey % 5 = 0 THEN '19x' ELSE concat(chr(92), 'N') END AS deathYear",
        "CASE WHEN s_suppkey % 3 = 0 THEN 'actor,writer' ELSE concat(chr(92), 'N') END AS primaryProfession",
        "CASE WHEN s_suppkey % 2 = 0 THEN 'tt1' ELSE 'tt1,tt2' END AS knownForTitles",
    )),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, expressions = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*expressions)


def with_views(*names: str) -> str:
    """The views as SQL common table expressions."""
    return "WITH " + ",\n".join(f"{n} AS (SELECT {', '.join(VIEWS[n][1])} FROM {VIEWS[n][0]})" for n in names)
