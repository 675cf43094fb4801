"""The registered queries as SQL, written apart from the operators."""

from __future__ import annotations

from ..ml.contract import BOOLEAN_PREDICTORS, NUMERIC_PREDICTORS
from ..ml.pipeline import HIT_THRESHOLDS
from ..schemas import BEST_PICTURE, RELEVANT_ROLES, TOP_GENRES
from .tables import with_views

ROLES = ", ".join(f"'{r}'" for r in RELEVANT_ROLES)
HISTORY = f""", e AS (SELECT * FROM edges WHERE category IN ({ROLES})),
pairs AS (SELECT DISTINCT tconst, nconst FROM e WHERE tconst IS NOT NULL AND nconst IS NOT NULL),
timed AS (SELECT p.tconst, p.nconst, i.start_year, i.average_rating, i.num_votes FROM pairs p JOIN items i ON p.tconst = i.tconst),
yearly AS (
  SELECT nconst, start_year, count(*) AS n, count(average_rating) AS n_scored, sum(average_rating) AS scores, sum(num_votes) AS votes,
    count(*) FILTER (average_rating >= 7) AS n_high
  FROM timed WHERE start_year IS NOT NULL GROUP BY nconst, start_year),
prior AS (
  SELECT a.nconst, a.start_year, sum(b.n) AS n, sum(b.n_scored) AS n_scored, sum(b.scores) AS scores, sum(b.votes) AS votes, sum(b.n_high) AS n_high
  FROM yearly a JOIN yearly b ON a.nconst = b.nconst AND b.start_year < a.start_year GROUP BY a.nconst, a.start_year),
past AS (
  SELECT t.tconst, t.nconst, t.start_year, t.average_rating, t.num_votes, CAST(coalesce(n, 0) AS BIGINT) AS prior_movie_count,
    CAST(scores AS DOUBLE) / nullif(n_scored, 0) AS prior_average_rating,
    CAST(coalesce(votes, 0) AS BIGINT) AS prior_total_votes, CAST(coalesce(n_high, 0) AS BIGINT) AS prior_highly_rated_movie_count
  FROM timed t LEFT JOIN prior p ON t.nconst = p.nconst AND t.start_year = p.start_year)"""
GROUPED = """, g AS (SELECT DISTINCT tconst, nconst, CASE WHEN category IN ('actor', 'actress') THEN 'cast' WHEN category IN ('director', 'writer', 'producer') THEN category ELSE 'other' END AS g FROM e),
rows_ AS (SELECT g.*, prior_movie_count AS c, prior_average_rating AS r, prior_total_votes AS v, coalesce(prior_movie_count >= 10 AND prior_average_rating >= 7, false) AS known
  FROM g LEFT JOIN past ON g.tconst = past.tconst AND g.nconst = past.nconst)"""


def _role(g: str) -> str:
    return f"CAST(count(DISTINCT CASE WHEN g = '{g}' THEN nconst END) AS BIGINT) AS {g}_count"


def _mean(g: str, value: str, name: str) -> str:
    return f"avg(CASE WHEN g = '{g}' THEN {value} END) AS {g}_{name}"


FEATURES = GROUPED + f""", feats AS (SELECT tconst, CAST(count(DISTINCT nconst) AS BIGINT) AS principal_count, {', '.join(map(_role, ('cast', 'director', 'writer', 'producer')))},
  {_mean('cast', 'c', 'prior_movie_count_mean')}, {_mean('cast', 'r', 'prior_rating_mean')}, CAST(coalesce(sum(CASE WHEN g = 'cast' THEN v END), 0) AS BIGINT) AS cast_prior_votes_sum,
  {_mean('director', 'c', 'prior_movie_count_mean')}, {_mean('director', 'r', 'prior_rating_mean')}, CAST(coalesce(sum(CASE WHEN g = 'director' THEN v END), 0) AS BIGINT) AS director_prior_votes_sum,
  {_mean('writer', 'c', 'prior_movie_count_mean')}, {_mean('writer', 'r', 'prior_rating_mean')},
  avg(c) AS principal_prior_movie_count_mean, avg(r) AS principal_prior_rating_mean, CAST(coalesce(sum(v), 0) AS BIGINT) AS principal_prior_votes_sum, max(r) AS principal_max_prior_rating,
  CAST(count(DISTINCT CASE WHEN g = 'cast' AND known THEN nconst END) AS BIGINT) AS known_cast_count,
  CAST(count(DISTINCT CASE WHEN g = 'director' AND known THEN nconst END) AS BIGINT) AS known_director_count,
  count(DISTINCT CASE WHEN g = 'cast' AND known THEN nconst END) > 0 AS has_known_cast, count(DISTINCT CASE WHEN g = 'director' AND known THEN nconst END) > 0 AS has_known_director
  FROM rows_ GROUP BY tconst)"""
FLOATS = ("cast_prior_movie_count_mean", "cast_prior_rating_mean", "director_prior_movie_count_mean", "director_prior_rating_mean", "writer_prior_movie_count_mean", "writer_prior_rating_mean", "principal_prior_movie_count_mean", "principal_prior_rating_mean", "principal_max_prior_rating")
COUNTS = ("principal_count", "cast_count", "director_count", "writer_count", "producer_count", "cast_prior_votes_sum", "director_prior_votes_sum", "principal_prior_votes_sum", "known_cast_count", "known_director_count")
ENRICHED = FEATURES + ", enriched AS (SELECT i.*, " + ", ".join([*FLOATS, *(f"coalesce({c}, 0) AS {c}" for c in COUNTS), *(f"coalesce({c}, false) AS {c}" for c in ("has_known_cast", "has_known_director"))]) + " FROM items i LEFT JOIN feats f ON i.tconst = f.tconst)"
BASE = with_views("items", "edges") + HISTORY
KNOWN = BASE + """, career AS (SELECT nconst, true AS is_known_person, CAST(count(DISTINCT tconst) AS BIGINT) AS career_movie_count, avg(average_rating) AS career_average_rating, CAST(sum(num_votes) AS BIGINT) AS career_total_votes
  FROM past GROUP BY nconst HAVING count(DISTINCT tconst) >= 10 AND sum(num_votes) >= 100000 AND avg(average_rating) >= 5.5)"""
BEST = ", ".join(f"'{b}'" for b in BEST_PICTURE)
NOMS = with_views("award_rows") + f""", noms AS (SELECT trim(t) AS tconst, TRY_CAST(Ceremony AS INTEGER) AS ceremony, Year AS award_year, Class AS award_class, CanonicalCategory AS canonical_category, Category AS category,
  Film AS film_title_raw, Name AS nominee_name, Nominees AS nominees, NomineeIds AS nominee_ids_raw, coalesce(lower(trim(Winner)) = 'true', false) AS is_winner, Detail AS detail, Note AS note,
  CanonicalCategory IN ({BEST}) AS is_best_picture_category, Class = 'Acting' AS is_acting_category, Class = 'Directing' AS is_directing_category, Class = 'Writing' AS is_writing_category
  FROM (SELECT *, unnest(string_split(FilmId, '|')) AS t FROM award_rows) WHERE regexp_full_match(trim(t), 'tt[0-9]+'))"""


def _sum(flag: str, name: str) -> str:
    return f"CAST(sum(CAST({flag} AS INTEGER)) AS BIGINT) AS {name}"


AWARDS = NOMS + f""", aw AS (SELECT tconst, CAST(count(*) AS BIGINT) AS oscar_nomination_count, {_sum('is_winner', 'oscar_win_count')}, bool_or(is_winner) AS was_oscar_winner, true AS was_oscar_nominated,
  min(ceremony) AS first_oscar_ceremony, max(ceremony) AS last_oscar_ceremony, {_sum('is_best_picture_category', 'best_picture_nomination_count')}, {_sum('(is_best_picture_category AND is_winner)', 'best_picture_win_count')},
  bool_or(is_best_picture_category AND is_winner) AS best_picture_won, bool_or(is_best_picture_category) AS best_picture_nominated,
  {', '.join(_sum(f'is_{g}_category', f'{g}_nomination_count') + ', ' + _sum(f'(is_{g}_category AND is_winner)', f'{g}_win_count') for g in ('acting', 'directing', 'writing'))} FROM noms GROUP BY tconst)"""
AWARD_COUNTS = [f"{g}_{k}_count" for g in ("oscar", "best_picture", "acting", "directing", "writing") for k in ("nomination", "win")]
TAGGED = with_views("tagged") + ", t AS (SELECT * EXCLUDE (genre_list), CASE WHEN trim(genre_list) <> '' THEN string_split(genre_list, ',') END AS genres FROM tagged)"
DECADE = "CAST(floor(start_year / 10) * 10 AS INTEGER)"
HIT = "CASE WHEN average_rating >= 7 AND num_votes >= 1000 THEN 1 WHEN average_rating < 7 OR num_votes < 1000 THEN 0 END"
DECADES = TAGGED + f""", x AS (SELECT *, {DECADE} AS decade, unnest(genres) AS genre FROM t), stats AS (SELECT decade, genre, CAST(count(*) AS BIGINT) AS film_count, CAST(quantile_disc(average_rating, 0.5) AS DOUBLE) AS median_rating, CAST(sum(num_votes) AS BIGINT) AS total_votes, CAST(quantile_disc(num_votes, 0.5) AS DOUBLE) AS median_votes
  FROM x WHERE genre <> '' AND decade IS NOT NULL GROUP BY ALL)"""
SCORED = with_views("scored")
RATES = "CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS precision, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS recall, CASE WHEN tp > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS positive_f1, CAST(tp + tn AS DOUBLE) / nullif(tp + fp + fn + tn, 0) AS accuracy, CAST(tp + fn AS DOUBLE) / nullif(tp + fp + fn + tn, 0) AS prevalence"
CELLS = "CAST(count(*) FILTER (label = 1 AND p) AS BIGINT) AS tp, CAST(count(*) FILTER (label = 0 AND p) AS BIGINT) AS fp, CAST(count(*) FILTER (label = 1 AND NOT p) AS BIGINT) AS fn, CAST(count(*) FILTER (label = 0 AND NOT p) AS BIGINT) AS tn"


def _sweep(thresholds: tuple[float, ...]) -> str:
    return SCORED + f""", th AS (SELECT CAST(unnest([{', '.join(map(str, thresholds))}]) AS DOUBLE) AS threshold),
s AS (SELECT threshold, label, positive_score >= threshold AS p FROM scored, th), c AS (SELECT threshold, {CELLS} FROM s GROUP BY threshold), sweep AS (SELECT *, {RATES} FROM c)"""


SWEEP = _sweep(HIT_THRESHOLDS)


def _checks(source: str, key: str, checks: list[tuple[str, str, str]]) -> str:
    lines = [f"SELECT 'no_rows' AS \"check\", 'error' AS severity, CAST(count(*) = 0 AS BIGINT) AS violations FROM {source}", f"SELECT 'key_repeated', 'error', CAST(count({key}) - count(DISTINCT {key}) AS BIGINT) FROM {source}"]
    return "\n" + " UNION ALL ".join([*lines, *(f"SELECT '{n}', '{s}', CAST(count(*) FILTER ({c}) AS BIGINT) FROM {source}" for n, s, c in checks)])


def _negative(*columns: str) -> list[tuple[str, str, str]]:
    return [(f"{c}_negative", "error", f"{c} < 0") for c in columns]


NULL_KEY = ("tconst_null", "error", "tconst IS NULL")
GRID = " UNION ALL ".join(f"SELECT CAST({r} AS DOUBLE) AS rating_min, CAST({v} AS BIGINT) AS votes_min, avg(CASE WHEN average_rating >= {r} AND num_votes >= {v} THEN 1 WHEN average_rating < {r} OR num_votes < {v} THEN 0 END) AS hit_rate FROM t" for r in (6.5, 7.0, 7.5) for v in (500, 1000, 5000))
PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM t" for c in ("tconst", "primary_title", "start_year", "runtime_minutes", "average_rating", "num_votes", "genres"))
PARTS = " UNION ALL ".join(f"SELECT '{n}' AS part, CAST(count(*) AS BIGINT) AS rows, min(start_year) AS min_year, max(start_year) AS max_year, CAST(coalesce(sum(label), 0) AS BIGINT) AS positives, avg(label) AS positive_rate FROM scored WHERE {c}" for n, c in (("train", "start_year <= 1997"), ("validation", "start_year BETWEEN 1998 AND 1999"), ("test", "start_year BETWEEN 2000 AND 2001")))

ROUNDED = "* REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in FLOATS) + ")"

SQL: dict[str, str] = {
    "enriched_orders": BASE + ENRICHED + f" SELECT {ROUNDED} FROM enriched",
    "null_marks": r"SELECT c_custkey, nullif(CASE WHEN c_custkey % 7 = 0 THEN '\N' ELSE c_mktsegment END, '\N') AS segment, nullif(CASE WHEN c_custkey % 5 = 0 THEN '\N' ELSE CAST(c_nationkey AS VARCHAR) END, '\N') AS nation FROM customer",
    "typed_casts": "SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'x1' ELSE CAST(o_custkey AS VARCHAR) END AS INTEGER) AS as_int, TRY_CAST(CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS BIGINT) AS as_long, TRY_CAST(CASE WHEN o_orderkey % 5 = 0 THEN '1.5' ELSE 'n/a' END AS DOUBLE) AS as_double FROM orders",
    "filter_roles": with_views("edges") + f" SELECT category, CAST(count(*) AS BIGINT) AS n FROM edges WHERE category IN ({ROLES}) GROUP BY category",
    "filter_category": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
    "regex_ids": with_views("award_rows") + " SELECT FilmId, CAST(count(*) AS BIGINT) AS n FROM award_rows WHERE regexp_full_match(FilmId, 'tt[0-9]+') GROUP BY FilmId",
    "tag_arrays": TAGGED + " SELECT tconst, CAST(coalesce(len(genres), -1) AS INTEGER) AS n_tags, array_to_string(genres, '/') AS tags FROM t",
    "exploded_tags": TAGGED + " SELECT * FROM (SELECT tconst, unnest(genres) AS genre FROM t) WHERE genre <> ''",
    "rated_join": "WITH r AS (SELECT l_orderkey, max(CASE WHEN l_linenumber > 1 THEN l_linenumber END) AS average_rating, CAST(count(*) AS BIGINT) AS num_votes FROM lineitem GROUP BY 1) SELECT o_orderkey AS tconst, o_orderpriority AS primary_title, o_orderstatus AS original_title, CAST(year(o_orderdate) AS INTEGER) AS start_year, CAST(o_custkey % 260 AS INTEGER) AS runtime_minutes, o_orderpriority AS genres, average_rating, num_votes FROM orders JOIN r ON o_orderkey = l_orderkey",
    "restricted_edges": with_views("items", "edges") + " SELECT tconst, CAST(count(*) AS BIGINT) AS n FROM edges WHERE tconst IN (SELECT tconst FROM items WHERE start_year <= 1997) GROUP BY tconst",
    "names_join": BASE + " SELECT e.nconst, s_name AS primary_name, CAST(count(*) AS BIGINT) AS n FROM e LEFT JOIN supplier s ON e.nconst = s_suppkey GROUP BY 1, 2",
    "known_flags": KNOWN + " SELECT e.nconst, coalesce(is_known_person, false) AS is_known_person, CAST(count(*) AS BIGINT) AS n FROM e LEFT JOIN career ON e.nconst = career.nconst GROUP BY 1, 2",
    "career_lookup": KNOWN + " SELECT * FROM career",
    "entity_history": BASE + " SELECT * FROM past",
    "entity_history_window": BASE + " SELECT * FROM past",
    "role_features": BASE + FEATURES + f" SELECT {ROUNDED} FROM feats",
    "award_nominations": NOMS + " SELECT * FROM noms",
    "award_features": AWARDS + " SELECT * FROM aw",
    "awards_enriched": AWARDS + ", b AS (SELECT concat('tt', c_custkey) AS tconst, c_mktsegment FROM customer) SELECT b.*, first_oscar_ceremony, last_oscar_ceremony, " + ", ".join([*(f"coalesce({c}, 0) AS {c}" for c in AWARD_COUNTS), *(f"coalesce({c}, false) AS {c}" for c in ("was_oscar_nominated", "was_oscar_winner", "best_picture_nominated", "best_picture_won"))]) + " FROM b LEFT JOIN aw ON b.tconst = aw.tconst",
    "genre_decades": DECADES + " SELECT * FROM stats",
    "runtime_buckets": TAGGED + " SELECT CAST(floor(runtime_minutes / 15) * 15 AS INTEGER) AS runtime_bucket, CAST(count(*) AS BIGINT) AS film_count, CAST(quantile_disc(average_rating, 0.5) AS DOUBLE) AS median_rating, avg(average_rating) AS mean_rating, CAST(sum(num_votes) AS BIGINT) AS total_votes FROM t WHERE runtime_minutes BETWEEN 40 AND 240 GROUP BY 1 HAVING count(*) >= 5",
    "anomalies": TAGGED + ", c AS (SELECT CAST(quantile_disc(num_votes, 0.1) AS DOUBLE) AS vote_cut_used FROM t) SELECT tconst, primary_title, start_year, average_rating, num_votes, runtime_minutes, vote_cut_used FROM t, c WHERE average_rating >= 8 AND num_votes <= vote_cut_used",
    "prior_vs_rating": BASE + ENRICHED + " SELECT tconst, primary_title, start_year, average_rating, num_votes, round(director_prior_rating_mean, 6) AS director_prior_rating_mean, round(director_prior_movie_count_mean, 6) AS director_prior_movie_count_mean, director_prior_votes_sum FROM enriched WHERE director_prior_rating_mean IS NOT NULL",
    "prior_correlation": BASE + ENRICHED + " SELECT round(corr(director_prior_rating_mean, average_rating), 6) AS r, CAST(count(*) AS BIGINT) AS n FROM enriched WHERE director_prior_rating_mean IS NOT NULL AND average_rating IS NOT NULL",
    "signal_lift": TAGGED + f", l AS (SELECT *, {HIT} AS is_hit FROM t), b AS (SELECT *, ntile(4) OVER (ORDER BY num_votes, tconst) AS signal_band, avg(is_hit) OVER () AS base FROM l WHERE is_hit IS NOT NULL AND num_votes IS NOT NULL) SELECT CAST(signal_band AS INTEGER) AS signal_band, CAST(count(*) AS BIGINT) AS film_count, min(num_votes) AS signal_min, max(num_votes) AS signal_max, round(avg(num_votes), 9) AS signal_mean, round(avg(is_hit), 9) AS outcome_rate, round(avg(is_hit) / nullif(max(base), 0), 9) AS lift_vs_eligible FROM b GROUP BY 1",
    "label_grid": TAGGED + " " + GRID,
    "label_rate": TAGGED + f" SELECT avg({HIT}) AS base_rate FROM t",
    "genre_flags": TAGGED + " SELECT tconst, " + ", ".join(f"CAST(coalesce(list_contains(genres, '{g}'), false) AS INTEGER) AS genre_{g.lower()}" for g in ("Red", "blue", "Drama")) + " FROM t",
    "modeling_rows": BASE + ENRICHED + f" SELECT tconst, CAST({HIT} AS INTEGER) AS is_hit, CAST(CASE WHEN tconst % 3 = 0 AND tconst % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS label_awards, CAST(has_known_cast AS INTEGER) AS has_known_cast, CAST(has_known_director AS INTEGER) AS has_known_director, 1 AS genre_drama, 0 AS genre_comedy FROM enriched",
    "top_tags": TAGGED + " SELECT genre, CAST(count(*) AS BIGINT) AS film_count FROM (SELECT unnest(genres) AS genre FROM t) WHERE genre <> '' GROUP BY genre ORDER BY 2 DESC, 1 LIMIT 15",
    "decade_profile": TAGGED + f" SELECT {DECADE} AS decade, CAST(count(*) AS BIGINT) AS film_count, avg(average_rating) AS mean_rating, avg(num_votes) AS mean_votes FROM t WHERE start_year IS NOT NULL GROUP BY 1",
    "null_profile": TAGGED + " " + PROFILE,
    "item_summary": TAGGED + " SELECT CAST(count(*) AS BIGINT) AS rows, avg(average_rating) AS mean_rating, avg(num_votes) AS mean_votes, min(start_year) AS min_year, max(start_year) AS max_year FROM t",
    "tag_trends": DECADES + ", top AS (SELECT genre, CAST(sum(film_count) AS BIGINT) AS film_total FROM stats GROUP BY genre ORDER BY 2 DESC, 1 LIMIT 8), fit AS (SELECT genre, min(decade) AS first_decade, max(decade) AS last_decade, arg_min(median_rating, decade) AS first_median, arg_max(median_rating, decade) AS last_median FROM stats WHERE film_count >= 5 GROUP BY genre) SELECT top.*, first_decade, last_decade, first_median, last_median, last_median - first_median AS rating_change FROM top JOIN fit ON top.genre = fit.genre",
    "temporal_split": SCORED + " " + PARTS,
    "class_weights": SCORED + ", n AS (SELECT label, count(*) AS n FROM scored GROUP BY label), a AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM n WHERE label IS NOT NULL) SELECT label, CASE WHEN label IS NOT NULL THEN total / (2 * n) END AS class_weight, CAST(n AS BIGINT) AS n FROM n, a",
    "applied_threshold": SCORED + " SELECT label, CAST(positive_score >= CAST(0.35 AS DOUBLE) AS DOUBLE) AS prediction, CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY 1, 2",
    "confusion_metrics": SCORED + f", c AS (SELECT {CELLS} FROM (SELECT label, positive_score >= CAST(0.35 AS DOUBLE) AS p FROM scored)) SELECT *, {RATES} FROM c",
    "threshold_sweep": SWEEP + " SELECT * FROM sweep",
    "threshold_edges": _sweep((0.0, 0.5, 1.0)) + " SELECT * FROM sweep",
    "threshold_choice": SWEEP + " SELECT threshold, tp, fp FROM sweep WHERE recall >= 0.25 ORDER BY positive_f1 DESC, recall DESC, precision DESC, threshold DESC LIMIT 1",
    "roc_area": SCORED + ", r AS (SELECT label, rank() OVER (ORDER BY positive_score) + (count(*) OVER (PARTITION BY positive_score) - 1) / 2.0 AS k FROM scored WHERE label IS NOT NULL), s AS (SELECT CAST(sum(label) AS DOUBLE) AS p, CAST(count(*) - sum(label) AS DOUBLE) AS n, CAST(sum(CASE WHEN label = 1 THEN k END) AS DOUBLE) AS k FROM r) SELECT round((k - p * (p + 1) / 2) / (p * n), 9) AS roc_auc FROM s",
    "quality_items": with_views("items") + _checks("items", "tconst", [NULL_KEY, ("average_rating_range", "error", "average_rating NOT BETWEEN 1 AND 10"), ("num_votes_negative", "error", "num_votes < 0"), ("runtime_minutes_not_positive", "warning", "runtime_minutes <= 0"), ("start_year_range", "warning", "start_year NOT BETWEEN 1870 AND 2035")]),
    "quality_features": BASE + FEATURES + _checks("feats", "tconst", [NULL_KEY, *_negative("principal_count", "cast_count", "director_count", "writer_count", "producer_count", "known_cast_count", "known_director_count", "cast_prior_movie_count_mean", "director_prior_movie_count_mean", "principal_prior_movie_count_mean")]),
    "quality_awards": AWARDS + _checks("aw", "tconst", [NULL_KEY, ("wins_over_nominations", "error", "oscar_win_count > oscar_nomination_count"), *_negative("oscar_nomination_count", "oscar_win_count", "best_picture_nomination_count", "best_picture_win_count")]),
    "quality_edges": with_views("edges") + _checks("edges", "tconst", [NULL_KEY, ("role_null", "error", "category IS NULL"), ("self_role", "warning", "category = 'self'")]),
    "distinct_counts": BASE + " SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT nconst) AS BIGINT) AS people, CAST(count(DISTINCT tconst) AS BIGINT) AS films FROM e",
    "history_rank": BASE + GROUPED + ", b AS (SELECT g, rows_.nconst, max(c) AS prior_movie_count FROM rows_ JOIN past ON rows_.tconst = past.tconst AND rows_.nconst = past.nconst GROUP BY 1, 2) SELECT g, nconst, prior_movie_count FROM b QUALIFY row_number() OVER (PARTITION BY g ORDER BY prior_movie_count DESC, nconst) <= 3",
}


MARK = "concat(chr(92), 'N')"


def _unmarked(columns: str) -> str:
    return ", ".join(f"nullif({c}, {MARK}) AS {c}" for c in columns.split())


def _whole(columns: str) -> str:
    return ", ".join(f"TRY_CAST({c} AS INTEGER) AS {c}" for c in columns.split())


TITLES = f""", rt AS (SELECT {_unmarked("tconst titleType primaryTitle originalTitle isAdult startYear endYear runtimeMinutes genres")} FROM raw_titles),
titles AS (SELECT tconst, titleType, primaryTitle, originalTitle, {_whole("isAdult startYear endYear runtimeMinutes")}, replace(genres, ',', '/') AS genres FROM rt WHERE titleType = 'movie')"""
RATINGS = f""", rr AS (SELECT {_unmarked("tconst averageRating numVotes")} FROM raw_ratings),
ratings AS (SELECT tconst, TRY_CAST(averageRating AS DOUBLE) AS averageRating, TRY_CAST(numVotes AS BIGINT) AS numVotes FROM rr)"""
MOVIES = TITLES + RATINGS + """, movies AS (SELECT titles.tconst, primaryTitle AS primary_title, originalTitle AS original_title, startYear AS start_year, runtimeMinutes AS runtime_minutes, genres, averageRating AS average_rating, numVotes AS num_votes
  FROM titles JOIN ratings ON titles.tconst = ratings.tconst)"""
PEOPLE = f""", rp AS (SELECT {_unmarked("tconst ordering nconst category job characters")} FROM raw_principals),
principals AS (SELECT tconst, TRY_CAST(ordering AS INTEGER) AS ordering, nconst, category, job, characters FROM rp WHERE category IN ({ROLES}))"""
#: The jobs' tables under the names that the history's SQL reads.
RAW_BASE = with_views("raw_titles", "raw_ratings", "raw_principals") + MOVIES + PEOPLE + ", items AS (SELECT tconst, start_year, runtime_minutes, average_rating, num_votes FROM movies), edges AS (SELECT * FROM principals WHERE tconst IN (SELECT tconst FROM items))" + HISTORY
PREDICTORS = ("start_year", "runtime_minutes", *(c for c in NUMERIC_PREDICTORS[2:]), *BOOLEAN_PREDICTORS)
TAGS = ", ".join(f"CAST({int(g in ('Drama', 'Crime'))} AS DOUBLE) AS genre_{g.lower()}" for g in TOP_GENRES)
NAME_LISTS = ", ".join(f"replace({a}, ',', '/') AS {b}" for a, b in (("primaryProfession", "primary_profession"), ("knownForTitles", "known_for_titles")))
SQL |= {
    "raw_titles": with_views("raw_titles") + TITLES + " SELECT * FROM titles",
    "raw_ratings": with_views("raw_ratings") + RATINGS + " SELECT * FROM ratings",
    "raw_principals": with_views("raw_principals") + PEOPLE + " SELECT * FROM principals",
    "raw_names": with_views("raw_names") + f", n AS (SELECT {_unmarked('nconst primaryName birthYear deathYear primaryProfession knownForTitles')} FROM raw_names) SELECT nconst, primaryName AS primary_name, TRY_CAST(birthYear AS INTEGER) AS birth_year, TRY_CAST(deathYear AS INTEGER) AS death_year, {NAME_LISTS} FROM n",
    "imputed_features": BASE + ENRICHED + " SELECT tconst, " + ", ".join(f"round(coalesce(CAST({c} AS DOUBLE), avg(CAST({c} AS DOUBLE)) OVER ()), 6) AS {c}" for c in ("start_year", "runtime_minutes", "director_prior_rating_mean")) + " FROM enriched",
    "vector_scores": SCORED + " SELECT tconst, positive_score FROM scored",
    "evaluated_scores": SCORED + f""", l AS (SELECT label, positive_score, positive_score >= CAST(0.35 AS DOUBLE) AS p FROM scored WHERE label IS NOT NULL), cells AS (SELECT {CELLS} FROM l),
by_score AS (SELECT positive_score AS s, sum(label) AS pos, count(*) AS n FROM l GROUP BY 1),
cum AS (SELECT s, sum(pos) OVER w AS tps, sum(n) OVER w AS taken FROM by_score WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT s, CAST(tps AS DOUBLE) / (SELECT sum(pos) FROM by_score) AS r, CAST(tps AS DOUBLE) / taken AS p, CAST(taken - tps AS DOUBLE) / (SELECT sum(n - pos) FROM by_score) AS f FROM cum),
steps AS (SELECT r, p, f, lag(r, 1, 0.0) OVER o AS r0, coalesce(lag(p) OVER o, p) AS p0, lag(f, 1, 0.0) OVER o AS f0 FROM curve WINDOW o AS (ORDER BY s DESC))
SELECT cells.*, round(a.roc, 9) AS roc_auc, round(a.pr, 9) AS pr_auc FROM cells, (SELECT sum((f - f0) * (r + r0) / 2) AS roc, sum((r - r0) * (p + p0) / 2) AS pr FROM steps) a""",
    "raw_marks": with_views("raw_names") + " SELECT nconst, birthYear, deathYear, primaryProfession FROM raw_names",
    "raw_quotes": with_views("raw_quotes") + " SELECT * FROM raw_quotes",
    "raw_inventory": "SELECT CAST(count(*) AS BIGINT) AS rows, 'nconst,primaryName,birthYear,deathYear,primaryProfession,knownForTitles' AS header, true AS sized FROM supplier",
    "raw_awards": NOMS + " SELECT * FROM noms",
    "published_items": with_views("items") + " SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(num_votes) AS BIGINT) AS votes, CAST(count(DISTINCT tconst) AS BIGINT) AS films, CAST(count(*) AS BIGINT) AS reported, true AS passed FROM items",
    "bronze_job": with_views("raw_titles", "raw_ratings") + MOVIES + " SELECT *, CAST(count(*) OVER () AS BIGINT) AS counted FROM movies",
    "features_job": RAW_BASE + ENRICHED + f" SELECT {ROUNDED} FROM enriched",
    "enriched_checks": "SELECT b AS baseline, CAST(e AS INTEGER) AS errors, e = 0 AS passed, CAST(n AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM orders), (VALUES ('same', 0), ('more', 2)) v(b, e)",
    "awards_checks": "SELECT b AS baseline, CAST(e AS INTEGER) AS errors, e = 0 AS passed, CAST(n + more AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM customer), (VALUES ('same', 0, 0), ('repeated', 2, 1)) v(b, e, more)",
    "predictor_frame": BASE + ENRICHED + " SELECT tconst, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in PREDICTORS) + f", {TAGS} FROM enriched",
}
SQL["streamed_names"] = SQL["raw_names"]
SQL |= {f"{name}_approx": SQL[name] for name in ("genre_decades", "runtime_buckets", "anomalies")}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
