"""Which columns may predict, and which artifact versions may be used."""

from __future__ import annotations

from collections.abc import Sequence

from ..schemas import FEATURE_VERSION

# The predictor contract.
NUMERIC_PREDICTORS = (
    "start_year",
    "runtime_minutes",
    "principal_count",
    "cast_count",
    "director_count",
    "writer_count",
    "producer_count",
    "cast_prior_movie_count_mean",
    "cast_prior_rating_mean",
    "director_prior_movie_count_mean",
    "director_prior_rating_mean",
    "writer_prior_movie_count_mean",
    "writer_prior_rating_mean",
    "principal_prior_movie_count_mean",
    "principal_prior_rating_mean",
    "principal_max_prior_rating",
    "known_cast_count",
    "known_director_count",
)
BOOLEAN_PREDICTORS = ("has_known_cast", "has_known_director")
AFTER_RELEASE = ("average_rating", "num_votes", "is_hit")
AWARD_COLUMNS = (
    "oscar_nomination_count",
    "oscar_win_count",
    "was_oscar_winner",
    "was_oscar_nominated",
    "first_oscar_ceremony",
    "last_oscar_ceremony",
    "best_picture_nomination_count",
    "best_picture_win_count",
    "best_picture_won",
    "best_picture_nominated",
    "acting_nomination_count",
    "acting_win_count",
    "directing_nomination_count",
    "directing_win_count",
    "writing_nomination_count",
    "writing_win_count",
)
SNAPSHOT_VOTES = ("cast_prior_votes_sum", "director_prior_votes_sum", "principal_prior_votes_sum")
FULL_CAREER = ("career_movie_count", "career_average_rating", "career_total_votes", "is_known_person")
FORBIDDEN = frozenset({*AFTER_RELEASE, *AWARD_COLUMNS, *SNAPSHOT_VOTES, *FULL_CAREER, "label_awards"})


def check_predictors(columns: Sequence[str], label_col: str | None = None) -> None:
    """ValueError naming the columns that must not predict."""
    wrong = sorted(FORBIDDEN.intersection(columns))
    if wrong:
        raise ValueError("forbidden predictors: " + ", ".join(wrong))
    if label_col in columns:
        raise ValueError(f"the label {label_col} must not predict itself")


def check_artifact(metadata: dict) -> None:
    if metadata.get("feature_semantics_version") != FEATURE_VERSION:
        raise RuntimeError(f"stale features: version {metadata.get('feature_semantics_version')}, {FEATURE_VERSION} is needed; rebuild them")


def leakage_notes() -> dict[str, object]:
    return {
        "hit_label": "rating and votes reach their minimums; both are known only after release",
        "awards_label": "nominated at least once; a missing record means not nominated",
        "history": "only items of strictly earlier years count towards a person's history",
        "snapshot_votes": list(SNAPSHOT_VOTES),
        "excluded": sorted(FORBIDDEN),
    }
