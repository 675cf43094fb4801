"""Data-quality checks, all of a table's in one pass."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SCORE_RANGE, YEAR_RANGE

MOVIE_COLUMNS = ("tconst", "primary_title", "original_title", "start_year", "runtime_minutes", "genres", "average_rating", "num_votes")


@dataclass
class Result:
    passed: bool = True
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    details: dict[str, object] = field(default_factory=dict)

    def fail(self, message: str) -> None:
        self.passed = False
        self.errors.append(message)

    def raise_if_failed(self) -> Result:
        if not self.passed:
            raise RuntimeError("validation failed: " + "; ".join(self.errors))
        return self

    def as_dict(self) -> dict[str, object]:
        return {"passed": self.passed, "errors": self.errors, "warnings": self.warnings, "details": self.details}


@dataclass(frozen=True)
class Check:
    """A condition that no row may meet."""

    name: str
    violation: Column
    severity: str = "error"


def key_checks(key: str) -> list[Check]:
    return [Check(f"{key}_null", F.col(key).isNull())]


def movie_checks(key: str = "tconst", score: str = "average_rating", weight: str = "num_votes", runtime: str = "runtime_minutes", year: str = "start_year") -> list[Check]:
    return [
        *key_checks(key),
        Check(f"{score}_range", ~F.col(score).between(*SCORE_RANGE)),
        Check(f"{weight}_negative", F.col(weight) < 0),
        Check(f"{runtime}_not_positive", F.col(runtime) <= 0, "warning"),
        Check(f"{year}_range", ~F.col(year).between(*YEAR_RANGE), "warning"),
    ]


NON_NEGATIVE = (
    "principal_count", "cast_count", "director_count", "writer_count", "producer_count", "known_cast_count", "known_director_count",
    "cast_prior_movie_count_mean", "director_prior_movie_count_mean", "principal_prior_movie_count_mean",
)


def feature_checks(columns: tuple[str, ...] = NON_NEGATIVE, key: str = "tconst") -> list[Check]:
    return [*key_checks(key), *[Check(f"{c}_negative", F.col(c) < 0) for c in columns]]


AWARD_NON_NEGATIVE = ("oscar_nomination_count", "oscar_win_count", "best_picture_nomination_count", "best_picture_win_count")


def award_checks(columns: tuple[str, ...] = AWARD_NON_NEGATIVE, key: str = "tconst", wins: str = "oscar_win_count", nominations: str = "oscar_nomination_count") -> list[Check]:
    return [*key_checks(key), Check("wins_over_nominations", F.col(wins) > F.col(nominations)), *[Check(f"{c}_negative", F.col(c) < 0) for c in columns]]


def report(df: DataFrame, checks: list[Check], key: str | None = None) -> DataFrame:
    """check, severity and violations of every check (rows whose key repeats included), from one scan.

    The checks are counted per key first where the key must be unique, so the same
    aggregation finds repeats; map tasks combine both levels.
    """
    counts = [F.count_if(c.violation).alias(f"c{i}") for i, c in enumerate(checks)]
    if key:
        keyed = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *counts)
        repeats = F.coalesce(F.sum(F.when(F.col(key).isNotNull() & (F.col("n") > 1), F.col("n") - 1)), F.lit(0))
        one = keyed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), repeats.alias("repeats"), *[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(len(checks))])
    else:
        one = df.agg(F.count(F.lit(1)).alias("rows"), F.lit(0).cast("long").alias("repeats"), *counts)
    line = lambda name, severity, n: F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"), n.cast("long").alias("violations"))
    lines = [line("no_rows", "error", (F.col("rows") == 0).cast("long")), line("key_repeated", "error", F.col("repeats"))]
    return one.select(F.inline(F.array(*lines, *[line(c.name, c.severity, F.col(f"c{i}")) for i, c in enumerate(checks)])))


def validate(df: DataFrame, checks: list[Check], key: str | None = "tconst", columns: tuple[str, ...] = (), result: Result | None = None) -> Result:
    result = result or Result()
    missing = [c for c in (*columns, *([key] if key else [])) if c not in df.columns]
    if missing:
        result.fail("missing columns: " + ", ".join(sorted(set(missing))))
        return result
    for row in report(df, checks, key).collect():
        if row.violations:
            text = f"{row.check}: {row.violations}"
            result.fail(text) if row.severity == "error" else result.warnings.append(text)
    return result


def check_output_path(path: str, root: str, repository: str | None = None, result: Result | None = None) -> Result:
    """The output must lie below the data root, not in the repository; HDFS paths are URIs."""
    result = result or Result()
    bare, base = path.rstrip("/"), root.rstrip("/")
    if base.startswith("hdfs:") and not bare.startswith("hdfs:"):
        result.fail(f"{path} is no HDFS URI")
    if not (bare + "/").startswith(base + "/"):
        result.fail(f"{path} lies outside the data root {root}")
    if repository and (bare + "/").startswith(repository.rstrip("/") + "/"):
        result.fail(f"{path} lies inside the repository")
    return result


def validate_movies(df: DataFrame) -> Result:
    result = validate(df, movie_checks(), "tconst", MOVIE_COLUMNS)
    if all(c in df.columns for c in MOVIE_COLUMNS):
        from .analytics import null_profile

        profile = null_profile(df).collect()
        result.details |= {"row_count": profile[0].rows, "null_counts": {r.column_name: r.nulls for r in profile}}
    return result


def validate_features(df: DataFrame) -> Result:
    return validate(df, feature_checks(), "tconst", NON_NEGATIVE)


def validate_award_features(df: DataFrame) -> Result:
    return validate(df, award_checks(), "tconst", AWARD_NON_NEGATIVE)


def validate_enriched(df: DataFrame, baseline_rows: int, baseline_columns: list[str], key: str = "tconst") -> Result:
    """Enrichment keeps every row and column of its baseline."""
    result = validate(df, key_checks(key), key, tuple(baseline_columns))
    if (rows := df.count()) != baseline_rows:
        result.fail(f"{rows} rows, the baseline has {baseline_rows}")
    result.details["row_count"] = rows
    return result
