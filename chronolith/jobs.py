"""The batch jobs, their order, and a command line."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.clean import prepare_names, prepare_principals, prepare_ratings, prepare_titles
from .functions.labels import available_predictors, modeling_frame, predictors_as_double, with_hit_label
from .ml.contract import check_artifact, leakage_notes
from .ml.pipeline import AWARDS_COHORT, AWARDS_THRESHOLDS, HIT_COHORT, HIT_THRESHOLDS, save, train
from .operators import analytics, enrich, explode, history, quality, rollup
from .schemas import FEATURE_VERSION, HIGH_SCORE, KNOWN_ITEMS, KNOWN_SCORE, NAMES, PRINCIPALS, RATINGS, TITLES
from .session import build_session
from .sources.lake import Lake, default_root, storage_backend, storage_errors
from .sources.readers import read_awards, read_parquet, read_tsv
from .sources.sinks import dump_plan, publish, write_metrics


def bronze(spark: SparkSession, lake: Lake) -> dict:
    """Titles and their ratings to one table."""
    began = time.time()
    paths = {k: lake.at("raw", f"{k}.tsv.gz").uri for k in ("title.basics", "title.ratings")}
    titles = prepare_titles(read_tsv(spark, paths["title.basics"], TITLES))
    movies = enrich.rated_movies(titles, prepare_ratings(read_tsv(spark, paths["title.ratings"], RATINGS)))
    plan = lake.at("plans", "bronze.txt")
    dump_plan(movies, plan)
    out = publish(movies, lake.at("bronze", "movies_ratings").uri, quality.validate_movies, root=lake.base.uri)
    return write_metrics(lake.at("metrics", "baseline_metrics.json"), "bronze", input_paths=paths, row_counts={"joined_movies_ratings": out["rows"]}, plan_path=plan.uri, total_seconds=round(time.time() - began, 3), **out)


def features(spark: SparkSession, lake: Lake) -> dict:
    """Point-in-time cast and crew features, and the enriched table."""
    movies = read_parquet(spark, lake.at("bronze", "movies_ratings").uri).cache()
    edges = enrich.restrict(prepare_principals(read_tsv(spark, lake.at("raw", "title.principals.tsv.gz").uri, PRINCIPALS)), movies).cache()
    names = prepare_names(read_tsv(spark, lake.at("raw", "name.basics.tsv.gz").uri, NAMES))
    past = history.entity_history(edges, movies).cache()
    try:
        table = rollup.role_features(edges, past)
        plan = lake.at("plans", "cast_crew.txt")
        dump_plan(table, plan)
        counts = edges.agg(F.count(F.lit(1)).alias("movie_related_principals"), F.countDistinct("nconst").alias("distinct_people"), F.countDistinct("tconst").alias("distinct_movies")).first().asDict()
        counts["principals_with_names"] = enrich.attach_names(edges, names).where("primary_name IS NOT NULL").count()
        counts["known_people"] = rollup.known_people(past).count()
        feature_out = publish(table, lake.at("silver", "cast_crew_features").uri, quality.validate_features, root=lake.base.uri)
        total, columns = movies.count(), movies.columns
        enriched = enrich.enriched_movies(movies, read_parquet(spark, feature_out["output_path"]))
        enriched_out = publish(enriched, lake.at("silver", "movies_enriched").uri, lambda df: quality.validate_enriched(df, total, columns), root=lake.base.uri)
    finally:
        for df in (movies, edges, past):
            df.unpersist()
    parameters = {"high_score": HIGH_SCORE, "known_items": KNOWN_ITEMS, "known_score": KNOWN_SCORE}
    return write_metrics(lake.at("metrics", "cast_crew_metrics.json"), "features", feature_semantics_version=FEATURE_VERSION, parameters=parameters, row_counts=counts, cast_crew=feature_out, enriched=enriched_out, plan_paths=[plan.uri])


def awards(spark: SparkSession, lake: Lake) -> dict:
    """Award nominations, their features, and the table enriched with them."""
    silver = lake.at("silver", "movies_enriched")
    version = None
    if silver.exists():
        metadata = json.loads(lake.at("metrics", "cast_crew_metrics.json").read_text())
        check_artifact(metadata)
        version = metadata["feature_semantics_version"]
    source = silver if silver.exists() else lake.at("bronze", "movies_ratings")
    nominations = explode.award_nominations(read_awards(spark, lake.at("raw", "oscars.csv").uri))
    bronze_out = publish(nominations, lake.at("bronze", "oscars_nominations").uri, root=lake.base.uri)
    table = rollup.award_features(read_parquet(spark, bronze_out["output_path"]))
    plan = lake.at("plans", "oscars.txt")
    dump_plan(table, plan)
    feature_out = publish(table, lake.at("silver", "movie_oscar_features").uri, quality.validate_award_features, root=lake.base.uri)
    movies = read_parquet(spark, source.uri)
    total, columns = movies.count(), movies.columns
    enriched = enrich.awards_enriched_movies(movies, read_parquet(spark, feature_out["output_path"]))
    enriched_out = publish(enriched, lake.at("silver", "movies_awards_enriched").uri, lambda df: quality.validate_enriched(df, total, columns), root=lake.base.uri)
    one = read_parquet(spark, enriched_out["output_path"]).agg(F.count_if("was_oscar_nominated").alias("rated_nominated"), F.count_if("was_oscar_winner").alias("rated_winners")).first().asDict()
    note = "award columns are known after release and must not predict"
    return write_metrics(lake.at("metrics", "oscar_metrics.json"), "awards", feature_semantics_version=version, source=source.uri, row_counts=one | {"nominations": bronze_out["rows"], "films": feature_out["rows"]}, features=feature_out, enriched=enriched_out, plan_path=plan.uri, leakage_note=note)


def chart_data(lake: Lake, frames: dict[str, DataFrame], prefix: str = "") -> list[str]:
    """The data of each chart as a Parquet folder, in place of pictures; returns where."""
    places = {name: lake.at("charts", f"{prefix}{name}.parquet").uri for name in frames}
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(places[name])
    return list(places.values())


def describe(spark: SparkSession, lake: Lake) -> dict:
    """The descriptive analytics and the data of their charts."""
    movies = read_parquet(spark, lake.at("silver", "movies_enriched").uri).cache()
    labeled = with_hit_label(movies)
    stats = analytics.genre_decade_stats(movies).cache()
    frames = {
        "genre_decade": stats,
        "runtime_profile": analytics.runtime_bucket_stats(movies),
        "signal_lift": analytics.signal_lift(labeled, signal_col="director_prior_movie_count_mean", tie_break=("tconst",)),
        "label_grid": analytics.label_grid(movies),
        "anomalies": analytics.rating_anomalies(movies),
        "director_prior": analytics.director_prior_vs_rating(movies),
        "rating_sample": analytics.seeded_sample(movies, ("average_rating", "num_votes", "runtime_minutes"), 0.05, 1),
    }
    charts = chart_data(lake, frames)
    back = dict(zip(frames, (read_parquet(spark, c) for c in charts)))
    peak = back["runtime_profile"].orderBy(F.desc("film_count")).first()
    rows = lambda df: [r.asDict() for r in df.collect()]
    return write_metrics(
        lake.at("metrics", "analytics_metrics.json"), "analytics", schema_version=2, row_count=movies.count(), charts=charts,
        genre_summary=rows(analytics.genre_summary(back["genre_decade"])), director_prior_rating_corr=analytics.director_prior_correlation(movies),
        anomaly_count_rating_ge_8_bottom_decile_votes=back["anomalies"].count(), base_hit_rate=analytics.label_rate(labeled).first()[0],
        runtime_profile={} if peak is None else {"peak_volume_bucket_minutes": peak.runtime_bucket, "peak_volume_film_count": peak.film_count, "peak_volume_median_rating": peak.median_rating},
        pre_release_signal_lift=rows(back["signal_lift"]), hit_label_sensitivity=rows(back["label_grid"]), notes=leakage_notes(),
    )


def model(spark: SparkSession, lake: Lake, label: str = "is_hit", cohort: dict | None = None, estimators: dict | None = None) -> dict:
    """Train and test the model of a label, save it, and write its metrics."""
    check_artifact(json.loads(lake.at("metrics", "cast_crew_metrics.json").read_text()))
    hit = label == "is_hit"
    frame = modeling_frame(read_parquet(spark, lake.at("silver", "movies_enriched" if hit else "movies_awards_enriched").uri))
    columns = available_predictors(frame)
    fitted, document = train(predictors_as_double(frame, columns), columns, label_col=label, cohort=cohort or (HIT_COHORT if hit else AWARDS_COHORT), thresholds=HIT_THRESHOLDS if hit else AWARDS_THRESHOLDS, estimators=estimators)
    name = "hit" if hit else "awards"
    path = lake.at("models", f"{name}_selected_model").uri
    save(fitted, path)
    frame = lambda rows, schema: spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    curve, measures = document["test_curve"], "threshold double, tp long, fp long, fn long, tn long, precision double, recall double, positive_f1 double"
    charts = chart_data(lake, {
        "candidates": frame(document["candidate_results"], "candidate_id string, roc_auc double, pr_auc double, positive_f1 double"),
        "threshold_sweep": frame(document["threshold_selection"]["sweep"], measures),
        "test_curve": frame(curve, measures).withColumn("false_positive_rate", F.try_divide("fp", F.col("fp") + F.col("tn"))),
        "feature_importance": frame(document["feature_importance"], "feature string, importance double"),
    }, f"{name}_model_")
    return write_metrics(lake.at("metrics", f"{name}_model_metrics.json"), f"{name} model", model_path=path, leakage=leakage_notes(), charts=charts, **document)


STEPS = {
    "bronze": bronze,
    "features": features,
    "awards": awards,
    "analytics": describe,
    "hit-model": model,
    "awards-model": lambda spark, lake: model(spark, lake, "label_awards"),
}


def run(spark: SparkSession, lake: Lake, steps: list[str] | None = None, least_free_gb: float = 0, volume: str | None = None) -> dict[str, dict]:
    """The steps in order, after a check of the storage; the first failure stops the run."""
    lake.create()
    if errors := storage_errors(spark, lake.root, least_free_gb, volume):
        raise RuntimeError("storage is not fit: " + "; ".join(errors))
    return {name: STEPS[name](spark, lake) for name in (steps or list(STEPS))}


def command(root: str, steps: Sequence[str] = (), backend: str | None = None, archive: str | None = None, conf: Mapping[str, str] | None = None) -> list[str]:
    """The command line of a run: Python on one machine, spark-submit to YARN in client mode on a cluster.

    ``archive`` is a zip of the package for machines where it is not installed.
    """
    args = [root, *steps]
    if storage_backend(backend) == "local":
        return [sys.executable, "-m", __package__, *args]
    given = [x for key, value in sorted((conf or {}).items()) for x in ("--conf", f"{key}={value}")]
    return ["spark-submit", "--master", "yarn", "--deploy-mode", "client", *given, *(["--py-files", archive] if archive else []), os.path.join(os.path.dirname(os.path.abspath(__file__)), "__main__.py"), *args]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m chronolith.jobs")
    parser.add_argument("root", help="URI of the data lake; `default` is DATA_ROOT or a folder of STORAGE_BACKEND")
    parser.add_argument("steps", nargs="*", choices=[*STEPS, []], help="steps to run, all by default")
    parser.add_argument("--least-free-gb", type=float, default=50, help="space that the root must have left")
    parser.add_argument("--volume", help="mount point that must hold the root")
    args = parser.parse_args(argv)
    spark = build_session("chronolith-jobs")
    try:
        for name, document in run(spark, Lake(spark, default_root() if args.root == "default" else args.root), args.steps or None, args.least_free_gb, args.volume).items():
            print(name, document["completed_at_utc"])
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
