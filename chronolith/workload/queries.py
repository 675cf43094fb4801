"""The registered queries: each operator over a whole table of the driver's."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import jobs
from ..functions import clean, labels
from ..ml import evaluate
from ..ml.pipeline import HIT_THRESHOLDS, candidates, feature_pipeline, train
from ..operators import analytics, enrich, explode, history, quality, rollup
from ..schemas import AWARDS, NAMES, PRINCIPALS, RATINGS, TITLES
from ..sources.lake import Lake, workspace
from ..sources.readers import inventory, read_awards, read_tsv
from ..sources.sinks import publish
from ..streaming import ingest
from .tables import view

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SPLIT = {"train_end": 1997, "validation_end": 1999, "test_end": 2001}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "tagged").withColumn("genres", clean.list_field(F.col("genre_list"))).drop("genre_list")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.relevant_principals(view(spark, sf_dir, "edges"))


def past(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.entity_history(edges(spark, sf_dir), view(spark, sf_dir, "items"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.role_features(edges(spark, sf_dir), past(spark, sf_dir))


def nominations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode.award_nominations(view(spark, sf_dir, "award_rows"))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enriched_movies(view(spark, sf_dir, "items"), features(spark, sf_dir))


def rounded(df: DataFrame) -> DataFrame:
    """Means of fractions to six places: their last digits depend on the order of the sum."""
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


@query
def enriched_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every item with its point-in-time role features or their defaults."""
    return rounded(enriched(spark, sf_dir))


@query
def null_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, r"\N").otherwise(F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_custkey") % 5 == 0, r"\N").otherwise(F.col("c_nationkey").cast("string")).alias("nation"))
    return clean.null_marks(marked)


@query
def typed_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "x1").otherwise(F.col("o_custkey").cast("string")).alias("as_int"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("o_orderkey").cast("string")).alias("as_long"), F.when(F.col("o_orderkey") % 5 == 0, "1.5").otherwise("n/a").alias("as_double"))
    return clean.try_casts(rows, {"as_int": "int", "as_long": "long", "as_double": "double"})


@query
def filter_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query
def filter_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.only(table(spark, sf_dir, "orders"), "o_orderstatus", "F").select("o_orderkey", "o_orderstatus")


@query
def regex_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "award_rows").where(F.col("FilmId").rlike(explode.ITEM_ID)).groupBy("FilmId").agg(F.count(F.lit(1)).alias("n"))


@query
def tag_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).select("tconst", F.coalesce(F.array_size("genres"), F.lit(-1)).alias("n_tags"), F.array_join("genres", "/").alias("tags"))


@query
def exploded_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode.explode_tags(tagged(spark, sf_dir)).select("tconst", "genre")


@query
def rated_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tconst"), F.col("o_orderpriority").alias("primaryTitle"), F.col("o_orderstatus").alias("originalTitle"), F.year("o_orderdate").alias("startYear"), (F.col("o_custkey") % 260).cast("int").alias("runtimeMinutes"), F.col("o_orderpriority").alias("genres"))
    ratings = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tconst")).agg(F.max(F.when(F.col("l_linenumber") > 1, F.col("l_linenumber"))).alias("averageRating"), F.count(F.lit(1)).alias("numVotes"))
    return enrich.rated_movies(titles, ratings)


@query
def restricted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = view(spark, sf_dir, "items").where("start_year <= 1997")
    return enrich.restrict(view(spark, sf_dir, "edges"), early).groupBy("tconst").agg(F.count(F.lit(1)).alias("n"))


@query
def names_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("nconst"), F.col("s_name").alias("primary_name"), F.col("s_nationkey").alias("birth_year"))
    return enrich.attach_names(edges(spark, sf_dir), names).groupBy("nconst", "primary_name").agg(F.count(F.lit(1)).alias("n"))


@query
def known_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = rollup.known_people(past(spark, sf_dir), min_score=5.5)
    return enrich.attach_known_people(edges(spark, sf_dir), known).groupBy("nconst", "is_known_person").agg(F.count(F.lit(1)).alias("n"))


@query
def career_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.known_people(past(spark, sf_dir), min_score=5.5)


@query
def entity_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return past(spark, sf_dir)


@query
def entity_history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.entity_history_by_window(edges(spark, sf_dir), view(spark, sf_dir, "items"))


@query
def role_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features(spark, sf_dir))


@query
def award_nominations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nominations(spark, sf_dir)


@query
def award_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.award_features(nominations(spark, sf_dir))


@query
def awards_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select(F.concat(F.lit("tt"), F.col("c_custkey").cast("string")).alias("tconst"), "c_mktsegment")
    return enrich.awards_enriched_movies(base, award_features(spark, sf_dir))


@query
def genre_decades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.genre_decade_stats(tagged(spark, sf_dir), exact=True)


@query
def runtime_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.runtime_bucket_stats(tagged(spark, sf_dir), min_films=5, exact=True)


@query
def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.rating_anomalies(tagged(spark, sf_dir), exact=True)


def doubled(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in names})


@query
def genre_decades_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the jobs compute them: percentile_approx, then counts around it."""
    return doubled(analytics.genre_decade_stats(tagged(spark, sf_dir)), "median_rating", "median_votes")


@query
def runtime_buckets_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubled(analytics.runtime_bucket_stats(tagged(spark, sf_dir), min_films=5), "median_rating")


@query
def anomalies_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.rating_anomalies(tagged(spark, sf_dir))


@query
def prior_vs_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.director_prior_vs_rating(enriched(spark, sf_dir)))


@query
def prior_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enriched(spark, sf_dir).where("director_prior_rating_mean IS NOT NULL AND average_rating IS NOT NULL")
    return rows.agg(F.round(F.corr("director_prior_rating_mean", "average_rating"), 6).alias("r"), F.count(F.lit(1)).alias("n"))


@query
def signal_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    labeled = labels.with_hit_label(tagged(spark, sf_dir))
    out = analytics.signal_lift(labeled, signal_col="num_votes", tie_break=("tconst",))
    return out.withColumns({c: F.round(c, 9) for c in ("signal_mean", "outcome_rate", "lift_vs_eligible")})


@query
def label_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.label_grid(tagged(spark, sf_dir))


@query
def label_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.label_rate(labels.with_hit_label(tagged(spark, sf_dir)))


@query
def genre_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = labels.add_genre_flags(tagged(spark, sf_dir), ("Red", "blue"))
    top = labels.add_genre_flags(flagged).select("tconst", "genre_red", "genre_blue", "genre_drama")
    return top


@query
def modeling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = enriched(spark, sf_dir).withColumns({"genres": F.array(F.lit("Drama")), "was_oscar_nominated": F.when(F.col("tconst") % 3 == 0, F.col("tconst") % 2 == 0)})
    frame = labels.modeling_frame(frame)
    return frame.select("tconst", "is_hit", "label_awards", "has_known_cast", "has_known_director", "genre_drama", "genre_comedy")


@query
def top_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_tags(tagged(spark, sf_dir))


@query
def decade_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.decade_profile(tagged(spark, sf_dir))


@query
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.null_profile(tagged(spark, sf_dir))


@query
def item_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.summary(tagged(spark, sf_dir))


@query
def tag_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.genre_summary(analytics.genre_decade_stats(tagged(spark, sf_dir), exact=True), min_films=5)


@query
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = zip(("train", "validation", "test"), evaluate.temporal_split(view(spark, sf_dir, "scored"), **SPLIT))
    frames = [evaluate.partition_frame(p, label_col="label").select(F.lit(name).alias("part"), "*") for name, p in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted, _ = evaluate.with_balanced_class_weights(view(spark, sf_dir, "scored"), label_col="label")
    return weighted.groupBy("label", "class_weight").agg(F.count(F.lit(1)).alias("n"))


@query
def applied_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.apply_threshold(view(spark, sf_dir, "scored"), threshold=0.35).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = labels.apply_threshold(view(spark, sf_dir, "scored"), threshold=0.35)
    return evaluate.with_rates(scored.agg(*evaluate.confusion(F.col("label"), F.col("prediction"))))


@query
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.sweep_frame(view(spark, sf_dir, "scored"), label_col="label", thresholds=HIT_THRESHOLDS)


@query
def threshold_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds that every score reaches and that none does: there F1 is NULL."""
    return evaluate.sweep_frame(view(spark, sf_dir, "scored"), label_col="label", thresholds=(0.0, 0.5, 1.0))


@query
def threshold_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.threshold_sweep(view(spark, sf_dir, "scored"), label_col="label", thresholds=HIT_THRESHOLDS)
    best = evaluate.select_threshold(rows, minimum_recall=0.25)
    return spark.range(1).select(F.lit(best["threshold"]).alias("threshold"), F.lit(best["tp"]).cast("long").alias("tp"), F.lit(best["fp"]).cast("long").alias("fp"))


@query
def roc_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.roc_auc(view(spark, sf_dir, "scored"), label_col="label").select(F.round("roc_auc", 9).alias("roc_auc"))


@query
def quality_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(view(spark, sf_dir, "items"), quality.movie_checks(), "tconst")


@query
def quality_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(features(spark, sf_dir), quality.feature_checks(), "tconst")


@query
def quality_awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(award_features(spark, sf_dir), quality.award_checks(), "tconst")


@query
def quality_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [*quality.key_checks("tconst"), quality.Check("role_null", F.col("category").isNull()), quality.Check("self_role", F.col("category") == "self", "warning")]
    return quality.report(view(spark, sf_dir, "edges"), checks, "tconst")


@query
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("nconst").alias("people"), F.countDistinct("tconst").alias("films"))


@query
def history_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest career of each role group at its latest film."""
    rows = past(spark, sf_dir).join(edges(spark, sf_dir).select("tconst", "nconst", rollup.role_group(F.col("category")).alias("g")).distinct(), ["tconst", "nconst"])
    best = rows.groupBy("g", "nconst").agg(F.max("prior_movie_count").alias("prior_movie_count"))
    first = Window.partitionBy("g").orderBy(F.desc("prior_movie_count"), "nconst")
    return best.withColumn("k", F.row_number().over(first)).where("k <= 3").drop("k")


def raw_lake(spark: SparkSession, sf_dir: str, *names: str) -> Lake:
    """A lake whose raw layer holds the views as the sources publish them: gzipped tab-separated text with a header."""
    home = Lake(spark, workspace(spark)).create()
    files = {"raw_titles": "title.basics", "raw_ratings": "title.ratings", "raw_quotes": "title.ratings", "raw_principals": "title.principals", "raw_names": "name.basics"}
    for name in names:
        # no quoting: the sources do not quote either
        view(spark, sf_dir, name).write.options(header=True, sep="\t", quote="\u0000", emptyValue="", compression="gzip").csv(home.at("raw", f"{files[name]}.tsv.gz").uri)
    if not names:
        view(spark, sf_dir, "award_rows").select("*", F.lit('say "x|y"').alias("Citation")).select(AWARDS.names).write.options(header=True, sep="\t", quoteAll=True, escape='"', emptyValue="", compression="none").csv(home.at("raw", "oscars.csv").uri)
    return home


def raw(spark: SparkSession, sf_dir: str, name: str, file: str, schema: StructType, **options: object) -> DataFrame:
    return read_tsv(spark, raw_lake(spark, sf_dir, name).at("raw", f"{file}.tsv.gz").uri, schema, **options)


@query
def raw_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles from their file: null marks, casts, films only, genre lists."""
    rows = clean.prepare_titles(raw(spark, sf_dir, "raw_titles", "title.basics", TITLES))
    return rows.withColumn("genres", F.array_join("genres", "/"))


@query
def raw_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.prepare_ratings(raw(spark, sf_dir, "raw_ratings", "title.ratings", RATINGS))


@query
def raw_principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.prepare_principals(raw(spark, sf_dir, "raw_principals", "title.principals", PRINCIPALS, partitions=8))


@query
def raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean.prepare_names(raw(spark, sf_dir, "raw_names", "name.basics", NAMES))
    return rows.withColumns({c: F.array_join(c, "/") for c in ("primary_profession", "known_for_titles")})


@query
def streamed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stream that runs twice and takes a file once."""
    home = raw_lake(spark, sf_dir, "raw_names")
    stream = ingest.tsv_stream(spark, home.at("raw", "name.basics.tsv.gz").uri, NAMES)
    out, state = home.at("bronze", "names").uri, home.at("samples", "names_state").uri
    for _ in range(2):
        ingest.append_to(stream, out, state, clean.prepare_names).awaitTermination()
    return spark.read.parquet(out).withColumns({c: F.array_join(c, "/") for c in ("primary_profession", "known_for_titles")})


@query
def raw_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a null mark the mark is text."""
    rows = raw(spark, sf_dir, "raw_names", "name.basics", NAMES, null_mark=None)
    return rows.select("nconst", "birthYear", "deathYear", "primaryProfession")


@query
def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a quote character quotes are text."""
    return raw(spark, sf_dir, "raw_quotes", "title.ratings", RATINGS, quote="")


@query
def raw_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inventory(spark, raw_lake(spark, sf_dir, "raw_names").at("raw", "name.basics.tsv.gz").uri, NAMES, count_rows=True)
    return spark.range(1).select(F.lit(found["rows"]).cast("long").alias("rows"), F.lit(",".join(found["header"])).alias("header"), F.lit(found["size_bytes"] > 0).alias("sized"))


@query
def raw_awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nominations from the award file, whose fields are quoted."""
    return explode.award_nominations(read_awards(spark, raw_lake(spark, sf_dir).at("raw", "oscars.csv").uri))


@query
def published_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items validated, published twice and read again, with what the publication reports."""
    home = Lake(spark, workspace(spark)).create()
    place = home.at("silver", "items").uri
    for _ in range(2):
        done = publish(view(spark, sf_dir, "items"), place, lambda df: quality.validate(df, quality.key_checks("tconst")), root=home.base.uri)
    back = spark.read.parquet(place)
    return back.agg(F.count(F.lit(1)).alias("rows"), F.sum("num_votes").alias("votes"), F.countDistinct("tconst").alias("films")).withColumns({"reported": F.lit(done["rows"]).cast("long"), "passed": F.lit(done["validation"]["passed"])})


@query
def bronze_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first job over raw files: films with their ratings, its metrics read back for the counts."""
    home = raw_lake(spark, sf_dir, "raw_titles", "raw_ratings")
    jobs.bronze(spark, home)
    counted = json.loads(home.at("metrics", "baseline_metrics.json").read_text())["row_counts"]["joined_movies_ratings"]
    rows = spark.read.parquet(home.at("bronze", "movies_ratings").uri).withColumn("genres", F.array_join("genres", "/"))
    return rows.withColumn("counted", F.lit(counted).cast("long"))


@query
def features_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two jobs over raw files: the enriched table with its features or their defaults."""
    home = raw_lake(spark, sf_dir, "raw_titles", "raw_ratings", "raw_principals", "raw_names")
    jobs.bronze(spark, home)
    jobs.features(spark, home)
    return rounded(spark.read.parquet(home.at("silver", "movies_enriched").uri).drop("primary_title", "original_title", "genres"))


@query
def enriched_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment against its own baseline, and against one with a row and a column more."""
    items, rows = view(spark, sf_dir, "items"), enriched(spark, sf_dir)
    n = items.count()
    found = [(name, len(r.errors), r.passed, r.details["row_count"]) for name, r in (("same", quality.validate_enriched(rows, n, items.columns)), ("more", quality.validate_enriched(rows, n + 1, [*items.columns, "missing"])))]
    return spark.createDataFrame(found, "baseline string, errors int, passed boolean, rows long")


@query
def awards_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the awards enrichment, whose base has a repeated key too."""
    base = table(spark, sf_dir, "customer").select(F.concat(F.lit("tt"), F.col("c_custkey").cast("string")).alias("tconst"), "c_mktsegment")
    rows, n = enrich.awards_enriched_movies(base, award_features(spark, sf_dir)), base.count()
    twice = rows.unionByName(rows.where("tconst = 'tt1'"))
    found = [(name, len(r.errors), r.passed, r.details["row_count"]) for name, r in (("same", quality.validate_enriched(rows, n, base.columns)), ("repeated", quality.validate_enriched(twice, n, base.columns)))]
    return spark.createDataFrame(found, "baseline string, errors int, passed boolean, rows long")


@query
def predictor_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The allowed predictors that a modeling frame has, as doubles."""
    frame = labels.modeling_frame(enriched(spark, sf_dir).withColumn("genres", F.array(F.lit("Drama"), F.lit("Crime"))))
    columns = labels.available_predictors(frame)
    return rounded(labels.predictors_as_double(frame, columns).select("tconst", *columns))


@query
def imputed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature pipeline's vector, taken apart: values or the column's mean."""
    columns = ["start_year", "runtime_minutes", "director_prior_rating_mean"]
    frame = labels.predictors_as_double(enriched(spark, sf_dir), columns)
    made = feature_pipeline(columns, label_col="is_hit").fit(frame).transform(frame)
    values = vector_to_array("features")
    return made.select("tconst", *[F.round(F.get(values, i), 6).alias(c) for i, c in enumerate(columns)])


@query
def vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive scores from probability vectors."""
    score = F.col("positive_score")
    rows = view(spark, sf_dir, "scored").select("tconst", array_to_vector(F.array(1 - score, score)).alias("probability"))
    return labels.with_positive_score(rows).select("tconst", "positive_score")


@query
def evaluated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts at a threshold, and both areas."""
    rows = labels.apply_threshold(view(spark, sf_dir, "scored").where("label IS NOT NULL"), threshold=0.35)
    found = evaluate.evaluate_predictions(rows, label_col="label")
    return spark.createDataFrame([(*(found[c] for c in ("tp", "fp", "fn", "tn")), round(found["roc_auc"], 9), round(found["pr_auc"], 9))], "tp long, fp long, fn long, tn long, roc_auc double, pr_auc double")


def model_estimators() -> dict[str, object]:
    """The candidates of the production grid."""
    return candidates("is_hit")


@query
def model_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid fitted on the earliest years and compared on the next; the chosen one's locked threshold and test metrics beside it."""
    frame = labels.with_hit_label(enriched(spark, sf_dir), rating_min=7.0, votes_min=100_000)
    columns = ["runtime_minutes", "principal_count", "director_prior_rating_mean", "cast_prior_rating_mean"]
    frame = labels.predictors_as_double(frame.where("is_hit IS NOT NULL"), columns)
    _, document = train(frame, columns, label_col="is_hit", cohort=SPLIT, thresholds=HIT_THRESHOLDS, estimators=model_estimators())
    test, threshold = document["test_metrics"], document["threshold_selection"]["selected"]["threshold"]
    out = []
    for r in document["candidate_results"]:
        chosen = r["candidate_id"] == document["selected_candidate"]["candidate_id"]
        out.append((r["candidate_id"], r["algorithm"], float(r["roc_auc"]), float(r["pr_auc"]), chosen, *((float(threshold), float(test["roc_auc"]), test["positive_f1"], test["tp"] + test["fn"]) if chosen else (None,) * 4)))
    return spark.createDataFrame(out, "candidate string, algorithm string, roc_auc double, pr_auc double, selected boolean, threshold double, test_roc_auc double, test_f1 double, test_positives long")
