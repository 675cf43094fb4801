"""Operators on small tables, brute force for the histories, plans and a whole run of the jobs."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from chronolith import artifacts, jobs, report, schemas
from chronolith.functions import clean, labels
from chronolith.ml import contract, evaluate, pipeline
from chronolith.operators import analytics, enrich, explode, history, quality, rollup
from chronolith.plans.explain import operators
from chronolith.session import usable_default_fs
from chronolith.sources import lake, readers, sinks
from chronolith.streaming import ingest

MOVIE = "tconst string, primary_title string, original_title string, start_year int, runtime_minutes int, genres array<string>, average_rating double, num_votes long"
EDGE = "tconst string, nconst string, category string"


@pytest.fixture(scope="module")
def movies(spark):
    rows = [("m1", 2005, 8.0, 5000), ("m2", 2010, 7.5, 8000), ("m3", 2020, 6.0, 100), ("m4", 2010, None, 10), ("m5", None, 9.0, 900), ("m6", 2020, 5.0, 1)]
    return spark.createDataFrame([(i, i, i, y, 90, ["Drama"], r, v) for i, y, r, v in rows], MOVIE)


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("m1", "a", "actor"), ("m1", "a", "actress"), ("m2", "a", "director"), ("m2", "a", "writer"), ("m4", "a", "actor"), ("m3", "a", "actor"), ("m5", "a", "actor"), ("m6", "b", "composer"), ("zz", "b", "actor"), ("m3", None, "actor"), ("m3", "b", "self")]
    return clean.relevant_principals(spark.createDataFrame(rows, EDGE))


def brute_history(edges, movies):
    out = {}
    films = {m["tconst"]: m for m in movies}
    pairs = {(e["tconst"], e["nconst"]) for e in edges if e["tconst"] and e["nconst"] and e["tconst"] in films}
    for t, n in pairs:
        year = films[t]["start_year"]
        prior = [films[x] for x, m in pairs if m == n and year is not None and films[x]["start_year"] is not None and films[x]["start_year"] < year]
        scores = [p["average_rating"] for p in prior if p["average_rating"] is not None]
        out[t, n] = (len(prior), round(sum(scores) / len(scores), 9) if scores else None, sum(p["num_votes"] or 0 for p in prior), sum(s >= 7 for s in scores))
    return out


def found(df):
    return {(r.tconst, r.nconst): (r[5], None if r[6] is None else round(r[6], 9), r[7], r[8]) for r in df.collect()}


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_history(edges, movies):
    expected = brute_history(rows_of(edges), rows_of(movies))
    assert expected["m3", "a"] == (3, 7.75, 13010, 2) and expected["m5", "a"] == (0, None, 0, 0)
    assert found(history.entity_history(edges, movies)) == expected
    assert found(history.entity_history_by_window(edges, movies)) == expected


@pytest.mark.parametrize("seed", range(2))
def test_history_property(spark, seed):
    r = random.Random(seed)
    films = [(f"t{i}", "", "", r.choice([None, 2000, 2001, 2002, 2003]), 1, None, r.choice([None, 1.0, 7.0, 8.5]), r.choice([None, 5, 9])) for i in range(40)]
    m = spark.createDataFrame(films, MOVIE)
    e = spark.createDataFrame([(f"t{r.randrange(45)}", f"n{r.randrange(6)}", "actor") for _ in range(150)], EDGE)
    expected = brute_history(rows_of(e), rows_of(m))
    assert found(history.entity_history(e, m)) == found(history.entity_history_by_window(e, m)) == expected


def test_role_features(edges, movies):
    rows = {r.tconst: r for r in rollup.role_features(edges, history.entity_history(edges, movies)).collect()}
    m2, m3 = rows["m2"], rows["m3"]
    assert (m2.principal_count, m2.director_count, m2.writer_count, m2.cast_count) == (1, 1, 1, 0)
    assert m2.principal_prior_votes_sum == 10_000 and m2.cast_prior_rating_mean is None and m2.cast_prior_votes_sum == 0
    assert (rows["m1"].cast_count, rows["m1"].principal_count) == (1, 1)
    assert m3.principal_count == 1 and m3.principal_max_prior_rating == 7.75 and not m3.has_known_cast
    assert rows["m6"].principal_count == 1 and rows["m6"].cast_count == 0
    assert len(rollup.role_features(edges, history.entity_history(edges, movies)).columns) == 22


def test_known_thresholds(spark):
    past = spark.createDataFrame([("a", "p", 9, 8.0, 1, 1), ("b", "q", 10, 8.0, 1, 1)], "tconst string, nconst string, prior_movie_count long, prior_average_rating double, prior_total_votes long, prior_highly_rated_movie_count long")
    e = spark.createDataFrame([("a", "p", "director"), ("b", "q", "director")], EDGE)
    assert {r.tconst: r.has_known_director for r in rollup.role_features(e, past).collect()} == {"a": False, "b": True}


def test_enrichment(edges, movies):
    out = enrich.enriched_movies(movies, rollup.role_features(edges, history.entity_history(edges, movies)).where("tconst <> 'm1'"))
    assert out.count() == movies.count()
    m1 = out.where("tconst = 'm1'").first()
    assert m1.principal_count == 0 and m1.has_known_cast is False and m1.cast_prior_rating_mean is None
    assert quality.validate_enriched(out, 6, movies.columns).passed
    assert not quality.validate_enriched(out, 7, [*movies.columns, "more"]).passed


def test_awards(spark):
    base = ("1", "1927/28", "Acting", "BEST PICTURE", "c", "f", "tt1| tt2", "n", "m", "i", "True", "d", "o", "x")
    rows = [base, (*base[:6], r"\N", *base[7:]), (*base[:2], None, "OTHER", *base[4:6], "tt1", *base[7:10], None, *base[11:])]
    noms = explode.award_nominations(spark.createDataFrame(rows, schemas.AWARDS))
    got = sorted(map(tuple, noms.select("tconst", "is_winner", "is_acting_category").collect()), key=repr)
    assert got == [("tt1", False, None), ("tt1", True, True), ("tt2", True, True)]
    f = {r.tconst: r for r in rollup.award_features(noms).collect()}
    assert (f["tt1"].oscar_nomination_count, f["tt1"].oscar_win_count, f["tt1"].best_picture_won, f["tt1"].acting_win_count) == (2, 1, True, 1)
    assert quality.validate_award_features(rollup.award_features(noms)).passed
    films = spark.createDataFrame([("tt1",), ("tt9",)], "tconst string")
    out = enrich.awards_enriched_movies(films, rollup.award_features(noms)).where("tconst = 'tt9'").first()
    assert (out.oscar_win_count, out.was_oscar_nominated, out.first_oscar_ceremony) == (0, False, None)


def test_readers_and_stream(spark, tmp_path):
    text = "nconst\tprimaryName\tbirthYear\tdeathYear\tprimaryProfession\tknownForTitles\nn1\tA\t1950\t\\N\tactor,writer\t\\N\nn2\t\t19x\t2000\t\\N\ttt1\n"
    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in" / "n.tsv.gz", "wt") as f:
        f.write(text)
    path = str(tmp_path / "in" / "n.tsv.gz")
    rows = clean.prepare_names(readers.read_tsv(spark, path, schemas.NAMES)).orderBy("nconst").collect()
    assert rows[0].primary_profession == ["actor", "writer"] and rows[0].known_for_titles is None and rows[0].death_year is None
    assert rows[1].birth_year is None and rows[1].primary_profession is None
    assert readers.read_tsv(spark, path, schemas.NAMES, null_mark=None).where("deathYear = '\\\\N'").count() == 1
    assert readers.read_tsv(spark, path, schemas.NAMES, partitions=3).rdd.getNumPartitions() == 3
    assert readers.inventory(spark, path, schemas.NAMES, True)["rows"] == 2
    stream = ingest.tsv_stream(spark, str(tmp_path / "in"), schemas.NAMES)
    for _ in range(2):  # a file is taken once
        ingest.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp"), clean.prepare_names).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    quoted = tmp_path / "q.tsv"
    quoted.write_text('tconst\taverageRating\tnumVotes\n3\t"unclosed\tz\n')
    assert readers.read_tsv(spark, str(quoted), schemas.RATINGS).first().numVotes is None
    assert readers.read_tsv(spark, str(quoted), schemas.RATINGS, quote="").first().averageRating == '"unclosed'


def test_lake_guards(spark, tmp_path):
    for bad in ("/", "file:///", lake.REPOSITORY, lake.REPOSITORY + "/data"):
        with pytest.raises(ValueError):
            lake.Lake(spark, bad)
    home = lake.Lake(spark, str(tmp_path / "lake")).create()
    assert home.at("bronze").is_dir() and not home.at("bronze", "x").exists()
    home.at("metrics", "a.json").write_text("hi é")
    assert home.at("metrics", "a.json").read_text() == "hi é" and home.at("metrics", "a.json").is_file() and home.at("metrics").size() == 5
    assert home.holds(home.at("gold").uri) and not home.holds(str(tmp_path))
    assert lake.normalise("/user/x") == "hdfs:///user/x" and lake.normalise("/data") == "/data"
    with pytest.raises(ValueError):
        lake.storage_backend("tape")
    assert usable_default_fs("hdfs://h:1") and not usable_default_fs("hdfs:///") and usable_default_fs("file:///")


def test_publish(spark, movies, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.publish(movies, path, lambda df: quality.validate(df, quality.key_checks("tconst")))["rows"] == 6
    bad = movies.union(movies)
    with pytest.raises(RuntimeError, match="key_repeated"):
        sinks.publish(bad, path, quality.validate_movies)
    assert spark.read.parquet(path).count() == 6
    with pytest.raises(RuntimeError):
        sinks.reread_count(movies, path, 7)


def test_quality(spark, movies):
    bad = spark.createDataFrame([("x", "", "", 1700, 0, None, 11.0, -1), (None, "", "", 2000, 5, None, 5.0, 1)], MOVIE)
    r = quality.validate_movies(bad)
    assert not r.passed and any("average_rating" in e for e in r.errors) and len(r.warnings) == 2 and r.details["null_counts"]["tconst"] == 1
    with pytest.raises(RuntimeError):
        r.raise_if_failed()
    assert not quality.validate_movies(movies.limit(0)).passed and not quality.validate_movies(movies.drop("genres")).passed
    assert quality.check_output_path("/data/lake/bronze", "/data/lake").passed
    assert not quality.check_output_path("/tmp/x", "/data/lake").passed and not quality.check_output_path("/data/x", "hdfs://data").passed
    assert not quality.check_output_path("/r/x/y", "/r", "/r/x").passed


def test_labels_and_contract(spark, movies):
    assert contract.FORBIDDEN.isdisjoint([*contract.NUMERIC_PREDICTORS, *contract.BOOLEAN_PREDICTORS]) and len(contract.FORBIDDEN) == 27
    for c in ("average_rating", "was_oscar_nominated", "career_movie_count", "cast_prior_votes_sum"):
        with pytest.raises(ValueError, match=c):
            contract.check_predictors(["start_year", c])
    with pytest.raises(ValueError):
        pipeline.feature_pipeline(["start_year"], label_col="start_year")
    with pytest.raises(RuntimeError, match="stale"):
        contract.check_artifact({"feature_semantics_version": 1})
    contract.check_artifact({"feature_semantics_version": 2})
    frame = labels.modeling_frame(movies)
    assert labels.available_predictors(frame)[:3] == ["start_year", "runtime_minutes", "genre_drama"]
    assert {r.tconst: r.is_hit for r in frame.collect()} == {"m1": 1, "m2": 1, "m3": 0, "m4": 0, "m5": 0, "m6": 0}
    assert contract.leakage_notes()["excluded"]
    with pytest.raises(ValueError):
        labels.apply_threshold(frame, threshold=1.5)
    assert len(pipeline.HIT_THRESHOLDS) == 37 and pipeline.HIT_THRESHOLDS[-1] == 0.95
    assert len(pipeline.AWARDS_THRESHOLDS) == 38 and pipeline.AWARDS_THRESHOLDS[-1] == 0.75


def test_evaluation(spark):
    years = spark.createDataFrame([("a", 2010), ("b", 2015), ("c", 2020), ("d", None), ("e", 2030)], "tconst string, start_year int")
    parts = evaluate.temporal_split(years, train_end=2014, validation_end=2019, test_end=2024)
    assert [[r.start_year for r in p.collect()] for p in parts] == [[2010], [2015], [2020]]
    with pytest.raises(ValueError):
        evaluate.temporal_split(years, train_end=5, validation_end=5, test_end=6)
    four = spark.createDataFrame([(0,), (0,), (0,), (1,), (None,)], "label int")
    weighted, weights = evaluate.with_balanced_class_weights(four, label_col="label")
    assert weights == {0: 4 / 6, 1: 2.0} and weighted.where("class_weight IS NULL").count() == 1
    with pytest.raises(ValueError):
        evaluate.with_balanced_class_weights(four.where("label = 1"), label_col="label")
    m = evaluate.positive_class_metrics(tp=5, fp=5, fn=15, tn=75)
    assert (m["precision"], m["recall"], round(m["positive_f1"], 9)) == (0.5, 0.25, round(1 / 3, 9))
    assert evaluate.positive_class_metrics(tp=0, fp=0, fn=0, tn=0)["accuracy"] is None
    scored = spark.createDataFrame([(0.0, 0.0, 0.1), (0.0, 0.0, 0.2), (1.0, 1.0, 0.8), (1.0, 1.0, 0.9)], "label double, prediction double, positive_score double")
    e = evaluate.evaluate_predictions(scored, label_col="label")
    assert e["roc_auc"] == e["pr_auc"] == e["positive_f1"] == 1
    assert evaluate.roc_auc(scored, label_col="label").first()[0] == 1
    rows = evaluate.threshold_sweep(scored, label_col="label", thresholds=[0.85, 0.15, 0.5, 0.5])
    assert [(r["threshold"], r["tp"], r["fp"], r["fn"], r["tn"]) for r in rows] == [(0.15, 2, 1, 0, 1), (0.5, 2, 0, 0, 2), (0.85, 1, 0, 1, 2)]
    assert evaluate.select_threshold(rows)["threshold"] == 0.5
    with pytest.raises(ValueError):
        evaluate.select_threshold(rows, minimum_recall=1.1)
    for bad in ([], [0.5, 1.5]):
        with pytest.raises(ValueError):
            evaluate.sweep_frame(scored, label_col="label", thresholds=bad)
    assert evaluate.partition_summary(scored.withColumn("start_year", F.lit(1)), label_col="label")["positives"] == 2


def test_analytics(spark, movies):
    assert analytics.rating_anomalies(movies.limit(0)).count() == 0
    edge = spark.createDataFrame([("a", "a", "a", 1999, m, ["Drama", ""], 8.5, 5) for m in (40, 39, 240, 241)], MOVIE)
    buckets = {r.runtime_bucket: r.film_count for r in analytics.runtime_bucket_stats(edge, min_films=1).collect()}
    assert buckets == {30: 1, 240: 1}
    assert analytics.genre_decade_stats(edge).first().film_count == 4
    with pytest.raises(ValueError):
        analytics.signal_lift(movies, signal_col="num_votes", label_col="num_votes", buckets=1)
    two = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 1), (4.0, 1)], "s double, is_hit int")
    assert [(r.outcome_rate, r.lift_vs_eligible) for r in analytics.signal_lift(two, signal_col="s", buckets=2).collect()] == [(0.0, 0.0), (1.0, 2.0)]
    tied = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 1), (1.0, 0), (1.0, 1)], "s double, is_hit int")
    bands = analytics.signal_lift(tied, signal_col="s", buckets=2).collect()
    assert [r.film_count for r in bands] == [3, 2] and all(abs(r.lift_vs_eligible - 1) < 1e-9 for r in bands)
    none = analytics.signal_lift(two.withColumn("is_hit", F.lit(0)), signal_col="s", buckets=2).collect()
    assert all(r.lift_vs_eligible is None for r in none)
    assert analytics.correlation(two, "s", "is_hit") > 0.8


def test_plans(spark, edges, movies):
    semi = operators(enrich.restrict(edges, movies))
    assert semi["BroadcastHashJoin"] + semi["SortMergeJoin"] == 1 and semi["HashAggregate"] == 0
    assert operators(history.entity_history_by_window(edges, movies.where("start_year IS NOT NULL")))["Window"] == 1
    assert operators(rollup.role_features(edges, history.entity_history(edges, movies)))["Expand"] == 0


def good_document():
    part = lambda a, b: {"rows": 5, "positives": 1, "min_year": a, "max_year": b}
    return {
        "schema_version": 2, "feature_cols": ["start_year"], "partitions": {"train": part(1, 2), "validation": part(3, 4), "test": part(5, 6)},
        "candidate_results": [{"candidate_id": "x"}], "selected_candidate": {"candidate_id": "x", "algorithm": "A"},
        "threshold_selection": {"source": "validation", "selected": {"threshold": 0.5}},
        "test_metrics": {"pr_auc": 0.1, "roc_auc": 0.5, "precision": 0.1, "recall": 0.1, "positive_f1": 0.1, "tp": 1, "fp": 1, "fn": 1, "tn": 1}, "charts": ["c.png"],
    }


def test_artifacts_and_report(tmp_path):
    assert artifacts.model_errors(good_document()) == []
    bad = good_document() | {"schema_version": 1, "feature_cols": ["is_hit"], "threshold_selection": {"source": "test"}, "candidate_results": []}
    bad["partitions"]["test"]["min_year"] = 4
    assert len(artifacts.model_errors(bad)) == 6
    assert len(artifacts.validate_artifacts(tmp_path)) == 5
    (tmp_path / "c.png").write_text("")
    analytics_doc = {"schema_version": 2, "charts": ["c.png"], "genre_summary": [{"genre": "A", "rating_change": 0.5}, {"genre": "B", "rating_change": -0.5}], "director_prior_rating_corr": 0.4681, "anomaly_count_rating_ge_8_bottom_decile_votes": 6712, "runtime_profile": {"peak_volume_bucket_minutes": 90, "peak_volume_film_count": 1000, "peak_volume_median_rating": 6.1}, "pre_release_signal_lift": [{"signal_band": 1, "lift_vs_eligible": 0.5}, {"signal_band": 4, "lift_vs_eligible": 1.41}]}
    for name, doc in (("cast_crew", {"feature_semantics_version": 2, "completed_at_utc": "2"}), ("oscar", {"feature_semantics_version": 2, "completed_at_utc": "3"}), ("analytics", analytics_doc), ("hit_model", good_document()), ("awards_model", good_document())):
        (tmp_path / f"{name}_metrics.json").write_text(json.dumps(doc))
    (tmp_path / "r.md").write_text("x {{FINAL_HIT_F1}}")
    assert artifacts.validate_artifacts(tmp_path, tmp_path) == []
    assert len(artifacts.validate_artifacts(tmp_path, tmp_path, tmp_path / "r.md")) == 1
    filled = report.values(analytics_doc, good_document(), good_document())
    assert report.resolve("{{FINAL_DIRECTOR_CORRELATION}} {{FINAL_NICHE_CANDIDATE_COUNT}}", filled) == "0.468 6,712"
    assert "1.41" in filled["FINAL_SIGNAL_LIFT_FINDING"] and report.number(None) == "N/A"
    with pytest.raises(RuntimeError):
        report.resolve("{{FINAL_NOTHING}}", filled)


def test_jobs_end_to_end(spark, tmp_path):
    """Raw files to a tested model."""
    from pyspark.ml.classification import LogisticRegression

    r = random.Random(1)
    home = lake.Lake(spark, str(tmp_path / "lake")).create()
    films = [(f"tt{i}", "movie" if i % 9 else "short", f"F{i}", f"F{i}", "0", str(1990 + i % 30), r"\N", str(60 + i % 90), "Drama,Comedy" if i % 3 else r"\N") for i in range(600)]
    raw = {
        "title.basics": (schemas.TITLES, films),
        "title.ratings": (schemas.RATINGS, [(f[0], str(round(r.uniform(4, 9.5), 1)), str(r.randrange(50, 9000))) for f in films if int(f[0][2:]) % 7]),
        "title.principals": (schemas.PRINCIPALS, [(f[0], "1", f"n{r.randrange(60)}", r.choice(["actor", "director", "writer", "self"]), r"\N", '["x"]') for f in films for _ in range(4)]),
        "name.basics": (schemas.NAMES, [(f"n{i}", f"N{i}", "1950", r"\N", "actor", "tt1") for i in range(60)]),
    }
    for name, (schema, rows) in raw.items():
        with gzip.open(f"{home.root}/raw/{name}.tsv.gz", "wt") as f:
            f.write("\n".join(["\t".join(schema.names), *map("\t".join, rows)]) + "\n")
    with open(f"{home.root}/raw/oscars.csv", "w") as f:
        line = lambda i: [str(i % 90), "1999", "Acting", "BEST PICTURE", "c", "f", f"tt{i}|tt{i + 1}", "n", "m", "i", "True" if i % 2 else "", "d", "", ""]
        f.write("\n".join(["\t".join(schemas.AWARDS.names), *("\t".join(line(i)) for i in range(0, 600, 5))]) + "\n")
    done = jobs.run(spark, home, ["bronze", "features", "awards", "analytics"])
    assert done["bronze"]["validation"]["passed"] and done["features"]["feature_semantics_version"] == 2
    silver = spark.read.parquet(home.at("silver", "movies_awards_enriched").uri)
    assert silver.count() == done["bronze"]["rows"] and silver.where("was_oscar_nominated").count() > 0
    assert done["analytics"]["runtime_profile"] and len(done["analytics"]["hit_label_sensitivity"]) == 9
    cohort = {"min_year": 1990, "train_end": 2005, "validation_end": 2012, "test_end": 2019}
    doc = jobs.model(spark, home, cohort=cohort, estimators={"lr": LogisticRegression(labelCol="is_hit", weightCol="class_weight", maxIter=5)})
    assert artifacts.model_errors(json.loads(json.dumps(doc, default=str))) == []
    assert home.at("models", "hit_selected_model").is_dir() and doc["feature_importance"]
    awards = {"min_year": 1990, "train_end": 2005, "validation_end": 2012, "test_end": 2019}
    jobs.model(spark, home, "label_awards", cohort=awards, estimators={"lr": LogisticRegression(labelCol="label_awards", weightCol="class_weight", maxIter=5)})
    assert artifacts.validate_artifacts(home.at("metrics").uri) == []
    home.at("charts", "genre_decade.parquet").remove()
    assert len(artifacts.validate_artifacts(home.at("metrics").uri)) == 1


def test_entry_without_corpus_operators():
    import __spark_entry__ as e

    kept = e.corpus_queries, e.corpus_pipeline
    try:
        e.corpus_queries = e.corpus_pipeline = None
        assert set(e.oracle_sql()) <= set(e.queries()) and "enriched_orders" in e.queries()
    finally:
        e.corpus_queries, e.corpus_pipeline = kept


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("one_range", [0, 200_000])
def test_running_sums_and_quantiles(spark, monkeypatch, one_range):
    from chronolith.operators import ranks

    monkeypatch.setattr(ranks, "ONE_RANGE", one_range)
    r = random.Random(4)
    values = [(r.choice([None, *range(9)]), r.choice("ab"), r.choice([None, 0.5, 1.5, 1.5, 7.0, float(r.randrange(300))])) for _ in range(3000)]
    rows = spark.createDataFrame(values, "k int, g string, x double").withColumn("id", F.monotonically_increasing_id())
    got = {(v.k, v.id): v.before_n for v in ranks.running(rows.withColumn("n", F.lit(2)), ["k", "id"], ["n"], 3000).collect()}
    order = sorted(got, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    assert [got[k] for k in order] == [2 * i for i in range(3000)]
    for p in (0.1, 0.5, 1.0):
        found = {(v.g): v.q for v in ranks.quantiles(rows, ["g"], "x", p, "q").collect()}
        disc = {v.g: v.q for v in rows.groupBy("g").agg(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY x)").alias("q")).collect()}
        assert found == disc
    assert ranks.quantiles(rows.limit(0), [], "x", 0.5, "q").first().q is None
    assert ranks.running(rows.limit(0).withColumn("n", F.lit(1)), ["k"], ["n"], 0).count() == 0


def test_ranked_plans_have_no_single_task_over_rows(spark, monkeypatch):
    """What meets in one task is a row for each range, made by an aggregation by range."""
    monkeypatch.setattr("chronolith.operators.ranks.ONE_RANGE", 0)
    rows = spark.range(2000).select(F.col("id").alias("tconst"), (F.col("id") % 700).cast("double").alias("s"), (F.col("id") % 2).cast("int").alias("is_hit"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (analytics.signal_lift(rows, signal_col="s", tie_break=("tconst",)), evaluate.roc_auc(rows, label_col="is_hit", score_col="s")):
            plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
            singles = [i for i, line in enumerate(plan) if "Exchange SinglePartition" in line]
            windows = [i for i, line in enumerate(plan) if "Window [" in line and "range_#" in line and "start" not in line]
            assert windows
            for i in singles:  # an aggregation stands directly below each
                assert "HashAggregate" in plan[i + 1] or "HashAggregate" in plan[i + 2]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_history_reads_the_edges_once(spark, movies, edges, tmp_path):
    paths = {"m": movies, "e": edges}
    for name, df in paths.items():
        df.write.parquet(str(tmp_path / name))
    m, e = (spark.read.parquet(str(tmp_path / n)) for n in paths)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = history.entity_history(e, m)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert plan.count("FileScan parquet") == 2 and plan.count("ReusedExchange") == 2


def test_names_without_a_match(spark, edges):
    names = spark.createDataFrame([("a", "A", 1950), ("z", "Z", 1)], "nconst string, primary_name string, birth_year int")
    got = {(r.nconst, r.primary_name) for r in enrich.attach_names(edges, names).collect()}
    assert got == {("a", "A"), ("b", None), (None, None)}


def test_f1_without_a_true_positive():
    assert evaluate.positive_class_metrics(tp=0, fp=1, fn=1, tn=1)["positive_f1"] is None
    rows = [{"threshold": t, "precision": 0.0, "recall": 0.0, "positive_f1": None} for t in (0.5, 0.6)]
    with pytest.raises(ValueError):
        evaluate.select_threshold(rows)
    good = {"threshold": 0.1, "precision": 0.1, "recall": 0.1, "positive_f1": 0.1}
    assert evaluate.select_threshold([*rows, good]) == good


def test_publication_cut_short(spark, movies, tmp_path):
    path = str(tmp_path / "t")
    sinks.publish(movies, path)
    (tmp_path / "t").rename(tmp_path / "t__previous")  # as a crash between the two renames leaves it
    assert sinks.restore(spark, path) and spark.read.parquet(path).count() == 6
    assert not sinks.restore(spark, path)
    assert sinks.publish(movies.limit(2), path, root=str(tmp_path))["rows"] == 2
    assert spark.read.parquet(path).count() == 2 and not (tmp_path / "t__previous").exists()
    with pytest.raises(RuntimeError, match="outside"):
        sinks.publish(movies, path, root=str(tmp_path / "other"))


def test_storage_checks(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    assert lake.storage_errors(spark, root, 0) == []
    assert lake.storage_errors(spark, root + "/none", 0) and lake.storage_errors(spark, root, 1e9)
    assert len(lake.storage_errors(spark, root, 0, volume=root + "/x", local_dir="hdfs://a/b")) == 3
    place = lake.Location(spark, root + "/f")
    (tmp_path / "in").write_text("abc")
    assert place.put(root + "/in").read_text() == "abc" and place.free() > 0 and place.remove() and not place.exists()
    for key in ("DATA_ROOT", "HDFS_USER"):
        monkeypatch.delenv(key, raising=False)
    assert lake.default_root("hdfs", "u") == "hdfs:///user/u/chronolith-data" and lake.default_root("local").endswith("/chronolith-data")
    monkeypatch.setenv("DATA_ROOT", "/user/u/d")
    assert lake.default_root("hdfs") == "hdfs:///user/u/d" and lake.default_root("local") == "/user/u/d"


def test_seeded_sample(movies):
    many = movies.sparkSession.range(20_000, numPartitions=4)
    a, b = (analytics.seeded_sample(many, ["id"], 0.05, 1) for _ in range(2))
    assert 800 < a.count() < 1200 and a.exceptAll(b).count() == 0 and a.distinct().count() == a.count()


def test_artifact_rules():
    good = good_document()
    for path, value in (("threshold_selection.selected.threshold", True), ("test_metrics.tp", 1.5), ("test_metrics.recall", None), ("partitions.train.max_year", None), ("feature_cols", []), ("candidate_results", None)):
        bad = json.loads(json.dumps(good))
        *folders, last = path.split(".")
        node = bad
        for key in folders:
            node = node[key]
        node[last] = value
        found = artifacts.model_errors(bad)
        assert len(found) == 1 and ("candidate" in found[0] if last == "candidate_results" else found[0].startswith(path))


def copied(tmp_path, *missing):
    """The repository's code without some of its parts, and what its entry lists there."""
    import os
    import shutil
    import subprocess
    import sys

    root = lake.REPOSITORY
    shutil.copytree(f"{root}/chronolith", tmp_path / "chronolith", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{root}/{name}"):
            shutil.copy(f"{root}/{name}", tmp_path)
    for name in missing:
        path = tmp_path / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    if (tmp_path / "chronolith/llm/bpe.py").exists() and "regex" in missing:
        text = (tmp_path / "chronolith/llm/bpe.py").read_text()
        (tmp_path / "chronolith/llm/bpe.py").write_text(text.replace("import regex", "import no_such_regex"))
    code = "import __spark_entry__ as e; print(' '.join(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)


def test_entry_of_a_copy_without_corpus_operators(tmp_path):
    for i, missing in enumerate((("chronolith/llm", "corpus_pipeline.py"), ("chronolith/llm",))):
        done = copied(tmp_path / str(i), *missing)
        assert "enriched_orders" in done.stdout and "op1_" not in done.stdout and "pipeline" not in done.stdout, done.stderr
        assert done.stdout.strip().endswith("True")


def test_entry_does_not_hide_import_errors(tmp_path):
    whole = copied(tmp_path / "whole")
    if "op1_" in whole.stdout:
        broken = copied(tmp_path / "broken", "regex")
        assert broken.returncode and "no_such_regex" in broken.stderr


def test_fetch(spark, tmp_path):
    from chronolith.sources import fetch

    source, staging = tmp_path / "source", tmp_path / "staging"
    source.mkdir()
    staging.mkdir()
    with gzip.open(source / "a.tsv.gz", "wt") as f:
        f.write("x\ty\n" * 5000)
    (source / "b.tsv").write_text("z")
    good = (source / "a.tsv.gz").read_bytes()
    (staging / "a.tsv.gz").write_bytes(good[:50])  # as an interrupted run leaves it
    target = lake.Location(spark, str(tmp_path / "raw"))
    sums = fetch.fetch(source.as_uri(), ["a.tsv.gz", "b.tsv"], str(staging), target)
    assert (tmp_path / "raw" / "a.tsv.gz").read_bytes() == good and sums["b.tsv"] == fetch.sha256(source / "b.tsv")
    assert (target / "SHA256SUMS").read_text().splitlines()[0] == f"{sums['a.tsv.gz']}  a.tsv.gz" and (target / "downloaded_at_utc.txt").exists()
    (source / "b.tsv").unlink()  # staged already
    assert fetch.fetch(source.as_uri(), ["b.tsv"], str(staging), target)["b.tsv"] == sums["b.tsv"]
    (source / "c.gz").write_bytes(good[:60])
    with pytest.raises(OSError, match="damaged"):
        fetch.fetch(source.as_uri(), ["c.gz"], str(staging), target)
    with pytest.raises(OSError):
        fetch.fetch(source.as_uri(), ["none"], str(staging), target)


def test_commands(monkeypatch):
    import subprocess
    import sys

    assert jobs.command("/data", ["bronze"], "local")[1:] == ["-m", "chronolith", "/data", "bronze"]
    line = jobs.command("hdfs:///d", backend="hdfs", archive="p.zip", conf={"a.b": "1"})
    assert line[:7] == ["spark-submit", "--master", "yarn", "--deploy-mode", "client", "--conf", "a.b=1"] and line[-4:-2] == ["--py-files", "p.zip"] and line[-1] == "hdfs:///d"
    shown = subprocess.run([sys.executable, line[-2], "--help"], capture_output=True, text=True, cwd="/")
    assert "root" in shown.stdout and shown.returncode == 0


def test_sweep_of_odd_scores(spark):
    scores = [None, float("nan"), float("-inf"), float("inf"), 0.0, 0.25, 0.5, 0.50001, 1.0]
    rows = [(i % 2, s) for i, s in enumerate(scores * 2)] + [(None, 0.9)]
    frame = spark.createDataFrame(rows, "label int, positive_score double")
    thresholds = [i / 100 for i in range(101)]
    swept = evaluate.threshold_sweep(frame, label_col="label", thresholds=thresholds)
    for r in (swept[0], swept[25], swept[50], swept[51], swept[100]):
        hit = lambda s: s != s or s >= r["threshold"]  # noqa: E731, B023
        want = {k: sum(y == a and s is not None and hit(s) == b for y, s in rows) for k, a, b in (("tp", 1, True), ("fp", 0, True), ("fn", 1, False), ("tn", 0, False))}
        assert {k: r[k] for k in want} == want, r["threshold"]


def test_areas_of_many_scores(spark, monkeypatch):
    """Every distinct score is a point of the curves, in one range or many."""
    r = random.Random(5)
    rows = [(y, r.gauss(y * 0.3, 1)) for y in (r.choice([0, 0, 0, 1]) for _ in range(4000))]
    frame = spark.createDataFrame([(y, s, float(s >= 0.5)) for y, s in rows], "label int, positive_score double, prediction double").repartition(3)
    p, n, tp, fp, roc, pr = sum(y for y, _ in rows), sum(1 - y for y, _ in rows), 0, 0, 0.0, 0.0
    for y, _ in sorted(rows, key=lambda v: -v[1]):
        before = tp / (tp + fp) if tp + fp else float(y)
        roc += (1 - y) * tp / (p * n)
        tp, fp = tp + y, fp + 1 - y
        pr += y / p * (before + tp / (tp + fp)) / 2
    for one_range in (200_000, 0):
        monkeypatch.setattr("chronolith.operators.ranks.ONE_RANGE", one_range)
        found = evaluate.evaluate_predictions(frame, label_col="label")
        assert abs(found["roc_auc"] - roc) < 1e-9 and abs(found["pr_auc"] - pr) < 1e-9
        assert found["tp"] == sum(y == 1 and s >= 0.5 for y, s in rows)
    assert evaluate.evaluate_predictions(frame.limit(0), label_col="label")["pr_auc"] == 0


def test_boosted_candidates_share_a_fit(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    r = random.Random(6)
    rows = [(r.choice([None, 1.0, 2.0, 3.0]), r.random(), 2000 + i % 5, r.randrange(2)) for i in range(400)]
    frame = spark.createDataFrame(rows, "runtime_minutes double, principal_count double, start_year int, is_hit int")
    calls, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, *a: calls.append((self.getMaxDepth(), self.getMaxIter())) or fit(self, *a))
    grid = {k: e.setWeightCol("class_weight") for k, e in pipeline.candidates("is_hit", max_iter=5, trees=(2, 4)).items() if k.startswith("gbt")}
    _, doc = pipeline.train(frame, ["runtime_minutes", "principal_count"], label_col="is_hit", cohort={"train_end": 2002, "validation_end": 2003, "test_end": 2004}, thresholds=[0.1, 0.5], estimators=grid)
    assert sorted(calls) == [(3, 4), (5, 4)] and [c["candidate_id"] for c in doc["candidate_results"]] == list(grid)
    data = pipeline.feature_pipeline(["runtime_minutes", "principal_count"], label_col="is_hit").fit(frame).transform(frame).withColumn("class_weight", F.lit(1.0)).coalesce(1)
    small, large = grid["gbt_3_2"].fit(data), grid["gbt_3_4"].fit(data)
    cut = pipeline.first_trees(large, grid["gbt_3_2"])
    assert cut.getNumTrees == 2 and cut.treeWeights == small.treeWeights and cut.featureImportances == small.featureImportances
    score = lambda m: [tuple(v) for v in m.transform(data).select("probability", "prediction").collect()]
    assert score(cut) == score(small) != score(large)


@pytest.mark.parametrize("near", [0.0003, 0.0])
def test_percentiles_near_the_approximation(spark, monkeypatch, near):
    """Over 10,000 values percentile_approx is off by ranks; the counts around it are not, even where it misses."""
    from pyspark.sql.functions import percentile_approx

    from chronolith.operators import ranks

    monkeypatch.setattr(ranks, "NEAR", near)
    if not near:  # cuts that miss on either side
        monkeypatch.setattr(ranks.F, "percentile_approx", lambda c, sides: percentile_approx(c, [0.3, 0.4]))
    rows = spark.range(120_000).select("id", (F.col("id") * 7919 % 119_983).alias("x"), F.when(F.col("id") % 50 == 0, None).otherwise(F.col("id") % 3).alias("g"))
    rows = rows.withColumn("x", F.when(F.col("id") % 17 > 0, F.col("x")))
    for keys in ([], ["g"]):
        for p in (0.1, 0.35, 0.5, 1.0):
            want = {tuple(r)[:-1]: r.q for r in ranks.quantiles(rows, keys, "x", p, "q").collect()}
            assert {tuple(r)[:-1]: r.q for r in ranks.near_quantiles(rows, keys, "x", p, "q").collect()} == want
    assert ranks.near_quantiles(rows.limit(0), [], "x", 0.5, "q").first().q is None


def test_anomalies_of_many_films(spark):
    films = spark.range(120_000).select(F.col("id").cast("string").alias("tconst"), F.lit("a").alias("primary_title"), F.lit(2000).alias("start_year"), F.lit(90).alias("runtime_minutes"), F.lit(9.0).alias("average_rating"), (F.col("id") * 7919 % 119_983).alias("num_votes"))
    got = analytics.rating_anomalies(films)
    assert got.first().vote_cut_used == films.selectExpr("percentile_disc(0.1) WITHIN GROUP (ORDER BY num_votes) AS q").first().q
