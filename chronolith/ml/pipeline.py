"""Feature pipelines, candidates and the choice among them."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, StorageLevel, inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import apply_threshold, with_positive_score
from .contract import check_predictors
from .evaluate import evaluate_predictions, partition_summary, select_threshold, temporal_split, threshold_sweep, with_balanced_class_weights

# Cohorts and thresholds of the two models.
HIT_COHORT = {"min_year": 1960, "train_end": 2013, "validation_end": 2018, "test_end": 2023}
AWARDS_COHORT = {"min_year": 1960, "train_end": 2007, "validation_end": 2013, "test_end": 2019}
HIT_THRESHOLDS = tuple(round(0.05 + 0.025 * i, 3) for i in range(37))
#: Thresholds of the ROC and precision-recall curves of the test years.
CURVE = tuple(i / 100 for i in range(101))
#: Candidates fitted at once, and rows to a task of a fit: boosting runs a job for each level of each tree.
FITS, ROWS_PER_TASK = 3, 50_000
AWARDS_THRESHOLDS = tuple(round(0.01 + 0.02 * i, 3) for i in range(38))


def feature_pipeline(feature_cols: Sequence[str], *, label_col: str) -> Pipeline:
    """Mean imputation and assembly, not yet fitted."""
    check_predictors(feature_cols, label_col)
    filled = [f"{c}_imp" for c in feature_cols]
    return Pipeline(stages=[Imputer(inputCols=list(feature_cols), outputCols=filled, strategy="mean"), VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="keep")])


def candidates(label_col: str, weight_col: str = "class_weight", max_iter: int = 100, trees: Sequence[int] = (20, 40)) -> dict[str, object]:
    """Logistic regressions over two penalties and mixes, boosted trees over two depths and sizes."""
    found: dict[str, object] = {}
    for reg in (0.01, 0.1):
        for mix in (0.0, 0.5):
            found[f"lr_{reg}_{mix}"] = LogisticRegression(labelCol=label_col, weightCol=weight_col, maxIter=max_iter, regParam=reg, elasticNetParam=mix)
    for depth in (3, 5):
        for n in trees:
            found[f"gbt_{depth}_{n}"] = GBTClassifier(labelCol=label_col, weightCol=weight_col, maxDepth=depth, maxIter=n, stepSize=0.1, seed=42)
    return found


def one_fit_each(grid: dict[str, object]) -> dict[str, list[str]]:
    """Candidate to fit -> the candidates it serves: boosted trees that differ only in their number share the largest's fit."""
    groups: dict[object, list[str]] = {}
    for name, e in grid.items():
        boosted = isinstance(e, GBTClassifier) and not e.isDefined(e.validationIndicatorCol)
        key = tuple(sorted((p.name, str(v)) for p, v in e.extractParamMap().items() if p.name != "maxIter")) if boosted else name
        groups.setdefault(key, []).append(name)
    return {max(names, key=lambda n: grid[n].getMaxIter()) if len(names) > 1 else names[0]: names for names in groups.values()}


def first_trees(model: GBTClassificationModel, estimator: GBTClassifier) -> GBTClassificationModel:
    """What the smaller estimator would fit: boosting adds tree after tree, each by the seed and its own number."""
    n, java, sc = estimator.getMaxIter(), model._java_obj, SparkContext._active_spark_context
    trees = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = sc._gateway.new_array(sc._jvm.double, n)
    for i, (tree, weight) in enumerate(zip(java.trees()[:n], list(java.treeWeights())[:n])):
        trees[i], weights[i] = tree, weight
    made = sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(estimator.uid, trees, weights, java.numFeatures(), java.numClasses())
    return estimator._copyValues(GBTClassificationModel(made))


def importance(model: PipelineModel, feature_cols: Sequence[str], top: int = 10) -> list[dict]:
    """Tree importances or absolute coefficients, the largest first."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    return [{"feature": f, "importance": float(v)} for v, f in sorted(zip(values, feature_cols), reverse=True)[:top]]


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def train(frame: DataFrame, feature_cols: Sequence[str], *, label_col: str, cohort: dict, thresholds: Sequence[float], estimators: dict[str, object] | None = None, year_col: str = "start_year") -> tuple[PipelineModel, dict]:
    """Fit the candidates on the earliest years, choose model and threshold on the next, test once on the last.

    The frame's needed columns are computed once and stored; values are imputed and
    assembled once for all candidates, in tasks of about ROWS_PER_TASK rows.

    Returns the model and the metrics document.  ValueError if a partition has no positives.
    """
    needed = dict.fromkeys([*feature_cols, label_col, year_col])
    stored = frame.where(F.col(year_col) <= cohort["test_end"]).select(*needed).persist(StorageLevel.MEMORY_AND_DISK)
    parts = dict(zip(("train", "validation", "test"), temporal_split(stored, year_col=year_col, **cohort)))
    held = [stored]
    try:
        parts["train"], weights = with_balanced_class_weights(parts["train"], label_col=label_col)
        summaries = {k: partition_summary(p, label_col=label_col, year_col=year_col) for k, p in parts.items()}
        empty = [k for k, s in summaries.items() if not s["positives"]]
        if empty:
            raise ValueError("no positives in " + ", ".join(empty))
        parts = {k: p.coalesce(1 + summaries[k]["rows"] // ROWS_PER_TASK) for k, p in parts.items()}
        prepared = feature_pipeline(feature_cols, label_col=label_col).fit(parts["train"])
        made = {k: prepared.transform(p).drop(*feature_cols, *(f"{c}_imp" for c in feature_cols)).persist(StorageLevel.MEMORY_AND_DISK) for k, p in parts.items()}
        held += made.values()
        grid = estimators or candidates(label_col)

        fits = one_fit_each(grid)

        def fitted(name: str) -> Model:
            return grid[name].fit(made["train"])

        with ThreadPool(FITS) as pool:
            largest = dict(zip(fits, pool.map(inheritable_thread_target(frame.sparkSession)(fitted), fits, chunksize=1)))
        last = {name: first_trees(largest[big], grid[name]) if name != big else largest[big] for big, names in fits.items() for name in names}
        models = {name: PipelineModel([*prepared.stages, last[name]]) for name in grid}
        score = lambda name, part: with_positive_score(models[name].stages[-1].transform(made[part]))
        results = []
        for name, estimator in grid.items():
            found = evaluate_predictions(score(name, "validation"), label_col=label_col, total=summaries["validation"]["rows"])
            results.append({"candidate_id": name, "algorithm": type(estimator).__name__} | found)
        chosen = max(results, key=lambda r: (r["pr_auc"], r["roc_auc"]))
        model = models[chosen["candidate_id"]]
        sweep = threshold_sweep(score(chosen["candidate_id"], "validation"), label_col=label_col, thresholds=thresholds)
        locked = select_threshold(sweep)
        scored = score(chosen["candidate_id"], "test").drop("prediction")
        tested = apply_threshold(scored, threshold=locked["threshold"])
        return model, {
            "schema_version": 2,
            "label": label_col,
            "feature_cols": list(feature_cols),
            "selection_rule": "highest validation PR AUC, then ROC AUC",
            "class_weights": weights,
            "partitions": summaries,
            "candidate_results": results,
            "selected_candidate": chosen,
            "threshold_selection": {"source": "validation", "selected": locked, "sweep": sweep},
            "test_curve": threshold_sweep(scored, label_col=label_col, thresholds=CURVE),
            "test_metrics": evaluate_predictions(tested, label_col=label_col, total=summaries["test"]["rows"]),
            "feature_importance": importance(model, feature_cols),
        }
    finally:
        for p in held:
            p.unpersist()
