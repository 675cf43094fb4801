"""Chronological evaluation of rare events."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import running


def temporal_split(df: DataFrame, *, train_end: int, validation_end: int, test_end: int, year_col: str = "start_year", min_year: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three disjoint frames by year; NULL years and years beyond ``test_end`` are in none."""
    if not train_end < validation_end < test_end:
        raise ValueError("the bounds must increase")
    year = F.col(year_col)
    first = year <= train_end if min_year is None else year.between(min_year, train_end)
    return df.where(first), df.where((year > train_end) & (year <= validation_end)), df.where((year > validation_end) & (year <= test_end))


def partition_summary(df: DataFrame, *, label_col: str, year_col: str = "start_year") -> dict:
    return partition_frame(df, label_col=label_col, year_col=year_col).first().asDict()


def partition_frame(df: DataFrame, *, label_col: str, year_col: str = "start_year") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min(year_col).alias("min_year"), F.max(year_col).alias("max_year"), F.coalesce(F.sum(F.col(label_col).cast("long")), F.lit(0)).alias("positives"), F.avg(F.col(label_col).cast("double")).alias("positive_rate"))


def with_balanced_class_weights(df: DataFrame, *, label_col: str, output_col: str = "class_weight") -> tuple[DataFrame, dict[int, float]]:
    """Weight N / (2 n) for each class; NULL labels get none.  ValueError unless both classes are there."""
    counts = {int(r[0]): r[1] for r in df.where(F.col(label_col).isNotNull()).groupBy(label_col).count().collect()}
    if counts.keys() != {0, 1}:
        raise ValueError(f"labels must be 0 and 1, both present: {sorted(counts)}")
    weights = {k: sum(counts.values()) / (2 * n) for k, n in counts.items()}
    label = F.col(label_col)
    return df.withColumn(output_col, F.when(label == 0, weights[0]).when(label == 1, weights[1])), weights


def confusion(label: Column, prediction: Column) -> list[Column]:
    cell = lambda name, a, b: F.count_if((label == a) & (prediction == b)).alias(name)
    return [cell("tp", 1, 1), cell("fp", 0, 1), cell("fn", 1, 0), cell("tn", 0, 0)]


def with_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, accuracy and prevalence of tp, fp, fn, tn; NULL where undefined, F1 also without a true positive."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({
        "precision": F.try_divide(tp, tp + fp),
        "recall": F.try_divide(tp, tp + fn),
        "positive_f1": F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)),
        "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn),
        "prevalence": F.try_divide(tp + fn, tp + fp + fn + tn),
    })


def positive_class_metrics(*, tp: int, fp: int, fn: int, tn: int) -> dict:
    ratio = lambda a, b: a / b if b else None
    n = tp + fp + fn + tn
    return {
        "tp": tp, "fp": fp, "fn": fn, "tn": tn,
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "positive_f1": 2 * tp / (2 * tp + fp + fn) if tp else None,
        "accuracy": ratio(tp + tn, n), "prevalence": ratio(tp + fn, n),
    }


def evaluate_predictions(predictions: DataFrame, *, label_col: str, prediction_col: str = "prediction", score_col: str = "positive_score", total: int | None = None) -> dict:
    """Confusion counts, their rates, and both areas over every distinct score, from sums by score.

    The precision-recall curve begins at recall 0 with the precision of the highest
    score; NaN counts as the highest.  ``total`` is about the number of rows, counted if
    not given.
    """
    label, score = F.col(label_col).cast("double"), F.col(score_col).cast("double")
    down = F.when(F.isnan(score), float("-inf")).otherwise(-score)
    by = predictions.groupBy(down.alias("down")).agg(F.count_if(label > 0.5).alias("p"), F.count_if(label <= 0.5).alias("n"), *confusion(label, F.col(prediction_col)))
    placed = running(by, ["down"], ["p", "n"], predictions.count() if total is None else total)
    p, n, tp, fp = (F.col(c) for c in ("p", "n", "before_p", "before_n"))
    precision = (tp + p) / (tp + p + fp + n)
    earlier = F.coalesce(F.try_divide(tp, tp + fp), precision)
    sums = placed.where("p + n > 0").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "p", "n")], F.sum(n * (tp + p / 2)).alias("pairs"), F.sum(p * (earlier + precision) / 2).alias("area"))
    found = {k: v or 0 for k, v in sums.first().asDict().items()}
    roc = found["pairs"] / (found["p"] * found["n"]) if found["p"] and found["n"] else float(found["p"] > 0)
    return positive_class_metrics(**{c: found[c] for c in ("tp", "fp", "fn", "tn")}) | {"roc_auc": roc, "pr_auc": found["area"] / found["p"] if found["p"] else 0.0}


def roc_auc(predictions: DataFrame, *, label_col: str, score_col: str = "positive_score") -> DataFrame:
    """ROC area as the Mann-Whitney statistic with mid-ranks, from sums by distinct score."""
    by = predictions.groupBy(score_col).agg(F.count_if(F.col(label_col) == 1).alias("p"), F.count_if(F.col(label_col) == 0).alias("n"))
    ranked = running(by, [score_col], ["n"], predictions.count())
    return ranked.select("p", "n", (F.col("p") * (F.col("before_n") + F.col("n") / 2)).alias("u")).agg(F.try_divide(F.sum("u"), (F.sum("p") * F.sum("n")).cast("double")).alias("roc_auc"))


def checked(thresholds: Iterable[float]) -> list[float]:
    values = sorted(set(thresholds))
    if not values or values[0] < 0 or values[-1] > 1:
        raise ValueError("thresholds must be given and lie between 0 and 1")
    return values


def sweep_frame(predictions: DataFrame, *, label_col: str, thresholds: Iterable[float], score_col: str = "positive_score") -> DataFrame:
    """Confusion counts and rates at each threshold.

    Each score falls into the band between two thresholds by binary search; rows are
    summed by band, and the few bands are summed up by threshold, so no row meets every
    threshold.  NaN reaches them all, as in a comparison.
    """
    values = checked(thresholds)
    label, score = F.col(label_col), F.col(score_col)
    rows = predictions.where(score.isNotNull()).select(label.alias(label_col), score.cast("double").alias("score_"))
    rows = Bucketizer(splits=[-math.inf, *values, math.inf], inputCol="score_", outputCol="band_", handleInvalid="keep").transform(rows)
    band = F.least(F.col("band_").cast("int"), F.lit(len(values)))
    bands = rows.groupBy(band.alias("band")).agg(F.count_if(label == 1).alias("p"), F.count_if(label == 0).alias("n"))
    spark = predictions.sparkSession
    grid = spark.range(1).select(F.posexplode(F.array(*map(F.lit, values))).alias("i", "threshold"))
    above = lambda c: F.coalesce(F.sum(F.when(F.col("band") > F.col("i"), F.col(c))), F.lit(0))
    below = lambda c: F.coalesce(F.sum(F.when(F.col("band") <= F.col("i"), F.col(c))), F.lit(0))
    counts = grid.join(F.broadcast(bands), F.col("band") >= 0, "left").groupBy("threshold").agg(above("p").alias("tp"), above("n").alias("fp"), below("p").alias("fn"), below("n").alias("tn"))
    return with_rates(counts).orderBy("threshold")


def threshold_sweep(predictions: DataFrame, **kwargs) -> list[dict]:
    return [r.asDict() for r in sweep_frame(predictions, **kwargs).collect()]


def select_threshold(results: Sequence[dict], *, minimum_recall: float | None = None) -> dict:
    """The best by F1, then recall, precision and threshold, of those that have an F1 and reach the recall."""
    fit = [r for r in results if r["positive_f1"] is not None and (minimum_recall is None or (r["recall"] or 0) >= minimum_recall)]
    if not fit:
        raise ValueError("no threshold qualifies")
    return max(fit, key=lambda r: tuple(r[k] or 0 for k in ("positive_f1", "recall", "precision", "threshold")))
