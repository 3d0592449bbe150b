"""Metrics of predictions, each from one small aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import rounded

HIGH_SCORE = 0.99
BASELINE_MARGIN = 0.02
HIGH_SCORE_NOTE = (
    "Suspiciously high score. This may indicate target leakage, duplicate rows, "
    "or an easy deterministic target."
)


def class_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows (class, support, predicted, hits), from the confusion counts."""
    confusion = df.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("l").alias("class"),
            n.alias("support"),
            zero.alias("predicted"),
            F.when(F.col("l") == F.col("p"), n).otherwise(zero).alias("hits"),
        ),
        F.struct(
            F.col("p").alias("class"), zero.alias("support"), n.alias("predicted"), zero.alias("hits")
        ),
    )
    long = confusion.select(F.inline(sides))
    return long.groupBy("class").agg(
        F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"),
        F.sum("hits").alias("hits"),
    )


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: accuracy, weighted and macro F1, weighted precision and recall."""
    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    none = F.lit(0.0)
    scored = class_scores(df, label, prediction).select(
        "hits",
        "support",
        F.coalesce(F.try_divide(hits, predicted), none).alias("precision"),
        F.coalesce(F.try_divide(hits, support), none).alias("recall"),
        F.coalesce(F.try_divide(hits * 2, support + predicted), none).alias("f1"),
    )
    total = F.sum("support")

    def weighted(name: str):
        return rounded(F.try_divide(F.sum(F.col(name) * support), total))

    return scored.agg(
        rounded(F.try_divide(F.sum("hits"), total)).alias("accuracy"),
        weighted("f1").alias("f1_weighted"),
        rounded(F.avg("f1")).alias("f1_macro"),
        weighted("precision").alias("precision_weighted"),
        weighted("recall").alias("recall_weighted"),
    )


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: R2, MAE and RMSE."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    stats = df.agg(
        F.count(y).alias("n"),
        F.sum(F.pow(y - p, F.lit(2))).alias("sse"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.var_pop(y).alias("var"),
    )
    spread = F.col("var") * F.col("n")
    fit = F.when(spread > 0, 1 - F.col("sse") / F.nullif(spread, F.lit(0.0)))
    r2 = fit.when(F.col("sse") == 0, 1.0).otherwise(0.0)
    return stats.select(
        rounded(r2).alias("r2"),
        rounded(F.col("mae")).alias("mae"),
        rounded(F.sqrt(F.try_divide(F.col("sse"), F.col("n")))).alias("rmse"),
    )


def majority_baseline(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """One row: the most frequent training class scored on the test rows."""
    counts = train.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    majority = counts.orderBy(F.desc("n"), "class").limit(1).select("class").scalar()
    scored = test.select(F.col(label).alias("y")).withColumn("p", majority)
    metrics = classification_metrics(scored, "y", "p")
    return metrics.select(
        F.lit("majority_class").alias("strategy"),
        majority.cast("string").alias("prediction"),
        "accuracy",
        "f1_weighted",
    )


def mean_baseline(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """One row: the training mean scored on the test rows."""
    mean = train.agg(F.avg(F.col(label).cast("double")).alias("m")).select("m").scalar()
    scored = test.select(F.col(label).alias("y")).withColumn("p", mean)
    return regression_metrics(scored, "y", "p").select(
        F.lit("mean_prediction").alias("strategy"),
        rounded(mean).alias("prediction"),
        "r2",
        "mae",
        "rmse",
    )


def quality_flags(metrics: dict, baseline: dict, selected: str) -> dict:
    """Warnings on a model's metric row; only scores can be suspiciously high."""
    scores = [
        v for k, v in metrics.items() if isinstance(v, float) and k not in ("mae", "rmse", "cv_std")
    ]
    floor = baseline.get(selected)
    return {
        "suspicious": HIGH_SCORE_NOTE if any(HIGH_SCORE <= v <= 1.0 for v in scores) else None,
        "beats_baseline": None if floor is None else metrics[selected] > floor + BASELINE_MARGIN,
    }
