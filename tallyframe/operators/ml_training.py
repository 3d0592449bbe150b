"""Training, comparing, saving and applying tabular models."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    Imputer,
    IndexToString,
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import clean_text, dtype_of, ref, to_number
from ..lineage import spread
from . import ml_metrics, ml_schema, ml_split
from .frequency import top_values, value_frequencies
from .neighbours import nearest_neighbours
from .tools import rank_auc

LABEL, FEATURES, INDEX, KEY, POINT = "_label", "_features", "_index", "_key", "_point_key"
MODES = ("fast", "balanced", "deep")
# Folds and candidate counts per mode.
FOLDS = {"fast": 0, "balanced": 3, "deep": 5}
CANDIDATES = {"fast": 3, "balanced": 5, "deep": None}
TREES = {"fast": 70, "balanced": 120, "deep": 120}
# Spark trees reach depth 30 at most, which stands for "unlimited" here.
DEPTH = {"fast": 14, "balanced": 14, "deep": 30}
MIN_ROWS = 10
KNN = "KNN"


# Classes that models and the driver hold a row each of.
MOST_CLASSES = 10_000


@dataclass
class TrainedModel:
    """The selected model with everything scoring needs."""

    target: str
    task: str
    name: str
    features: list[Row]
    model: PipelineModel
    labels: list[str]
    training_rows: DataFrame | None = None


@dataclass
class TrainingResult:
    best: TrainedModel
    comparison: DataFrame
    schema: DataFrame
    summary: dict


def preprocessing(train: DataFrame, features: Sequence[Row]) -> list:
    """Stages: median imputing and scaling; mode imputing and one-hot."""
    numeric = [f["feature_name"] for f in features if f["type"] in ("numeric", "boolean")]
    categorical = [f["feature_name"] for f in features if f["type"] == "categorical"]
    stages, parts = [], []
    if numeric:
        filled = [f"_f{i}" for i in range(len(numeric))]
        stages += [
            Imputer(strategy="median", inputCols=numeric, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="_numbers"),
            StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
        ]
        parts.append("_scaled")
    if categorical:
        texts = train.select(*[ref(c) for c in categorical])
        freq = value_frequencies(texts, short=True)
        modes = {r["column"]: r["value"] for r in top_values(freq, 1, texts).collect()}
        filled = [f"_c{i}" for i in range(len(categorical))]
        choices = ", ".join(
            "coalesce(`{}`, {}) AS {}".format(
                c.replace("`", "``"), _sql_text(modes.get(c, "")), f
            )
            for c, f in zip(categorical, filled)
        )
        indexed = [f"{f}_i" for f in filled]
        encoded = [f"{f}_v" for f in filled]
        stages += [
            SQLTransformer(statement=f"SELECT *, {choices} FROM __THIS__"),
            # unseen values get the extra index, which the encoder drops to zeros
            StringIndexer(inputCols=filled, outputCols=indexed, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        ]
        parts += encoded
    stages.append(VectorAssembler(inputCols=parts, outputCol=FEATURES))
    return stages


def _sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def candidate_models(task: str, mode: str, rows: int, classes: int = 2, neighbours: bool = True) -> list[tuple[str, object]]:
    """Names and estimators for ``rows`` rows to fit; nearest neighbours are marked by their name."""
    trees, depth, seed = TREES[mode], DEPTH[mode], ml_split.SEED
    common = {"featuresCol": FEATURES, "seed": seed}
    if task == "classification":
        boosted = GBTClassifier(labelCol=INDEX, maxIter=100, maxDepth=3, stepSize=0.1, **common)
        if classes > 2:
            boosted = OneVsRest(classifier=boosted, labelCol=INDEX, featuresCol=FEATURES)
        models = [
            (
                "Logistic Regression",
                LogisticRegression(
                    featuresCol=FEATURES, labelCol=INDEX, maxIter=1200, regParam=1.0 / rows,
                    standardization=False,
                ),
            ),
            (
                "Random Forest Classifier",
                RandomForestClassifier(
                    labelCol=INDEX, numTrees=trees, maxDepth=depth, weightCol="weight",
                    featureSubsetStrategy="sqrt", maxMemoryInMB=1024, cacheNodeIds=True, **common,
                ),
            ),
            ("Gradient Boosting Classifier", boosted),
        ]
    else:
        models = [
            (
                "Ridge Regression",
                LinearRegression(
                    featuresCol=FEATURES, labelCol=LABEL, regParam=1.0 / rows, standardization=False
                ),
            ),
            ("Linear Regression", LinearRegression(featuresCol=FEATURES, labelCol=LABEL)),
            (
                "Random Forest Regressor",
                RandomForestRegressor(
                    labelCol=LABEL, numTrees=trees, maxDepth=depth, featureSubsetStrategy="all",
                    maxMemoryInMB=1024, cacheNodeIds=True, **common,
                ),
            ),
            (
                "Gradient Boosting Regressor",
                GBTRegressor(labelCol=LABEL, maxIter=100, maxDepth=3, stepSize=0.1, **common),
            ),
        ]
    if neighbours:
        models.append((f"{KNN} {'Classifier' if task == 'classification' else 'Regressor'}", None))
    return models[: CANDIDATES[mode]]


def prepare(
    df: DataFrame, target: str, features: Sequence[Row], task: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Typed features, the label, and a key hashed from the row's own content.

    The key covers ``keys``, or every column, ids and dates included.
    """
    dtype = dtype_of(df, target)
    label = clean_text(ref(target), dtype) if task == "classification" else to_number(ref(target), dtype)
    hashed = keys or [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    content = df.withColumn(LABEL, label).withColumn(KEY, content_key(hashed))
    rows = ml_schema.coerce_features(content, features, keep=[LABEL, KEY])
    return rows.filter(F.col(LABEL).isNotNull())


def content_key(columns: Sequence[str]) -> Column:
    """Digest of a row's values in which a null is a value of its own."""
    return F.sha2(F.to_json(F.struct(*[ref(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


@dataclass
class _Prepared:
    """Fitted preprocessing and the transformed training rows, kept in memory."""

    stages: PipelineModel
    rows: DataFrame


def _prepared(train: DataFrame, features: Sequence[Row], task: str, labels: list[str]) -> _Prepared:
    """Fits the preprocessing once for all candidates of a training part."""
    stages = Pipeline(stages=preprocessing(train, features)).fit(train)
    rows = stages.transform(train)
    columns = [LABEL, FEATURES]
    if task == "classification":
        indexer = StringIndexerModel.from_labels(
            labels, inputCol=LABEL, outputCol=INDEX, handleInvalid="keep"
        )
        rows = ml_split.with_class_weight(indexer.transform(rows), LABEL)
        columns += [INDEX, "weight"]
    return _Prepared(stages, rows.select(*columns).persist())


def _fit(estimator, prepared: _Prepared, task: str, labels: list[str]) -> PipelineModel:
    stages = list(prepared.stages.stages)
    if estimator is not None:
        stages.append(estimator.fit(prepared.rows))
        if task == "classification":
            stages.append(IndexToString(inputCol="prediction", outputCol="_predicted", labels=labels))
    return PipelineModel(stages)


def apply_model(trained: TrainedModel, rows: DataFrame) -> DataFrame:
    """Adds ``_predicted`` (and ``probability`` where the model has one)."""
    if trained.training_rows is None:
        scored = trained.model.transform(rows)
        if trained.task == "regression":
            scored = scored.withColumn("_predicted", F.col("prediction"))
        return scored
    return _apply_neighbours(trained, rows)


def _apply_neighbours(trained: TrainedModel, rows: DataFrame) -> DataFrame:
    classify = trained.task == "classification"
    names = {label: i for i, label in enumerate(trained.labels)}
    train = trained.model.transform(trained.training_rows)
    names_of = [f["feature_name"] for f in trained.features]
    label = F.col(LABEL)
    if classify:
        label = F.element_at(F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(float(v)))]), label)
    train = train.select(
        content_key(names_of).alias(POINT),
        vector_to_array(FEATURES).alias("_point"),
        label.alias("_y"),
    )
    scored = trained.model.transform(rows)
    # equal feature rows have equal predictions, so one per feature row is enough
    scored = scored.withColumn(POINT, content_key(names_of))
    points = scored.select(POINT, vector_to_array(FEATURES).alias("_point")).dropDuplicates([POINT])
    found = nearest_neighbours(train, points, POINT, "_point", "_y", classify)
    joined = scored.drop("prediction").join(found, POINT)
    if classify:
        listed = F.array(*[F.lit(x) for x in trained.labels])
        return joined.withColumn("_predicted", F.get(listed, F.col("prediction").cast("int")))
    return joined.withColumn("_predicted", F.col("prediction"))


def evaluate(scored: DataFrame, task: str, imbalanced: bool, labels: Sequence[str]) -> tuple[dict, str]:
    """Metric row of scored test rows, and the metric that selects."""
    if task == "regression":
        return ml_metrics.regression_metrics(scored, LABEL, "_predicted").first().asDict(), "r2"
    metrics = ml_metrics.classification_metrics(scored, LABEL, "_predicted").first().asDict()
    if len(labels) == 2 and "probability" in scored.columns:
        positive = scored.select(
            (F.col(LABEL) == labels[1]).cast("int").alias("y"),
            vector_to_array("probability")[1].alias("s"),
        )
        metrics["roc_auc"] = rank_auc(positive, "y", "s").first()["roc_auc"]
    return metrics, "f1_weighted" if imbalanced else "accuracy"


def _metrics_text(metrics: dict) -> str:
    return json.dumps(metrics, sort_keys=True)


def train(
    df: DataFrame, target: str, mode: str = "balanced", keys: Sequence[str] = (), neighbours: bool = True
) -> TrainingResult:
    """Trains all candidates of a mode and keeps the best.

    ``keys`` name the columns that decide the split; by default all of
    them do, which keeps equal rows on one side.  ``neighbours`` says whether
    nearest neighbours are among the candidates, however many rows there are.
    A model that fails is recorded and skipped.
    """
    if mode not in MODES:
        raise ValueError(f"Unknown mode: {mode}")
    df = ml_schema.with_target(ml_schema.drop_empty_rows(df), target)
    task = ml_schema.task_type(df, target).first()["task_type"]
    schema = ml_schema.feature_schema(df, target)
    listed = schema.orderBy("position").collect()
    features = [r for r in listed if r["required"]]
    if not features:
        raise ValueError("No suitable feature columns remain")
    rows = spread(prepare(df, target, features, task, keys), KEY)

    balance, labels, imbalanced = None, [], False
    # counted in one scan
    n, several = rows.agg(F.count(F.lit(1)), F.min(LABEL) < F.max(LABEL)).first()
    if task == "classification":
        sizes = ml_schema.class_balance(rows, LABEL)
        if sizes.limit(MOST_CLASSES + 1).count() > MOST_CLASSES:
            raise ValueError(f"A target with more than {MOST_CLASSES} classes cannot be learned")
        balance = {r["label"]: r["count"] for r in sizes.collect()}
        labels = sorted(balance)
        imbalanced = min(balance.values()) / n < 0.2
        distinct = len(labels)
    else:
        distinct = 2 if several else 1
    if n < MIN_ROWS or distinct < 2:
        raise ValueError("Not enough usable target data to train a model")
    stratify = bool(balance) and min(balance.values()) >= 2 and len(labels) < n * 0.5
    placed = ml_split.stratified_split(rows, [KEY], LABEL if stratify else None)
    folds = FOLDS[mode]
    if folds:
        placed = ml_split.with_fold(placed, [KEY], folds, stratum=LABEL if stratify else None)
    # read once per model and iteration
    placed = placed.persist()
    train_rows = placed.filter(~F.col("is_test")).drop("is_test")
    test_rows = placed.filter("is_test").drop("is_test")
    if task == "classification":
        baseline = ml_metrics.majority_baseline(train_rows, test_rows, LABEL)
    else:
        baseline = ml_metrics.mean_baseline(train_rows, test_rows, LABEL)
    baseline = baseline.first().asDict()

    cross_validate = bool(folds) and (task == "regression" or min(balance.values()) >= folds)
    whole = _prepared(train_rows, features, task, labels)
    parts = []
    if cross_validate:
        for fold in range(folds):
            part = placed.filter(F.col("fold") != fold)
            parts.append((part, _prepared(part, features, task, labels), placed.filter(F.col("fold") == fold)))
    compared, best, best_metrics = [], None, None
    for name, estimator in candidate_models(task, mode, train_rows.count(), len(labels), neighbours):
        started = time.time()

        def fit(part: DataFrame, prepared: _Prepared) -> TrainedModel:
            model = _fit(estimator, prepared, task, labels)
            neighbours = part if estimator is None else None
            return TrainedModel(target, task, name, features, model, labels, neighbours)

        try:
            trained = fit(train_rows, whole)
            metrics, selected = evaluate(apply_model(trained, test_rows), task, imbalanced, labels)
            score = metrics[selected]
            if cross_validate:
                scores = []
                for part, prepared, held_out in parts:
                    scored = apply_model(fit(part, prepared), held_out)
                    scores.append(evaluate(scored, task, imbalanced, labels)[0][selected])
                mean = sum(scores) / folds
                deviation = (sum((s - mean) ** 2 for s in scores) / folds) ** 0.5
                metrics.update(cv_scores=scores, cv_mean=round(mean, 4), cv_std=round(deviation, 4))
                score = mean
        except Exception as error:  # a failed candidate must not end the comparison
            compared.append((name, "failed", None, None, None, None, str(error)))
            continue
        took = round(time.time() - started, 3)
        compared.append((name, "complete", selected, round(score, 4), _metrics_text(metrics), took, None))
        if best is None or score > best[0]:
            best, best_metrics = (score, trained, selected), metrics
    if best is None:
        raise ValueError("All candidate models failed to train")
    spark = df.sparkSession
    comparison = spark.createDataFrame(
        compared,
        "model_name string, status string, selected_metric string, selection_score double, "
        "metrics string, training_time_seconds double, error string",
    )
    method = "stratified train/test split" if stratify else "train/test split"
    if folds:
        method += f" + {folds}-fold cross-validation"
    n_test = test_rows.count()
    for kept in [placed, whole.rows, *[prepared.rows for _, prepared, _ in parts]]:
        kept.unpersist()
    summary = {
        "target": target,
        "task_type": task,
        "mode": mode,
        "selected_model": best[1].name,
        "selected_metric": best[2],
        "metrics": best_metrics,
        "baseline": baseline,
        "class_balance": balance,
        "imbalanced": imbalanced,
        "validation_method": method,
        "train_rows": n - n_test,
        "test_rows": n_test,
        "rows_used": n,
        "features_used": len(features),
        "random_state": ml_split.SEED,
        **ml_metrics.quality_flags(best_metrics, baseline, best[2]),
    }
    return TrainingResult(best[1], comparison, schema, summary)


def batch_score(trained: TrainedModel, df: DataFrame) -> DataFrame:
    """Input columns plus ``predicted_<target>`` and, where the model gives
    them, class probabilities.  Raises naming the columns that are missing."""
    names = [f["feature_name"] for f in trained.features]
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"Required columns not found: {', '.join(absent)}")
    typed = {f"_in{i}": c for i, c in enumerate(df.columns)}
    kept = df.select(*[ref(c).alias(i) for i, c in typed.items()], *[ref(n) for n in names])
    rows = ml_schema.coerce_features(kept, trained.features, keep=list(typed))
    scored = apply_model(trained, rows)
    output = [F.col(i).alias(c) for i, c in typed.items()]
    output.append(F.col("_predicted").alias(f"predicted_{trained.target}"))
    if trained.task == "classification" and "probability" in scored.columns:
        chance = vector_to_array("probability")
        pairs = [
            F.struct(F.lit(label), F.round(chance[i], 4)) for i, label in enumerate(trained.labels)
        ]
        output.append(F.map_from_entries(F.array(*pairs)).alias("probabilities"))
    return scored.select(*output)
