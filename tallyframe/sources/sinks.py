"""Writers: CSV, JSON result tables, model bundles."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import is_nested, ref
from ..operators.ml_training import TrainedModel, TrainingResult

FEATURE_SCHEMA = (
    "position int, feature_name string, display_name string, type string, required boolean, "
    "excluded_reason string, allowed_values array<string>"
)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with header; nested columns are written as JSON text."""
    columns = [
        F.to_json(ref(f.name)).alias(f.name) if is_nested(f.dataType) and not isinstance(f.dataType, T.BinaryType) else ref(f.name)
        for f in df.schema.fields
    ]
    df.select(*columns).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_tables(tables: dict[str, DataFrame], folder: str, mode: str = "error") -> None:
    """One JSON folder per result table."""
    for name, table in tables.items():
        table.write.mode(mode).json(f"{folder}/{name}")


def _write_text(spark: SparkSession, name: str, payload: dict, path: str, mode: str) -> None:
    text = json.dumps(payload, default=str)
    spark.createDataFrame([(name, text)], "name string, payload string").write.mode(mode).json(path)


def save_model(result: TrainingResult, folder: str, mode: str = "error") -> None:
    """The selected model, its feature schema, metrics and metadata."""
    best = result.best
    spark = result.schema.sparkSession
    writer = best.model.write()
    (writer.overwrite() if mode == "overwrite" else writer).save(f"{folder}/model")
    result.schema.write.mode(mode).json(f"{folder}/feature_schema")
    result.comparison.write.mode(mode).json(f"{folder}/model_comparison")
    _write_text(spark, "metrics", result.summary["metrics"], f"{folder}/metrics", mode)
    metadata = {**result.summary, "labels": best.labels, "neighbours": best.training_rows is not None}
    _write_text(spark, "metadata", metadata, f"{folder}/metadata", mode)
    if best.training_rows is not None:
        best.training_rows.write.mode(mode).parquet(f"{folder}/training_rows")


def load_model(spark: SparkSession, folder: str) -> TrainedModel:
    row = spark.read.schema("name string, payload string").json(f"{folder}/metadata").first()
    metadata = json.loads(row["payload"])
    listed = spark.read.schema(FEATURE_SCHEMA).json(f"{folder}/feature_schema")
    features: list[Row] = listed.filter("required").orderBy("position").collect()
    rows = spark.read.parquet(f"{folder}/training_rows") if metadata["neighbours"] else None
    return TrainedModel(
        metadata["target"],
        metadata["task_type"],
        metadata["selected_model"],
        features,
        PipelineModel.load(f"{folder}/model"),
        metadata["labels"],
        rows,
    )
