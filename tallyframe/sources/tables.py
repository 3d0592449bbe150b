"""Readers: parquet, CSV as text with null tokens, JSON with a schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import CSV_NULL_TOKENS
from ..functions.values import NUMBER_PATTERN, is_text, ref


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def null_tokens(df: DataFrame) -> DataFrame:
    """Text cells that spell a default null token become null."""
    columns = []
    for field in df.schema.fields:
        col = ref(field.name)
        if is_text(field.dataType):
            col = F.when(~col.isin(*CSV_NULL_TOKENS), col).alias(field.name)
        columns.append(col)
    return df.select(*columns)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names, from the header line only."""
    return spark.read.option("header", True).csv(path).columns


def read_csv(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV with header, every column as text.

    With ``multi_line``, quoted cells may hold line breaks, and each file is
    one task.  Without it a line is a row and large files are split; a line
    whose quotes do not match up then raises, since it would make wrong rows.
    """
    names = list(columns) if columns else csv_header(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if not multi_line:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        if spark.read.text(path).filter(quotes % 2 == 1).limit(1).count():
            raise ValueError(f"Cells of {path} hold line breaks or single quotes: read it with multi_line=True")
    reader = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", multi_line)
    return null_tokens(reader.csv(path))


def typed_numbers(df: DataFrame) -> DataFrame:
    """Text columns that hold only numbers become bigint or double columns.

    One scan over all text columns decides; one row reaches the driver.
    """
    texts = [f.name for f in df.schema.fields if is_text(f.dataType)]
    if not texts:
        return df
    tests = []
    for i, name in enumerate(texts):
        plain = F.trim(ref(name))
        present = plain.isNotNull()
        number = plain.rlike(NUMBER_PATTERN)
        whole = plain.rlike(r"^[+-]?\d{1,18}$")
        tests += [
            F.count_if(present).alias(f"n{i}"),
            F.count_if(present & number).alias(f"d{i}"),
            F.count_if(present & whole).alias(f"w{i}"),
        ]
    seen = df.agg(*tests).first()
    kinds = {}
    for i, name in enumerate(texts):
        n = seen[f"n{i}"]
        if n and seen[f"w{i}"] == n:
            kinds[name] = "bigint"
        elif n and seen[f"d{i}"] == n:
            kinds[name] = "double"
    return df.select(
        *[
            F.trim(ref(c)).cast(kinds[c]).alias(c) if c in kinds else ref(c).alias(c)
            for c in df.columns
        ]
    )


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """The table itself; raises listing the required columns it lacks."""
    absent = [name for name in required if name not in df.columns]
    if absent:
        raise ValueError(f"Required columns not found: {', '.join(absent)}")
    return df


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
