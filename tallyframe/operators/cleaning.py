"""Cleaning: safe names, parsed columns, duplicates and null counts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.text import safe_names
from ..functions.values import (
    clean_text,
    dtype_of,
    is_float,
    is_missing_like,
    is_null,
    is_text,
    parse_formatted_number,
    parse_moment,
    ref,
)


def clean_table(df: DataFrame, profile_rows: Sequence[Row]) -> tuple[DataFrame, list[dict]]:
    """Cleaned table (a lazy projection) and its conversions.

    ``profile_rows`` are the collected rows of ``column_profile``, one per
    column.
    """
    inferred = {r["column"]: r["inferred_type"] for r in profile_rows}
    safe = safe_names(df.columns)
    columns, conversions = [], []
    for name, new in zip(df.columns, safe):
        dtype = dtype_of(df, name)
        col = ref(name)
        kind = inferred.get(name)
        conversion = None
        if kind == "datetime":
            col, conversion = parse_moment(col, dtype), "parsed datetime"
        elif kind == "numeric" and is_text(dtype):
            col, conversion = parse_formatted_number(col, dtype), "parsed numeric-like strings"
        columns.append(col.alias(new))
        conversions.append({"column": name, "safe_name": new, "conversion": conversion})
    return df.select(*columns), conversions


def row_key(df: DataFrame) -> list[Column]:
    """Columns that identify a row; NaN counts as null."""
    keys = []
    for field in df.schema.fields:
        col = ref(field.name)
        if is_float(field.dataType):
            col = F.when(~F.isnan(col), col)
        keys.append(col.alias(field.name))
    return keys


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Rows that occur more than once, with their number of copies."""
    counted = df.select(*row_key(df)).groupBy(*[ref(n) for n in df.columns])
    return counted.agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: copies beyond the first (null equals null)."""
    return duplicate_groups(df).agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows")
    )


def _count_per_column(df: DataFrame, test, name: str) -> DataFrame:
    counted = df.agg(
        *[F.count_if(test(ref(f.name), f.dataType)).alias(f.name) for f in df.schema.fields]
    )
    return counted.unpivot([], [ref(n) for n in df.columns], "column", name)


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, in one scan and without a shuffle of values."""
    return _count_per_column(df, is_null, "null_count")


def missing_like_counts(df: DataFrame) -> DataFrame:
    """Missing-like cells per column."""
    return _count_per_column(df, is_missing_like, "missing_count")


def cleaning_report(df: DataFrame, profile_rows: Sequence[Row]) -> DataFrame:
    """Per column: safe name, conversion, nulls after cleaning; and duplicates."""
    cleaned, conversions = clean_table(df, profile_rows)
    spark = df.sparkSession
    names = spark.createDataFrame(
        [(i, c["column"], c["safe_name"], c["conversion"]) for i, c in enumerate(conversions)],
        "position int, column string, safe_name string, conversion string",
    )
    nulls = null_counts(cleaned).withColumnRenamed("column", "safe_name")
    copies = duplicate_rows(cleaned).select("duplicate_rows").scalar()
    return names.join(nulls, "safe_name").select(
        "position", "column", "safe_name", "conversion", "null_count", copies.alias("duplicate_rows")
    )


def equal_columns(df: DataFrame) -> DataFrame:
    """Rows (first, second): pairs of columns equal as text in every row.

    Two scans without a shuffle.  The first takes an order-free fingerprint
    per column; only pairs with equal fingerprints are compared cell by cell.
    """
    names = df.columns

    def text(name: str) -> Column:
        return F.coalesce(clean_text(ref(name), dtype_of(df, name)), F.lit("__NA__"))

    marks = []
    for i, name in enumerate(names):
        digest = F.xxhash64(text(name))
        marks.append(
            F.struct(
                F.bit_xor(digest).alias("x"),
                F.sum(digest.cast("decimal(28,0)")).alias("s"),
            ).alias(f"f{i}")
        )
    prints = df.agg(*marks).first()
    pairs = [
        (names[i], names[j])
        for i, j in combinations(range(len(names)), 2)
        if prints[f"f{i}"] == prints[f"f{j}"]
    ]
    if not pairs:
        return df.sparkSession.createDataFrame([], "first string, second string")
    differing = df.agg(
        *[F.count_if(text(a) != text(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    )
    structs = [
        F.struct(
            F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"p{i}").alias("differing")
        )
        for i, (a, b) in enumerate(pairs)
    ]
    equal = differing.select(F.inline(F.array(*structs))).filter("differing = 0")
    return equal.select("first", "second")


def duplicate_columns(df: DataFrame) -> DataFrame:
    """Rows (column, duplicate_of): each copy next to the first column it equals."""
    position = F.create_map(*[x for i, n in enumerate(df.columns) for x in (F.lit(n), F.lit(i))])
    return equal_columns(df).groupBy(F.col("second").alias("column")).agg(
        F.min_by("first", F.element_at(position, F.col("first"))).alias("duplicate_of")
    )
