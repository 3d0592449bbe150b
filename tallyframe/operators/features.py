"""Derived features: date parts and quantile buckets."""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Context, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import DATE_PART_NAMES, NameRule
from ..functions.values import dtype_of, is_moment, is_number, ref, to_number
from . import ordered
from .frequency import more_distinct_than
from .summaries import long_numbers

# Names that are never binned.
NEVER_BINNED = NameRule(
    (*DATE_PART_NAMES, "weekofyear"),
    ("_id", "_year", "_month", "_day", "_quarter", "_day_of_week", "_is_weekend"),
    ("id", "uuid", "code"),
)

BUCKETS = 4
MIN_DISTINCT = 8


def date_parts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Adds year, month, quarter, day_of_week (Monday 0) and is_weekend."""
    if columns is None:
        columns = [n for n in df.columns if is_moment(dtype_of(df, n))]
    added = []
    for name in columns:
        t = ref(name)
        day = F.weekday(t)
        added += [
            F.year(t).alias(f"{name}_year"),
            F.month(t).alias(f"{name}_month"),
            F.quarter(t).alias(f"{name}_quarter"),
            day.alias(f"{name}_day_of_week"),
            F.coalesce(day.isin(5, 6), F.lit(False)).cast("int").alias(f"{name}_is_weekend"),
        ]
    return df.select("*", *added)


def bucket_columns(df: DataFrame) -> list[str]:
    """The numeric columns worth binning."""
    named = [n for n in df.columns if is_number(dtype_of(df, n)) and not NEVER_BINNED(n)]
    values = {n: to_number(ref(n), dtype_of(df, n)) for n in named}
    varied = more_distinct_than(df, values, MIN_DISTINCT)
    return [n for n in named if n in varied]


def bucket_edges(
    df: DataFrame, columns: Sequence[str], builtin_rows: int = ordered.BUILTIN_ROWS
) -> dict[str, list[float]]:
    """Distinct quantile edges per column (at most five numbers each)."""
    if not columns:
        return {}
    points = [i / BUCKETS for i in range(BUCKETS + 1)]
    rows = ordered.quantiles(
        long_numbers(df, columns), "v", points, ["column"], builtin_rows=builtin_rows
    ).collect()
    edges = {}
    for row in rows:
        values = [row[f"q{i}"] for i in range(len(points))]
        if values[0] is not None:
            edges[row["column"]] = sorted(set(values))
    return edges


def _round_edge(edge: float, digits: int) -> float:
    """Rounds half up to ``digits`` decimals, or significant digits below one."""
    if edge == 0 or not math.isfinite(edge):
        return edge
    if abs(edge) < 1:
        digits += -math.floor(math.log10(abs(edge))) - 1
    # the decimals that are shown decide: as binary fractions, halves are a little more or less
    step = Decimal(1).scaleb(-digits)
    return float(Decimal(repr(float(edge))).quantize(step, ROUND_HALF_UP, Context(prec=400)))


def bucket_labels(edges: Sequence[float]) -> list[str]:
    """``(low, high]`` texts, rounded to three digits or as many as needed to
    tell the edges apart; the lowest edge is shown just below its value."""
    shown, digits = list(edges), 3
    for digits in range(3, 20):
        shown = [_round_edge(e, digits) for e in edges]
        if len(set(shown)) == len(edges):
            break
    shown[0] -= 10.0**-digits
    return [f"({low}, {high}]" for low, high in zip(shown, shown[1:])]


def bucket(col: Column, edges: Sequence[float]) -> Column:
    """Label of the right-closed bin of a value; the lowest edge is included."""
    label = None
    for high, text in zip(edges[1:], bucket_labels(edges)):
        inside = col <= high
        label = F.when(inside, text) if label is None else label.when(inside, text)
    return F.when(col.isNotNull() & (col >= edges[0]), label)


def quantile_buckets(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    builtin_rows: int = ordered.BUILTIN_ROWS,
) -> DataFrame:
    """Adds ``<column>_bucket``; columns with fewer than two bins are left out."""
    columns = bucket_columns(df) if columns is None else list(columns)
    edges = bucket_edges(df, columns, builtin_rows)
    added = []
    for name in columns:
        if len(edges.get(name, [])) > 2:
            value = to_number(ref(name), dtype_of(df, name))
            added.append(bucket(value, edges[name]).alias(f"{name}_bucket"))
    return df.select("*", *added)


def engineer_features(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The widened table and a report row per new column."""
    dates = [n for n in df.columns if is_moment(dtype_of(df, n))]
    wide = quantile_buckets(date_parts(df, dates), bucket_columns(df))
    report = []
    for name in wide.columns[len(df.columns) :]:
        if name.endswith("_bucket"):
            base = name.removesuffix("_bucket")
            method, reason = "quantile binning", "Useful for comparing numeric ranges as groups."
        else:
            base = next(d for d in dates if name.startswith(f"{d}_"))
            method, reason = "datetime extraction", "Useful for time-based grouping and trends."
        report.append((name, base, method, reason))
    rows = df.sparkSession.createDataFrame(
        report, "new_feature string, derived_from string, method string, reason string"
    )
    return wide, rows
