"""Value frequencies of all columns in one shuffle."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.values import clean_text, dtype_of, ref
from ..lineage import cut, spread


# Characters of a value that a short frequency keeps; a longer one is told apart by its digest.
SHORT = 64


def value_frequencies(df: DataFrame, columns: Sequence[str] | None = None, short: bool = False) -> DataFrame:
    """Rows (column, value, n, length); the null value counts missing cells.

    Partial aggregation on the map side collapses frequent values before the
    shuffle, so a value holding most rows of a column makes no hot task.

    With ``short`` no long text is shuffled: a value of more than ``SHORT``
    characters is cut there, and a column ``digest`` (16 bytes, null for short
    values) tells it from others.  ``top_values`` and its like put back whole
    values where they show any.
    """
    names = list(columns or df.columns)
    df = spread(df)
    cells = []
    for name in names:
        text = clean_text(ref(name), dtype_of(df, name))
        parts = [text.alias("value"), F.length(text).alias("length")]
        if short:
            parts = [F.left(text, F.lit(SHORT)).alias("value"), parts[1], _digest(text).alias("digest")]
        cells.append(F.struct(*parts).alias(name))
    long = df.select(*cells).unpivot([], [ref(n) for n in names], "column", "cell")
    keys = [F.col(f"cell.{k}").alias(k) for k in (("value", "digest") if short else ("value",))]
    return long.groupBy("column", *keys).agg(F.count(F.lit(1)).alias("n"), F.max("cell.length").alias("length"))


def _digest(text: Column) -> Column:
    return F.when(F.length(text) > SHORT, F.unhex(F.md5(text)))


def _whole(short: DataFrame, df: DataFrame) -> DataFrame:
    """Rows of a short frequency with whole values: another scan, for those columns that have long ones."""
    columns = [r["column"] for r in short.filter("digest is not null").select("column").distinct().collect()]
    if not columns:
        return short.drop("digest")
    cells = [F.struct(F.lit(n).alias("column"), clean_text(ref(n), dtype_of(df, n)).alias("text")) for n in columns]
    texts = df.select(F.inline(F.array(*cells))).withColumn("digest", _digest(F.col("text"))).filter("digest is not null")
    # only wanted texts pass the join, and equal ones are folded in their task
    wanted = short.select("column", "digest")
    texts = texts.join(wanted, ["column", "digest"], "left_semi").groupBy("column", "digest").agg(F.min("text").alias("text"))
    found = short.join(texts, ["column", "digest"], "left")
    return found.withColumn("value", F.coalesce("text", "value")).drop("digest", "text")


def surely_wide(df: DataFrame, columns: dict[str, Column], bound: int) -> set[str]:
    """Names of expressions that a sketch proves to have over ``bound`` values.

    ``bound`` values touch at most that many registers of the sketch, which
    keeps its estimate near ``bound``: over twice as much proves more.
    """
    if not columns:
        return set()
    # eight registers for each value of the bound, and no more: large sketches are slow to plan
    error = min(0.05, 1.1 / math.sqrt(8 * bound))
    sketch = df.agg(
        *[F.approx_count_distinct(c, error).alias(f"d{i}") for i, c in enumerate(columns.values())]
    ).first()
    return {n for i, n in enumerate(columns) if sketch[f"d{i}"] > 2 * bound + 20}


def few_values(df: DataFrame, columns: dict[str, Column], bound: int) -> dict[str, list]:
    """Sorted values of each expression that has at most ``bound``, exactly.

    Only expressions the sketch leaves open are collected, all in one job;
    those have some twice the bound of values at most.
    """
    wide = surely_wide(df, columns, bound)
    left = {n: c for n, c in columns.items() if n not in wide}
    if not left:
        return {}
    row = df.agg(*[F.collect_set(c).alias(f"v{i}") for i, c in enumerate(left.values())]).first()
    return {n: sorted(v) for n, v in zip(left, row) if len(v) <= bound}


def more_distinct_than(df: DataFrame, columns: dict[str, Column], bound: int) -> set[str]:
    """Names of expressions with more than ``bound`` different values, exactly."""
    return set(columns) - set(few_values(df, columns, bound))


def column_totals(freq: DataFrame, *extra: Column) -> DataFrame:
    """One row per column: rows, missing, valid and distinct counts.

    ``extra`` aggregates over (value, n) ride along in the same pass.
    """
    present = F.col("value").isNotNull()
    return freq.groupBy("column").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(present, F.col("n")).otherwise(0)).alias("valid_count"),
        F.sum(F.when(~present, F.col("n")).otherwise(0)).alias("missing_count"),
        F.count("value").alias("unique_count"),
        F.max(F.when(present, F.col("n"))).alias("top_count"),
        *extra,
    )


def _first_values(freq: DataFrame, limit: int, df: DataFrame | None, *order: Column) -> DataFrame:
    """The first values per column, with their rank.

    The rank filter is pushed below the shuffle, so each task forwards at most
    ``limit`` values per column.  Nulls are ranked last and dropped afterwards
    rather than filtered first: the frequency shuffle then has the same plan
    as that of ``column_totals``, and one run of it serves both.

    Of short frequencies (``df`` is what they count) all values that may be
    among the first are taken, then ordered as whole values.
    """
    place = W.partitionBy("column").orderBy(F.isnull("value"), *order)
    if "digest" in freq.columns:
        near = freq.select("column", "value", "digest", "n", F.rank().over(place).alias("rank")).filter(F.col("rank") <= limit)
        freq = _whole(cut(near.filter(F.col("value").isNotNull()).drop("rank")), df)
    ranked = freq.select("column", "value", "n", F.row_number().over(place).alias("rank"))
    return ranked.filter(F.col("rank") <= limit).filter(F.col("value").isNotNull())


def top_values(freq: DataFrame, limit: int, df: DataFrame | None = None) -> DataFrame:
    """The most frequent values per column, ties by value."""
    return _first_values(freq, limit, df, F.desc("n"), F.asc("value"))


def first_values(freq: DataFrame, limit: int, name: str, df: DataFrame | None = None) -> DataFrame:
    """Rows (column, name): an array of the first values in value order."""
    # n takes part in the order only to keep the frequency plan shared
    order = [F.asc("value")] if "digest" in freq.columns else [F.asc("value"), F.asc("n")]
    kept = _first_values(freq, limit, df, *order)
    return kept.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias(name))


def allowed_values(freq: DataFrame, limit: int = 80, df: DataFrame | None = None) -> DataFrame:
    """Sorted values per column, at most ``limit`` of them."""
    return first_values(freq, limit, "allowed_values", df)
