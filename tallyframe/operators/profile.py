"""Semantic column types: one profile row per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_name
from ..functions.tokens import FALSE_TOKENS, TRUE_TOKENS
from ..functions.values import (
    dtype_of,
    is_moment,
    is_nested,
    is_number,
    is_text,
    parse_formatted_number,
    parse_moment,
    ref,
)
from .frequency import column_totals, first_values, value_frequencies

SAMPLE_VALUES = 5
DATETIME_SHARE = 0.75
NUMBER_SHARE = 0.8
HIGH_MISSING = 40
HIGH_CARDINALITY = 50

CONSTANT_NOTE = "Column has one or zero distinct values."
MISSING_NOTE = "High missingness may reduce reliability."
CARDINALITY_NOTE = "High cardinality; grouped charts may be limited to top values."


def storage_kind(dtype) -> str:
    if is_number(dtype):
        return "number"
    if is_moment(dtype):
        return "moment"
    if is_text(dtype):
        return "text"
    return "nested" if is_nested(dtype) else "boolean"


def by_name(pairs: dict[str, Column], name: Column) -> Column:
    """Driver-known value per column name."""
    return F.element_at(
        F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), name
    )


def text_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per text column, the share of valid cells that parse, and mean length.

    One scan without a shuffle of values; rows (column, number_share,
    moment_share, mean_length).
    """
    from ..functions.values import clean

    cells = []
    for name in columns:
        dtype = dtype_of(df, name)
        col = ref(name)
        valid = clean(col, dtype)
        cells.append(
            F.struct(
                F.when(valid.isNotNull(), parse_formatted_number(col, dtype).isNotNull().cast("int")).alias("number"),
                F.when(valid.isNotNull(), parse_moment(col, dtype).isNotNull().cast("int")).alias("moment"),
                F.length(valid).alias("length"),
            ).alias(name)
        )
    long = df.select(*cells).unpivot([], [ref(n) for n in columns], "column", "cell")
    return long.groupBy("column").agg(
        F.avg("cell.number").alias("number_share"),
        F.avg("cell.moment").alias("moment_share"),
        F.avg("cell.length").alias("mean_length"),
    )


def sample_values(freq: DataFrame, df: DataFrame, limit: int = SAMPLE_VALUES) -> DataFrame:
    """The first values per column in value order; ``freq`` counts ``df``."""
    return first_values(freq, limit, "sample_values", df)


def column_profile(
    df: DataFrame, columns: Sequence[str] | None = None, freq: DataFrame | None = None
) -> DataFrame:
    """Rows (column, position, safe_name, inferred_type, ...), one per column.

    ``freq`` may be a persisted ``value_frequencies`` of the same columns.
    """
    names = list(columns or df.columns)
    freq = value_frequencies(df, names, short=True) if freq is None else freq
    kinds = {n: storage_kind(dtype_of(df, n)) for n in names}
    word = F.lower("value")
    others = F.count_if(~word.isin(*TRUE_TOKENS, *FALSE_TOKENS))
    totals = column_totals(freq, (others == 0).alias("all_boolean"))
    profile = totals.join(sample_values(freq, df), "column", "left")
    texts = [n for n in names if kinds[n] == "text"]
    if texts:
        profile = profile.join(text_shares(df, texts), "column", "left")
    else:
        for extra in ("number_share", "moment_share", "mean_length"):
            profile = profile.withColumn(extra, F.lit(None).cast("double"))
    column = F.col("column")
    profile = (
        profile.withColumn("kind", by_name({n: F.lit(k) for n, k in kinds.items()}, column))
        .withColumn("position", by_name({n: F.lit(i) for i, n in enumerate(names)}, column))
        .withColumn("safe_name", by_name({n: F.lit(safe_name(n)) for n in names}, column))
        .withColumn("inferred_type", semantic_type())
    )
    missing_share = F.col("missing_count") / F.greatest(F.col("row_count"), F.lit(1)) * 100
    kind = F.col("inferred_type")
    warnings = F.array_compact(
        F.array(
            F.when(kind == "constant", CONSTANT_NOTE),
            F.when(missing_share > HIGH_MISSING, MISSING_NOTE),
            F.when(
                kind.isin("categorical", "high-cardinality categorical")
                & (F.col("unique_count") > HIGH_CARDINALITY),
                CARDINALITY_NOTE,
            ),
        )
    )
    return profile.select(
        "column",
        "position",
        "safe_name",
        "inferred_type",
        "kind",
        F.round(missing_share, 2).alias("missing_percentage"),
        "row_count",
        "missing_count",
        "unique_count",
        "top_count",
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        warnings.alias("warnings"),
        (kind.isin("numeric", "categorical", "boolean") & (F.col("unique_count") > 1)).alias(
            "target_candidate"
        ),
    )


def semantic_type() -> Column:
    """The type ladder over the per-column totals."""
    rows, unique, kind = F.col("row_count"), F.col("unique_count"), F.col("kind")
    number = (kind == "number") | ((kind == "text") & (F.col("number_share") >= NUMBER_SHARE))
    id_like = (unique == rows) & (
        F.contains(F.lower("column"), F.lit("id"))
        | (unique > F.greatest(F.lit(30.0), rows * 0.9))
    )
    moment = (kind == "moment") | ((kind == "text") & (F.col("moment_share") >= DATETIME_SHARE))
    many = (unique / F.greatest(rows, F.lit(1)) > 0.5) & (unique > 30)
    return (
        F.when(kind == "nested", "nested")
        .when(unique <= 1, "constant")
        .when((kind == "boolean") | F.col("all_boolean"), "boolean")
        .when(number & id_like, "id-like")
        .when(number, "numeric")
        .when(moment, "datetime")
        .when(many & (F.col("mean_length") > 24), "text-like")
        .when(many, "high-cardinality categorical")
        .otherwise("categorical")
    )


def type_counts(profile: DataFrame) -> DataFrame:
    return profile.groupBy("inferred_type").agg(F.count(F.lit(1)).alias("columns"))


def tool_schema(df: DataFrame, freq: DataFrame | None = None, limit: int = 8) -> DataFrame:
    """Columns as a question front end sees them: samples, and for text columns
    the most frequent values and the missing count."""
    from .frequency import top_values

    names = df.columns
    freq = value_frequencies(df, names, short=True) if freq is None else freq
    numbers = [n for n in names if is_number(dtype_of(df, n))]
    numeric = F.col("column").isin(*numbers) if numbers else F.lit(False)
    top = (
        top_values(freq.filter(~numeric), limit, df)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("t"))
        .select("column", F.col("t.value").alias("top_values"))
    )
    types = {n: F.lit(dtype_of(df, n).simpleString()) for n in names}
    return (
        column_totals(freq)
        .join(sample_values(freq, df), "column", "left")
        .join(top, "column", "left")
        .select(
            "column",
            by_name(types, F.col("column")).alias("dtype"),
            numeric.alias("numeric"),
            "sample_values",
            "top_values",
            F.when(~numeric, F.col("missing_count")).alias("missing_count"),
        )
    )
