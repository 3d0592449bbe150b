"""Filter specs as boolean columns; null never matches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import MISSING_TOKENS
from ..functions.values import (
    clean_text,
    dtype_of,
    is_float,
    is_number,
    is_text,
    ref,
    strip,
    to_number,
)
from ..plans.specs import COMPARISONS, Filter, check_filters


def predicate(df: DataFrame, spec: Filter) -> Column:
    """Condition of one filter spec.

    Numeric columns are compared as they are stored, so that the comparison
    reaches the parquet scan; text is coerced or normalised first.
    """
    spec.check(df)
    dtype = dtype_of(df, spec.column)
    col = ref(spec.column)
    if spec.operator in COMPARISONS or spec.operator == "between":
        return _numeric_condition(col, dtype, spec)
    text = clean_text(col, dtype)
    if spec.operator == "contains":
        return text.rlike("(?i)" + str(spec.value))
    if spec.operator == "in":
        many = isinstance(spec.value, (list, tuple, set))
        values = sorted(spec.value, key=str) if many else [spec.value]
        return _equals_any(col, dtype, text, values)
    same = _equals_any(col, dtype, text, [spec.value])
    return text.isNotNull() & ~same if spec.operator == "!=" else same


def _numeric_condition(col, dtype, spec) -> Column:
    value = col if is_number(dtype) else to_number(col, dtype)
    if spec.operator == "between":
        low, high = (_literal(v) for v in spec.value)
        condition = (value >= low) & (value <= high)
    else:
        bound = _literal(spec.value)
        condition = {
            "<": value < bound,
            "<=": value <= bound,
            ">": value > bound,
            ">=": value >= bound,
        }[spec.operator]
    # NaN sorts above every number in Spark, but is a missing value here
    return condition & ~F.isnan(value) if is_float(dtype) else condition


def _literal(value) -> Column:
    number = float(value)
    if number.is_integer() and abs(number) < 2**31:
        return F.lit(int(number))
    return F.lit(number)


def _equals_any(col, dtype, text, values) -> Column:
    words = [str(v).strip().lower() for v in values]
    if is_text(dtype):
        # a word that is no missing-like token matches no missing-like cell
        words = [w for w in words if w not in MISSING_TOKENS]
        return F.lower(strip(col)).isin(*words) if words else F.lit(False)
    if not is_number(dtype):
        return F.lower(text).isin(*words) if words else F.lit(False)
    numbers = []
    for word in words:
        try:
            numbers.append(_literal(word))
        except ValueError:
            continue
    return col.isin(*numbers) if numbers else F.lit(False)


def all_of(df: DataFrame, filters: Sequence[Filter]) -> Column:
    """Conjunction of the specs as a true / false column, never null."""
    check_filters(df, filters)
    if not filters:
        return F.lit(True)
    condition = reduce(lambda a, b: a & b, [predicate(df, f) for f in filters])
    return F.coalesce(condition, F.lit(False))


def apply_filters(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Matching rows; kept free of coalesce so that it can be pushed down."""
    check_filters(df, filters)
    for spec in filters:
        df = df.filter(predicate(df, spec))
    return df


def complement(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Rows that do not match, those with a null condition included."""
    return df.filter(~all_of(df, filters))


def outside_fences(value: Column, q1: Column, q3: Column) -> Column:
    """Outside the 1.5 IQR fences; an IQR of zero fences nothing."""
    reach = (q3 - q1) * 1.5
    beyond = (value < q1 - reach) | (value > q3 + reach)
    return (q3 != q1) & beyond
