"""Cell-level expressions: missing-like values, coercion and rounding.

All functions take the column together with its Spark type, so that typed
parquet columns keep plain, pushable expressions and only text columns pay for
trimming and token tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import (
    FALSE_TOKENS,
    MISSING_TOKENS,
    TRUE_TOKENS,
    WHITESPACE,
)

# Text accepted as a number; a bare cast would also take '12d' or '5f'.
NUMBER_PATTERN = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"

# Layouts tried after ISO dates, in this order.
DATE_PATTERNS = (
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
)
# Longer texts are no token, and are not lower-cased to find out.
LONGEST_TOKEN = max(len(token) for token in MISSING_TOKENS)
ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    """Spark type of a column; raises when the column does not exist."""
    for field in df.schema.fields:
        if field.name == name:
            return field.dataType
    raise ValueError(f"Column not found: {name}")


def ref(name: str) -> Column:
    """Column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def is_moment(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def strip(text: Column) -> Column:
    """Text without leading and trailing whitespace of any kind."""
    return F.btrim(text, F.lit(WHITESPACE))


def clean(col: Column, dtype: T.DataType) -> Column:
    """The value with missing-like content turned into null; text is trimmed."""
    if is_text(dtype):
        text = strip(col)
        return F.when((F.length(text) > LONGEST_TOKEN) | ~F.lower(text).isin(*MISSING_TOKENS), text)
    if is_float(dtype):
        return F.when(~F.isnan(col), col)
    return col


def is_missing_like(col: Column, dtype: T.DataType) -> Column:
    if is_text(dtype):
        return col.isNull() | F.lower(strip(col)).isin(*MISSING_TOKENS)
    if is_float(dtype):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def is_null(col: Column, dtype: T.DataType) -> Column:
    """Plain null test; NaN counts as null, missing-like text does not."""
    return (col.isNull() | F.isnan(col)) if is_float(dtype) else col.isNull()


def number_text(col: Column) -> Column:
    """A double as shortest text: plain from 0.0001 up to 1e16, else as 1e-05 or 1.5e+20.

    Spark's own text turns to ``1.0E-4`` below 0.001 and to ``1.0E7`` from ten
    millions, so values that look alike would be written, and ordered, in two ways.
    """
    text, size = col.cast("string"), F.abs(col)
    plain = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    parts = F.split(text, "E")
    power = F.get(parts, F.lit(1)).try_cast("int")
    sign = F.when(power < 0, "e-").otherwise("e+")
    power = F.abs(power).cast("string")
    power = F.when(F.length(power) < 2, F.concat(F.lit("0"), power)).otherwise(power)
    scientific = F.concat(F.regexp_replace(F.get(parts, F.lit(0)), r"\.0$", ""), sign, power)
    return F.when(~text.contains("E"), text).when((size >= 1e-4) & (size < 1e16), plain).otherwise(scientific)


def clean_text(col: Column, dtype: T.DataType) -> Column:
    """Canonical text of the cleaned value, used as key and for comparisons."""
    if is_text(dtype):
        return clean(col, dtype)
    if is_float(dtype):
        # 0.0 and -0.0 are one value
        return number_text(F.when(~F.isnan(col), F.when(col == 0, F.lit(0.0)).otherwise(col)))
    if is_nested(dtype):
        return F.to_json(col) if not isinstance(dtype, T.BinaryType) else F.hex(col)
    return col.cast("string")


def parse_number(text: Column) -> Column:
    """Number in a trimmed text, null for anything else."""
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def to_number(col: Column, dtype: T.DataType) -> Column:
    """Value as double; unparsable text and NaN become null."""
    if is_float(dtype):
        return F.when(~F.isnan(col), col.cast("double"))
    if is_number(dtype):
        return col.cast("double")
    if isinstance(dtype, T.BooleanType):
        return col.cast("int").cast("double")
    if is_text(dtype):
        return parse_number(strip(col))
    return F.lit(None).cast("double")


def parse_formatted_number(col: Column, dtype: T.DataType) -> Column:
    """Like to_number, but ``$``, ``,`` and ``%`` in texts are dropped first."""
    if not is_text(dtype):
        return to_number(col, dtype)
    return parse_number(strip(F.translate(clean(col, dtype), "$,%", "")))


def parse_moment(col: Column, dtype: T.DataType) -> Column:
    """Value as timestamp without time zone; unparsable text becomes null."""
    if is_moment(dtype):
        return col.cast("timestamp_ntz")
    if not is_text(dtype):
        return F.lit(None).cast("timestamp_ntz")
    text = clean(col, dtype)
    parsed = [F.when(text.rlike(ISO_DATE), text.try_cast("timestamp_ntz"))]
    for pattern, layout in DATE_PATTERNS:
        moment = F.try_to_timestamp(text, F.lit(layout))
        parsed.append(F.when(text.rlike(pattern), moment.cast("timestamp_ntz")))
    return F.coalesce(*parsed)


def to_flag(
    col: Column,
    dtype: T.DataType,
    true_tokens: tuple[str, ...] = TRUE_TOKENS,
    false_tokens: tuple[str, ...] = FALSE_TOKENS,
) -> Column:
    """1.0 / 0.0 / null by boolean spelling."""
    if isinstance(dtype, T.BooleanType):
        return col.cast("int").cast("double")
    text = F.lower(clean_text(col, dtype))
    return F.when(text.isin(*true_tokens), 1.0).when(text.isin(*false_tokens), 0.0)


def finite(col: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col)


def rounded(col: Column, digits: int = 4) -> Column:
    return F.round(finite(col.cast("double")), digits)


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage of ``whole``, with an empty whole counted as one."""
    return F.round(part / F.greatest(whole, F.lit(1)) * 100, digits)


def integer_like(col: Column) -> Column:
    """Whether a double is a whole number up to the usual float tolerance."""
    nearest = F.rint(col)
    return F.abs(col - nearest) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(nearest)
