"""Shared pieces: table reader, dirty columns in both dialects, SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.tokens import FALSE_TOKENS, MISSING_TOKENS, TRUE_TOKENS
from tallyframe.sources.tables import read_parquet


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_parquet(spark, folder, name)


def sql_list(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


MISSING_SQL = sql_list(MISSING_TOKENS)
TRUE_SQL = sql_list(TRUE_TOKENS)
FALSE_SQL = sql_list(FALSE_TOKENS)


def clean_sql(expr: str) -> str:
    """Trimmed text with missing-like tokens as null."""
    t = f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN lower({t}) NOT IN ({MISSING_SQL}) THEN {t} END"


# Dirt put over clean rows, the same in both dialects: every event gets a
# spelling of its type, of its value and of a flag by its id.
DIRTY_TYPE = """CASE event_id % 9
 WHEN 0 THEN ' N/A ' WHEN 1 THEN 'NaN' WHEN 2 THEN '' WHEN 3 THEN upper(event_type)
 WHEN 4 THEN concat('  ', event_type, '  ') WHEN 5 THEN 'Missing' WHEN 6 THEN NULL
 WHEN 7 THEN 'undefined' ELSE event_type END"""
DIRTY_PRICE = """CASE event_id % 7
 WHEN 0 THEN concat('$', cast(user_id as {text}), ',', '250.5') WHEN 1 THEN concat(cast(user_id as {text}), '%')
 WHEN 2 THEN concat(cast(user_id as {text}), 'd') WHEN 3 THEN ' n/a ' WHEN 4 THEN concat(' -', cast(user_id as {text}), '.5 ')
 WHEN 5 THEN concat(cast(user_id as {text}), 'e2') ELSE cast(user_id as {text}) END"""
DIRTY_FLAG = """CASE event_id % 8
 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no ' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0'
 WHEN 4 THEN 'None' WHEN 5 THEN '1' WHEN 6 THEN NULL ELSE 'False' END"""
DIRTY_DATE = """CASE event_id % 6
 WHEN 0 THEN {iso_day} WHEN 1 THEN {iso_second} WHEN 2 THEN {us_day}
 WHEN 3 THEN 'not a date' WHEN 4 THEN 'null' ELSE {slash_day} END"""

SPARK_DIRTY = [
    "event_id", "user_id", "ts", "value",
    DIRTY_TYPE + " AS kind",
    DIRTY_PRICE.format(text="string") + " AS price",
    DIRTY_FLAG + " AS flag",
    DIRTY_DATE.format(
        iso_day="date_format(ts, 'yyyy-MM-dd')",
        iso_second="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")",
        us_day="date_format(ts, 'M/d/yyyy')",
        slash_day="date_format(ts, 'yyyy/M/d')",
    ) + " AS happened",
    "CASE WHEN event_id % 2 = 0 THEN value END AS half_value",
]
DIRTY_SQL = f"""dirty AS (SELECT event_id, user_id, ts, value, {DIRTY_TYPE} AS kind,
 {DIRTY_PRICE.format(text='varchar')} AS price, {DIRTY_FLAG} AS flag,
 {DIRTY_DATE.format(
    iso_day="strftime(ts, '%Y-%m-%d')", iso_second="strftime(ts, '%Y-%m-%dT%H:%M:%S')",
    us_day="strftime(ts, '%-m/%-d/%Y')", slash_day="strftime(ts, '%Y/%-m/%-d')")} AS happened,
 CASE WHEN event_id % 2 = 0 THEN value END AS half_value FROM events)"""


def dirty_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*SPARK_DIRTY)


def as_text(df: DataFrame, *columns: str, sep: str = " | ") -> DataFrame:
    """Array columns joined into text, for comparison."""
    for name in columns:
        df = df.withColumn(name, F.array_join(name, sep))
    return df


def number_sql(expr: str) -> str:
    """Guarded number parse of a trimmed text."""
    return (
        f"CASE WHEN regexp_full_match({expr}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') "
        f"THEN try_cast({expr} AS DOUBLE) END"
    )
