"""The whole-table analysis: profile, clean, summarise, derive, chart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.text import safe_names
from ..operators import chart_select, cleaning, features, profile, retrieval, summaries
from ..operators.frequency import value_frequencies


@dataclass
class Analysis:
    """Result tables by name, the cleaned and widened tables, chart data."""

    tables: dict[str, DataFrame]
    cleaned: DataFrame
    engineered: DataFrame
    charts: dict[str, DataFrame]
    frequencies: DataFrame

    def release(self) -> None:
        """Frees the kept frequency table; the results stay computable."""
        self.frequencies.unpersist()

    def corpus(self) -> DataFrame:
        """Text rows of all results, for retrieval; pairs and columns left out of the charts are no results."""
        return retrieval.artifact_corpus({k: v for k, v in self.tables.items() if k not in ("excluded_pairs", "charts_left_out")})


def analyse(df: DataFrame, limits: chart_select.Limits | None = None) -> Analysis:
    """Runs every step over the whole table; ``limits`` says how many columns get charts.

    Table ``charts_left_out`` names the columns that a limit kept from a kind of chart.

    The value-frequency table is built once and kept for the profile, the
    category and the boolean summaries.  Only tables with one row per column
    (or per chart) reach the driver.
    """
    spark = df.sparkSession
    freq = value_frequencies(df, short=True).persist()
    described = profile.column_profile(df, freq=freq)
    profile_rows = described.collect()
    described = spark.createDataFrame(profile_rows, described.schema)
    cleaned, _ = cleaning.clean_table(df, profile_rows)
    roles = summaries.column_roles(cleaned, profile_rows)
    safe = dict(zip(df.columns, safe_names(df.columns)))
    named = [v for k, n in safe.items() for v in (F.lit(k), F.lit(n))]
    safe_freq = freq.withColumn("column", F.element_at(F.create_map(*named), F.col("column")))

    tables = {
        "profile": described,
        "type_counts": profile.type_counts(described),
        "cleaning": cleaning.cleaning_report(df, profile_rows),
        "dataset": summaries.dataset_quality(cleaned),
    }
    per_column = {}
    if roles.numeric:
        per_column["numeric"] = summaries.numeric_summary(cleaned, roles.numeric)
    if roles.boolean:
        per_column["boolean"] = summaries.boolean_summary(cleaned, roles.boolean, safe_freq)
    if roles.categorical:
        per_column["categorical"] = summaries.category_summary(cleaned, roles.categorical, safe_freq)
        tables["category_top_values"] = summaries.category_top_values(
            cleaned, roles.categorical, freq=safe_freq
        )
    by_column: dict[str, dict[str, Row]] = {"numeric": {}, "boolean": {}, "categorical": {}}
    for name, table in per_column.items():
        rows = table.collect()
        by_column[name] = {r["column"]: r for r in rows}
        tables[name] = spark.createDataFrame(rows, table.schema)
    if roles.datetime:
        tables["datetime"] = summaries.datetime_summary(cleaned, roles.datetime)
    # one row for each pair of columns; all are scored, as the strongest may all be redundant
    every = summaries.correlation_pairs(cleaned, roles.numeric, limit=None)
    pairs = spark.createDataFrame(every.collect(), every.schema)
    tables["correlations"] = pairs.orderBy(F.desc(F.abs("correlation")), "x", "y").limit(summaries.TOP_PAIRS)
    engineered, report = features.engineer_features(cleaned)
    tables["features"] = report

    small = chart_select.ProfileTables(
        rows=max((r["row_count"] for r in profile_rows), default=0),
        numeric=by_column["numeric"],
        categorical=by_column["categorical"],
        boolean=by_column["boolean"],
        unique={safe[r["column"]]: r["unique_count"] for r in profile_rows},
    )
    scored = chart_select.pair_usefulness(pairs, cleaned.columns, small.mostly_unique())
    tables["excluded_pairs"] = chart_select.excluded_pairs(scored, cleaned.columns)
    limits = limits or chart_select.Limits()
    found = chart_select.chart_candidates(cleaned, roles, small, pairs, safe_freq, limits)
    tables["charts_left_out"] = spark.createDataFrame(chart_select.left_out(roles, small, limits), "column string, chart string")
    tables["charts"] = chart_select.chart_specs(found, spark)
    return Analysis(tables, cleaned, engineered, {c.chart_id: c.data for c in found}, freq)
