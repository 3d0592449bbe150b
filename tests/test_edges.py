"""Empty, constant, all-null and single-row tables."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import chart_select, charts, cleaning, frequency, profile, summaries, tools
from tallyframe.plans.analysis import analyse
from tallyframe.plans.specs import AGGREGATES, Filter, Group

SCHEMA = "n double, t string, b boolean, d timestamp_ntz"


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_table(spark):
    df = empty(spark)
    assert profile.column_profile(df).count() == 0
    assert tools.filtered_aggregation(df, [Filter("n", "<", 1)], "n").first()["status"] == "no_matches"
    for function in AGGREGATES:
        assert tools.groupby_aggregation(df, "t", "n", function).count() == 0
    for method in ("pearson", "spearman", "kendall"):
        row = tools.correlation(df, "n", "n", method).first()
        assert row["matched_rows"] == 0 and row["correlation"] is None
    assert charts.histogram(df, "n").count() == 0 and charts.density(df, "n").count() == 0
    assert cleaning.duplicate_rows(df).first()[0] == 0
    assert charts.crosstab(df, "t", "t").count() == 0
    assert summaries.dataset_quality(df).first()["row_count"] == 0


def test_constant_and_null_columns(spark):
    rows = [(1.5, None, "x", i) for i in range(30)]
    df = spark.createDataFrame(rows, "same double, gone double, word string, i int")
    kinds = {r["column"]: r["inferred_type"] for r in profile.column_profile(df).collect()}
    assert kinds == {"same": "constant", "gone": "constant", "word": "constant", "i": "numeric"}
    assert tools.correlation(df, "same", "i").first()["correlation"] is None
    assert summaries.all_correlations(df, ["same", "gone", "i"]).filter("correlation is not null").count() == 0
    row = {r["column"]: r for r in summaries.numeric_summary(df, ["same", "gone"]).collect()}
    assert row["same"]["outlier_count"] == 0 and row["same"]["skewness"] is None
    assert row["gone"]["count"] == 0 and row["gone"]["missing_percentage"] == 100.0
    assert charts.histogram(df, "same").count() == 0


def test_zero_one_columns(spark):
    df = spark.createDataFrame([(i % 2, float(i % 2)) for i in range(10)], "whole int, real double")
    kinds = {r["column"]: r["inferred_type"] for r in profile.column_profile(df).collect()}
    assert kinds == {"whole": "boolean", "real": "numeric"}


def test_single_row(spark):
    df = spark.createDataFrame([(1.0, "x")], "n double, t string")
    row = summaries.numeric_summary(df, ["n"]).first()
    assert row["std"] is None and row["median"] == 1.0
    assert tools.compare_groups(df, "n", "median", [Group(), Group((Filter("t", "==", "y"),))]).count() == 2
    assert analyse(df).tables["charts"].count() >= 1


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (5.0,)], "v double")
    assert tools.filtered_aggregation(df, [Filter("v", ">", 2)], "v", "count").first()["matched_rows"] == 1
    assert summaries.numeric_summary(df, ["v"]).first()["count"] == 2
    assert {r["null_count"] for r in cleaning.null_counts(df).collect()} == {2}


def test_bad_specs(spark):
    df = spark.createDataFrame([(1.0, "x")], "n double, t string")
    for call in (
        lambda: tools.filtered_aggregation(df, [Filter("gone", "<", 1)], "n"),
        lambda: tools.filtered_aggregation(df, [Filter("n", "~", 1)], "n"),
        lambda: tools.filtered_aggregation(df, [], "gone"),
        lambda: tools.filtered_aggregation(df, [], "n", "mode"),
        lambda: tools.compare_groups(df, "n", "mean", [Group()]),
        lambda: tools.correlation(df, "n", "n", "other"),
    ):
        with pytest.raises(ValueError):
            call()


def test_pairwise_complete_correlations(spark):
    rows = [(float(i), float(i * i) if i % 3 else None, float(-i) if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    frame = df.toPandas()
    got = {(r["x"], r["y"]): r["correlation"] for r in summaries.all_correlations(df, df.columns).collect()}
    for (x, y), r in got.items():
        assert r == pytest.approx(frame[x].corr(frame[y]), abs=6e-5)


def test_long_texts_stay_whole(spark):
    long = "x" * 5000
    df = spark.createDataFrame([(long + "a",), (long + "a",), (long + "b",), ("short",)], "t string")
    rows = frequency.value_frequencies(df).collect()
    assert sorted(r["n"] for r in rows) == [1, 1, 2]
    assert {r["value"] for r in rows} == {long + "a", long + "b", "short"} and max(r["length"] for r in rows) == 5001
    assert [r["t"] for r in cleaning.duplicate_groups(df).collect()] == [long + "a"]
    assert cleaning.duplicate_rows(df).first()[0] == 1


def test_copied_columns(spark):
    df = spark.range(20).select("id", F.col("id").alias("again"), (F.col("id") + 1).alias("other"), F.col("id").alias("third"))
    got = {r["column"]: r["duplicate_of"] for r in cleaning.duplicate_columns(df).collect()}
    assert got == {"again": "id", "third": "id"}


@pytest.mark.parametrize("together", [1000, 5])
def test_correlations_of_many_columns(spark, monkeypatch, together):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame(rng.normal(0, 1, (400, 14)) @ rng.normal(0, 1, (14, 14)) + 1e3, columns=[f"c{i:02d}" for i in range(14)])
    frame.loc[::3, "c03"] = None
    frame.loc[1::4, "c07"] = None
    frame["c05"] = 7.5
    frame["c09"] = None
    frame.loc[frame.index % 2 == 0, "c11"] = 1.25
    frame.loc[frame.index % 2 == 1, "c12"] = None  # c11 is constant where c12 has a value
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"{c} double" for c in frame)).repartition(5)
    monkeypatch.setattr(summaries, "COLUMNS_TOGETHER", together)
    got = {(r["x"], r["y"]): r["correlation"] for r in summaries.all_correlations(df, list(frame)).collect()}
    monkeypatch.setattr(summaries, "PAIRS_PER_PASS", 1000)
    few = {(r["x"], r["y"]): r["correlation"] for r in summaries.all_correlations(df, list(frame)).collect()}
    assert got == few and len(got) == 14 * 13 / 2
    want = frame.astype(float).corr()
    assert got["c00", "c03"] == pytest.approx(want.loc["c00", "c03"], abs=1e-4) and got["c05", "c06"] is None and got["c11", "c12"] is None


def test_contingency_of_near_unique_levels(spark, monkeypatch):
    """Totals by broadcast, and by shuffle with frequent levels apart, give the same; a holds most cells in one level."""
    pairs = [("hot" if i % 3 else f"a{i % 7}", f"b{i}" if i % 5 else "common") for i in range(900)] + [(None, "b1"), ("a1", None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    both = [p for p in pairs if None not in p]
    cells, rows, cols = (Counter(x) for x in (both, [p[0] for p in both], [p[1] for p in both]))
    phi2 = sum(n * n / (rows[a] * cols[b]) for (a, b), n in cells.items()) - 1
    for few, share in ((10_000, 10_000), (0, 3)):
        monkeypatch.setattr(charts, "FEW_LEVELS", few)
        monkeypatch.setattr(charts, "SHARE_OF_HOT", share)
        got = charts.association(df, "a", "b").first()
        assert (got["rows"], got["levels_a"], got["levels_b"]) == (len(both), len(rows), len(cols))
        assert abs(got["association_strength"] - phi2) < 1e-3
    monkeypatch.setattr(charts, "GRID_LEVELS", 50)
    grid = {(r["category"], r["series"]): r["count"] for r in charts.crosstab(df, "a", "b").collect()}
    assert grid == {(a, b): cells[a, b] for a in rows for b in cols}
    empty = charts.association(df.limit(0), "a", "b").first()
    assert (empty["rows"] or 0, empty["levels_a"], empty["association_strength"]) == (0, 0, 0.0)


def test_charts_of_all_columns_on_request(spark):
    """Limits keep columns from charts and say so; without limits each column has its charts."""
    days = pd.date_range("2020-01-01", periods=60, freq="7D")
    data = {f"v{i}": [(j * (7 + i)) % 23 * 1.5 for j in range(60)] for i in range(7)}
    data |= {f"c{i}": [f"g{(j + i) % 3}" for j in range(60)] for i in range(3)}
    data |= {"d0": days, "d1": days[::-1]}
    df = spark.createDataFrame(pd.DataFrame(data))
    some, every = analyse(df), analyse(df, chart_select.Limits(*[None] * 7))
    left = {tuple(r) for r in some.tables["charts_left_out"].collect()}
    assert {("v5", "distribution"), ("v6", "distribution"), ("c1", "groups"), ("c2", "mix"), ("d1", "trend")} <= left
    assert every.tables["charts_left_out"].count() == 0
    assert "v6_distribution" in every.charts and "v6_distribution" not in some.charts
    assert set(some.charts) <= set(every.charts)
    some.release(), every.release()
