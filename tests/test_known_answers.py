"""Tables with answers known beforehand."""

import fixtures
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import chart_select, ml_schema, ml_training, profile, summaries, tools
from tallyframe.operators.cleaning import clean_table
from tallyframe.plans.analysis import analyse
from tallyframe.plans.specs import Filter, Group


def one(df):
    return df.first().asDict()


def test_filtered_mean(spark):
    got = one(tools.filtered_aggregation(
        fixtures.students(spark), [Filter("sleep_hours_per_night", "<", 4)], "stress_level"))
    assert got["result"] == 8.0 and got["status"] == "complete"
    assert got["difference_from_overall"] == round(8.0 - got["overall_baseline"], 4)


@pytest.mark.parametrize(
    "column, groups, rows, results, difference",
    [
        ("Productivity_Score", [("Sleep_Hours_Per_Night", "<", 5), ("Sleep_Hours_Per_Night", ">=", 8)], (12, 18), (52.0, 81.0), -29.0),
        ("Previous_Semester_GPA", [("Sleep_Hours_Per_Night", "<=", 5), ("Sleep_Hours_Per_Night", ">=", 8)], (12, 18), (6.2, 7.4), -1.2),
        ("Stress_Level", [("Part_Time_Job", "==", "true"), ("Part_Time_Job", "==", "False")], (10, 30), (6.4, 5.4667), 0.9333),
        ("Screen_Time_Hours", [("Performance_Category", "==", "High"), ("Performance_Category", "==", "low")], (18, 12), (5.0, 9.0), -4.0),
    ],
)
def test_compare_groups(spark, column, groups, rows, results, difference):
    specs = [Group((Filter(*g),)) for g in groups]
    got = tools.compare_groups(fixtures.performance(spark), column, "mean", specs).orderBy("position").collect()
    assert tuple(r["matched_rows"] for r in got) == rows
    assert tuple(r["result"] for r in got) == results
    assert {r["difference"] for r in got} == {difference}
    assert all(r["sample_size_warning"] == (r["matched_rows"] < 30) for r in got)


def test_top_group(spark):
    rows = tools.groupby_aggregation(
        fixtures.performance(spark), "Performance_Category", "Productivity_Score", "mean").collect()
    assert [r["group"] for r in rows] == ["High", "Medium", "Low"]


def test_missing_like_is_no_category(spark):
    rows = summaries.category_top_values(fixtures.genders(spark), ["gender"]).collect()
    assert {r["value"] for r in rows} == {"Male", "Female", "Other"}
    assert summaries.category_summary(fixtures.genders(spark), ["gender"]).first()["missing_count"] == 6


def test_two_categorical_filters(spark):
    got = one(tools.filtered_aggregation(
        fixtures.orders(spark), [Filter("Shipping_Method", "==", "express"), Filter("Returned", "in", ["yes"])],
        "Order_ID", "count"))
    assert got["result"] == 2 and got["matched_rows"] == 2


def test_group_means(spark):
    rows = tools.groupby_aggregation(fixtures.shipping(spark), "Shipping_Method", "Delivery_Days", "mean").collect()
    assert [(r["group"], r["value"]) for r in rows] == [("Standard", 6.4), ("Same-Day", 1.0)]


def test_booleans_are_not_numeric(spark):
    df = fixtures.jobs(spark)
    rows = profile.column_profile(df).collect()
    cleaned, _ = clean_table(df, rows)
    roles = summaries.column_roles(cleaned, rows)
    assert roles.boolean == ["is_remote", "is_startup"]
    assert not set(roles.boolean) & set(roles.numeric)
    assert roles.datetime == ["posted_at"]
    remote = {r["column"]: r for r in summaries.boolean_summary(cleaned, roles.boolean).collect()}["is_remote"]
    assert (remote["true_count"], remote["false_count"], remote["missing_count"]) == (3, 2, 1)


def test_formula_pairs_are_excluded(spark):
    df = fixtures.formulas(spark)
    names = [c for c in df.columns if c not in ("job_id", "job_family")]
    scored = chart_select.pair_usefulness(summaries.correlation_pairs(df, names), df.columns)
    excluded = {frozenset((r["x"], r["y"])): r["exclusion_reason"]
                for r in chart_select.excluded_pairs(scored, df.columns).collect()}
    for pair in (("salary_midpoint_lpa", "salary_min_lpa"), ("order_amount", "tax_amount"), ("month", "quarter"),
                 ("unit_price", "order_amount")):
        assert excluded[frozenset(pair)]
    useful = {frozenset((r["x"], r["y"])) for r in chart_select.useful_pairs(scored).collect()}
    assert useful and not useful & set(excluded)
    # the analysis delivers them with its charts
    delivered = analyse(df).tables["excluded_pairs"].collect()
    assert {frozenset((r["x"], r["y"])) for r in delivered} >= {frozenset(("month", "quarter")), frozenset(("order_amount", "tax_amount"))}
    assert all(r["exclusion_reason"] for r in delivered)


def test_chart_vocabulary(spark):
    got = analyse(fixtures.vocabulary(spark))
    specs = got.tables["charts"].collect()
    assert {"heatmap", "stacked_bar", "density", "line", "area"} & {r["chart_type"] for r in specs}
    assert all(r["chart_intent"] and r["reason"] for r in specs)
    assert len(specs) <= 14
    assert got.charts[specs[0]["chart_id"]].count() > 0
    assert got.corpus().filter("length(text) > 2").count() > 10
    assert {"created_at_year", "score_bucket"} <= set(got.engineered.columns)


def test_regression_training(spark):
    result = ml_training.train(fixtures.ratings(spark), "company_rating", "fast")
    assert result.summary["task_type"] == "regression"
    assert {"r2", "mae", "rmse"} <= set(result.summary["metrics"])
    assert result.summary["baseline"]["strategy"] == "mean_prediction"
    assert result.summary["metrics"]["r2"] > 0.9 and result.summary["beats_baseline"]
    assert result.comparison.filter("status = 'complete'").count() == 3
    assert result.summary["test_rows"] == 18
    used = {f["feature_name"] for f in result.best.features}
    assert "job_id" not in used and "remote_allowed" in used
    scored = ml_training.batch_score(result.best, fixtures.ratings(spark))
    error = scored.agg(F.max(F.abs(F.col("company_rating") - F.col("predicted_company_rating")))).first()[0]
    assert error < 0.5
    with pytest.raises(ValueError, match="not found: remote_allowed"):
        ml_training.batch_score(result.best, fixtures.ratings(spark).drop("remote_allowed"))


def test_schema_lists_values_of_possible_categories_only(spark, monkeypatch):
    rows = [(i, float(i % 50), "ab"[i % 2], ["yes", "no"][i % 3 == 0], f"2024-01-{i % 28 + 1:02d}", i % 5) for i in range(100)]
    df = spark.createDataFrame(rows, "key long, price double, kind string, loyal string, order_date string, size int")
    asked, counted = [], ml_schema.value_frequencies
    monkeypatch.setattr(ml_schema, "value_frequencies", lambda df, names, **more: asked.append(list(names)) or counted(df, names, **more))
    got = {r["feature_name"]: (r["type"], r["allowed_values"]) for r in ml_schema.feature_schema(df, "price").collect()}
    assert asked == [df.columns, ["kind", "loyal", "order_date"]]
    assert got["kind"] == ("categorical", ["a", "b"]) and got["loyal"] == ("boolean", ["true", "false"])
    assert got["size"] == ("numeric", None) and got["order_date"][1] is None
    whole = ml_schema.feature_schema(df, "price", counted(df, df.columns, short=True)).collect()
    assert {r["feature_name"]: (r["type"], r["allowed_values"]) for r in whole} == got
