"""Cell expressions on dirty data, and name rules."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import text
from tallyframe.functions.tokens import MISSING_TOKENS
from tallyframe.functions.values import (
    clean,
    integer_like,
    parse_formatted_number,
    parse_moment,
    rounded,
    to_flag,
    to_number,
)
from tallyframe.operators import ml_schema
from tallyframe.operators.features import bucket_labels

TEXT = T.StringType()


def apply(spark, values, expression, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_missing_tokens_in_any_case_and_padding(spark):
    values = [p.format(t) for t in MISSING_TOKENS for t in (t, t.upper(), t.title())
              for p in ("{}", "  {} ", "\t{}\n", " {}")]
    assert set(apply(spark, values, lambda c: clean(c, TEXT))) == {None}
    assert apply(spark, ["  x\t", "nano", "n / a"], lambda c: clean(c, TEXT)) == ["x", "nano", "n / a"]


def test_numbers(spark):
    values = ["12", " 12.5 ", "-.5", "1e3", "12d", "5f", "0x1A", "1_000", "", None, "nan", "$1"]
    assert apply(spark, values, lambda c: to_number(c, TEXT)) == [12.0, 12.5, -0.5, 1000.0] + [None] * 8
    values = ["$1,234.5%", "7%", "$", "12d", "N/A"]
    assert apply(spark, values, lambda c: parse_formatted_number(c, TEXT)) == [1234.5, 7.0, None, None, None]
    assert apply(spark, [1.5, float("nan"), None], lambda c: to_number(c, T.DoubleType()), "double") == [1.5, None, None]


def test_moments(spark):
    values = ["2024-02-29", "2024-02-30", "2024-01-02T03:04:05", "3/4/2024", "2024/1/2", "5-Jan-2024", "Jan 5, 2024", "12", "soon", None]
    got = apply(spark, values, lambda c: parse_moment(c, TEXT).cast("string"))
    assert got == ["2024-02-29 00:00:00", None, "2024-01-02 03:04:05", "2024-03-04 00:00:00", "2024-01-02 00:00:00",
                   "2024-01-05 00:00:00", "2024-01-05 00:00:00", None, None, None]


def test_flags(spark):
    values = [" Yes", "TRUE", "1", "no", "0", "False", "y", "maybe", None]
    assert apply(spark, values, lambda c: to_flag(c, TEXT)) == [1.0, 1.0, 1.0, 0.0, 0.0, 0.0, None, None, None]


def test_rounding_and_integers(spark):
    values = [1.23456, float("inf"), float("nan"), None]
    assert apply(spark, values, rounded, "double") == [1.2346, None, None, None]
    assert apply(spark, [2.0, 2.5, 1e-9, -3.0000000001], integer_like, "double") == [True, False, True, True]


def test_names():
    assert text.safe_names(["A b", "a-b", "  ", "A_B!"]) == ["a_b", "a_b_2", "column", "a_b_3"]
    assert text.display_name("order__total-value") == "Order Total Value"
    assert bucket_labels([1.0, 2.5, 4.0]) == ["(0.999, 2.5]", "(2.5, 4.0]"]


def test_labels_round_halves_up():
    # 125150.1375 is a little less as a binary fraction
    assert bucket_labels([1.0, 125150.1375, 2e5]) == ["(0.999, 125150.138]", "(125150.138, 200000.0]"]
    assert bucket_labels([0.00010005, 1.0, 1e300])[1] == "(1.0, 1e+300]"


def test_small_and_large_numbers_as_text(spark):
    from pyspark.sql import functions as F

    from tallyframe.functions.values import clean_text, dtype_of
    from tallyframe.operators.profile import column_profile

    want = {-0.0005: "-0.0005", 1e-4: "0.0001", 1e-5: "1e-05", 2.5e-5: "2.5e-05", 1e7: "10000000.0", 123456789.25: "123456789.25", 0.001: "0.001",
            1e15: "1000000000000000.0", 1e16: "1e+16", 1.5e120: "1.5e+120", 0.0: "0.0", 41.5: "41.5"}
    df = spark.createDataFrame([(x,) for x in want], "x double")
    got = df.select("x", clean_text(F.col("x"), dtype_of(df, "x")).alias("t")).collect()
    assert {r["x"]: r["t"] for r in got} == want
    # as '-5.0E-4' the value would come after the others
    few = spark.createDataFrame([(x,) for x in (-4.9, -0.0005, -5.5, -4.2, -4.1, -4.3)], "x double")
    assert column_profile(few).first()["sample_values"][0] == "-0.0005"



@pytest.mark.parametrize(
    "target, feature, leaks",
    [
        ("high_value", "order_total", True), ("returned", "refund_count", True), ("price", "price", True),
        ("total_price", "price_status", True), ("rating", "salary", False), ("total_price", "price_level", False),
    ],
)
def test_leakage(spark, target, feature, leaks):
    row = spark.createDataFrame([(feature,)], "n string").select(ml_schema.leakage_reason(F.col("n"), target).alias("r")).first()
    assert (row["r"] is not None) == leaks
    if leaks:
        reason = {"high_value": "possible target leakage for high_value", "returned": "possible target leakage for returned", "price": "target column"}
        assert row["r"] == reason.get(target, "shares outcome-like terms with target total_price")
