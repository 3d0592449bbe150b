"""Filtered, grouped, compared and correlated aggregates."""

from __future__ import annotations

from tallyframe.operators import filters, tools
from tallyframe.plans.specs import AGGREGATES, Filter, Group

from .common import DIRTY_SQL, clean_sql, dirty_events, table


def filtered(name, filters_, column, function):
    def run(spark, folder):
        return tools.filtered_aggregation(table(spark, folder, name), filters_, column, function)

    return run


def filtered_sql(name, condition, column, function):
    """The report with baseline and complement for mean and median."""
    agg = {"mean": "avg({})", "median": "quantile_cont({}, 0.5)"}[function]
    hit = agg.format(f"CASE WHEN {condition} THEN {column} END")
    rest = agg.format(f"CASE WHEN NOT ({condition}) THEN {column} END")
    every = agg.format(column)
    return f"""WITH s AS (SELECT count(*) FILTER (WHERE {condition}) AS matched_rows,
  count(*) FILTER (WHERE NOT ({condition})) AS comparison_rows,
  {hit} AS r, {rest} AS c, {every} AS o FROM {name})
SELECT CASE WHEN matched_rows > 0 THEN 'complete' ELSE 'no_matches' END AS status,
 '{function}' AS aggregation, '{column}' AS column_name, matched_rows,
 CASE WHEN matched_rows > 0 THEN round(r, 4) END AS result,
 CASE WHEN matched_rows > 0 THEN round(o, 4) END AS overall_baseline,
 CASE WHEN matched_rows > 0 THEN round(round(r, 4) - round(o, 4), 4) END AS difference_from_overall,
 CASE WHEN matched_rows > 0 AND c IS NOT NULL THEN comparison_rows END AS comparison_rows,
 CASE WHEN matched_rows > 0 THEN round(c, 4) END AS comparison_result,
 CASE WHEN matched_rows > 0 THEN round(round(r, 4) - c, 4) END AS comparison_difference FROM s"""


def plain_sql(name, condition, column, function, expression):
    return f"""WITH s AS (SELECT count(*) AS matched_rows, {expression} AS r FROM {name} WHERE {condition})
SELECT CASE WHEN matched_rows > 0 THEN 'complete' ELSE 'no_matches' END AS status,
 '{function}' AS aggregation, '{column}' AS column_name, matched_rows,
 CASE WHEN matched_rows > 0 THEN round(cast(r AS DOUBLE), 4) END AS result,
 cast(NULL AS DOUBLE) AS overall_baseline, cast(NULL AS DOUBLE) AS difference_from_overall,
 cast(NULL AS BIGINT) AS comparison_rows, cast(NULL AS DOUBLE) AS comparison_result,
 cast(NULL AS DOUBLE) AS comparison_difference FROM s"""


def grouped(function):
    def run(spark, folder):
        return tools.groupby_aggregation(table(spark, folder, "events"), "event_type", "value", function)

    return run


GROUP_SQL = {
    "count": "cast(count(value) AS DOUBLE)", "mean": "avg(value)", "median": "quantile_cont(value, 0.5)",
    "sum": "coalesce(sum(value), 0)", "min": "min(value)", "max": "max(value)", "std": "stddev_samp(value)",
}


def grouped_sql(function):
    return f"""SELECT event_type AS "group", round({GROUP_SQL[function]}, 4) AS value FROM events
GROUP BY event_type HAVING {GROUP_SQL[function]} IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 20"""


def correlated(method):
    def run(spark, folder):
        return tools.correlation(table(spark, folder, "lineitem"), "l_quantity", "l_discount", method)

    return run


CORR_HEAD = "SELECT 'l_quantity' AS x_column, 'l_discount' AS y_column, '{}' AS method"
CORR_SQL = {
    "pearson": CORR_HEAD.format("pearson")
    + ", count(*) AS matched_rows, round(corr(l_quantity, l_discount), 4) AS correlation FROM lineitem",
    "spearman": """WITH r AS (SELECT
  rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx,
  rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS ry FROM lineitem)
""" + CORR_HEAD.format("spearman") + ", count(*) AS matched_rows, round(corr(rx, ry), 4) AS correlation FROM r",
    "kendall": """WITH j AS (SELECT l_quantity AS x, l_discount AS y, cast(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2),
s AS (SELECT sum(CASE WHEN (a.x < b.x AND a.y < b.y) THEN a.n * b.n ELSE 0 END) AS con,
  sum(CASE WHEN (a.x < b.x AND a.y > b.y) THEN a.n * b.n ELSE 0 END) AS dis FROM j a JOIN j b ON a.x < b.x),
t AS (SELECT sum(n) AS n FROM j),
tx AS (SELECT sum(c * (c - 1) / 2) AS v FROM (SELECT x, sum(n) AS c FROM j GROUP BY x)),
ty AS (SELECT sum(c * (c - 1) / 2) AS v FROM (SELECT y, sum(n) AS c FROM j GROUP BY y))
""" + CORR_HEAD.format("kendall") + """, cast(t.n AS BIGINT) AS matched_rows,
 round((s.con - s.dis) / sqrt((t.n * (t.n - 1) / 2 - tx.v) * (t.n * (t.n - 1) / 2 - ty.v)), 4) AS correlation
FROM s, t, tx, ty""",
}

STATUS_GROUPS = (
    Group((Filter("o_orderstatus", "==", "f"),), "finished"),
    Group((Filter("o_orderstatus", "==", "O"), Filter("o_totalprice", ">", 100000)), "open and large"),
    Group((Filter("o_orderstatus", "in", ["F", "P"]),)),
)
GROUP_CONDITIONS = (
    ("finished", "o_orderstatus = 'F'"),
    ("open and large", "o_orderstatus = 'O' AND o_totalprice > 100000"),
    ("Group 3", "o_orderstatus IN ('F', 'P')"),
)


def compared(function):
    def run(spark, folder):
        return tools.compare_groups(table(spark, folder, "orders"), "o_totalprice", function, STATUS_GROUPS)

    return run


def compared_sql(function):
    agg = {"mean": "avg(o_totalprice)", "median": "quantile_cont(o_totalprice, 0.5)"}[function]
    parts = " UNION ALL ".join(
        f"SELECT {i + 1} AS position, '{label}' AS label, count(*) AS matched_rows, round({agg}, 4) AS result FROM orders WHERE {cond}"
        for i, (label, cond) in enumerate(GROUP_CONDITIONS)
    )
    return f"""WITH g AS ({parts}) SELECT position, label, matched_rows, result,
 matched_rows < 30 AS sample_size_warning,
 round((SELECT result FROM g WHERE position = 1) - (SELECT result FROM g WHERE position = 2), 4) AS difference FROM g"""


def rest_of_orders(spark, folder):
    orders = table(spark, folder, "orders")
    return filters.complement(orders, [Filter("o_orderstatus", "==", "F"), Filter("o_totalprice", "<", 200000)])


def contains_rows(spark, folder):
    parts = table(spark, folder, "part")
    kept = filters.apply_filters(parts, [Filter("p_type", "contains", "^(econ|st)"), Filter("p_size", "between", (5, 20))])
    return kept.select("p_partkey", "p_type", "p_size")


def dirty_filter(spark, folder):
    """Missing-like values match neither an equality nor its opposite."""
    return tools.filtered_aggregation(dirty_events(spark, folder), [Filter("kind", "!=", "click")], "price", "mean")


DIRTY_KIND = clean_sql("kind")
PRICE_NUMBER = (
    "CASE WHEN regexp_full_match(trim(price), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') "
    "THEN try_cast(trim(price) AS DOUBLE) END"
)

CASES = {
    "filtered_mean_baseline": (
        filtered("lineitem", [Filter("l_quantity", "<", 5)], "l_extendedprice", "mean"),
        filtered_sql("lineitem", "l_quantity < 5", "l_extendedprice", "mean"),
    ),
    "filtered_median_between": (
        filtered("lineitem", [Filter("l_discount", "between", (0.02, 0.05))], "l_extendedprice", "median"),
        filtered_sql("lineitem", "l_discount BETWEEN 0.02 AND 0.05", "l_extendedprice", "median"),
    ),
    "filtered_count_two_filters": (
        filtered("lineitem", [Filter("l_returnflag", "==", "r"), Filter("l_linestatus", "==", " F ")], "l_orderkey", "count"),
        plain_sql("lineitem", "l_returnflag = 'R' AND l_linestatus = 'F'", "l_orderkey", "count", "count(l_orderkey)"),
    ),
    "filter_contains_regex": (
        contains_rows,
        "SELECT p_partkey, p_type, p_size FROM part WHERE regexp_matches(lower(p_type), '^(econ|st)') AND p_size BETWEEN 5 AND 20",
    ),
    "filter_in": (
        filtered("orders", [Filter("o_orderpriority", "in", ["1-urgent", " 5-LOW "])], "o_totalprice", "max"),
        plain_sql("orders", "o_orderpriority IN ('1-URGENT', '5-LOW')", "o_totalprice", "max", "max(o_totalprice)"),
    ),
    "filter_not_equal": (
        filtered("customer", [Filter("c_mktsegment", "!=", "machinery")], "c_acctbal", "min"),
        plain_sql("customer", "lower(c_mktsegment) <> 'machinery'", "c_acctbal", "min", "min(c_acctbal)"),
    ),
    "filter_ge_le_gt": (
        filtered("lineitem", [Filter("l_quantity", ">=", 10), Filter("l_quantity", "<=", 20), Filter("l_tax", ">", 0.02)], "l_extendedprice", "std"),
        plain_sql("lineitem", "l_quantity >= 10 AND l_quantity <= 20 AND l_tax > 0.02", "l_extendedprice", "std", "stddev_samp(l_extendedprice)"),
    ),
    "filtered_no_match": (
        filtered("lineitem", [Filter("l_quantity", ">", 1e9)], "l_extendedprice", "mean"),
        filtered_sql("lineitem", "l_quantity > 1e9", "l_extendedprice", "mean"),
    ),
    "filter_complement": (
        rest_of_orders,
        "SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 200000)",
    ),
    "filter_dirty_text": (
        dirty_filter,
        f"WITH {DIRTY_SQL}, d AS (SELECT coalesce(lower({DIRTY_KIND}) <> 'click', false) AS hit, {PRICE_NUMBER} AS price FROM dirty) "
        + filtered_sql("d", "hit", "price", "mean").replace("WITH s AS", ", s AS", 1),
    ),
    **{f"groupby_{f}": (grouped(f), grouped_sql(f)) for f in AGGREGATES},
    **{f"compare_groups_{f}": (compared(f), compared_sql(f)) for f in ("mean", "median")},
    **{f"corr_{m}": (correlated(m), CORR_SQL[m]) for m in CORR_SQL},
}
