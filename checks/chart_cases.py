"""Derived features, chart data and chart selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import chart_select, charts, features, summaries
from tallyframe.plans.analysis import analyse

from .common import DIRTY_SQL, clean_sql, dirty_events, table
from .profile_cases import LINE_NUMBERS, DIRTY, boolean_sql, numeric_sql, text_sql

REASON_SQL = chart_select.ID_REASON


def edges_sql(column, source):
    """Five distinct quantile edges, as they are and as shown in labels."""
    shown = ", ".join(f"round(edges[{i}], 3)" for i in range(1, 6))
    return f"""e AS (SELECT list_sort(list_distinct(quantile_cont({column}, [0, 0.25, 0.5, 0.75, 1]))) AS edges FROM {source}),
 f AS (SELECT edges, [{shown}] AS shown FROM e)"""


def label_sql(column):
    def text(low, high):
        return f"'(' || cast({low} AS VARCHAR) || ', ' || cast({high} AS VARCHAR) || ']'"

    branches = [f"WHEN {column} <= edges[2] THEN {text('shown[1] - 0.001', 'shown[2]')}"]
    branches += [f"WHEN {column} <= edges[{i + 1}] THEN {text(f'shown[{i}]', f'shown[{i + 1}]')}" for i in (2, 3, 4)]
    return "CASE " + " ".join(branches) + " END"


def buckets(spark, folder):
    orders = table(spark, folder, "orders").select("o_totalprice")
    wide = features.quantile_buckets(orders, ["o_totalprice"])
    return wide.groupBy("o_totalprice_bucket").agg(F.count(F.lit(1)).alias("rows"))


def bucket_rows(spark, folder):
    """Buckets of a column with nulls, next to the value."""
    df = dirty_events(spark, folder).select("event_id", "half_value")
    return features.quantile_buckets(df, ["half_value"])


def date_parts(spark, folder):
    rows = dirty_events(spark, folder).select(
        "event_id", F.expr("CASE WHEN event_id % 5 > 0 THEN ts END").alias("t")
    )
    return features.date_parts(rows).drop("t")


def engineered(spark, folder):
    return features.engineer_features(table(spark, folder, "orders"))[1]


ENGINEERED_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('o_orderdate_{p}', 'o_orderdate', 'datetime extraction', 'Useful for time-based grouping and trends.')"
    for p in ("year", "month", "quarter", "day_of_week", "is_weekend")
) + """) v(new_feature, derived_from, method, reason) UNION ALL
SELECT 'o_totalprice_bucket', 'o_totalprice', 'quantile binning', 'Useful for comparing numeric ranges as groups.'
FROM orders HAVING count(DISTINCT o_totalprice) > 8 UNION ALL
SELECT 'o_custkey_bucket', 'o_custkey', 'quantile binning', 'Useful for comparing numeric ranges as groups.'
FROM orders HAVING count(DISTINCT o_custkey) > 8 UNION ALL
SELECT 'o_orderkey_bucket', 'o_orderkey', 'quantile binning', 'Useful for comparing numeric ranges as groups.'
FROM orders HAVING count(DISTINCT o_orderkey) > 8"""


def histogram_sql(column, source):
    return f"""WITH s AS (SELECT min({column}) AS lo, max({column}) AS hi,
  least(24, greatest(6, cast(floor(sqrt(count({column}))) AS INTEGER))) AS bins FROM {source}),
b AS (SELECT unnest(range(bins)) AS i, lo, hi, bins, (hi - lo) / bins AS w FROM s),
c AS (SELECT greatest(0, least(bins - 1, cast(floor(({column} - lo) / (hi - lo) * bins) AS INTEGER))) AS i, count(*) AS n
  FROM {source}, s WHERE {column} IS NOT NULL GROUP BY 1)
SELECT cast(b.i AS INTEGER) AS bin_index, cast(cast(round(lo + b.i * w, 2) AS DECIMAL(38, 2)) AS VARCHAR) || ' - ' ||
  cast(cast(round(lo + (b.i + 1) * w, 2) AS DECIMAL(38, 2)) AS VARCHAR) AS bin, coalesce(n, 0) AS count
FROM b LEFT JOIN c ON b.i = c.i"""


def density_sql(column, source):
    return f"""WITH s AS (SELECT min({column}) AS lo, max({column}) AS hi, count({column}) AS t, count(DISTINCT {column}) AS d FROM {source}),
b AS (SELECT unnest(range(28)) AS i, lo, (hi - lo) / 28 AS w, t, d FROM s),
c AS (SELECT greatest(0, least(27, cast(floor(({column} - lo) / (hi - lo) * 28) AS INTEGER))) AS i, count(*) AS n
  FROM {source}, s WHERE {column} IS NOT NULL GROUP BY 1),
x AS (SELECT b.i, (lo + b.i * w + lo + (b.i + 1) * w) / 2 AS x, coalesce(n, 0) / t / w AS d FROM b LEFT JOIN c ON b.i = c.i WHERE t >= 20 AND b.d >= 5)
SELECT round(x, 4) AS x, round(avg(d) OVER (ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS density FROM x"""


def on(name, operator, *arguments):
    return lambda spark, folder: operator(table(spark, folder, name), *arguments)


def box(spark, folder):
    events = table(spark, folder, "events")
    return charts.box_plot(summaries.numeric_summary(events, ["value", "user_id"]), "value")


def dirty_boxes(spark, folder):
    return charts.box_by_group(dirty_events(spark, folder), "kind", "value")


def boxes_sql(category, value, source, head=""):
    return f"""WITH {head} d AS (SELECT {category} AS k, {value} AS v FROM {source})
SELECT k AS label, round(min(v), 4) AS min, round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.5), 4) AS median,
 round(quantile_cont(v, 0.75), 4) AS q3, round(max(v), 4) AS max, count(*) AS count FROM d
WHERE k IS NOT NULL AND v IS NOT NULL GROUP BY k HAVING count(*) >= 5 ORDER BY k LIMIT 10"""


EFFECT_SQL = """WITH g AS (SELECT avg(c_acctbal) AS m FROM customer GROUP BY c_mktsegment ORDER BY 1 DESC LIMIT 12),
w AS (SELECT stddev_samp(c_acctbal) AS std, avg(abs(c_acctbal)) AS size FROM customer),
s AS (SELECT count(*) AS groups, max(m) - min(m) AS spread FROM g)
SELECT groups, round(spread, 4) AS group_mean_spread, round(spread / std, 4) AS effect_size_approx,
 round(spread / greatest(size, 1e-9), 4) AS relative_spread,
 groups < 2 OR spread = 0 OR (spread / std < 0.15 AND spread / greatest(size, 1e-9) < 0.04) AS negligible FROM s, w"""

CROSS_SQL = """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2),
g AS (SELECT a, b FROM (SELECT DISTINCT a FROM c), (SELECT DISTINCT b FROM c)),
t AS (SELECT a, sum(n) AS total FROM c GROUP BY 1)
SELECT g.a AS category, g.b AS series, coalesce(n, 0) AS count, round(coalesce(n, 0) / total * 100, 2) AS percent
FROM g JOIN t USING (a) LEFT JOIN c ON c.a = g.a AND c.b = g.b"""

ASSOCIATION_SQL = """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2),
r AS (SELECT a, sum(n) AS rt FROM c GROUP BY 1), k AS (SELECT b, sum(n) AS ct FROM c GROUP BY 1), t AS (SELECT sum(n) AS total FROM c),
e AS (SELECT coalesce(n, 0) AS o, rt * ct / total AS e, total FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.a = r.a AND c.b = k.b)
SELECT cast(sum(o) AS BIGINT) AS rows, (SELECT count(*) FROM r) AS levels_a, (SELECT count(*) FROM k) AS levels_b,
 round(sum(power(o - e, 2) / greatest(e, 1e-9)) / max(total), 4) AS association_strength FROM e"""


def boolean_chart(spark, folder):
    rows = summaries.boolean_summary(table(spark, folder, "labels"), ["quality", "toxic"])
    return charts.boolean_chart(rows)


def category_chart(spark, folder):
    return charts.category_chart(dirty_events(spark, folder), ["kind", "price"])


CATEGORY_CHART_SQL = f"WITH {DIRTY_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", rank, value, count, round(count / sum(count) OVER () * 100, 2) AS percentage FROM (
 SELECT cast(row_number() OVER (ORDER BY n DESC, v) AS INTEGER) AS rank, v AS value, n AS count
 FROM (SELECT {clean_sql(c)} AS v, count(*) AS n FROM dirty GROUP BY 1) WHERE v IS NOT NULL QUALIFY rank <= 14)"""
    for c in ("kind", "price")
)


def heatmap(spark, folder):
    return charts.correlation_heatmap(table(spark, folder, "lineitem"), LINE_NUMBERS)


HEATMAP_SQL = " UNION ALL ".join(
    f"SELECT {i} AS x, {j} AS y, '{a}' AS x_label, '{b}' AS y_label, round(corr({a}, {b}), 4) AS value FROM lineitem"
    for i, a in enumerate(LINE_NUMBERS) for j, b in enumerate(LINE_NUMBERS)
)

# Lines under names that the redundancy rules know.
RENAMED = {
    "unit_price": "l_extendedprice", "quantity": "l_quantity", "order_amount": "l_extendedprice * l_quantity",
    "tax_amount": "l_extendedprice * l_tax", "order_year": "year(l_shipdate)", "order_month": "month(l_shipdate)",
    "line_id": "l_linenumber", "label_rate": "l_discount", "month": "month(l_shipdate)", "quarter": "quarter(l_shipdate)",
}


def renamed(spark, folder):
    lines = table(spark, folder, "lineitem")
    return lines.selectExpr(*[f"cast({e} AS double) AS {n}" for n, e in RENAMED.items()])


def scored_pairs(spark, folder):
    df = renamed(spark, folder)
    every = summaries.all_correlations(df, df.columns)
    return chart_select.pair_usefulness(every.filter("correlation IS NOT NULL"), df.columns)


def reason_sql():
    """The rules spelled out over the names used here."""
    date = "regexp_matches(x, '(^|_)(year|month|quarter)$') AND regexp_matches(y, '(^|_)(year|month|quarter)$')"
    money = "('order_amount', 'tax_amount')"
    price = "('unit_price', 'quantity', 'order_amount')"
    return f"""CASE WHEN x = 'line_id' OR y = 'line_id' THEN '{chart_select.ID_REASON}'
 WHEN {date} THEN '{chart_select.DATE_REASON}'
 WHEN x IN {money} AND y IN {money} THEN '{chart_select.AMOUNT_REASON}'
 WHEN x IN {price} AND y IN {price} AND 'unit_price' IN (x, y) AND 'order_amount' IN (x, y) THEN '{chart_select.PRICE_REASON}'
 WHEN x IN {price} AND y IN {price} AND 'order_amount' IN (x, y) THEN '{chart_select.AMOUNT_REASON}'
 WHEN x IN {price} AND y IN {price} THEN '{chart_select.FORMULA_REASON}' END"""


def renamed_pairs_sql():
    names = sorted(RENAMED)
    head = "d AS (SELECT " + ", ".join(f"cast({e} AS DOUBLE) AS {n}" for n, e in RENAMED.items()) + " FROM lineitem)"
    parts = " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 4) AS r FROM d"
        for i, a in enumerate(names) for b in names[i + 1 :]
    )
    return f"{head}, p AS (SELECT x, y, r AS correlation, {reason_sql()} AS exclusion_reason FROM ({parts}))"


SCORED_SQL = f"""{renamed_pairs_sql()}, q AS (SELECT *, exclusion_reason IS NOT NULL AS should_exclude,
 contains(x || ' ' || y, 'label') AS hinted FROM p),
scored AS (SELECT x, y, correlation, round(least(1.0, abs(correlation)), 4) AS statistical_strength,
 CASE WHEN should_exclude THEN 0.12 ELSE 0.82 END::DOUBLE AS analytical_usefulness,
 CASE WHEN should_exclude THEN 0.85 ELSE 0 END::DOUBLE AS redundancy_penalty,
 CASE WHEN hinted THEN 0.35 ELSE 0 END::DOUBLE AS leakage_penalty,
 round(greatest(0.05::DOUBLE, least(1.0::DOUBLE, abs(correlation)) * 0.35::DOUBLE + CASE WHEN should_exclude THEN 0.12::DOUBLE ELSE 0.82::DOUBLE END * 0.55::DOUBLE
  - CASE WHEN should_exclude THEN 0.85::DOUBLE ELSE 0::DOUBLE END - CASE WHEN hinted THEN 0.35::DOUBLE ELSE 0::DOUBLE END), 4) AS final_usefulness_score,
 should_exclude, exclusion_reason FROM q)"""


def excluded(spark, folder):
    df = renamed(spark, folder)
    return chart_select.excluded_pairs(scored_pairs(spark, folder), df.columns).select("x", "y", "exclusion_reason")


EXCLUDED_SQL = f"""WITH {SCORED_SQL} SELECT x, y, exclusion_reason FROM scored WHERE should_exclude"""


def useful(spark, folder):
    return chart_select.useful_pairs(scored_pairs(spark, folder))


def known_pairs(spark, folder):
    """Known pairs that the strongest correlations alone do not exclude."""
    df = renamed(spark, folder)
    strongest = summaries.correlation_pairs(df, df.columns, limit=2)
    scored = chart_select.pair_usefulness(strongest, df.columns)
    return chart_select.known_excluded_pairs(scored, df.columns).select("x", "y", "exclusion_reason")


def chart_selection(spark, folder):
    return analyse(table(spark, folder, "orders")).tables["charts"]


def chart_lookup(spark, folder):
    return chart_select.chart_lookup(analyse(table(spark, folder, "customer")).tables["charts"])


def scatter(spark, folder):
    return charts.scatter(dirty_events(spark, folder), "user_id", "half_value")


def missing_note(spark, folder):
    return charts.missing_metadata(dirty_events(spark, folder), "kind")


MISSING_CHART_SQL = f"""WITH {DIRTY_SQL}, m AS ({" UNION ALL ".join(
    f'''SELECT '{c}' AS "column", count(*) FILTER (WHERE ({text_sql(c, k)}) IS NULL) AS missing FROM dirty''' for c, k in DIRTY
)}) SELECT * FROM m WHERE missing > 0"""

KIND = clean_sql("kind")

CASES = {
    "date_parts": (
        date_parts,
        """WITH d AS (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN ts END AS t FROM events)
SELECT event_id, cast(year(t) AS INTEGER) AS t_year, cast(month(t) AS INTEGER) AS t_month, cast(quarter(t) AS INTEGER) AS t_quarter,
 cast(isodow(t) - 1 AS INTEGER) AS t_day_of_week, CASE WHEN isodow(t) >= 6 THEN 1 ELSE 0 END AS t_is_weekend FROM d""",
    ),
    "quantile_buckets": (
        buckets,
        f"WITH {edges_sql('o_totalprice', 'orders')} SELECT {label_sql('o_totalprice')} AS o_totalprice_bucket, count(*) AS rows FROM orders, f GROUP BY 1",
    ),
    "quantile_buckets_nulls": (
        bucket_rows,
        f"WITH {DIRTY_SQL}, {edges_sql('half_value', 'dirty')} SELECT event_id, half_value, {label_sql('half_value')} AS half_value_bucket FROM dirty, f",
    ),
    "engineered_features": (engineered, ENGINEERED_SQL),
    "histogram": (on("orders", charts.histogram, "o_totalprice"), histogram_sql("o_totalprice", "orders")),
    "histogram_skewed": (on("events", charts.histogram, "value"), histogram_sql("value", "events")),
    "density": (on("orders", charts.density, "o_totalprice"), density_sql("o_totalprice", "orders")),
    "box_plot": (
        box,
        'SELECT "column" AS label, min, q1, median, q3, max FROM (' + numeric_sql("events", ["value"]) + ") WHERE outlier_count > 0",
    ),
    "box_by_group": (
        on("customer", charts.box_by_group, "c_mktsegment", "c_acctbal"),
        boxes_sql("c_mktsegment", "c_acctbal", "customer"),
    ),
    "box_by_group_dirty": (dirty_boxes, boxes_sql(KIND, "value", "dirty", DIRTY_SQL + ",")),
    "group_means": (
        on("customer", charts.group_means, "c_mktsegment", "c_acctbal"),
        "SELECT c_mktsegment AS category, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1 ORDER BY avg(c_acctbal) DESC, 1 LIMIT 12",
    ),
    "group_effect": (on("customer", charts.group_effect, "c_mktsegment", "c_acctbal"), EFFECT_SQL),
    "crosstab": (on("orders", charts.crosstab, "o_orderstatus", "o_orderpriority"), CROSS_SQL),
    "association": (on("orders", charts.association, "o_orderstatus", "o_orderpriority"), ASSOCIATION_SQL),
    "monthly_trend": (
        on("orders", charts.monthly_trend, "o_orderdate", "o_totalprice"),
        """SELECT cast(cast(last_day(o_orderdate) AS DATE) AS VARCHAR) AS date, round(avg(o_totalprice), 4) AS value
FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 60""",
    ),
    "boolean_chart": (
        boolean_chart,
        "SELECT \"column\", unnest(['True', 'False']) AS value, unnest([true_count, false_count]) AS count FROM ("
        + boolean_sql("labels", [("quality", "number"), ("toxic", "number")]) + ")",
    ),
    "category_chart": (category_chart, CATEGORY_CHART_SQL),
    "correlation_heatmap": (heatmap, HEATMAP_SQL),
    "missingness_chart": (lambda spark, folder: charts.missingness(dirty_events(spark, folder)), MISSING_CHART_SQL),
    "missing_metadata": (
        missing_note,
        f"""WITH {DIRTY_SQL}, s AS (SELECT count(*) AS n, count(*) - count({KIND}) AS m FROM dirty)
SELECT 'kind' AS "column", m AS excluded_missing_count, round(m / n * 100, 2) AS excluded_missing_percent,
 CASE WHEN m > 0 THEN 'This chart excludes ' || m || ' missing values from kind.' END AS note FROM s""",
    ),
    "scatter": (
        scatter,
        f"WITH {DIRTY_SQL} SELECT cast(user_id AS DOUBLE) AS x, half_value AS y FROM dirty WHERE half_value IS NOT NULL",
    ),
    "pair_usefulness": (scored_pairs, f"WITH {SCORED_SQL} SELECT * FROM scored WHERE correlation IS NOT NULL"),
    "excluded_pairs": (excluded, EXCLUDED_SQL),
    "useful_pairs": (
        useful,
        f"WITH {SCORED_SQL} SELECT * FROM scored WHERE NOT should_exclude ORDER BY final_usefulness_score DESC, x, y LIMIT 10",
    ),
    "known_excluded_pairs": (
        known_pairs,
        f"""WITH {SCORED_SQL}, top AS (SELECT * FROM scored ORDER BY abs(correlation) DESC, x, y LIMIT 2),
k AS (SELECT * FROM (VALUES ('order_amount', 'tax_amount', '{chart_select.AMOUNT_REASON}'),
 ('unit_price', 'order_amount', '{chart_select.PRICE_REASON}'), ('month', 'quarter', '{chart_select.DATE_REASON}')) v(x, y, exclusion_reason))
SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.should_exclude AND least(t.x, t.y) = least(k.x, k.y) AND greatest(t.x, t.y) = greatest(k.x, k.y))""",
    ),
    "chart_selection": (chart_selection, None),
    "chart_lookup": (chart_lookup, None),
}
