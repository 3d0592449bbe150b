"""Coercion, profiles, cleaning and column summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.text import safe_name
from tallyframe.functions.tokens import CSV_NULL_TOKENS
from tallyframe.functions.values import (
    dtype_of,
    parse_formatted_number,
    parse_moment,
    to_flag,
    to_number,
)
from tallyframe.operators import cleaning, frequency, profile, summaries
from tallyframe.sources.tables import null_tokens

from .common import (
    DIRTY_SQL,
    FALSE_SQL,
    TRUE_SQL,
    as_text,
    clean_sql,
    dirty_events,
    number_sql,
    sql_list,
    table,
)

CUSTOMER = [("c_custkey", "number"), ("c_name", "text"), ("c_nationkey", "number"), ("c_acctbal", "number"), ("c_mktsegment", "text")]
EVENTS = [("event_id", "number"), ("ts", "moment"), ("user_id", "number"), ("event_type", "text"), ("value", "number"), ("props", "text")]
ORDERS = [("o_orderkey", "number"), ("o_custkey", "number"), ("o_orderstatus", "text"), ("o_totalprice", "number"), ("o_orderdate", "moment"), ("o_orderpriority", "text")]
DIRTY = [("event_id", "number"), ("user_id", "number"), ("ts", "moment"), ("value", "number"), ("kind", "text"), ("price", "text"), ("flag", "text"), ("happened", "text"), ("half_value", "number")]
LABELS = [("doc_id", "number"), ("quality", "number"), ("toxic", "number")]
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def text_sql(name, kind):
    return clean_sql(name) if kind == "text" else f"cast({name} AS VARCHAR)"


def formatted_sql(expr):
    plain = f"trim(translate({expr}, '$,%', ''))"
    return number_sql(plain)


def moment_sql(expr):
    layouts = (("\\d{1,2}/\\d{1,2}/\\d{4}", "%m/%d/%Y"), ("\\d{4}/\\d{1,2}/\\d{1,2}", "%Y/%m/%d"))
    tries = [f"CASE WHEN regexp_full_match({expr}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}([ T].*)?') THEN try_cast({expr} AS TIMESTAMP) END"]
    tries += [f"CASE WHEN regexp_full_match({expr}, '{p}') THEN try_strptime({expr}, '{f}') END" for p, f in layouts]
    return f"coalesce({', '.join(tries)})"


def profile_sql(source, columns, head=""):
    """Profile rows of a relation, one branch per column."""
    parts = []
    for i, (name, kind) in enumerate(columns):
        number, moment = ("v", "v") if kind == "text" else ("NULL", "NULL")
        number = f"({formatted_sql('v')}) IS NOT NULL" if kind == "text" else "false"
        moment = f"({moment_sql('v')}) IS NOT NULL" if kind == "text" else "false"
        inner = f"(SELECT {text_sql(name, kind)} AS v FROM {source})"
        parts.append(f"""SELECT '{name}' AS "column", {i} AS position, '{safe_name(name)}' AS safe_name, '{kind}' AS kind,
 count(*) AS row_count, count(*) - count(v) AS missing_count, count(DISTINCT v) AS unique_count,
 bool_and(v IS NULL OR lower(v) IN ({TRUE_SQL}, {FALSE_SQL})) AS all_boolean, avg(length(v)) AS mean_length,
 avg(CASE WHEN v IS NOT NULL THEN ({number})::INT END) AS number_share,
 avg(CASE WHEN v IS NOT NULL THEN ({moment})::INT END) AS moment_share,
 coalesce((SELECT string_agg(v, ' | ' ORDER BY v) FROM (SELECT DISTINCT v FROM {inner} WHERE v IS NOT NULL ORDER BY v LIMIT 5)), '') AS sample_values
FROM {inner}""")
    union = " UNION ALL ".join(parts)
    return f"""WITH {head} s AS ({union}), k AS (SELECT *, CASE WHEN unique_count <= 1 THEN 'constant'
 WHEN all_boolean THEN 'boolean'
 WHEN (kind = 'number' OR number_share >= 0.8) AND unique_count = row_count
   AND (contains(lower("column"), 'id') OR unique_count > greatest(30, row_count * 0.9)) THEN 'id-like'
 WHEN kind = 'number' OR number_share >= 0.8 THEN 'numeric'
 WHEN kind = 'moment' OR moment_share >= 0.75 THEN 'datetime'
 WHEN unique_count / row_count > 0.5 AND unique_count > 30 AND mean_length > 24 THEN 'text-like'
 WHEN unique_count / row_count > 0.5 AND unique_count > 30 THEN 'high-cardinality categorical'
 ELSE 'categorical' END AS inferred_type FROM s)"""


PROFILE_TAIL = """ SELECT "column", position, safe_name, inferred_type, kind, round(missing_count / row_count * 100, 2) AS missing_percentage,
 row_count, missing_count, unique_count, sample_values,
 concat_ws(' | ', CASE WHEN inferred_type = 'constant' THEN 'Column has one or zero distinct values.' END,
  CASE WHEN missing_count / row_count > 0.4 THEN 'High missingness may reduce reliability.' END,
  CASE WHEN inferred_type IN ('categorical', 'high-cardinality categorical') AND unique_count > 50
   THEN 'High cardinality; grouped charts may be limited to top values.' END) AS warnings,
 inferred_type IN ('numeric', 'categorical', 'boolean') AND unique_count > 1 AS target_candidate FROM k"""


def profiled(load):
    def run(spark, folder):
        rows = profile.column_profile(load(spark, folder)).drop("top_count")
        return as_text(rows, "sample_values", "warnings")

    return run


def loader(name):
    return lambda spark, folder: table(spark, folder, name)


def typed(load):
    return lambda spark, folder: profile.type_counts(profile.column_profile(load(spark, folder)))


def tool_schema(spark, folder):
    rows = profile.tool_schema(dirty_events(spark, folder).select("user_id", "kind", "flag", "price"))
    return as_text(rows, "sample_values", "top_values")


def tool_schema_sql():
    columns = (("user_id", "number", "bigint"), ("kind", "text", "string"), ("flag", "text", "string"), ("price", "text", "string"))
    parts = []
    for name, kind, dtype in columns:
        inner = f"(SELECT {text_sql(name, kind)} AS v FROM dirty)"
        text = kind == "text"
        top = (
            f"(SELECT string_agg(v, ' | ' ORDER BY n DESC, v) FROM (SELECT v, count(*) AS n FROM {inner} WHERE v IS NOT NULL GROUP BY v ORDER BY n DESC, v LIMIT 8))"
            if text else "cast(NULL AS VARCHAR)"
        )
        parts.append(f"""SELECT '{name}' AS "column", '{dtype}' AS dtype, {str(not text).lower()} AS numeric,
 (SELECT string_agg(v, ' | ' ORDER BY v) FROM (SELECT DISTINCT v FROM {inner} WHERE v IS NOT NULL ORDER BY v LIMIT 5)) AS sample_values,
 {top} AS top_values, {f"(SELECT count(*) - count(v) FROM {inner})" if text else "cast(NULL AS BIGINT)"} AS missing_count""")
    return f"WITH {DIRTY_SQL} " + " UNION ALL ".join(parts)


def missing_counts(spark, folder):
    return cleaning.missing_like_counts(dirty_events(spark, folder))


def null_counts(spark, folder):
    return cleaning.null_counts(dirty_events(spark, folder))


def count_sql(test, name):
    parts = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {test(c, k)}) AS {name} FROM dirty""" for c, k in DIRTY
    )
    return f"WITH {DIRTY_SQL} {parts}"


def coerced(column, expression, alias):
    def run(spark, folder):
        df = dirty_events(spark, folder)
        return df.select("event_id", expression(F.col(column), dtype_of(df, column)).alias(alias))

    return run


def csv_nulls(spark, folder):
    df = dirty_events(spark, folder)
    return null_tokens(df).select("event_id", "kind", "flag")


def frequencies(spark, folder):
    df = dirty_events(spark, folder).select("kind", "flag", "user_id")
    return frequency.value_frequencies(df)


def frequencies_sql():
    parts = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", v AS value, count(*) AS n, cast(max(length(v)) AS INTEGER) AS length
FROM (SELECT {text_sql(c, k)} AS v FROM dirty) GROUP BY v"""
        for c, k in (("kind", "text"), ("flag", "text"), ("user_id", "number"))
    )
    return f"WITH {DIRTY_SQL} {parts}"


def document_frequencies(spark, folder):
    """Whole texts."""
    return frequency.value_frequencies(table(spark, folder, "documents"), ["text", "lang", "source"])


DOCUMENT_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", v AS value,
 count(*) AS n, cast(max(length(v)) AS INTEGER) AS length FROM (SELECT {clean_sql(c)} AS v FROM documents) GROUP BY 2"""
    for c in ("text", "lang", "source")
)


def doubled(spark, folder):
    """Lines without their keys, where some rows repeat."""
    return table(spark, folder, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def copied(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.withColumn("status_copy", F.col("o_orderstatus")).withColumn(
        "price_copy", F.col("o_totalprice")
    ).withColumn("almost", F.when(F.col("o_orderkey") == 7, F.lit("?")).otherwise(F.col("o_orderpriority")))


def document_copies(spark, folder):
    """Whole documents that occur more than once."""
    return cleaning.duplicate_rows(table(spark, folder, "documents").select("text", "lang"))


def report(spark, folder):
    df = dirty_events(spark, folder)
    return cleaning.cleaning_report(df, profile.column_profile(df).collect())


REPORT_SQL = f"""WITH {DIRTY_SQL}, c AS (SELECT event_id, user_id, ts, value, kind, {formatted_sql(clean_sql('price'))} AS price,
 flag, {moment_sql(clean_sql('happened'))} AS happened, half_value FROM dirty),
n AS ({" UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS col, count(*) - count({c}) AS null_count FROM c" for i, (c, _) in enumerate(DIRTY))})
SELECT position, col AS "column", col AS safe_name,
 CASE WHEN col = 'price' THEN 'parsed numeric-like strings' WHEN col IN ('happened', 'ts') THEN 'parsed datetime' END AS conversion,
 null_count, cast(0 AS BIGINT) AS duplicate_rows FROM n"""


def quality(spark, folder):
    df = dirty_events(spark, folder).select("kind", "flag", "half_value")
    return as_text(summaries.dataset_quality(df), "data_quality_warnings")


QUALITY_SQL = f"""WITH {DIRTY_SQL}, d AS (SELECT kind, flag, half_value FROM dirty),
s AS (SELECT count(*) AS row_count, count(*) - count(kind) AS a, count(*) - count(flag) AS b, count(*) - count(half_value) AS c FROM d),
x AS (SELECT cast(coalesce(sum(n - 1), 0) AS BIGINT) AS dup FROM (SELECT count(*) AS n FROM d GROUP BY kind, flag, half_value HAVING count(*) > 1))
SELECT row_count, 3 AS column_count, a + b + c AS missing_values_total, dup AS duplicate_rows,
 concat_ws(' | ', CASE WHEN dup > 0 THEN dup || ' duplicate rows detected.' END,
  CASE WHEN greatest(a, b, c) / row_count > 0.4 THEN 'High missingness in ' || concat_ws(', ',
   CASE WHEN a / row_count > 0.4 THEN 'kind' END, CASE WHEN b / row_count > 0.4 THEN 'flag' END,
   CASE WHEN c / row_count > 0.4 THEN 'half_value' END) || '.' END) AS data_quality_warnings FROM s, x"""


def numeric_sql(source, columns, head=""):
    parts = []
    for c in columns:
        parts.append(f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean,
 round(quantile_cont({c}, 0.5), 4) AS median, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max,
 round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.75), 4) AS q3,
 round(avg(power({c} - m, 3)) / power(var_pop({c}), 1.5), 4) AS skewness, round(kurtosis_pop({c}), 4) AS kurtosis,
 round((count(*) - count({c})) / count(*) * 100, 4) AS missing_percentage,
 count(*) FILTER (WHERE h <> l AND ({c} < l - 1.5 * (h - l) OR {c} > h + 1.5 * (h - l))) AS outlier_count
FROM (SELECT {c} FROM {source}), (SELECT avg({c}) AS m, quantile_cont({c}, 0.25) AS l, quantile_cont({c}, 0.75) AS h FROM {source})""")
    return (f"WITH {head} " if head else "") + " UNION ALL ".join(parts)


def booleans(spark, folder):
    rows = summaries.boolean_summary(dirty_events(spark, folder), ["flag"])
    return as_text(rows, "unique_values")


def label_booleans(spark, folder):
    return as_text(summaries.boolean_summary(table(spark, folder, "labels"), ["quality", "toxic"]), "unique_values")


def boolean_sql(source, columns, head=""):
    parts = []
    for c, kind in columns:
        inner = f"(SELECT {text_sql(c, kind)} AS v FROM {source})"
        parts.append(f"""SELECT '{c}' AS "column", true_count, false_count, round(true_count / (true_count + false_count) * 100, 2) AS true_percentage,
 round(false_count / (true_count + false_count) * 100, 2) AS false_percentage, missing_count,
 round(missing_count / n * 100, 4) AS missing_percentage, unique_values FROM
 (SELECT count(*) AS n, count(*) FILTER (WHERE lower(v) IN ({TRUE_SQL})) AS true_count,
  count(*) FILTER (WHERE lower(v) IN ({FALSE_SQL})) AS false_count, count(*) - count(v) AS missing_count,
  (SELECT string_agg(v, ' | ' ORDER BY v) FROM (SELECT v FROM {inner} WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 8)) AS unique_values
  FROM {inner})""")
    return (f"WITH {head} " if head else "") + " UNION ALL ".join(parts)


def categories(spark, folder):
    return summaries.category_summary(dirty_events(spark, folder), ["kind", "price"])


CATEGORY_SQL = f"WITH {DIRTY_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(v) AS unique_count, cast(sum(n) - sum(CASE WHEN v IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS missing_count,
 round((sum(n) - sum(CASE WHEN v IS NOT NULL THEN n ELSE 0 END)) / sum(n) * 100, 4) AS missing_percentage,
 '{c} has ' || cast(sum(n) - sum(CASE WHEN v IS NOT NULL THEN n ELSE 0 END) AS BIGINT) || ' missing values excluded from this category summary.' AS missing_note,
 count(v) > 50 AS cardinality_warning,
 max(CASE WHEN v IS NOT NULL THEN n END) / sum(CASE WHEN v IS NOT NULL THEN n END) > 0.8 AS imbalance_warning
FROM (SELECT v, count(*) AS n FROM (SELECT {clean_sql(c)} AS v FROM dirty) GROUP BY v)"""
    for c in ("kind", "price")
)


def top_categories(spark, folder):
    return summaries.category_top_values(dirty_events(spark, folder), ["kind", "price"])


TOP_SQL = f"WITH {DIRTY_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", cast(row_number() OVER (ORDER BY n DESC, v) AS INTEGER) AS rank, v AS value, n AS count,
 round(n / (SELECT count({clean_sql(c)}) FROM dirty) * 100, 2) AS percentage
FROM (SELECT {clean_sql(c)} AS v, count(*) AS n FROM dirty GROUP BY 1) WHERE v IS NOT NULL QUALIFY rank <= 12"""
    for c in ("kind", "price")
)


def moments(name, columns):
    return lambda spark, folder: summaries.datetime_summary(table(spark, folder, name), columns)


def moments_sql(name, column):
    return f"""SELECT '{column}' AS "column", min({column}) AS min_date, max({column}) AS max_date,
 cast(floor(date_diff('microsecond', min({column}), max({column})) / 86400000000) AS BIGINT) AS time_span_days,
 round((count(*) - count({column})) / count(*) * 100, 4) AS missing_percentage FROM {name}"""


def pairs(spark, folder):
    return summaries.correlation_pairs(table(spark, folder, "lineitem"), LINE_NUMBERS)


PAIRS_SQL = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 4) AS correlation FROM lineitem"
    for i, a in enumerate(sorted(LINE_NUMBERS)) for b in sorted(LINE_NUMBERS)[i + 1 :]
) + ") ORDER BY abs(correlation) DESC LIMIT 20"

# More columns than are summed pair by pair, with nulls in some and one that never varies.
MANY_NUMBERS = {
    "quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "line": "cast(l_linenumber AS double)",
    "order_key": "cast(l_orderkey AS double)", "part_key": "cast(l_partkey AS double)", "supplier_key": "cast(l_suppkey AS double)",
    "paid": "l_extendedprice * (1 - l_discount)", "taxed": "l_extendedprice * (1 + l_tax)", "each": "l_extendedprice / l_quantity",
    "bulk": "CASE WHEN l_quantity > 25 THEN l_quantity END", "cheap": "CASE WHEN l_discount > 0.05 THEN l_extendedprice END",
    "one": "cast(1 AS double)", "small": "CASE WHEN l_quantity < 20 THEN l_tax END",
}


def many_pairs(spark, folder):
    lines = table(spark, folder, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in MANY_NUMBERS.items()])
    return summaries.all_correlations(lines, list(MANY_NUMBERS))


# a pair is null where a column has one value, or where no row has both
MANY_PAIRS_SQL = f"WITH m AS (SELECT {', '.join(f'{e} AS {n}' for n, e in MANY_NUMBERS.items())} FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, {f'round(corr({a}, {b}), 4)' if 'one' not in (a, b) and {a, b} != {'bulk', 'small'} else 'max(NULL::DOUBLE)'} AS correlation FROM m"
    for i, a in enumerate(sorted(MANY_NUMBERS)) for b in sorted(MANY_NUMBERS)[i + 1 :]
)

CASES = {
    **{
        f"column_profile_{n}": (profiled(loader(n)), profile_sql(n, cols) + PROFILE_TAIL)
        for n, cols in (("customer", CUSTOMER), ("events", EVENTS), ("orders", ORDERS), ("labels", LABELS))
    },
    "column_profile_dirty": (profiled(dirty_events), profile_sql("dirty", DIRTY, DIRTY_SQL + ",") + PROFILE_TAIL),
    "type_counts": (
        typed(dirty_events),
        profile_sql("dirty", DIRTY, DIRTY_SQL + ",") + " SELECT inferred_type, count(*) AS columns FROM k GROUP BY 1",
    ),
    "tool_schema": (tool_schema, tool_schema_sql()),
    "missing_like_counts": (
        missing_counts,
        count_sql(lambda c, k: f"({text_sql(c, k)}) IS NULL", "missing_count"),
    ),
    "null_counts": (null_counts, count_sql(lambda c, k: f"{c} IS NULL", "null_count")),
    "numeric_coercion": (
        coerced("price", to_number, "number"),
        f"WITH {DIRTY_SQL} SELECT event_id, {number_sql('trim(price)')} AS number FROM dirty",
    ),
    "numeric_string_parse": (
        coerced("price", parse_formatted_number, "number"),
        f"WITH {DIRTY_SQL} SELECT event_id, {formatted_sql(clean_sql('price'))} AS number FROM dirty",
    ),
    "datetime_parse": (
        coerced("happened", parse_moment, "moment"),
        f"WITH {DIRTY_SQL} SELECT event_id, {moment_sql(clean_sql('happened'))} AS moment FROM dirty",
    ),
    "boolean_coerce": (
        coerced("flag", to_flag, "flag_value"),
        f"""WITH {DIRTY_SQL} SELECT event_id, CASE WHEN lower(trim(flag)) IN ({TRUE_SQL}) THEN 1.0::DOUBLE
 WHEN lower(trim(flag)) IN ({FALSE_SQL}) THEN 0.0::DOUBLE END AS flag_value FROM dirty""",
    ),
    "csv_null_tokens": (
        csv_nulls,
        f"""WITH {DIRTY_SQL} SELECT event_id, CASE WHEN kind NOT IN ({sql_list(CSV_NULL_TOKENS)}) THEN kind END AS kind,
 CASE WHEN flag NOT IN ({sql_list(CSV_NULL_TOKENS)}) THEN flag END AS flag FROM dirty""",
    ),
    "value_frequencies": (frequencies, frequencies_sql()),
    "document_frequencies": (document_frequencies, DOCUMENT_SQL),
    "duplicate_rows": (
        lambda spark, folder: cleaning.duplicate_rows(doubled(spark, folder)),
        """SELECT cast(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM
 (SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)""",
    ),
    "duplicate_groups": (
        lambda spark, folder: cleaning.duplicate_groups(doubled(spark, folder)),
        """SELECT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, count(*) AS copies FROM lineitem
 GROUP BY ALL HAVING count(*) > 1""",
    ),
    "duplicate_documents": (
        document_copies,
        "SELECT cast(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)",
    ),
    "duplicate_columns": (
        lambda spark, folder: cleaning.duplicate_columns(copied(spark, folder)),
        """SELECT 'status_copy' AS "column", 'o_orderstatus' AS duplicate_of FROM orders
 HAVING count(*) FILTER (WHERE o_orderstatus IS DISTINCT FROM o_orderstatus) = 0
 UNION ALL SELECT 'price_copy', 'o_totalprice' FROM orders HAVING count(*) > 0
 UNION ALL SELECT 'almost', 'o_orderpriority' FROM orders HAVING count(*) FILTER (WHERE o_orderkey = 7 AND o_orderpriority <> '?') = 0""",
    ),
    "cleaning_report": (report, REPORT_SQL),
    "dataset_quality": (quality, QUALITY_SQL),
    "numeric_summary": (
        lambda spark, folder: summaries.numeric_summary(table(spark, folder, "lineitem"), LINE_NUMBERS),
        numeric_sql("lineitem", LINE_NUMBERS),
    ),
    "numeric_summary_nulls": (
        lambda spark, folder: summaries.numeric_summary(dirty_events(spark, folder), ["value", "half_value"]),
        numeric_sql("dirty", ["value", "half_value"], DIRTY_SQL),
    ),
    "boolean_summary": (booleans, boolean_sql("dirty", [("flag", "text")], DIRTY_SQL)),
    "boolean_summary_labels": (
        label_booleans, boolean_sql("labels", [("quality", "number"), ("toxic", "number")])
    ),
    "category_summary": (categories, CATEGORY_SQL),
    "category_top_values": (top_categories, TOP_SQL),
    "datetime_summary_orders": (moments("orders", ["o_orderdate"]), moments_sql("orders", "o_orderdate")),
    "datetime_summary_events": (moments("events", ["ts"]), moments_sql("events", "ts")),
    "correlation_pairs": (pairs, PAIRS_SQL),
    "correlation_pairs_many": (many_pairs, MANY_PAIRS_SQL),
}
