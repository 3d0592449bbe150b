"""Feature schema, splits, metrics, training and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import ml_metrics, ml_schema, ml_split, ml_training, neighbours, tools

from .common import DIRTY_SQL, as_text, clean_sql, dirty_events, table

# Orders with a copy, a constant, a flag, a leaking name and a wide text.
WIDE = [
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
    "o_orderstatus AS status_again", "'same' AS source", "CASE WHEN o_custkey % 3 = 0 THEN 'y' ELSE 'N' END AS loyal",
    "o_custkey * 2 AS totalprice_score", "concat('c', cast(o_custkey AS {text})) AS customer", "o_custkey % 4 AS order_month",
    "o_custkey % 7 AS region_id",
]


def wide_orders(spark, folder):
    return table(spark, folder, "orders").selectExpr(*[c.format(text="string") for c in WIDE])


def schema(spark, folder):
    rows = ml_schema.feature_schema(wide_orders(spark, folder), "o_totalprice")
    return as_text(rows, "allowed_values")


def schema_sql():
    """The ladder over per-column statistics; what depends on names alone is
    written out per column."""
    kinds = {
        "o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "categorical", "o_totalprice": "numeric",
        "o_orderdate": "date", "o_orderpriority": "categorical", "status_again": "categorical", "source": "categorical",
        "loyal": "boolean", "totalprice_score": "numeric", "customer": "categorical", "order_month": "date", "region_id": "numeric",
    }
    shown = {
        "o_orderkey": "O Orderkey", "o_custkey": "O Custkey", "o_orderstatus": "O Orderstatus", "o_totalprice": "O Totalprice",
        "o_orderdate": "O Orderdate", "o_orderpriority": "O Orderpriority", "status_again": "Status Again", "source": "Source",
        "loyal": "Loyal", "totalprice_score": "Totalprice Score", "customer": "Customer", "order_month": "Order Month", "region_id": "Region Id",
    }
    parts = []
    for i, (name, kind) in enumerate(kinds.items()):
        copy = {"status_again": "duplicate of o_orderstatus"}.get(name)
        leak = {"totalprice_score": "shares outcome-like terms with target o_totalprice"}.get(name)
        parts.append(f"""SELECT {i} AS position, '{name}' AS feature_name, '{shown[name]}' AS display_name, '{kind}' AS type,
 CASE WHEN {str(name == 'o_totalprice').lower()} THEN 'target column'
  WHEN {str(name == 'region_id').lower()} OR (sum(n) > 25 AND count(v) / sum(n) > 0.92) THEN '{ml_schema.ID_REASON}'
  WHEN count(v) <= 1 OR max(n) / sum(n) > 0.985 THEN '{ml_schema.CONSTANT_REASON}'
  WHEN '{kind}' = 'date' THEN '{ml_schema.DATE_REASON}'
  WHEN '{kind}' = 'categorical' AND count(v) > least(80, greatest(20, sum(n) * 0.2)) THEN '{ml_schema.CARDINALITY_REASON}'
  {f"WHEN true THEN '{copy}'" if copy else ""} {f"WHEN true THEN '{leak}'" if leak else ""} END AS excluded_reason,
 string_agg(v, ' | ' ORDER BY v) AS listed FROM (SELECT cast({name} AS VARCHAR) AS v, count(*) AS n FROM wide GROUP BY 1)""")
    columns = ", ".join(c.format(text="VARCHAR") for c in WIDE)
    return f"""WITH wide AS (SELECT {columns} FROM orders), s AS ({" UNION ALL ".join(parts)})
SELECT position, feature_name, display_name, type, excluded_reason IS NULL AS required, excluded_reason,
 CASE WHEN excluded_reason IS NULL AND type = 'categorical' THEN listed
  WHEN excluded_reason IS NULL AND type = 'boolean' THEN 'true | false' END AS allowed_values FROM s"""


def tasks(spark, folder):
    orders, labels = wide_orders(spark, folder), table(spark, folder, "labels")
    result = ml_schema.task_type(labels, "quality")
    for target in ("o_totalprice", "o_orderstatus", "loyal", "o_custkey"):
        result = result.unionByName(ml_schema.task_type(orders, target))
    return result


TASKS_SQL = """SELECT 'quality' AS target, CASE WHEN count(DISTINCT quality) <= 2 THEN 'classification' ELSE 'regression' END AS task_type FROM labels
UNION ALL SELECT 'o_totalprice', CASE WHEN count(DISTINCT o_totalprice) <= 2 THEN 'classification' ELSE 'regression' END FROM orders
UNION ALL SELECT 'o_custkey', CASE WHEN count(DISTINCT o_custkey) <= 2 THEN 'classification' ELSE 'regression' END FROM orders
UNION ALL SELECT unnest(['o_orderstatus', 'loyal']), 'classification'"""


FEATURES = [
    {"feature_name": "flag", "type": "boolean", "required": True},
    {"feature_name": "half_value", "type": "numeric", "required": True},
    {"feature_name": "kind", "type": "categorical", "required": True},
    {"feature_name": "absent", "type": "numeric", "required": False},
]


def coerced(spark, folder):
    return ml_schema.coerce_features(dirty_events(spark, folder), FEATURES, keep=["event_id"])


def validated(spark, folder):
    rows = ml_schema.missing_features(dirty_events(spark, folder), FEATURES)
    return as_text(rows.select("event_id", "missing_features"), "missing_features", sep=",")


def split(spark, folder):
    rows = ml_split.stratified_split(table(spark, folder, "orders"), ["o_orderkey"], "o_orderstatus")
    return rows.groupBy("o_orderstatus").agg(F.count_if("is_test").alias("test_rows"), F.count_if(~F.col("is_test")).alias("train_rows"))


SPLIT_SQL = """WITH s AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1),
t AS (SELECT cast(ceil(sum(n) * 0.22) AS BIGINT) AS k, sum(n) AS total FROM s),
e AS (SELECT o_orderstatus, n, n * k / total AS exact, k FROM s, t),
f AS (SELECT *, floor(exact) AS base, row_number() OVER (ORDER BY exact - floor(exact) DESC, o_orderstatus) AS turn FROM e),
g AS (SELECT *, k - sum(base) OVER () AS rest FROM f)
SELECT o_orderstatus, cast(base + CASE WHEN turn <= rest THEN 1 ELSE 0 END AS BIGINT) AS test_rows,
 cast(n - base - CASE WHEN turn <= rest THEN 1 ELSE 0 END AS BIGINT) AS train_rows FROM g"""


def folds(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return ml_split.with_fold(orders, ["o_orderkey"], 5, stratum="o_orderstatus")


# the digest of seed and key orders the keys of a class; every fifth goes to one fold
FOLDS_SQL = """SELECT o_orderkey, o_orderstatus, cast((row_number() OVER (PARTITION BY o_orderstatus
 ORDER BY cast(concat('0x', substr(md5(concat('42|', o_orderkey)), 1, 13)) AS BIGINT)) - 1) % 5 AS INTEGER) AS fold FROM orders"""


def weights(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    rows = ml_split.with_class_weight(orders, "o_orderstatus")
    return rows.withColumn("weight", F.round("weight", 6))


GUESS = "CASE WHEN o_totalprice > 300000 THEN 'O' WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'X' END"


def guessed(spark, folder):
    return table(spark, folder, "orders").selectExpr("o_orderstatus AS y", f"{GUESS} AS p")


CLASSES_SQL = f"""d AS (SELECT o_orderstatus AS y, {GUESS} AS p FROM orders),
k AS (SELECT y AS c FROM d UNION SELECT p FROM d),
m AS (SELECT c, (SELECT count(*) FROM d WHERE y = c) AS support, (SELECT count(*) FROM d WHERE p = c) AS predicted,
 (SELECT count(*) FROM d WHERE y = c AND p = c) AS hits FROM k),
x AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS pr, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS rc,
 2 * hits / (support + predicted) AS f FROM m)"""

METRICS_SQL = f"""WITH {CLASSES_SQL} SELECT round(sum(hits) / sum(support), 4) AS accuracy, round(sum(f * support) / sum(support), 4) AS f1_weighted,
 round(avg(f), 4) AS f1_macro, round(sum(pr * support) / sum(support), 4) AS precision_weighted, round(sum(rc * support) / sum(support), 4) AS recall_weighted FROM x"""


def class_scores(spark, folder):
    return ml_metrics.class_scores(guessed(spark, folder), "y", "p")


def regression(spark, folder):
    rows = table(spark, folder, "lineitem").selectExpr("l_extendedprice AS y", "l_quantity * 2000.0D AS p")
    return ml_metrics.regression_metrics(rows, "y", "p")


REGRESSION_SQL = """WITH d AS (SELECT l_extendedprice AS y, l_quantity * 2000 AS p FROM lineitem)
SELECT round(1 - sum(power(y - p, 2)) / (var_pop(y) * count(*)), 4) AS r2, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg(power(y - p, 2))), 4) AS rmse FROM d"""


def majority(spark, folder):
    orders = table(spark, folder, "orders")
    return ml_metrics.majority_baseline(orders, orders, "o_orderstatus")


MAJORITY_SQL = """WITH m AS (SELECT o_orderstatus AS c FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
s AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = c) AS h, any_value(c) AS c FROM orders, m)
SELECT 'majority_class' AS strategy, c AS prediction, round(h / n, 4) AS accuracy, round(2 * h / (h + n) * h / n, 4) AS f1_weighted FROM s"""


def mean_baseline(spark, folder):
    orders = table(spark, folder, "orders")
    return ml_metrics.mean_baseline(orders, orders, "o_totalprice")


MEAN_SQL = """WITH m AS (SELECT avg(o_totalprice) AS c FROM orders)
SELECT 'mean_prediction' AS strategy, round(any_value(c), 4) AS prediction, round(abs(1 - sum(power(o_totalprice - c, 2)) / (var_pop(o_totalprice) * count(*))), 4) AS r2,
 round(avg(abs(o_totalprice - c)), 4) AS mae, round(sqrt(avg(power(o_totalprice - c, 2))), 4) AS rmse FROM orders, m"""


def auc(spark, folder):
    rows = table(spark, folder, "lineitem").selectExpr("CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y", "l_quantity AS s")
    return tools.rank_auc(rows, "y", "s")


AUC_SQL = """WITH r AS (SELECT l_returnflag = 'R' AS y, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rk FROM lineitem),
s AS (SELECT count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n, sum(rk) FILTER (WHERE y) AS t FROM r)
SELECT p AS positives, n AS negatives, round((t - p * (p + 1) / 2) / p / n, 4) AS roc_auc FROM s"""


def compared(spark, folder):
    result = ml_training.train(table(spark, folder, "orders"), "o_totalprice", "fast", keys=["o_orderkey"])
    return result.comparison.drop("training_time_seconds")


def scored(spark, folder):
    orders = table(spark, folder, "orders")
    result = ml_training.train(orders, "o_totalprice", "fast", keys=["o_orderkey"])
    return ml_training.batch_score(result.best, orders)


def knn(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return neighbours.nearest_neighbours(vectors, vectors, "vec_id", "embedding", "label", True)


def knn_cells(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return neighbours.nearest_neighbours(vectors, vectors, "vec_id", "embedding", "label", True, block_rows=500, chunk_rows=2000)


KNN_SQL = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
d AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(power(list_distance(a.v, b.v), 2), 9), b.vec_id) AS r FROM e a, e b),
c AS (SELECT vec_id, label, count(*) AS n FROM d WHERE r <= 5 GROUP BY 1, 2)
SELECT vec_id, cast(label AS DOUBLE) AS prediction FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) = 1"""


KIND = clean_sql("kind")

CASES = {
    "task_type": (tasks, TASKS_SQL),
    "feature_schema": (schema, schema_sql()),
    "coerce_features": (
        coerced,
        f"""WITH {DIRTY_SQL} SELECT event_id, CASE WHEN lower(trim(flag)) IN ('true', 'yes', '1', 'y', 't') THEN 1.0::DOUBLE
 WHEN lower(trim(flag)) IN ('false', 'no', '0', 'n', 'f') THEN 0.0::DOUBLE END AS flag, half_value, {KIND} AS kind, cast(NULL AS DOUBLE) AS absent FROM dirty""",
    ),
    "row_validation": (
        validated,
        f"""WITH {DIRTY_SQL} SELECT event_id, concat_ws(',', CASE WHEN coalesce(flag, '') = '' THEN 'flag' END,
 CASE WHEN half_value IS NULL THEN 'half_value' END, CASE WHEN coalesce(kind, '') = '' THEN 'kind' END) AS missing_features FROM dirty""",
    ),
    "class_balance": (
        lambda spark, folder: ml_schema.class_balance(table(spark, folder, "orders"), "o_orderstatus"),
        """WITH c AS (SELECT o_orderstatus AS label, count(*) AS count FROM orders GROUP BY 1)
SELECT label, count, round(count / sum(count) OVER (), 4) AS share, min(count) OVER () / sum(count) OVER () < 0.2 AS imbalanced FROM c""",
    ),
    "stratified_split": (split, SPLIT_SQL),
    "cv_folds": (folds, FOLDS_SQL),
    "class_weights": (
        weights,
        """WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS k FROM c)
SELECT o_orderkey, o_orderstatus, round(total / (k * n), 6) AS weight FROM orders JOIN c USING (o_orderstatus), t""",
    ),
    "class_scores": (class_scores, f'WITH {CLASSES_SQL} SELECT c AS "class", support, predicted, hits FROM m'),
    "classification_metrics": (
        lambda spark, folder: ml_metrics.classification_metrics(guessed(spark, folder), "y", "p"), METRICS_SQL,
    ),
    "regression_metrics": (regression, REGRESSION_SQL),
    "majority_baseline": (majority, MAJORITY_SQL),
    "mean_baseline": (mean_baseline, MEAN_SQL),
    "rank_auc": (auc, AUC_SQL),
    "knn_predict": (knn, KNN_SQL),
    "knn_cells": (knn_cells, KNN_SQL),
    "train_compare": (compared, None),
    "batch_score": (scored, None),
}
