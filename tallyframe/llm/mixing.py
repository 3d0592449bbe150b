"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .shared import without

# A rate beyond this is a sum of draws at equal smaller rates, so that exp(-rate) stays exact.
LARGEST_RATE = 16.0
# Beyond this count the distribution function is 1 in double precision at that rate.
LARGEST_COUNT = 80
# Sources of which the rates may be broadcast (about 700 bytes each); more are joined by shuffle.
FEW_SOURCES = 10_000


def uniform(*parts) -> F.Column:
    """A number in [0, 1) of 52 bits, from the MD5 digest of the parts."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(p) if isinstance(p, str) else p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: Mapping[str, float], other: float = 1.0, source: str = "source", target: float | None = None) -> DataFrame:
    """Rows (source, rate): the mean number of copies of each of a source's documents.

    A source's share of the ``target`` (as many documents as there are, if
    None) is its weight over the weights of all sources present.  Sources
    without a weight, and null, have ``other``; weights are not negative.
    """
    named = F.lit(other)
    for name, weight in weights.items():
        named = F.when(F.col("source") == name, F.lit(float(weight))).otherwise(named)
    counts = cut(docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.count("*").alias("n")).withColumn("weight", named.cast("double")))
    rows, weight = counts.agg(F.sum("n"), F.sum("weight")).first()
    total = float(rows or 0) if target is None else float(target)
    return counts.select("source", (F.col("weight") * total / ((weight or 1.0) * F.col("n"))).alias("rate"))


def mixed(
    docs: DataFrame,
    weights: Mapping[str, float],
    other: float = 1.0,
    seed: int = 0,
    key: str = "doc_id",
    source: str = "source",
    target: float | None = None,
) -> DataFrame:
    """``docs`` with each row as often as its Poisson draw says, in one global random order.

    The draw inverts the distribution function at a number hashed from seed
    and key: runs agree whatever the layout.  Rows with one key are drawn
    alike; a null key is a key of its own.  Adds copy (1, 2, ...) and order_key,
    by which rows are dealt over all partitions and sorted within; columns so
    named are replaced.  No rows give no rows; a weight of 0 drops its source.
    """
    docs = without(docs, ("copy", "order_key"))
    rates = source_rates(docs, weights, other, source, target)
    parts = F.greatest(F.lit(1.0), F.ceil(F.col("rate") / LARGEST_RATE).cast("double"))
    rates = rates.withColumn("_parts", parts.cast("int")).withColumn("_rate", F.col("rate") / parts)
    # P(count <= k) for k = 0, 1, ...
    steps = f"""aggregate(sequence(1, {LARGEST_COUNT}), named_struct('p', exp(-_rate), 'c', exp(-_rate), 'all', array(exp(-_rate))),
      (s, k) -> named_struct('p', s.p * _rate / k, 'c', s.c + s.p * _rate / k, 'all', concat(s.all, array(s.c + s.p * _rate / k))), s -> s.all)"""
    rates = cut(rates.select(F.col("source").alias("_source"), "_parts", F.expr(steps).alias("_steps")))
    if rates.count() <= FEW_SOURCES:
        rates = F.broadcast(rates)
    # the document travels as one column, so that its names meet none of these
    rows = docs.select(
        F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("document"),
        F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("key"), F.col(source).cast("string").alias("source"),
    )
    rows = rows.join(rates, F.col("source").eqNullSafe(F.col("_source")))
    draws = F.transform(F.sequence(F.lit(1), F.col("_parts")), lambda i: uniform(F.lit(str(seed)), "key", i))
    count = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter("_steps", lambda c: c <= u)))
    rows = rows.select("document", "key", count.alias("n")).filter("n > 0")
    rows = rows.select("document", "key", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    order = F.md5(F.concat_ws("|", F.lit(f"order {seed}"), "key", "copy"))
    rows = rows.select("document.*", "copy", order.alias("order_key"))
    return rows.repartition("order_key").sortWithinPartitions("order_key")


def oracle(weights: Mapping[str, float], other: float = 1.0, seed: int = 0, documents: str = "documents") -> str:
    """SQL of :func:`mixed` over ``documents``, for rates up to LARGEST_RATE."""
    cases = " ".join(f"WHEN source = '{name}' THEN {float(w)!r}" for name, w in weights.items())
    return f"""WITH s AS (SELECT source, count(*) AS n, cast(CASE {cases} ELSE {other!r} END AS DOUBLE) AS w FROM {documents} GROUP BY 1),
r AS (SELECT source, w * sum(n) OVER () / (sum(w) OVER () * n) AS rate FROM s),
k AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r),
steps AS (WITH RECURSIVE x AS (SELECT * FROM k UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM x WHERE k < {LARGEST_COUNT}) SELECT source, list(c ORDER BY k) AS cs FROM x GROUP BY 1),
d AS (SELECT d.*, cs, ('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, 'null') || '|1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
 FROM {documents} d JOIN steps ON d.source IS NOT DISTINCT FROM steps.source),
e AS (SELECT * EXCLUDE (cs, u), unnest(range(1, len(list_filter(cs, lambda c: c <= u)) + 1))::INTEGER AS copy FROM d)
SELECT *, md5('order {seed}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy) AS order_key FROM e"""
