"""Stable train/test split, folds and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.values import ref
from ..lineage import cut
from . import ordered

TEST_SHARE = 0.22
SEED = 42
# Hashes below 2^52 keep their exact value as doubles.
HASH_RANGE = 2**52


def row_hash(keys: Sequence[str], seed: int) -> Column:
    """Hash of the key columns; depends on the row only, not on partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), *[ref(k) for k in keys]), F.lit(HASH_RANGE))


def stratified_split(
    df: DataFrame,
    keys: Sequence[str],
    stratum: str | None = None,
    test_share: float = TEST_SHARE,
    seed: int = SEED,
    builtin_rows: int = ordered.BUILTIN_ROWS,
) -> DataFrame:
    """Adds ``is_test``: the rows with the smallest hashes of each stratum.

    The test rows number ``ceil(share * n)``, shared out over the strata by
    largest remainder; rows with equal keys stay on the same side.
    """
    rows = df.withColumn("_s", ref(stratum) if stratum else F.lit(1)).withColumn(
        "_h", row_hash(keys, seed).cast("double")
    )
    groups, largest = ordered.group_sizes(rows, "_h", ["_s"])
    if groups > ordered.BROADCAST_ROWS:
        raise ValueError(f"Too many strata to split by: {groups}")
    sizes = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    wanted = _test_counts(sizes, test_share).filter("_k > 0")
    if largest <= ordered.BUILTIN_ROWS and largest <= builtin_rows:
        # the k-th smallest hash, from groups checked to be small
        placed = rows.withColumn(
            "_r", F.row_number().over(W.partitionBy("_s").orderBy("_h"))
        ).join(F.broadcast(wanted), "_s")
        limits = placed.filter(F.col("_r") == F.col("_k")).select("_s", F.col("_h").alias("_limit"))
    else:
        ranks = cut(wanted.select("_s", (F.col("_k") - 1).alias("rank")))
        narrow, found = rows.select("_s", "_h"), None
        if groups <= ordered.SKETCHED_GROUPS:
            found = ordered.near_quantiles(narrow, "_h", [test_share], ["_s"], ranks=ranks)[1]
        if found is None:
            found = cut(ordered.order_statistics(narrow, "_h", ranks, ["_s"], few_ranks=True))
        limits = found.select("_s", F.col("_h").alias("_limit"))
    return (
        rows.join(F.broadcast(limits), "_s", "left")
        .withColumn("is_test", F.coalesce(F.col("_h") <= F.col("_limit"), F.lit(False)))
        .select(*[ref(c) for c in df.columns], "is_test")
    )


def _test_counts(sizes: DataFrame, test_share: float) -> DataFrame:
    """Test rows per stratum (a table with one row per stratum)."""
    total = sizes.agg(F.sum("_n").alias("t")).select("t").scalar()
    target = F.ceil(total * F.lit(test_share))
    exact = F.col("_n") * target / total
    placed = sizes.select(
        "_s", F.floor(exact).alias("_k"), (exact - F.floor(exact)).alias("_rest"), target.alias("_t")
    )
    left = F.col("_t") - F.sum("_k").over(W.partitionBy())
    turn = F.row_number().over(W.orderBy(F.desc("_rest"), "_s"))
    return placed.withColumn("_left", left).withColumn("_turn", turn).select(
        "_s", (F.col("_k") + F.when(F.col("_turn") <= F.col("_left"), 1).otherwise(0)).alias("_k")
    )


def with_fold(
    df: DataFrame, keys: Sequence[str], folds: int, seed: int = SEED, stratum: str | None = None,
    builtin_rows: int = ordered.BUILTIN_ROWS, slice_rows: int = ordered.SLICE_ROWS,
) -> DataFrame:
    """Adds ``fold``: of the different keys of a stratum, each fold gets as many, or one more.

    Keys are dealt out in turn, in the order of their md5 digests (52 bits of
    them), which is known without a sort in one task: slices of digests are
    counted, and a key's number is that of the slices before plus that within
    its own.  Rows with equal keys share a fold, so none is trained on and
    tested; a null stratum is one of its own.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(ref(k).cast("string"), F.lit("")) for k in keys])
    digest = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    rows = df.withColumn("_s", F.to_json(F.struct(ref(stratum).alias("s"))) if stratum else F.lit("")).withColumn("_h", digest)
    each = rows.select("_s", "_h").distinct().withColumn("_one", F.lit(1))
    largest = ordered.group_sizes(each, "_h", ["_s"])[1]
    numbered = ordered.running_totals(each, "_h", ["_one"], ["_s"], slice_rows=slice_rows, small=largest <= builtin_rows)
    numbered = numbered.select("_s", "_h", F.pmod("_one_before", F.lit(folds)).cast("int").alias("fold"))
    return rows.drop("fold").join(numbered, ["_s", "_h"]).select(*[ref(c) for c in df.columns if c != "fold"], "fold")


def with_class_weight(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight = n / (classes * class size)``."""
    sizes = df.groupBy(ref(label).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
    stats = sizes.agg(F.sum("_n").alias("t"), F.count(F.lit(1)).alias("k"))
    total, classes = stats.select("t").scalar(), stats.select("k").scalar()
    weights = sizes.select("_class", (total / (classes * F.col("_n"))).alias("weight"))
    return df.join(weights, ref(label) == F.col("_class"), "left").drop("_class")
