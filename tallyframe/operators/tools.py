"""The four table questions: filtered, grouped, compared and correlated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.values import clean_text, dtype_of, is_null, ref, rounded, to_number
from ..plans.specs import Filter, Group, check_aggregate, check_filters
from ..lineage import cut
from . import ordered
from .filters import all_of

SMALL_SAMPLE = 30
TOP_GROUPS = 20

# Aggregate name to expression; median goes through ``ordered.quantiles``.
AGGREGATE_BUILDERS = {
    "count": lambda c: F.count(c).cast("double"),
    "mean": F.avg,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
}


def _measure(df: DataFrame, column: str, function: str) -> Column:
    """What is aggregated: any non-null value for counts, else the number."""
    dtype = dtype_of(df, column)
    if function == "count":
        return F.when(~is_null(ref(column), dtype), F.lit(1.0))
    return to_number(ref(column), dtype)


def filtered_aggregation(
    df: DataFrame,
    filters: Sequence[Filter],
    column: str,
    function: str = "mean",
    builtin_rows: int = ordered.BUILTIN_ROWS,
) -> DataFrame:
    """One row: the aggregate of matching rows, next to all and to the rest.

    The comparison columns are filled for mean and median only.
    """
    check_aggregate(df, column, function)
    check_filters(df, filters)
    compared = function in ("mean", "median")
    if filters and not compared:
        # no baseline asked for: filter first, so that the scan can skip
        return _plain_filtered(df, filters, column, function)
    rows = df.select(
        all_of(df, filters).alias("hit"), _measure(df, column, function).alias("v")
    )
    hit = F.col("hit")
    counts = [
        F.count_if(hit).alias("matched_rows"),
        F.count_if(~hit).alias("comparison_rows"),
    ]
    if function == "median":
        sides = rows.select("v", "hit", (~hit).alias("rest"), F.lit(True).alias("every"))
        medians = ordered.weighted_quantiles(
            sides, "v", ["hit", "rest", "every"], [0.5], builtin_rows
        )
        stats = rows.agg(*counts).select(
            "*",
            medians.select("hit_q0").scalar().alias("result"),
            medians.select("rest_q0").scalar().alias("comparison"),
            medians.select("every_q0").scalar().alias("overall"),
        )
    else:
        build = AGGREGATE_BUILDERS[function]
        value = F.col("v")
        stats = rows.agg(
            *counts,
            build(F.when(hit, value)).alias("result"),
            build(F.when(~hit, value)).alias("comparison"),
            build(value).alias("overall"),
        )
    return _report(stats, column, function, compared)


def _plain_filtered(df, filters, column, function) -> DataFrame:
    from .filters import apply_filters

    rows = apply_filters(df, filters).select(_measure(df, column, function).alias("v"))
    stats = rows.agg(
        F.count(F.lit(1)).alias("matched_rows"),
        AGGREGATE_BUILDERS[function](F.col("v")).alias("result"),
        F.lit(None).cast("double").alias("comparison"),
        F.lit(None).cast("double").alias("overall"),
        F.lit(0).cast("bigint").alias("comparison_rows"),
    )
    return _report(stats, column, function, False)


def _report(stats: DataFrame, column: str, function: str, compared: bool) -> DataFrame:
    some = F.col("matched_rows") > 0
    null = F.lit(None).cast("double")
    result = F.when(some, rounded(F.col("result")))
    overall = F.when(some, rounded(F.col("overall"))) if compared else null
    rest = F.when(some & (F.col("comparison_rows") > 0), F.col("comparison")) if compared else null
    return stats.select(
        F.when(some, "complete").otherwise("no_matches").alias("status"),
        F.lit(function).alias("aggregation"),
        F.lit(column).alias("column_name"),
        F.col("matched_rows"),
        result.alias("result"),
        overall.alias("overall_baseline"),
        rounded(result - overall).alias("difference_from_overall"),
        F.when(rest.isNotNull(), F.col("comparison_rows")).alias("comparison_rows"),
        rounded(rest).alias("comparison_result"),
        rounded(result - rest).alias("comparison_difference"),
    )


def groupby_aggregation(
    df: DataFrame,
    group_by: str,
    value_column: str,
    function: str,
    limit: int = TOP_GROUPS,
    builtin_rows: int = ordered.BUILTIN_ROWS,
) -> DataFrame:
    """Groups with the largest aggregate first; missing-like groups left out."""
    check_aggregate(df, value_column, function)
    rows = df.select(
        clean_text(ref(group_by), dtype_of(df, group_by)).alias("group"),
        _measure(df, value_column, function).alias("v"),
    ).filter(F.col("group").isNotNull())
    if function == "median":
        grouped = ordered.quantiles(
            rows, "v", [0.5], ["group"], builtin_rows=builtin_rows
        ).withColumnRenamed("q0", "value")
    else:
        grouped = rows.groupBy("group").agg(
            AGGREGATE_BUILDERS[function](F.col("v")).alias("value")
        )
    top = grouped.orderBy(F.desc_nulls_last("value"), F.asc("group")).limit(limit)
    return top.filter(F.col("value").isNotNull()).select(
        "group", rounded(F.col("value")).alias("value")
    )


def compare_groups(
    df: DataFrame,
    value_column: str,
    function: str,
    groups: Sequence[Group],
    builtin_rows: int = ordered.BUILTIN_ROWS,
) -> DataFrame:
    """One row per group; groups may overlap and may be empty.

    All groups are aggregated in one pass over the table.
    """
    if len(groups) < 2:
        raise ValueError("compare_groups requires at least two groups")
    check_aggregate(df, value_column, function)
    for group in groups:
        check_filters(df, group.filters)
    members = [f"m{i}" for i in range(len(groups))]
    rows = df.select(
        _measure(df, value_column, function).alias("v"),
        *[all_of(df, g.filters).alias(m) for m, g in zip(members, groups)],
    )
    aggregates = []
    for m in members:
        aggregates.append(F.count_if(F.col(m)).alias(f"{m}_rows"))
        value = F.when(F.col(m), F.col("v"))
        built = F.lit(None) if function == "median" else AGGREGATE_BUILDERS[function](value)
        aggregates.append(built.cast("double").alias(f"{m}_result"))
    stats = rows.agg(*aggregates)
    if function == "median":
        medians = ordered.weighted_quantiles(rows, "v", members, [0.5], builtin_rows)
        stats = stats.select(
            *[f"{m}_rows" for m in members],
            *[medians.select(f"{m}_q0").scalar().alias(f"{m}_result") for m in members],
        )
    first, second = (rounded(F.col(f"{m}_result")) for m in members[:2])
    structs = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(g.label or f"Group {i + 1}").alias("label"),
            F.col(f"{m}_rows").alias("matched_rows"),
            rounded(F.col(f"{m}_result")).alias("result"),
            (F.col(f"{m}_rows") < SMALL_SAMPLE).alias("sample_size_warning"),
            rounded(first - second).alias("difference"),
        )
        for i, (m, g) in enumerate(zip(members, groups))
    ]
    return stats.select(F.inline(F.array(*structs)))


def guarded_pearson(x: Column, y: Column) -> Column:
    """Correlation of pairs with both values, null on a constant column."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    scale = F.sqrt(F.var_pop(a) * F.var_pop(b))
    return F.try_divide(F.covar_pop(a, b), scale)


def correlation(
    df: DataFrame,
    x: str,
    y: str,
    method: str = "pearson",
    builtin_rows: int = ordered.BUILTIN_ROWS,
    slice_rows: int = ordered.SLICE_ROWS,
) -> DataFrame:
    """One row: correlation over rows where both columns hold a number.

    The rank methods sort in one task only up to ``builtin_rows`` rows.
    """
    for name in (x, y):
        dtype_of(df, name)
    pairs = df.select(
        to_number(ref(x), dtype_of(df, x)).alias("x"),
        to_number(ref(y), dtype_of(df, y)).alias("y"),
    )
    pairs = pairs.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    if method == "pearson":
        stats = pairs.agg(
            F.count(F.lit(1)).alias("n"), guarded_pearson(F.col("x"), F.col("y")).alias("r")
        )
    elif method == "spearman":
        stats = _spearman(pairs, pairs.count() <= builtin_rows, slice_rows)
    elif method == "kendall":
        stats = _kendall(pairs, pairs.count() <= builtin_rows, slice_rows)
    else:
        raise ValueError(f"Unsupported correlation method {method}")
    return stats.select(
        F.lit(x).alias("x_column"),
        F.lit(y).alias("y_column"),
        F.lit(method).alias("method"),
        F.col("n").alias("matched_rows"),
        rounded(F.col("r")).alias("correlation"),
    )


def _spearman(pairs: DataFrame, small: bool, slice_rows: int) -> DataFrame:
    """Pearson of mid-ranks, over distinct pairs weighted by their count."""
    joint = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    joint = joint if small else cut(joint)
    ranked = ordered.with_mid_rank(joint, "x", "n", small, slice_rows)
    ranked = ordered.with_mid_rank(ranked if small else cut(ranked), "y", "n", small, slice_rows)
    # (n + 1) / 2 is the mean of the ranks of any n rows
    centre = (pairs.agg(F.count(F.lit(1)).alias("n")).select("n").scalar() + 1) / 2
    n, dx, dy = F.col("n"), F.col("x_rank") - centre, F.col("y_rank") - centre
    sums = ranked.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n"),
        F.sum(n * dx * dy).alias("xy"),
        F.sum(n * dx * dx).alias("xx"),
        F.sum(n * dy * dy).alias("yy"),
    )
    scale = F.sqrt(F.col("xx") * F.col("yy"))
    return sums.select("n", F.try_divide(F.col("xy"), scale).alias("r"))


def _kendall(pairs: DataFrame, small: bool, slice_rows: int) -> DataFrame:
    """Tau-b by counting, bit by bit of the rank of y, never pairing rows.

    Two rows with different y first differ at one bit of their y ranks and
    agree on all higher bits.  Grouping by (bit position, higher bits) and
    running over x counts, for each such group, the rows with a smaller x on
    the other side of the bit: the concordant and the discordant pairs.
    """
    joint = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    joint = joint if small else cut(joint)
    xs = joint.groupBy("x").agg(F.sum("n").alias("c"))
    ys = joint.groupBy("y").agg(F.sum("n").alias("c")).withColumn("one", F.lit(1))
    if small:
        rows = joint.withColumn("ry", F.dense_rank().over(W.orderBy("y")) - 1)
    else:
        ranks = ordered.running_totals(ys, "y", ["one"], slice_rows=slice_rows)
        ranks = cut(ranks.select("y", "c", F.col("one_before").alias("ry")))
        rows = ordered.join_by_value(joint, ranks, "y", "c", "ry")

    def one(stats: DataFrame) -> Column:
        return stats.select(stats.columns[0]).scalar()

    top_rank = one(ys.agg(F.count(F.lit(1)) - 1))
    bits = F.ceil(F.log2(F.greatest(top_rank, F.lit(1)) + 1.0)).cast("int")
    rows = rows.withColumn("bit", F.explode(F.sequence(F.lit(0), bits)))
    power = F.pow(F.lit(2.0), F.col("bit"))
    quotient = F.floor(F.col("ry") / power).cast("bigint")
    rows = rows.select(
        "x",
        "bit",
        F.floor(quotient / 2).cast("bigint").alias("head"),
        F.when(quotient % 2 == 1, F.col("n")).otherwise(0).alias("ones"),
        F.when(quotient % 2 == 0, F.col("n")).otherwise(0).alias("zeros"),
    )
    sides = rows.groupBy("bit", "head", "x").agg(
        F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")
    )
    sides = ordered.running_totals(
        sides, "x", ["ones", "zeros"], ["bit", "head"], slice_rows, small
    )
    scored = sides.agg(
        F.sum(F.col("zeros_before").cast("double") * F.col("ones")).alias("concordant"),
        F.sum(F.col("ones_before").cast("double") * F.col("zeros")).alias("discordant"),
    )
    c = F.col("c").cast("double")
    scored = scored.select(
        "concordant",
        "discordant",
        F.coalesce(one(joint.agg(F.sum("n"))), F.lit(0)).alias("n"),
        one(xs.agg(F.sum(c * (c - 1) / 2))).alias("tied_x"),
        one(ys.agg(F.sum(c * (c - 1) / 2))).alias("tied_y"),
    )
    every = F.col("n").cast("double") * (F.col("n") - 1) / 2
    scale = F.sqrt((every - F.col("tied_x")) * (every - F.col("tied_y")))
    return scored.select(
        "n", F.try_divide(F.col("concordant") - F.col("discordant"), scale).alias("r")
    )


def rank_auc(
    df: DataFrame,
    label: str,
    score: str,
    builtin_rows: int = ordered.BUILTIN_ROWS,
    slice_rows: int = ordered.SLICE_ROWS,
) -> DataFrame:
    """Area under the ROC curve from mid-ranks; ``label`` is 0 or 1."""
    rows = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    small = rows.count() <= builtin_rows
    freq = (
        rows.groupBy(F.col(score).cast("double").alias("s"))
        .agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col(label) == 1).alias("p"))
    )
    ranked = ordered.running_totals(freq, "s", ["c"], slice_rows=slice_rows, small=small)
    middle = F.col("c_before") + (F.col("c") + 1) / 2
    sums = ranked.agg(
        F.sum("c").alias("n"),
        F.sum("p").alias("pos"),
        F.sum(middle * F.col("p")).alias("rank_sum"),
    )
    pos, neg = F.col("pos").cast("double"), (F.col("n") - F.col("pos")).cast("double")
    auc = F.try_divide(F.col("rank_sum") - pos * (pos + 1) / 2, pos * neg)
    return sums.select(
        F.col("pos").alias("positives"),
        (F.col("n") - F.col("pos")).alias("negatives"),
        rounded(auc).alias("roc_auc"),
    )
