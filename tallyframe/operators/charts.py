"""Chart-ready tables: a few rows per chart, aggregated on the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.values import clean_text, dtype_of, finite, ref, rounded, share, to_number
from ..lineage import cut
from . import ordered
from .cleaning import missing_like_counts
from .frequency import more_distinct_than, top_values, value_frequencies
from .summaries import all_correlations

MIN_BINS, MAX_BINS = 6, 24
DENSITY_BINS = 28
BOX_GROUPS = 10
BOX_MIN_ROWS = 5
MEAN_GROUPS = 12
CATEGORY_BARS = 14
CROSSTAB_LEVELS = 8
CROSSTAB_MIN_ROWS = 10
# Levels of the second category that a grid row brings together.
GRID_LEVELS = 1_000
# Levels of which the totals are broadcast; beyond, those with over so small a share of all cells.
FEW_LEVELS = 10_000
SHARE_OF_HOT = 10_000
TREND_PERIODS = 60
HEATMAP_COLUMNS = 8


def missingness(df: DataFrame) -> DataFrame:
    """Missing-like cells per column, columns without any left out."""
    counts = missing_like_counts(df).filter(F.col("missing_count") > 0)
    return counts.select("column", F.col("missing_count").alias("missing"))


def _numbers(df: DataFrame, column: str) -> DataFrame:
    value = finite(to_number(ref(column), dtype_of(df, column)))
    return df.select(value.alias("v")).filter(F.col("v").isNotNull())


def _binned(values: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Counts of all bins, empty ones included; the last bin is closed.

    A partial aggregate per task leaves at most ``bins`` rows to shuffle.
    """
    width = (high - low) / bins
    position = F.floor((F.col("v") - F.lit(low)) / F.lit(high - low) * bins)
    index = F.least(F.greatest(position, F.lit(0)), F.lit(bins - 1))
    counts = values.groupBy(index.cast("int").alias("index")).agg(F.count(F.lit(1)).alias("n"))
    scaffold = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("index"))
    edges = F.lit(low) + F.col("index") * F.lit(width)
    return scaffold.join(F.broadcast(counts), "index", "left").select(
        "index",
        edges.alias("low"),
        (F.lit(low) + (F.col("index") + 1) * F.lit(width)).alias("high"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


def _fixed(col: Column) -> Column:
    # values beyond the range of decimals are written as doubles
    shown = F.round(col, 2)
    return F.coalesce(shown.try_cast("decimal(38,2)").cast("string"), shown.cast("string"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Equal-width bins, between 6 and 24 of them by the root of the row count.

    Two scans of one column; empty when there are not two different values.
    """
    values = _numbers(df, column)
    n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n or low == high:
        return _empty(df, "bin_index int, bin string, count bigint")
    bins = min(MAX_BINS, max(MIN_BINS, int(n**0.5)))
    return _binned(values, low, high, bins).select(
        F.col("index").alias("bin_index"),
        F.concat(_fixed(F.col("low")), F.lit(" - "), _fixed(F.col("high"))).alias("bin"),
        "count",
    )


def density(df: DataFrame, column: str) -> DataFrame:
    """28 bins scaled to area one, smoothed over three neighbours.

    Empty with fewer than 20 values or 5 different ones.
    """
    values = _numbers(df, column)
    n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if n < 20 or not more_distinct_than(values, {"v": F.col("v")}, 4):
        return _empty(df, "x double, density double")
    width = (high - low) / DENSITY_BINS
    bins = _binned(values, low, high, DENSITY_BINS).withColumn(
        "d", F.col("count") / F.lit(float(n)) / F.lit(width)
    )
    near = W.orderBy("index").rowsBetween(-1, 1)  # 28 rows
    return bins.select(
        rounded((F.col("low") + F.col("high")) / 2).alias("x"),
        F.round(F.avg("d").over(near), 6).alias("density"),
    )


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def box_plot(summary: DataFrame, column: str) -> DataFrame:
    """Five numbers of one column, only when it has outliers."""
    rows = summary.filter((F.col("column") == column) & (F.col("outlier_count") > 0))
    return rows.select(F.col("column").alias("label"), "min", "q1", "median", "q3", "max")


def _grouped(df: DataFrame, category: str, value: str) -> DataFrame:
    return df.select(
        clean_text(ref(category), dtype_of(df, category)).alias("category"),
        to_number(ref(value), dtype_of(df, value)).alias("v"),
    ).filter(F.col("category").isNotNull() & F.col("v").isNotNull())


def box_by_group(
    df: DataFrame, category: str, value: str, builtin_rows: int = ordered.BUILTIN_ROWS, groups: int | None = BOX_GROUPS
) -> DataFrame:
    """Five numbers and a count per group with five or more rows: of the first
    ``groups`` in order of their names, or of all if None."""
    rows = _grouped(df, category, value)
    counts = rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("count"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    kept = counts.filter(F.col("count") >= BOX_MIN_ROWS)
    if groups is None:
        shown, sizes = rows.join(kept.select("category"), "category", "left_semi"), None
    else:
        # few groups: kept as literal rows, and only their rows are ordered
        found = kept.orderBy("category").limit(groups).collect()
        kept = df.sparkSession.createDataFrame(found, kept.schema)
        shown = rows.filter(F.col("category").isin(*[r["category"] for r in found]))
        sizes = (len(found), max((r["count"] for r in found), default=0))
    quartiles = ordered.quantiles(
        shown, "v", [0.25, 0.5, 0.75], ["category"], builtin_rows, known_sizes=sizes
    )
    return kept.join(quartiles, "category").select(
        F.col("category").alias("label"),
        rounded(F.col("min")).alias("min"),
        rounded(F.col("q0")).alias("q1"),
        rounded(F.col("q1")).alias("median"),
        rounded(F.col("q2")).alias("q3"),
        rounded(F.col("max")).alias("max"),
        "count",
    )


def group_means(df: DataFrame, category: str, value: str, limit: int = MEAN_GROUPS) -> DataFrame:
    """Groups with the highest mean first."""
    means = _grouped(df, category, value).groupBy("category").agg(F.avg("v").alias("m"))
    top = means.orderBy(F.desc("m"), "category").limit(limit)
    return top.select("category", rounded(F.col("m")).alias("mean"))


def group_effect(
    df: DataFrame, category: str, value: str, limit: int | None = MEAN_GROUPS
) -> DataFrame:
    """One row: spread of the group means against the spread of all values.

    ``limit`` keeps the spread to the groups a mean chart shows; None takes
    all groups.
    """
    rows = _grouped(df, category, value)
    groups = rows.groupBy("category").agg(F.avg("v").alias("m"))
    if limit is not None:
        groups = groups.orderBy(F.desc("m"), "category").limit(limit)
    whole = rows.agg(F.stddev_samp("v").alias("std"), F.avg(F.abs("v")).alias("size"))
    stats = groups.agg(
        F.count(F.lit(1)).alias("groups"), (F.max("m") - F.min("m")).alias("spread")
    ).select(
        "groups",
        "spread",
        F.coalesce(whole.select("std").scalar(), F.lit(0.0)).alias("std"),
        whole.select("size").scalar().alias("size"),
    )
    spread, std = F.col("spread"), F.col("std")
    effect = F.when(std > 0, spread / F.nullif(std, F.lit(0.0))).otherwise(0.0)
    relative = spread / F.greatest("size", F.lit(1e-9))
    negligible = (
        (F.col("groups") < 2) | (spread == 0) | ((effect < 0.15) & (relative < 0.04))
    )
    return stats.select(
        "groups",
        rounded(spread).alias("group_mean_spread"),
        rounded(effect).alias("effect_size_approx"),
        rounded(relative).alias("relative_spread"),
        negligible.alias("negligible"),
    )


def _level_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    rows = df.select(
        clean_text(ref(a), dtype_of(df, a)).alias("a"),
        clean_text(ref(b), dtype_of(df, b)).alias("b"),
    ).na.drop()
    return rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("count"))


def crosstab(df: DataFrame, a: str, b: str, levels: int | None = None) -> DataFrame:
    """Counts and row shares of two categories, zero cells included.

    Rows (category, series, count, percent).  Empty unless both have two levels
    or more, over at least ten rows; with ``levels``, at most so many levels.
    """
    counts = _level_counts(df, a, b)
    size = counts.agg(
        F.sum("count").alias("rows"),
        F.count_distinct("a").alias("levels_a"),
        F.count_distinct("b").alias("levels_b"),
    )
    rows, levels_a, levels_b = size.first()
    fits = (rows or 0) >= CROSSTAB_MIN_ROWS and all(
        2 <= n and (levels is None or n <= levels) for n in (levels_a, levels_b)
    )
    if not fits:
        return _empty(df, "category string, series string, count bigint, percent double")
    totals = _margins(counts, "a").withColumnRenamed("level", "a")
    # every level of a meets the levels of b in blocks, so that no array holds them all
    blocks = -(-levels_b // GRID_LEVELS)
    place = F.pmod(F.xxhash64("b"), F.lit(blocks))
    series = counts.select("b").distinct().groupBy(place.alias("_block")).agg(F.collect_list("b").alias("bs"))
    grid = totals.withColumn("_block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    grid = grid.join(series, "_block").select("a", "total", F.explode("bs").alias("b"))
    return grid.join(counts, ["a", "b"], "left").select(
        F.col("a").alias("category"),
        F.col("b").alias("series"),
        F.coalesce("count", F.lit(0)).alias("count"),
        share(F.coalesce("count", F.lit(0)), F.col("total")).alias("percent"),
    )


def _margins(counts: DataFrame, *sides: str) -> DataFrame:
    """Rows (side, level, total, cells) of the margins of a contingency table, all sides in one shuffle.

    A level's cells are added up within tasks first, so one with very many cells is no task's burden.
    """
    found = counts.groupingSets([[F.col(s)] for s in sides], *sides).agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("cells"))
    level = F.coalesce(*[F.col(s) for s in sides])
    if len(sides) == 1:
        return found.select(level.alias("level"), "total", "cells")
    side = F.coalesce(*[F.when(F.col(s).isNotNull(), F.lit(s)) for s in sides])
    return found.select(side.alias("side"), level.alias("level"), "total", "cells")


def _with_total(cells: DataFrame, lookup: DataFrame, side: str) -> DataFrame:
    """Adds a level's total to its cells; ``lookup`` has the level, its total and number of cells.

    Levels of many cells are at most SHARE_OF_HOT and broadcast; so are all where they are few.
    """
    total = f"{side}_total"
    levels, all_cells = lookup.agg(F.count(F.lit(1)), F.sum("cells")).first()
    if levels <= FEW_LEVELS:
        return cells.join(F.broadcast(lookup.select(side, total)), side)
    hot = F.col("cells") > all_cells / SHARE_OF_HOT
    common = lookup.filter(hot).select(side, F.col(total).alias("_common"))
    others = lookup.filter(~hot).select(side, total)
    marked = cells.join(F.broadcast(common), side, "left")
    ready = marked.filter(F.col("_common").isNotNull()).withColumnRenamed("_common", total)
    rest = marked.filter(F.col("_common").isNull()).drop("_common").join(others, side)
    return ready.unionByName(rest)


def association(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi-square over the row count of the cross-tab.

    Uses ``sum(o^2 / (row * column)) - 1``, which equals chi-square / N and
    needs no cell for absent combinations.
    """
    counts = cut(_level_counts(df, a, b))
    margins = cut(_margins(counts, "a", "b"))
    cells = counts
    for side in ("a", "b"):
        own = margins.filter(F.col("side") == side)
        lookup = own.select(F.col("level").alias(side), F.col("total").alias(f"{side}_total"), "cells")
        cells = _with_total(cells, lookup, side)
    product = F.col("a_total").cast("double") * F.col("b_total")
    ratio = F.pow(F.col("count").cast("double"), F.lit(2)) / product
    sizes = margins.agg(
        F.coalesce(F.sum(F.when(F.col("side") == "a", F.col("total"))), F.lit(0)).alias("rows"),
        *[F.count_if(F.col("side") == side).alias(f"levels_{side}") for side in ("a", "b")],
    )
    # two tables of one row each
    phi2 = cells.agg((F.sum(ratio) - 1).alias("phi2"))
    stats = sizes.select("*", phi2.scalar().alias("phi2"))
    both = (F.col("levels_a") > 1) & (F.col("levels_b") > 1)
    strength = F.when(both, F.greatest(F.col("phi2"), F.lit(0.0))).otherwise(0.0)
    return stats.select("rows", "levels_a", "levels_b", rounded(strength).alias("association_strength"))


def monthly_trend(
    df: DataFrame, moment: str, value: str, periods: int = TREND_PERIODS
) -> DataFrame:
    """Mean per month, labelled by the month's last day, latest periods only."""
    rows = df.select(
        F.last_day(ref(moment).cast("date")).alias("d"),
        to_number(ref(value), dtype_of(df, value)).alias("v"),
    ).filter(F.col("d").isNotNull() & F.col("v").isNotNull())
    months = rows.groupBy("d").agg(F.avg("v").alias("v"))
    latest = months.orderBy(F.desc("d")).limit(periods).orderBy("d")
    return latest.select(F.col("d").cast("string").alias("date"), rounded(F.col("v")).alias("value"))


def boolean_chart(summary: DataFrame) -> DataFrame:
    """True and False rows per boolean column of ``boolean_summary``."""
    bars = F.array(
        F.struct(F.lit("True").alias("value"), F.col("true_count").alias("count")),
        F.struct(F.lit("False").alias("value"), F.col("false_count").alias("count")),
    )
    return summary.select("column", F.inline(bars))


def category_chart(
    df: DataFrame,
    columns: Sequence[str],
    limit: int = CATEGORY_BARS,
    freq: DataFrame | None = None,
) -> DataFrame:
    """Most frequent values, with their share of the values shown."""
    freq = value_frequencies(df, columns, short=True) if freq is None else freq
    top = top_values(freq.filter(F.col("column").isin(*columns)), limit, df)
    shown = F.sum("n").over(W.partitionBy("column"))  # at most ``limit`` rows each
    return top.select(
        "column",
        "rank",
        "value",
        F.col("n").alias("count"),
        share(F.col("n"), shown).alias("percentage"),
    )


def correlation_heatmap(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """All cells of the correlation matrix, of the first ``limit`` columns if that is given."""
    names = list(dict.fromkeys(columns))[:limit]
    schema = "x int, y int, x_label string, y_label string, value double"
    if len(names) < 3:
        return _empty(df, schema)
    pairs = all_correlations(df, names).filter(F.col("correlation").isNotNull())
    mirrored = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("x").alias("x_label"), F.col("y").alias("y_label"), F.col("correlation").alias("value")),
                F.struct(F.col("y").alias("x_label"), F.col("x").alias("y_label"), F.col("correlation").alias("value")),
            )
        )
    )
    # a constant column correlates with nothing, itself included
    varying = [F.struct(F.lit(n).alias("name"), (F.var_pop(to_number(ref(n), dtype_of(df, n))) > 0).alias("varies")) for n in names]
    diagonal = (
        df.agg(F.array(*varying).alias("c"))
        .select(F.inline("c"))
        .filter("varies")
        .select(F.col("name").alias("x_label"), F.col("name").alias("y_label"), F.lit(1.0).alias("value"))
    )
    index = F.create_map(*[v for i, n in enumerate(names) for v in (F.lit(n), F.lit(i))])
    return mirrored.unionByName(diagonal).select(
        F.element_at(index, F.col("x_label")).alias("x"),
        F.element_at(index, F.col("y_label")).alias("y"),
        "x_label",
        "y_label",
        "value",
    )


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """All points with both values, as a lazy projection; never collected."""
    return df.select(
        to_number(ref(x), dtype_of(df, x)).alias("x"), to_number(ref(y), dtype_of(df, y)).alias("y")
    ).na.drop()


def missing_metadata(df: DataFrame, column: str) -> DataFrame:
    """One row: how many cells a chart of the column leaves out."""
    text = clean_text(ref(column), dtype_of(df, column))
    stats = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(text.isNull()).alias("n"))
    note = F.concat(
        F.lit("This chart excludes "), F.col("n").cast("string"), F.lit(f" missing values from {column}.")
    )
    return stats.select(
        F.lit(column).alias("column"),
        F.col("n").alias("excluded_missing_count"),
        share(F.col("n"), F.col("rows")).alias("excluded_missing_percent"),
        F.when(F.col("n") > 0, note).alias("note"),
    )
