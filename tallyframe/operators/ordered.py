"""Exact order statistics and running totals without a single-task sort.

``F.percentile`` keeps every distinct value of a group in one task, and a
running total over an unpartitioned window sorts a column in one task.  Both
are fine for small groups only.  Past a checked number of rows, quantiles of few groups
are looked up between the bounds that a sketch gives; other work here goes through *slices*: value ranges of about equal row count, between sampled
splitters that are refined until each slice fits.  Slices are counted with a partial aggregate, ordered by a
window over the slice table, and only within one slice are values sorted.
A value that repeats is collapsed to one row with a count before any sort, so
a hot value costs as much as a rare one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType

from ..lineage import cut

# Most rows of one group handed to the built-in percentile.
BUILTIN_ROWS = 1_000_000
# Rows aimed at per slice.
SLICE_ROWS = 1_000_000
# Most rows of a side that is broadcast after its rows were counted.
BROADCAST_ROWS = 1_000_000
# Splitters of one refinement, how exact their ranks are (1 / this share of the
# rows), and numbers that a refinement can give.
SPLITTERS = 1000
RANK_ACCURACY = 10_000
RADIX = 2048
# Groups of which a task may hold a sketch each.
SKETCHED_GROUPS = 64


def _place(value: Column, splitters: Column) -> Column:
    """Where a value falls between ascending splitters: even numbers between them, odd ones on them.

    A binary search in ten steps; a splitter's own value, however frequent, is
    a place of its own, so the places beside it stay small.
    """
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(SPLITTERS.bit_length()))])
    passed = F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(splitters, at + step - 1) <= value, at + step).otherwise(at)
    )
    number = F.transform(F.array(passed), lambda n: n * 2 - F.coalesce((F.get(splitters, n - 1) == value).cast("int"), F.lit(0)))
    return number[0].cast("bigint")


def with_slices(df: DataFrame, value: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Adds ``_slice``; ordering by it orders by value range.

    ``value`` must not be null.  A slice holds at most twice ``slice_rows`` rows
    of ``df``, or a single value.  Splitters are approximate quantiles of the
    rows themselves; a slice that is still too large is split again by those of
    its own rows, whatever the values look like and however many there are.
    """
    rows = df.withColumn("_slice", F.lit(0).cast("bigint"))
    points = F.array(*[F.lit(i / SPLITTERS) for i in range(1, SPLITTERS)])
    while True:
        sizes = rows.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high"))
        large = cut(sizes.filter((F.col("_n") > 2 * slice_rows) & (F.col("_low") < F.col("_high"))).select("_slice", "_n"))
        count = large.count()
        if not count:
            return rows
        few = count <= RADIX
        of_large = rows.join(F.broadcast(large) if few else large, "_slice").groupBy("_slice", "_n")
        found = of_large.agg(F.percentile_approx(value, points, RANK_ACCURACY).alias("p"))
        parts = F.least(F.ceil(F.col("_n") / slice_rows), F.lit(SPLITTERS)).cast("int")
        picked = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.get("p", F.floor(i * SPLITTERS / parts).cast("int") - 1))
        found = cut(found.select("_slice", F.array_distinct(picked).alias("_splitters")))
        rows = rows.join(F.broadcast(found) if few else found, "_slice", "left")
        number = F.when(F.col("_splitters").isNotNull(), _place(F.col(value), F.col("_splitters"))).otherwise(0)
        rows = rows.withColumn("_slice", F.col("_slice") * RADIX + number).drop("_splitters")


def running_totals(
    df: DataFrame,
    value: str,
    weights: Sequence[str],
    keys: Sequence[str] = (),
    slice_rows: int = SLICE_ROWS,
    small: bool = False,
) -> DataFrame:
    """Adds ``<weight>_before``: the weight of rows with a smaller value.

    ``df`` has one row per (keys, value); ``small`` says that it was checked
    to have few enough rows for one sort per key.
    """
    keys = list(keys)
    if small:
        before = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
        return df.select(
            "*",
            *[F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"{w}_before") for w in weights],
        )
    rows = with_slices(df, value, slice_rows=slice_rows)
    totals = rows.groupBy(*keys, "_slice").agg(
        *[F.sum(w).alias(f"_{w}_slice") for w in weights]
    )
    over_slices = W.partitionBy(*keys).orderBy("_slice").rowsBetween(
        W.unboundedPreceding, -1
    )
    offsets = totals.select(
        *keys,
        "_slice",
        *[
            F.coalesce(F.sum(f"_{w}_slice").over(over_slices), F.lit(0)).alias(f"_{w}_offset")
            for w in weights
        ],
    )
    within = W.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(
        W.unboundedPreceding, -1
    )
    joined = rows.join(offsets, [*keys, "_slice"])
    for w in weights:
        inside = F.coalesce(F.sum(w).over(within), F.lit(0))
        joined = joined.withColumn(f"{w}_before", F.col(f"_{w}_offset") + inside)
    return joined.drop("_slice", *[f"_{w}_offset" for w in weights])


def order_statistics(
    df: DataFrame,
    value: str,
    ranks: DataFrame,
    keys: Sequence[str] = (),
    slice_rows: int = SLICE_ROWS,
    few_ranks: bool = False,
) -> DataFrame:
    """Values at given 0-based ranks: rows (keys, rank, value).

    ``ranks`` holds (keys, rank); ``few_ranks`` says that their number was
    checked against ``BROADCAST_ROWS``.  A few narrow scans of the column: splitters,
    slice counts, and the few slices that hold a wanted rank.
    """
    keys = list(keys)
    rows = with_slices(
        df.select(*keys, value).filter(F.col(value).isNotNull()), value, slice_rows=slice_rows
    )
    counts = rows.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    over_slices = W.partitionBy(*keys).orderBy("_slice")
    ends = counts.withColumn("_end", F.sum("_n").over(over_slices)).withColumn(
        "_start", F.col("_end") - F.col("_n")
    )
    inside = (F.col("rank") >= F.col("_start")) & (F.col("rank") < F.col("_end"))
    wanted = ranks.select(*keys, F.col("rank").cast("bigint").alias("rank"))
    if keys:
        targets = ends.join(wanted, keys).filter(inside)
    else:
        # one row of ranks for the whole table, exploded next to each slice
        listed = wanted.agg(F.collect_set("rank").alias("r")).select("r").scalar()
        targets = ends.withColumn("rank", F.explode(listed)).filter(inside)
    targets = targets.select(*keys, "_slice", "_start", "rank")
    slice_keys = [*keys, "_slice"]
    wanted_slices = targets.select(*slice_keys).distinct()
    if few_ranks:
        rows = rows.join(F.broadcast(wanted_slices), slice_keys, "left_semi")
    values = rows.groupBy(*slice_keys, value).agg(F.count(F.lit(1)).alias("_n"))
    if not few_ranks:
        # repeated values are collapsed by now, so no slice is hot in this join
        values = values.join(wanted_slices, slice_keys, "left_semi")
    within = W.partitionBy(*slice_keys).orderBy(value)
    values = values.withColumn("_to", F.sum("_n").over(within))
    hit = (F.col("rank") >= F.col("_start") + F.col("_to") - F.col("_n")) & (
        F.col("rank") < F.col("_start") + F.col("_to")
    )
    return values.join(targets, slice_keys).filter(hit).select(*keys, "rank", value)


def group_sizes(df: DataFrame, value: str, keys: Sequence[str] = ()) -> tuple[int, int]:
    """Number of groups and rows with a value in the largest (two numbers)."""
    counts = df.groupBy(*keys).agg(F.count(value).alias("n"))
    groups, largest = counts.agg(F.count(F.lit(1)), F.max("n")).first()
    return groups, largest or 0


def near_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], keys: Sequence[str],
    slice_rows: int = SLICE_ROWS, ranks: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Sizes (keys, _n) of few groups, and the values (keys, rank, value) that their quantiles lie between.

    ``ranks`` (keys, rank) may say which ranks near the quantiles are wanted instead.

    A sketch gives each quantile a bracket that its error cannot leave.  The
    second scan keeps the values inside brackets, collapsed in their task, and
    counts the rows between them.  None instead of values if a bracket does not hold its rank.
    """
    reach = 2 / RANK_ACCURACY
    points = [max(p - reach, 0.0) for p in probabilities] + [min(p + reach, 1.0) for p in probabilities]
    sketch = df.groupBy(*keys).agg(
        F.count(value).alias("_n"), F.percentile_approx(value, F.array(*[F.lit(p) for p in points]), F.lit(RANK_ACCURACY)).alias("_p")
    )
    m = len(probabilities)
    low = [F.lit(float("-inf")) if points[i] <= 0 else F.get("_p", F.lit(i)) for i in range(m)]
    high = [F.lit(float("inf")) if points[m + i] >= 1 else F.get("_p", F.lit(m + i)) for i in range(m)]
    sketch = cut(sketch.select(*keys, "_n", F.array(*low).alias("_low"), F.array(*high).alias("_high")))
    sizes = sketch.select(*keys, "_n")
    v = F.col(value)
    rows = df.select(*keys, value).filter(v.isNotNull())
    bounds = F.broadcast(sketch.filter("_n > 0").select(*keys, "_low", "_high"))
    rows = rows.join(bounds, keys) if keys else rows.crossJoin(bounds)
    inside, passed = F.lit(False), F.lit(0)
    for i in range(m):
        beyond = v >= F.get("_low", F.lit(i))
        inside = inside | (beyond & (v <= F.get("_high", F.lit(i))))
        passed = passed + beyond.cast("int")
    # rows outside all brackets differ by the bracket that they come before; their least value gives the place
    places = [F.when(~inside, passed).alias("_outside"), F.when(inside, v).alias("_inside")]
    freq = rows.groupBy(*keys, *places).agg(F.min(value).alias(value), F.count(F.lit(1)).alias("_c"))
    freq = cut(freq)
    placed = running_totals(freq, value, ["_c"], keys, slice_rows=slice_rows, small=freq.count() <= slice_rows)
    wanted = F.broadcast(_wanted_ranks(sizes, probabilities) if ranks is None else ranks)
    hit = (F.col("rank") >= F.col("_c_before")) & (F.col("rank") < F.col("_c_before") + F.col("_c"))
    found = (placed.join(wanted, keys) if keys else placed.crossJoin(wanted)).filter(hit)
    found = cut(found.select(*keys, "rank", value, "_outside"))
    if found.filter("_outside IS NOT NULL").limit(1).count():
        return sizes, None
    return sizes, found.drop("_outside")


def _wanted_ranks(sizes: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """The ranks on both sides of each quantile; ``sizes`` has the rows of each group as ``_n``."""
    at = [F.lit(float(p)) * (F.col("_n") - 1) for p in probabilities]
    ranks = F.array_distinct(F.array(*[f(p).cast("bigint") for p in at for f in (F.floor, F.ceil)]))
    return sizes.filter("_n > 0").withColumn("rank", F.explode(ranks)).drop("_n")


def quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    keys: Sequence[str] = (),
    builtin_rows: int = BUILTIN_ROWS,
    slice_rows: int = SLICE_ROWS,
    known_sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation: rows (keys, q0, q1, ...).

    Uses the built-in percentile when the largest group is proven small, and
    brackets of a sketch otherwise (slices for many groups, or if a bracket
    should fail).  ``known_sizes`` are the number of groups and the rows
    of the largest, where the caller has counted them already.
    """
    keys = list(keys)
    names = [f"q{i}" for i in range(len(probabilities))]
    groups, largest = known_sizes or group_sizes(df, value, keys)
    if largest <= builtin_rows:
        points = F.array(*[F.lit(float(p)) for p in probabilities])
        both = df.groupBy(*keys).agg(F.percentile(value, points).alias("_q"))
        return both.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    found = None
    if groups <= SKETCHED_GROUPS and isinstance(df.schema[value].dataType, DoubleType):
        sizes, found = near_quantiles(df, value, probabilities, keys, slice_rows)
    else:
        sizes = df.groupBy(*keys).agg(F.count(value).alias("_n"))
    at = [F.lit(float(p)) * (F.col("_n") - 1) for p in probabilities]
    if found is None:
        few = groups * 2 * len(names) <= BROADCAST_ROWS
        found = order_statistics(df, value, _wanted_ranks(sizes, probabilities), keys, slice_rows, few)
    if keys:
        found = found.join(sizes, keys)
    else:
        found = found.withColumn("_n", sizes.select("_n").scalar())
    picks = []
    for name, p in zip(names, at):
        low = F.max(F.when(F.col("rank") == F.floor(p), F.col(value)))
        high = F.max(F.when(F.col("rank") == F.ceil(p), F.col(value)))
        fraction = F.max(p - F.floor(p))
        picks.append((low + (high - low) * fraction).alias(name))
    result = found.groupBy(*keys).agg(*picks)
    return sizes.select(*keys).join(result, keys, "left") if keys else result


def weighted_quantiles(
    rows: DataFrame,
    value: str,
    members: Sequence[str],
    probabilities: Sequence[float],
    builtin_rows: int = BUILTIN_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Exact quantiles of several, possibly overlapping, subsets of rows.

    ``members`` are boolean columns, one per subset.  The values are collapsed
    and ordered once for all subsets.  One row; column ``<member>_q<i>``.
    """
    valid = rows.filter(F.col(value).isNotNull())
    sizes = valid.agg(
        F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col(m)).alias(m) for m in members]
    ).first()
    if sizes["_all"] <= builtin_rows:
        points = F.array(*[F.lit(float(p)) for p in probabilities])
        # one aggregate, folded in each task; rows outside a subset count as null
        each = valid.agg(*[F.percentile(F.when(F.col(m), F.col(value)), points).alias(m) for m in members])
        return each.select(*[F.col(m)[i].alias(f"{m}_q{i}") for m in members for i in range(len(probabilities))])
    freq = valid.groupBy(value).agg(*[F.count_if(F.col(m)).alias(m) for m in members])
    placed = running_totals(freq, value, members, slice_rows=slice_rows)

    def at(member: str, rank: int) -> Column:
        before = F.col(f"{member}_before")
        inside = (before <= rank) & (before + F.col(member) > rank)
        return F.max(F.when(inside, F.col(value)))

    picks = []
    for m in members:
        for i, p in enumerate(probabilities):
            position = p * max(sizes[m] - 1, 0)
            low = math.floor(position)
            pick = at(m, low)
            if position > low:
                pick = pick + (at(m, low + 1) - pick) * (position - low)
            picks.append(pick.alias(f"{m}_q{i}"))
    return placed.agg(*picks)


def join_by_value(
    rows: DataFrame, lookup: DataFrame, key: str, count: str, result: str
) -> DataFrame:
    """Adds ``result`` from a one-row-per-value lookup, safe for hot values.

    Values with over one ten-thousandth of all counts number at most ten
    thousand: they are broadcast, and their rows then spread over all
    partitions of the shuffle join that serves the other values.
    """
    total = lookup.agg(F.sum(count).alias("t")).select("t").scalar()
    hot = F.col(count) > F.greatest(total / 10_000, F.lit(100_000))
    common = lookup.filter(hot).select(key, F.col(result).alias("_common"))
    others = lookup.filter(~hot).select(
        F.lit(False).alias("_hot"), F.col(key).alias("_key"), F.col(result).alias("_other")
    )
    spread = F.xxhash64(*[c for c in rows.columns]).cast("double")
    found = F.col("_common").isNotNull()
    return (
        rows.join(F.broadcast(common), key, "left")
        .withColumn("_hot", found)
        .withColumn("_key", F.when(found, spread).otherwise(F.col(key)))
        .join(others, ["_hot", "_key"], "left")
        .select(*rows.columns, F.coalesce("_common", "_other").alias(result))
    )


def with_mid_rank(
    rows: DataFrame,
    value: str,
    count: str,
    small: bool = False,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Adds ``<value>_rank``: the average 1-based rank of a value.

    ``rows`` are collapsed rows that stand for ``count`` rows each.
    """
    freq = rows.groupBy(value).agg(F.sum(count).alias("_c"))
    ranked = running_totals(freq, value, ["_c"], slice_rows=slice_rows, small=small)
    middle = (F.col("_c_before") + (F.col("_c") + 1) / 2).alias(f"{value}_rank")
    lookup = ranked.select(value, "_c", middle)
    if small:
        return rows.join(lookup.drop("_c"), value)
    return join_by_value(rows, cut(lookup), value, "_c", f"{value}_rank")
