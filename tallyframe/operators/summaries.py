"""Column summaries: numeric, boolean, category, datetime, correlations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import FALSE_TOKENS, TRUE_TOKENS
from ..functions.values import (
    dtype_of,
    is_moment,
    is_null,
    is_number,
    is_text,
    ref,
    rounded,
    share,
    to_number,
)
from . import ordered
from .cleaning import duplicate_rows
from .filters import outside_fences
from .frequency import column_totals, top_values, value_frequencies

TOP_CATEGORIES = 12
MANY_CATEGORIES = 50
IMBALANCED_SHARE = 0.8
TOP_PAIRS = 20
# Correlations computed per aggregate; more would outgrow compiled code.
PAIRS_PER_PASS = 60
# Columns of a block, of which more pairs are multiplied as matrices, and parts
# in which the tasks' sums are added first.
COLUMNS_TOGETHER = 1000
SUM_PARTS = 64
# Columns summarised per scan, for the same reason.
COLUMNS_PER_PASS = 8


@dataclass(frozen=True)
class Roles:
    numeric: list[str]
    boolean: list[str]
    categorical: list[str]
    datetime: list[str]


def column_roles(cleaned: DataFrame, profile_rows: Sequence[Row]) -> Roles:
    """Which columns get which summary, from the collected profile rows."""
    ordered_rows = sorted(profile_rows, key=lambda r: r["position"])
    kinds = dict(zip(cleaned.columns, [r["inferred_type"] for r in ordered_rows]))
    types = {n: dtype_of(cleaned, n) for n in cleaned.columns}
    boolean = [n for n in cleaned.columns if kinds[n] == "boolean"]
    numeric = [
        n
        for n in cleaned.columns
        if is_number(types[n]) and kinds[n] not in ("boolean", "id-like", "constant")
    ]
    categorical = [
        n
        for n in cleaned.columns
        if (n in boolean or is_text(types[n])) and kinds[n] not in ("id-like", "text-like")
    ]
    moments = [n for n in cleaned.columns if is_moment(types[n])]
    return Roles(numeric, boolean, categorical, moments)


def long_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column, v), one per cell, with unparsable cells null."""
    wide = df.select(*[to_number(ref(n), dtype_of(df, n)).alias(n) for n in columns])
    return wide.unpivot([], [ref(n) for n in columns], "column", "v")


def _one_pass_each(wide: DataFrame, columns: Sequence[str], build) -> dict[str, Row]:
    """Aggregates a few columns per scan, each scan reading those columns only.

    ``build(column)`` gives the aggregates of a column; its row comes back.
    """
    found = {}
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        part = columns[start : start + COLUMNS_PER_PASS]
        structs = [F.struct(*build(ref(n), n)).alias(f"c{i}") for i, n in enumerate(part)]
        row = wide.agg(*structs).first()
        found.update({n: row[f"c{i}"] for i, n in enumerate(part)})
    return found


def numeric_summary(
    df: DataFrame, columns: Sequence[str], builtin_rows: int = ordered.BUILTIN_ROWS
) -> DataFrame:
    """Moments, quartiles and fence outliers, one row per column.

    Three scans: counts and means, quartiles, then powers of the centred
    values together with the outliers.  No values are shuffled as long as the
    columns are small enough for the built-in percentile.
    """
    wide = df.select(*[to_number(ref(n), dtype_of(df, n)).alias(n) for n in columns])
    first = _one_pass_each(
        wide,
        columns,
        lambda v, n: [
            F.count(F.lit(1)).alias("rows"),
            F.count(v).alias("n"),
            F.avg(v).alias("mean"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
        ],
    )
    points = [0.25, 0.5, 0.75]
    if all(r["n"] <= builtin_rows for r in first.values()):
        array = F.array(*[F.lit(p) for p in points])
        found = _one_pass_each(wide, columns, lambda v, n: [F.percentile(v, array).alias("q")])
        quartiles = {n: r["q"] or [None] * 3 for n, r in found.items()}
    else:
        sizes = (len(columns), max(r["n"] for r in first.values()))
        rows = ordered.quantiles(
            long_numbers(df, columns), "v", points, ["column"], builtin_rows, known_sizes=sizes
        ).collect()
        quartiles = {r["column"]: [r["q0"], r["q1"], r["q2"]] for r in rows}

    def powers(v: Column, name: str) -> list[Column]:
        q1, _, q3 = quartiles[name]
        d = v - F.lit(first[name]["mean"])
        square = d * d
        beyond = outside_fences(v, F.lit(q1), F.lit(q3)) if q1 is not None else F.lit(False)
        return [
            F.sum(square).alias("p2"),
            F.sum(square * d).alias("p3"),
            F.sum(square * square).alias("p4"),
            F.count_if(beyond).alias("outliers"),
        ]

    second = _one_pass_each(wide, columns, powers)
    rows = []
    for name in columns:
        a, p = first[name], second[name]
        rows.append((name, a["rows"], a["n"], a["mean"], a["min"], a["max"], *quartiles[name],
                     p["p2"], p["p3"], p["p4"], p["outliers"]))
    table = df.sparkSession.createDataFrame(
        rows,
        "column string, rows bigint, count bigint, mean double, min double, max double, "
        "q1 double, median double, q3 double, p2 double, p3 double, p4 double, outlier_count bigint",
    )
    n = F.col("count")
    # a constant column has no shape; its powers are rounding remainders
    varies = (F.col("min") < F.col("max"))
    variance = F.col("p2") / n
    skew = F.try_divide(F.col("p3") / n, F.pow(variance, F.lit(1.5)))
    kurt = F.try_divide(F.col("p4") / n, variance * variance) - 3
    std = F.when(varies, F.sqrt(F.try_divide(F.col("p2"), n - 1))).when(n > 1, 0.0)
    return table.select(
        "column",
        n,
        rounded(F.col("mean")).alias("mean"),
        rounded(F.col("median")).alias("median"),
        rounded(std).alias("std"),
        rounded(F.col("min")).alias("min"),
        rounded(F.col("max")).alias("max"),
        rounded(F.col("q1")).alias("q1"),
        rounded(F.col("q3")).alias("q3"),
        F.when(varies & (n > 2), rounded(skew)).alias("skewness"),
        F.when(varies & (n > 3), rounded(kurt)).alias("kurtosis"),
        share(F.col("rows") - n, F.col("rows"), 4).alias("missing_percentage"),
        "outlier_count",
    )


def boolean_summary(
    df: DataFrame, columns: Sequence[str], freq: DataFrame | None = None
) -> DataFrame:
    """True, false and missing counts, one row per boolean-like column."""
    freq = value_frequencies(df, columns, short=True) if freq is None else freq
    rows = freq.filter(F.col("column").isin(*columns))
    word, n = F.lower("value"), F.col("n")

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    counted = rows.groupBy("column").agg(
        total(word.isin(*TRUE_TOKENS)).alias("true_count"),
        total(word.isin(*FALSE_TOKENS)).alias("false_count"),
        total(F.col("value").isNull()).alias("missing_count"),
        F.sum("n").alias("rows"),
    )
    spelled = (
        top_values(rows, 8, df)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list("value")).alias("unique_values"))
    )
    true, false = F.col("true_count"), F.col("false_count")
    return counted.join(spelled, "column", "left").select(
        "column",
        true,
        false,
        share(true, true + false).alias("true_percentage"),
        share(false, true + false).alias("false_percentage"),
        "missing_count",
        share(F.col("missing_count"), F.col("rows"), 4).alias("missing_percentage"),
        "unique_values",
    )


def category_summary(
    df: DataFrame, columns: Sequence[str], freq: DataFrame | None = None
) -> DataFrame:
    """One row per category column."""
    freq = value_frequencies(df, columns, short=True) if freq is None else freq
    totals = column_totals(freq.filter(F.col("column").isin(*columns)))
    missing = F.col("missing_count")
    note = F.concat(
        F.col("column"),
        F.lit(" has "),
        missing.cast("string"),
        F.lit(" missing values excluded from this category summary."),
    )
    valid = F.greatest(F.col("valid_count"), F.lit(1))
    return totals.select(
        "column",
        "unique_count",
        missing,
        share(missing, F.col("row_count"), 4).alias("missing_percentage"),
        F.when(missing > 0, note).alias("missing_note"),
        (F.col("unique_count") > MANY_CATEGORIES).alias("cardinality_warning"),
        F.coalesce(F.col("top_count") / valid > IMBALANCED_SHARE, F.lit(False)).alias(
            "imbalance_warning"
        ),
    )


def category_top_values(
    df: DataFrame,
    columns: Sequence[str],
    limit: int = TOP_CATEGORIES,
    freq: DataFrame | None = None,
) -> DataFrame:
    """Most frequent values per column with their share of all valid cells."""
    freq = value_frequencies(df, columns, short=True) if freq is None else freq
    rows = freq.filter(F.col("column").isin(*columns))
    totals = column_totals(rows).select("column", "valid_count")
    return (
        top_values(rows, limit, df)
        .join(F.broadcast(totals), "column")
        .select(
            "column",
            "rank",
            "value",
            F.col("n").alias("count"),
            share(F.col("n"), F.col("valid_count")).alias("percentage"),
        )
    )


def datetime_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """First and last moment, span in whole days, share of nulls."""
    wide = df.select(*[ref(n).cast("timestamp_ntz").alias(n) for n in columns])
    long = wide.unpivot([], [ref(n) for n in columns], "column", "t")
    stats = long.groupBy("column").agg(
        F.min("t").alias("first"),
        F.max("t").alias("last"),
        F.count(F.lit(1)).alias("rows"),
        F.count("t").alias("valid"),
    )
    return stats.select(
        "column",
        F.col("first").alias("min_date"),
        F.col("last").alias("max_date"),
        F.timestamp_diff("DAY", F.col("first"), F.col("last")).alias("time_span_days"),
        share(F.col("rows") - F.col("valid"), F.col("rows"), 4).alias("missing_percentage"),
    )


def all_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (x, y, correlation) for every pair x < y by name, null included.

    A first scan takes count, mean and range per column.  The second sums
    products of centred values: one sum per pair of complete columns, and six
    for a pair with nulls, which has its own set of rows.  Many columns are
    multiplied as matrices, a thousand of them in that one scan.
    """
    names = sorted(columns)
    pairs = list(combinations(names, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "x string, y string, correlation double")
    wide = df.select(*[to_number(ref(n), dtype_of(df, n)).alias(n) for n in names])
    firsts = wide.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(ref(n)).alias(f"n{i}") for i, n in enumerate(names)],
        *[F.avg(ref(n)).alias(f"m{i}") for i, n in enumerate(names)],
        *[(F.min(ref(n)) < F.max(ref(n))).alias(f"v{i}") for i, n in enumerate(names)],
    ).first()
    varying = {n for i, n in enumerate(names) if firsts[f"v{i}"]}
    complete = {n: firsts[f"n{i}"] == firsts["n"] for i, n in enumerate(names)}
    centred = wide.select(
        *[(ref(n) - F.lit(firsts[f"m{i}"])).alias(n) for i, n in enumerate(names)]
    )
    if len(pairs) <= PAIRS_PER_PASS:
        return _pair_sums(centred, pairs, complete, varying)
    result = None
    blocks = [names[i : i + COLUMNS_TOGETHER] for i in range(0, len(names), COLUMNS_TOGETHER)]
    for i, left in enumerate(blocks):
        for right in blocks[i:]:
            rows = _block_correlations(centred, left, right, firsts["n"], varying)
            result = rows if result is None else result.unionByName(rows)
    return result


# Sums over the rows where both columns of a pair have a value.
PAIR_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def _block_correlations(centred: DataFrame, left: Sequence[str], right: Sequence[str], total: int, varying: set[str]) -> DataFrame:
    """Rows (x, y, correlation) of the pairs x < y of two blocks of columns, in one scan.

    Each task multiplies the matrices of its rows: what it hands on is one row
    for each left column, with arrays over the right ones.  These are added up
    in two steps, so that no task gets those of all.
    """
    columns = list(dict.fromkeys([*left, *right]))
    shape = T.StructType(
        [T.StructField("i", T.IntegerType()), T.StructField("part", T.IntegerType()), *[T.StructField(f"s_{k}", T.ArrayType(T.DoubleType())) for k in PAIR_SUMS]]
    )

    def packed(i, part, sums):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(shape)
        return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(part, pa.int32()), *[pa.array(list(m), f.type) for m, f in zip(sums, list(schema)[2:])]], schema=schema)

    def multiply(batches: Iterator) -> Iterator:
        import numpy as np
        from pyspark import TaskContext

        sums = np.zeros((len(PAIR_SUMS), len(left), len(right)))
        a, b = [columns.index(c) for c in left], [columns.index(c) for c in right]
        for batch in batches:
            values = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
            there = ~np.isnan(values)
            values, there = np.where(there, values, 0.0), there.astype(float)
            x, y, has_x, has_y = values[:, a], values[:, b], there[:, a], there[:, b]
            for k, (p, q) in enumerate(((has_x, has_y), (x, has_y), (has_x, y), (x * x, has_y), (has_x, y * y), (x, y))):
                sums[k] += p.T @ q
        part = TaskContext.get().partitionId() % SUM_PARTS
        yield packed(range(len(left)), [part] * len(left), sums)

    def add(rows):
        import numpy as np
        import pyarrow as pa

        sums = [np.stack(rows.column(f"s_{k}").to_pylist()).sum(axis=0)[None, :] for k in PAIR_SUMS]
        return pa.Table.from_batches([packed(rows.column("i")[:1].to_pylist(), [0], sums)])

    partial = centred.select(*[ref(c).cast("double") for c in columns]).mapInArrow(multiply, shape)
    sums = partial.groupBy("i", "part").applyInArrow(add, shape).groupBy("i").applyInArrow(add, shape)
    lists = [F.array(*[F.lit(c) for c in block]) for block in (left, right)]
    each = sums.select(F.get(lists[0], F.col("i")).alias("x"), F.posexplode(F.arrays_zip(*[f"s_{k}" for k in PAIR_SUMS])).alias("j", "s"))
    each = each.select("x", F.get(lists[1], F.col("j")).alias("y"), "s.*").filter("x < y")
    n, sx, sy, sxx, syy, sxy = (F.col(f"s_{k}") for k in PAIR_SUMS)
    # as for few pairs: a constant column must give null, not the quotient of two tiny remainders
    vx, vy = (_variation(q - s * s / n, q) for q, s in ((sxx, sx), (syy, sy)))
    some = F.when(n > 0, F.try_divide(sxy - sx * sy / n, F.sqrt(vx * vy)))
    r = F.when(n == total, F.try_divide(sxy, F.sqrt(sxx * syy))).otherwise(some)
    known = [c for c in columns if c in varying]
    both = F.col("x").isin(*known) & F.col("y").isin(*known) if known else F.lit(False)
    return each.select("x", "y", F.when(both, rounded(r)).alias("correlation"))



def _pair_sums(
    centred: DataFrame,
    pairs: Sequence[tuple[str, str]],
    complete: dict[str, bool],
    varying: set[str],
) -> DataFrame:
    sums, structs = {}, []

    def total(name: str, value: Column) -> Column:
        if name not in sums:
            sums[name] = F.sum(value).alias(f"s{len(sums)}")
        return F.col(f"s{list(sums).index(name)}")

    for a, b in pairs:
        x, y = ref(a), ref(b)
        if a not in varying or b not in varying:
            r = F.lit(None).cast("double")
        elif complete[a] and complete[b]:
            square_x, square_y = total(f"{a}^2", x * x), total(f"{b}^2", y * y)
            r = F.try_divide(total(f"{a}*{b}", x * y), F.sqrt(square_x * square_y))
        else:
            key, both = f"{a}*{b}", x.isNotNull() & y.isNotNull()
            n = total(f"{key} n", F.when(both, 1.0))
            sx, sy = total(f"{key} x", F.when(both, x)), total(f"{key} y", F.when(both, y))
            sxx, syy = total(f"{key} xx", F.when(both, x * x)), total(f"{key} yy", F.when(both, y * y))
            sxy = total(f"{key} xy", F.when(both, x * y))
            # a constant column must give null, not the quotient of two tiny remainders
            vx, vy = (_variation(q - F.pow(s, F.lit(2)) / n, q) for q, s in ((sxx, sx), (syy, sy)))
            r = F.try_divide(sxy - sx * sy / n, F.sqrt(vx * vy))
        structs.append(
            F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), rounded(r).alias("correlation"))
        )
    sums = sums or {"none": F.count(F.lit(1)).alias("s0")}
    return centred.agg(*sums.values()).select(F.inline(F.array(*structs)))


def _variation(value: Column, scale: Column) -> Column:
    return F.when(value > scale * 1e-13, value).otherwise(0.0)


def correlation_pairs(df: DataFrame, columns: Sequence[str], limit: int | None = TOP_PAIRS) -> DataFrame:
    """The strongest pairs, ties by name; all of them if ``limit`` is None."""
    strong = all_correlations(df, columns).filter(F.col("correlation").isNotNull())
    strong = strong.orderBy(F.desc(F.abs("correlation")), "x", "y")
    return strong if limit is None else strong.limit(limit)


def dataset_quality(df: DataFrame) -> DataFrame:
    """One row: size, nulls, duplicate rows and warnings."""
    fields = df.schema.fields
    nulls = [F.count_if(is_null(ref(f.name), f.dataType)).alias(f"n{i}") for i, f in enumerate(fields)]
    stats = df.agg(F.count(F.lit(1)).alias("row_count"), *nulls)
    stats = stats.withColumn("duplicate_rows", duplicate_rows(df).select("duplicate_rows").scalar())
    rows = F.greatest(F.col("row_count"), F.lit(1))
    high = F.array_compact(
        F.array(*[F.when(F.col(f"n{i}") / rows > 0.4, f.name) for i, f in enumerate(fields)])
    )
    copies = F.col("duplicate_rows")
    warnings = F.array_compact(
        F.array(
            F.when(copies > 0, F.concat(copies.cast("string"), F.lit(" duplicate rows detected."))),
            F.when(
                F.size(high) > 0,
                F.concat(
                    F.lit("High missingness in "),
                    F.array_join(F.slice(high, 1, 4), ", "),
                    F.lit("."),
                ),
            ),
        )
    )
    total = sum((F.col(f"n{i}") for i in range(1, len(fields))), F.col("n0"))
    return stats.select(
        "row_count",
        F.lit(len(fields)).alias("column_count"),
        total.alias("missing_values_total"),
        copies,
        warnings.alias("data_quality_warnings"),
    )
