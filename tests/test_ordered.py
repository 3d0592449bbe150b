"""Order statistics by slices against pandas, at slice sizes that force them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import charts, features, ml_split, ordered, summaries, tools
from tallyframe.plans.specs import Filter


def skewed(n=3000, seed=7):
    """A third of all rows in one group and at one value, heavy tails, signs."""
    rng = np.random.default_rng(seed)
    value = np.exp(rng.normal(0, 4, n)) * rng.choice([-1, 1], n)
    value[: n // 3] = 42.0
    value[n // 3 : n // 3 + 40] = 1e9 + rng.integers(0, 5, 40)
    group = rng.choice(["a", "b", "c"], n, p=[0.2, 0.2, 0.6])
    group[: n // 3] = "c"
    other = value * 0.5 + rng.integers(-3, 4, n)
    frame = pd.DataFrame({"k": group, "v": value, "w": np.round(other, 1)})
    return frame.sample(frac=1, random_state=1).reset_index(drop=True)


@pytest.fixture(scope="module")
def frame():
    return skewed()


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame).repartition(7).cache()


POINTS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("builtin_rows", [0, 10**6])
def test_quantiles_by_group(df, frame, builtin_rows):
    rows = ordered.quantiles(df, "v", POINTS, ["k"], builtin_rows, slice_rows=50).collect()
    want = frame.groupby("k")["v"].quantile(POINTS).unstack()
    for row in rows:
        got = [row[f"q{i}"] for i in range(len(POINTS))]
        assert np.allclose(got, want.loc[row["k"]].to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("builtin_rows", [0, 10**6])
def test_quantiles_of_the_whole(df, frame, builtin_rows):
    row = ordered.quantiles(df, "v", POINTS, builtin_rows=builtin_rows, slice_rows=50).first()
    assert np.allclose([row[f"q{i}"] for i in range(len(POINTS))], frame["v"].quantile(POINTS), rtol=1e-12)


def test_quantiles_by_brackets_place_no_row_in_slices(df, frame, monkeypatch):
    # many rows between the brackets, and brackets that share values
    many = df.crossJoin(df.sparkSession.range(20).withColumnRenamed("id", "copy"))
    shifted = many.withColumn("v", F.col("v") + F.col("copy") / 7)
    points = [0.0, 0.25, 0.2501, 0.5, 0.99, 1.0]
    want = shifted.toPandas().groupby("k")["v"].quantile(points).unstack()
    plain = ordered.with_slices
    monkeypatch.setattr(ordered, "with_slices", None)
    for row in ordered.quantiles(shifted, "v", points, ["k"], 0).collect():
        assert np.allclose([row[f"q{i}"] for i in range(6)], want.loc[row["k"]].to_numpy(), rtol=1e-12)
    # a bracket that misses its rank is noticed
    monkeypatch.setattr(ordered, "with_slices", plain)
    approximate = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda c, p, a: approximate(F.col(c) + 1e12, p, a))
    got = {r["k"]: r["q0"] for r in ordered.quantiles(shifted, "v", [0.5], ["k"], 0, slice_rows=10**6).collect()}
    assert got == pytest.approx(want[0.5].to_dict())


def test_split_of_many_rows_places_no_row_in_slices(spark, monkeypatch):
    df = spark.range(30_000).selectExpr("id", "CASE WHEN id % 10 < 3 THEN 'a' ELSE 'b' END AS s")
    parts = [ml_split.stratified_split(df, ["id"], s, builtin_rows=10**6).filter("is_test") for s in (None, "s")]
    want = [{r["id"] for r in part.collect()} for part in parts]
    monkeypatch.setattr(ordered, "with_slices", None)
    for s, ids in zip((None, "s"), want):
        got = ml_split.stratified_split(df, ["id"], s, builtin_rows=0).filter("is_test")
        assert {r["id"] for r in got.collect()} == ids and len(ids) == 6600


def test_many_ranks_take_the_other_join(df, frame, monkeypatch):
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", 0)
    rows = ordered.quantiles(df, "v", [0.5], ["k"], 0, slice_rows=50).collect()
    want = frame.groupby("k")["v"].median()
    assert {r["k"]: r["q0"] for r in rows} == pytest.approx(want.to_dict())


def test_all_null_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "k string, v double")
    for builtin_rows in (0, 100):
        rows = {r["k"]: r["q0"] for r in ordered.quantiles(df, "v", [0.5], ["k"], builtin_rows).collect()}
        assert rows == {"a": 2.0, "b": None}


@pytest.mark.parametrize("small", [True, False])
def test_running_totals(df, frame, small):
    freq = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    rows = ordered.running_totals(freq, "v", ["n"], slice_rows=40, small=small).collect()
    counts = frame["v"].value_counts().sort_index()
    want = (counts.cumsum() - counts).to_dict()
    assert {r["v"]: r["n_before"] for r in rows} == want


@pytest.mark.parametrize("builtin_rows", [0, 10**6])
@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_correlation(df, frame, method, builtin_rows):
    got = tools.correlation(df, "v", "w", method, builtin_rows, slice_rows=40).first()["correlation"]
    if method == "kendall":
        x, y = frame["v"].to_numpy(), frame["w"].to_numpy()
        sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
        want = (sx * sy).sum() / np.sqrt((sx**2).sum() * (sy**2).sum())
    elif method == "spearman":
        want = frame["v"].rank().corr(frame["w"].rank())
    else:
        want = frame["v"].corr(frame["w"])
    assert got == pytest.approx(want, abs=6e-5)


@pytest.mark.parametrize("builtin_rows", [0, 10**6])
def test_rank_auc(df, frame, builtin_rows):
    rows = df.select((F.col("k") == "a").cast("int").alias("y"), "v")
    got = tools.rank_auc(rows, "y", "v", builtin_rows, slice_rows=40).first()["roc_auc"]
    ranks, y = frame["v"].rank(), frame["k"] == "a"
    want = (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert got == pytest.approx(want, abs=6e-5)


@pytest.mark.parametrize("builtin_rows", [0, 10**6])
def test_split_sizes_and_stability(spark, builtin_rows):
    df = spark.range(2000).select("id", F.when(F.col("id") % 10 < 7, "x").otherwise(F.concat(F.lit("y"), F.col("id") % 3)).alias("c"))
    first = ml_split.stratified_split(df, ["id"], "c", builtin_rows=builtin_rows)
    again = ml_split.stratified_split(df.repartition(5), ["id"], "c", builtin_rows=10**6)
    a = {r["id"]: r["is_test"] for r in first.collect()}
    assert a == {r["id"]: r["is_test"] for r in again.collect()}
    assert sum(a.values()) == 440
    for row in first.groupBy("c").agg(F.avg(F.col("is_test").cast("int")).alias("s")).collect():
        assert row["s"] == pytest.approx(0.22, abs=0.01)


@pytest.mark.parametrize("builtin_rows", [0, 10**6])
def test_summaries_agree_on_both_ways(df, frame, builtin_rows):
    row = {r["column"]: r for r in summaries.numeric_summary(df, ["v", "w"], builtin_rows).collect()}["v"]
    q1, q3 = frame["v"].quantile([0.25, 0.75])
    reach = 1.5 * (q3 - q1)
    assert row["median"] == pytest.approx(frame["v"].median(), abs=1e-4)
    assert row["outlier_count"] == ((frame["v"] < q1 - reach) | (frame["v"] > q3 + reach)).sum()
    med = tools.filtered_aggregation(df, [Filter("k", "==", "c")], "v", "median", builtin_rows).first()
    assert med["result"] == pytest.approx(frame[frame["k"] == "c"]["v"].median(), abs=1e-4)
    boxes = {r["label"]: r for r in charts.box_by_group(df, "k", "v", builtin_rows).collect()}
    assert boxes["a"]["q3"] == pytest.approx(frame[frame["k"] == "a"]["v"].quantile(0.75), abs=1e-4)
    wide = features.quantile_buckets(df, ["w"], builtin_rows)
    sizes = sorted(r["count"] for r in wide.groupBy("w_bucket").count().collect())
    assert sizes == sorted(pd.qcut(frame["w"], 4, duplicates="drop").value_counts().tolist())
    labels = {r["w_bucket"] for r in wide.select("w_bucket").distinct().collect()}
    assert labels == set(pd.qcut(frame["w"], 4, duplicates="drop").astype(str).unique())


def test_same_answer_on_any_partitioning(spark, frame):
    df = spark.createDataFrame(frame)
    for parts in (1, 7):
        part = df.repartition(parts)
        got = summaries.numeric_summary(part, ["v", "w"]).orderBy("column").collect()
        want = summaries.numeric_summary(df, ["v", "w"]).orderBy("column").collect()
        assert got == want


def sizes_of_slices(df, slice_rows):
    rows = ordered.with_slices(df, "v", slice_rows=slice_rows)
    found = rows.groupBy("_slice").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("_slice").collect()
    # order by slice is order by value
    assert all(a["high"] < b["low"] for a, b in zip(found, found[1:]))
    return [r["n"] for r in found if r["low"] < r["high"]], sum(r["n"] for r in found)


@pytest.mark.parametrize("shape", ["clustered", "geometric", "hot", "refined"])
def test_slices_fit_whatever_the_values(spark, monkeypatch, shape):
    if shape == "refined":  # few splitters, so slices are split again and again
        monkeypatch.setattr(ordered, "SPLITTERS", 4)
        monkeypatch.setattr(ordered, "RANK_ACCURACY", 20)
    values = {
        "clustered": "1e9 + id * 1e-4", "geometric": "pow(2D, -(id % 1000)) * (1 + id * 1e-9)",
        "hot": "if(id % 3 = 0, 7D, if(id % 3 = 1, double(id), 7D + id * 1e-7))", "refined": "pow(2D, (id % 2000) / 3) + id",
    }[shape]
    df = spark.range(0, 200_000, 1, 8).selectExpr(f"{values} AS v")
    if shape == "clustered":
        df = df.unionByName(spark.range(1).selectExpr("1.005e9 AS v"))
    sizes, total = sizes_of_slices(df, 5000)
    assert total == df.count() and max(sizes) <= 10_000 and len(sizes) >= 10


@pytest.mark.parametrize("builtin_rows,slice_rows", [(10**6, 10**6), (0, 100)])
def test_folds_are_stratified(spark, builtin_rows, slice_rows):
    df = spark.range(3000).selectExpr("if(id % 50 = 0, null, id) AS k", "if(id % 7 = 0, null, if(id % 3 = 0, 'a', 'b')) AS c", "id AS fold")
    got = ml_split.with_fold(df, ["k"], 5, stratum="c", builtin_rows=builtin_rows, slice_rows=slice_rows).toPandas()
    assert len(got) == 3000 and list(got.columns) == ["k", "c", "fold"]
    keyed = got[got.k.notna()]
    for _, part in keyed.groupby(keyed.c.fillna("none")):
        sizes = part.groupby("fold").size()
        # the null key is one of a stratum's keys, in some fold
        assert len(sizes) == 5 and sizes.max() - sizes.min() <= 2
    assert (got[got.k.isna()].groupby(got.c.fillna("none")).fold.nunique() == 1).all()


def test_long_values_stay_out_of_the_shuffle(spark):
    from tallyframe.operators import frequency

    base = "p" * 70
    rows = [(base + str(i % 40), "s" + str(i % 3), None) for i in range(200)] + [("p", "", "x" * 5000), (base[:64], " n/a ", "x" * 5000)]
    df = spark.createDataFrame(rows, "long string, short string, one string").repartition(3)
    short, whole = frequency.value_frequencies(df, short=True), frequency.value_frequencies(df)
    assert short.agg(F.max(F.length("value"))).first()[0] == frequency.SHORT
    totals = [sorted(tuple(r) for r in frequency.column_totals(f).collect()) for f in (short, whole)]
    assert totals[0] == totals[1]
    for find in (lambda f, d: frequency.top_values(f, 3, d), lambda f, d: frequency.first_values(f, 5, "v", d), lambda f, d: frequency.allowed_values(f, 80, d)):
        assert sorted(map(tuple, find(short, df).collect()), key=repr) == sorted(map(tuple, find(whole, None).collect()), key=repr)
