"""Retrieval, neighbours and question jobs against brute force."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import ml_cases, text_cases
from tallyframe.operators import neighbours, questions, retrieval
from tallyframe.plans.analysis import analyse


def brute_force(chunks, asked, limit):
    result = {}
    for query, question in asked:
        terms = [t.lower() for t in question.split() if len(t) > 2]
        charts = bool(set(terms) & set(retrieval.CHART_TERMS))
        scored = []
        for key, title, text in chunks:
            body = f"{title} {text}".lower()
            counts = Counter(body.split())
            score = sum(counts[t] for t in terms) + sum(t in body for t in terms)
            if charts and title.lower().startswith("chart:"):
                score += 6
            if charts and title.lower() in retrieval.SET_BACK_TITLES:
                score -= 2
            scored.append((-score, key))
        result[query] = [(k, -s) for s, k in sorted(scored)[:limit] if s < 0]
    return result


CHUNKS = [
    (1, "Chart: price", "the price price of things"), (2, "Schema summary", "columns and prices"),
    (3, "Other", "nothing here"), (4, "Chart: Size", "size by brand, size"), (5, "Feature engineering", "charts of price"),
]
ASKED = [(10, "price of the charts price"), (11, "SIZE"), (12, "zzz"), (13, "price columns and size brand"), (14, "a of")]


def test_retrieval(spark):
    chunks = spark.createDataFrame(CHUNKS, "id int, title string, text string").repartition(3)
    asked = spark.createDataFrame(ASKED, "q int, question string")
    rows = retrieval.retrieve(chunks, asked, "id", "text", "q", "question", limit=3, title="title", fallback=False).collect()
    got = {q: [] for q, _ in ASKED}
    for row in sorted(rows, key=lambda r: r["rank"]):
        got[row["query"]].append((row["chunk"], row["score"]))
    assert got == brute_force(CHUNKS, ASKED, 3)
    full = retrieval.retrieve(chunks, asked, "id", "text", "q", "question", 3, "title")
    given = sorted((r["rank"], r["chunk"]) for r in full.filter("query = 12").collect())
    assert given == [(1, 1), (2, 2), (3, 3)]


def test_retrieval_over_an_analysis(spark):
    rows = [("a" if i % 3 else "b", float(i % 17), float((i % 3) * 50 + i % 5)) for i in range(120)]
    corpus = analyse(spark.createDataFrame(rows, "city string, price double, score double")).corpus()
    titles = {r["title"] for r in corpus.collect()}
    assert {"Feature engineering", "Schema summary"} <= titles and any(t.startswith("Chart: ") for t in titles)
    asked = spark.createDataFrame([(1, "which charts show the price")], "q int, question string")
    best = retrieval.retrieve(corpus, asked, "title", "text", "q", "question", title="title")
    assert all(r["chunk"].startswith("Chart: ") for r in best.collect())


@pytest.mark.parametrize("block_rows", [17, 10**6])
@pytest.mark.parametrize("classify", [True, False])
def test_neighbours(spark, block_rows, classify):
    rng = np.random.default_rng(3)
    points = rng.integers(0, 6, (90, 2)).astype(float)
    labels = rng.integers(0, 3, 90)
    df = spark.createDataFrame([(i, p.tolist(), int(c)) for i, (p, c) in enumerate(zip(points, labels))], "i int, p array<double>, c int")
    got = {r["i"]: r["prediction"] for r in
           neighbours.nearest_neighbours(df, df, "i", "p", "c", classify, block_rows=block_rows, chunk_rows=25).collect()}
    for i, point in enumerate(points):
        distance = ((points - point) ** 2).sum(axis=1)
        near = labels[np.lexsort((np.arange(90), distance))[:5]]
        want = Counter(sorted(near)).most_common(1)[0][0] if classify else near.mean()
        assert got[i] == pytest.approx(want)


def test_predicates(spark):
    asked = ["GPA for sleep less than 5 and stress >= 2.5", "5 hours or less", "no more than 7", "between 2 and 4.5",
             "less than or equal to 3", "at least 6, under 9", "nothing"]
    df = spark.createDataFrame(list(enumerate(asked)), "i int, q string")
    got = {}
    for r in questions.numeric_predicates(df, "i", "q").collect():
        got.setdefault(r["i"], set()).add((r["operator"], r["low"], r["high"]))
    assert got == {
        0: {("<", 5.0, None), (">=", 2.5, None)}, 1: {("<=", 5.0, None)}, 2: {("<=", 7.0, None)},
        3: {("between", 2.0, 4.5)}, 4: {("<=", 3.0, None)}, 5: {(">=", 6.0, None), ("<", 9.0, None)},
    }


def test_intents_and_columns(spark):
    asked = ["show me a chart", "which column is missing", "is sleep related to stress", "compare A and B",
             "average price by brand", "average price", "hello"]
    df = spark.createDataFrame(list(enumerate(asked)), "i int, q string")
    got = [r["intent"] for r in questions.intent_tags(df, "q").orderBy("i").collect()]
    assert got == ["chart_lookup", "dataset_metadata", "correlation_query", "compare_groups", "groupby_aggregation",
                   "filtered_aggregation", "unsupported"]
    phrases = spark.createDataFrame([(1, "screen time"), (2, "GPA"), (3, "zzz"), (4, "")], "i int, phrase string")
    columns = ["Student_ID", "Screen_Time_Hours", "Previous_Semester_GPA", "Stress_Level"]
    rows = {r["i"]: r["matched"] for r in questions.column_match(phrases, "i", "phrase", columns).collect()}
    assert rows == {1: "Screen_Time_Hours", 2: "Previous_Semester_GPA", 3: None, 4: None}


def test_columns_with_many_values_are_searched(spark):
    df = spark.range(200).selectExpr("concat('v', id) AS many", "concat('w', id % 3) AS few")
    asked = spark.createDataFrame([(1, "v17 and w2 or w0")], "i int, q string")
    rows = questions.value_mentions(asked, "i", "q", df, ["many", "few"]).collect()
    assert sorted((r["column"], r["value"]) for r in rows) == [("few", "w0"), ("many", "v1")]
    groups = questions.group_mentions(asked, "i", "q", df, ["many", "few"]).collect()
    assert [(r["column"], r["first"], r["second"]) for r in groups] == [("many", "v1", "v17")]
    groups = questions.group_mentions(asked, "i", "q", df, ["few", "many"]).collect()
    assert [(r["column"], r["first"], r["second"]) for r in groups] == [("few", "w2", "w0")]


def test_mentions_of_an_empty_table(spark):
    df = spark.createDataFrame([], "many string, few string")
    asked = spark.createDataFrame([(1, "v17 and w2 or w0")], "i int, q string")
    got = questions.value_mentions(asked, "i", "q", df, ["many"])
    assert got.columns == ["i", "column", "value"] and got.count() == 0
    # a case over an emptied table is none for the checks: its work does not grow
    assert "value_mentions" in text_cases.CASES and "value_mentions_none" not in text_cases.CASES


def test_returns_and_without(spark):
    rows = [(1, "Express", "Yes", 2), (2, "Express", "No", 3), (3, "Standard", "Yes", 6), (4, "Express", "Yes", 1)]
    df = spark.createDataFrame(rows, "Order_ID int, Shipping_Method string, Returned string, Delivery_Days int")
    asked = ["How many orders used express shipping and were returned?", "orders without returned", "with and without returned", "not express", "compare yes and no", ""]
    asked = spark.createDataFrame(list(enumerate(asked)), "i int, q string")
    columns = ["Shipping_Method", "Returned"]
    got = {(r["i"], r["column"], r["operator"], *r["values"]) for r in questions.value_predicates(asked, "i", "q", df, columns).collect()}
    # "not" has the value "no" in it
    assert got == {
        (0, "Shipping_Method", "==", "Express"), (0, "Returned", "in", "Yes"), (1, "Returned", "in", "Yes"), (2, "Returned", "in", "Yes"),
        (3, "Shipping_Method", "==", "Express"), (3, "Returned", "==", "No"), (4, "Returned", "==", "No"),
    }
    groups = questions.group_predicates(asked, "i", "q", df, columns).collect()
    assert sorted((r["i"], r["column"], *r["first"], *r["second"]) for r in groups) == [(1, "Returned", "Yes", "No"), (2, "Returned", "Yes", "No"), (4, "Returned", "Yes", "No")]


def test_values_with_a_common_beginning_do_not_meet(spark):
    df = spark.range(3000).selectExpr("concat('Customer#', lpad(id, 9, '0')) AS name")
    asked = spark.range(3000).selectExpr("id AS i", "concat('what of customer ', lpad(id, 9, '0')) AS q")
    got = questions.value_mentions(asked, "i", "q", df, ["name"])
    assert {(r["i"], r["value"]) for r in got.collect()} == {(i, f"Customer#{i:09d}") for i in range(3000)}


def test_pieces_of_questions_are_not_broadcast(spark):
    df = spark.range(3000).selectExpr("concat('Customer#', lpad(id, 9, '0')) AS name")
    asked = spark.range(3000).selectExpr("id AS i", "concat('what of customer ', lpad(id, 9, '0')) AS q")
    got = questions.value_mentions(asked, "i", "q", df, ["name"])
    # each question has hundreds of pieces, which the size of its table does not tell
    assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()
    # one length of values: the same pieces of questions that are shorter than it meet nothing
    short = spark.createDataFrame([(1, "customer"), (2, "")], "i int, q string")
    assert questions.value_mentions(short, "i", "q", df, ["name"]).count() == 0


def test_retrieval_counts(spark):
    texts = ["the theme of the thesis", "a them\tthe", "", None, "other", "THE the", "xyz"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "c int, text string")
    asked = spark.createDataFrame([(1, "the the them ab"), (2, "qqq"), (3, None)], "i int, q string")
    got = {(r["query"], r["chunk"]): r["score"] for r in retrieval.retrieve(chunks, asked, "c", "text", "i", "q", limit=10, fallback=False).collect()}
    want = {}
    for c, text in enumerate(texts):
        body = (text or "").lower()
        score = sum(body.split().count(t) + (t in body) for t in ("the", "the", "them"))
        if score:
            want[1, c] = score
    assert got == want


def clustered(spark, n):
    """Points around few centres, a third of them copies of one; large keys, and ties."""
    import numpy as np

    random = np.random.default_rng(5)
    centres = random.normal(size=(12, 4)) * 40
    points = centres[random.integers(0, 12, n)] + random.normal(size=(n, 4))
    points[: n // 3] = points[0]
    rows = [((1 << 60) + i, [float(v) for v in p], i % 3) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "i bigint, p array<double>, c int"), points


def test_neighbours_in_cells_are_exact(spark):
    import numpy as np

    n = 600
    df, points = clustered(spark, n)
    squared = np.round((points**2).sum(1)[:, None] - 2 * points @ points.T + (points**2).sum(1)[None, :], 9)
    order = np.argsort(squared, axis=1, kind="stable")[:, :5]
    want = {(1 << 60) + i: np.mean([j % 3 for j in own]) for i, own in enumerate(order)}
    for block_rows in (40, 7):
        got = neighbours.nearest_neighbours(df, df, "i", "p", "c", False, block_rows=block_rows, chunk_rows=50).collect()
        assert len(got) == n and all(abs(want[r["i"]] - r["prediction"]) < 1e-9 for r in got)


def test_neighbours_meet_few_blocks(spark):
    df, _ = clustered(spark, 1500)
    train = df.select(F.col("i").alias("key"), F.col("p").alias("features"), F.col("c").cast("double").alias("label"))
    cells = neighbours.Cells(train, 1500, 50)
    rows = train.select("key", "features")
    schema = "key bigint, neighbour bigint, distance double, label double"
    first = neighbours._met(cells.home(rows), cells.rows, schema, 5, 500)
    asked = cells.within_bound(first.filter("neighbour IS NULL"), 5)
    sizes = cells.rows.groupBy("cell", "block").agg(F.count("*").alias("n"))
    both = cells.home(rows).select("cell", "block").unionByName(asked.select("cell", "block"))
    compared = both.join(sizes, ["cell", "block"]).agg(F.sum("n")).first()[0]
    # the copies, which are no farther than the bound, meet each other
    assert compared < 500 * 500 + 0.2 * (1500 * 1500 - 500 * 500)


@pytest.mark.parametrize("name", ["knn_predict", "knn_cells"])
def test_neighbour_queries_search_for_every_row(spark, tmp_path, name):
    rng = np.random.default_rng(11)
    points = rng.integers(0, 5, (720, 4)).astype(float)
    rows = [(3 * i + 1, p.tolist(), i % 3) for i, p in enumerate(points)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["vec_id"]: r["prediction"] for r in ml_cases.CASES[name][0](spark, str(tmp_path)).collect()}
    want = {}
    for i, (key, _, _) in enumerate(rows):
        distance = ((points - points[i]) ** 2).sum(axis=1)
        votes = Counter(j % 3 for j in np.lexsort((np.arange(720), distance))[:5])
        want[key] = min(votes, key=lambda label: (-votes[label], label))
    assert got == want
    # the SQL asks for every row as well
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert dict(con.execute(ml_cases.CASES[name][1]).fetchall()) == want


def test_few_rows_are_searched_without_cells(spark, monkeypatch):
    rng = np.random.default_rng(5)
    points = rng.integers(0, 4, (400, 3)).astype(float)
    points[7] = np.nan
    df = spark.createDataFrame([(i, p.tolist(), i % 7) for i, p in enumerate(points)], "i int, p array<double>, c int").repartition(3)
    rows = df.filter("i % 20 = 0")
    want = {}
    for i in range(0, 400, 20):
        distance = ((points - points[i]) ** 2).sum(axis=1)
        want[i] = np.mean([j % 7 for j in np.lexsort((np.arange(400), distance))[:5]])

    def found(rows):
        got = neighbours.nearest_neighbours(df, rows, "i", "p", "c", False, block_rows=60, chunk_rows=10).collect()
        return {r["i"]: r["prediction"] for r in got}

    assert found(rows) == pytest.approx(want)
    # a row was sent to each block of each cell that it may need
    monkeypatch.setattr(neighbours, "Cells", None)
    assert found(rows) == pytest.approx(want)
    assert found(rows.limit(0)) == {}


def test_neighbours_with_few_and_bad_rows(spark):
    rows = [(1, [0.0, 0.0], 1), (2, [1.0, 0.0], 0), (3, None, 1), (4, [2.0, 0.0], None), (5, [float("nan"), 0.0], 1)]
    df = spark.createDataFrame(rows, "i bigint, p array<double>, c int")
    got = {r["i"]: r["prediction"] for r in neighbours.nearest_neighbours(df, df, "i", "p", "c", False, k=2, block_rows=1, chunk_rows=1).collect()}
    assert got[1] == got[2] == got[4] == 0.5 and got[3] is None and set(got) == {1, 2, 3, 4, 5}
