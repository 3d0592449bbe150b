"""Term-count retrieval of text rows for a table of queries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.values import ref
from ..lineage import cut, spread

TOP_CHUNKS = 5
# Query words that favour chart chunks.
CHART_TERMS = (
    "chart", "charts", "visual", "visuals", "visualization", "visualizations",
    "pattern", "patterns", "useful", "important",
)
# How titles of charts start, and titles set back for such queries.
CHART_TITLE = "chart:"
SET_BACK_TITLES = ("feature engineering", "schema summary")
TABLE_TITLES = {"features": "Feature engineering", "profile": "Schema summary"}
CHART_BONUS, SET_BACK = 6, 2
MIN_TERM_LENGTH = 3
# Most (question, word) rows that a task holds, tokens that it remembers, and
# scores of a batch of chunks.
QUESTION_ROWS = 500_000
REMEMBERED_TOKENS = 500_000
SCORES = 1 << 22


def retrieve(
    chunks: DataFrame,
    queries: DataFrame,
    chunk_key: str,
    text: str,
    query_key: str,
    question: str,
    limit: int = TOP_CHUNKS,
    title: str | None = None,
    fallback: bool = True,
) -> DataFrame:
    """Rows (query, chunk, score, rank): the best chunks per query.

    A chunk scores, for every query word of three or more letters, the number
    of times the word stands in it plus one if its text contains the word
    anywhere.  Ties go to the smaller chunk key.  A query without any hit is
    given the first chunks, unless ``fallback`` is false.

    Texts are read once and only results are shuffled: each task holds the
    words of a bounded block of questions and hands on, for each batch of
    chunks and each question, the chunks that may be among its best.
    """
    head = F.coalesce(F.lower(ref(title)), F.lit("")) if title else F.lit("")
    body = F.lower(ref(text)) if not title else F.concat(head, F.lit(" "), F.lower(ref(text)))
    rows = chunks.select(
        ref(chunk_key).alias("chunk"), body.alias("body"),
        (F.when(head.startswith(CHART_TITLE), CHART_BONUS).when(head.isin(*SET_BACK_TITLES), -SET_BACK).otherwise(0)).alias("bonus"),
    )
    split = F.filter(F.split(F.lower(ref(question)), r"\s+"), lambda t: F.length(t) >= MIN_TERM_LENGTH)
    asked = queries.select(ref(query_key).alias("query"), split.alias("terms"))
    asked = asked.withColumn("charts", F.arrays_overlap("terms", F.array(*[F.lit(t) for t in CHART_TERMS])).cast("int"))
    said = asked.select("query", "charts", F.explode("terms").alias("term"))
    said = cut(said.groupBy("query", "charts", "term").agg(F.count("*").alias("times")))
    blocks = max(1, -(-said.count() // QUESTION_ROWS))
    scored = None
    for block in range(blocks):
        part = said.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block)
        found = _best_of_batches(spread(rows), part, limit)
        scored = found if scored is None else scored.unionByName(found)
    if title:
        # charts that a question about charts does not name: the first ones are enough
        charts = first_chunks(rows.filter(F.col("bonus") > 0), "chunk", limit).select("chunk", F.col("bonus").cast("bigint").alias("score"))
        given = asked.filter("charts = 1").select("query", F.lit(1).alias("one"))
        given = given.join(charts.withColumn("one", F.lit(1)), "one").select("query", "chunk", "score")
        scored = scored.unionByName(given.join(scored.select("query", "chunk"), ["query", "chunk"], "left_anti"))
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc("chunk"))
    found = scored.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    if not fallback:
        return found
    # read twice from here on, and small
    found = cut(found)
    heads = first_chunks(rows, "chunk", limit).agg(F.array_sort(F.collect_list("chunk")).alias("c"))
    unmatched = asked.select("query").join(found.select("query").distinct(), "query", "left_anti")
    given = unmatched.select("query", F.posexplode(heads.select("c").scalar()).alias("p", "chunk"))
    given = given.select(
        "query", "chunk", F.lit(0).cast("bigint").alias("score"), (F.col("p") + 1).alias("rank")
    )
    return found.unionByName(given)


class _Words:
    """The words of a block of questions, found inside tokens by their first bytes.

    What a token contains is looked up once; the memory is emptied when it is full.
    """

    def __init__(self, words: list[bytes]):
        self.short, self.long, self.known = {}, {}, {}
        for number, word in enumerate(words):
            if len(word) == MIN_TERM_LENGTH:
                self.short[word] = number
            else:
                self.long.setdefault(word[: MIN_TERM_LENGTH + 1], []).append((word, number))

    def inside(self, token: bytes) -> tuple[list, int]:
        """Numbers of the words that the token contains, and of the one that it is (or -1)."""
        found = self.known.get(token)
        if found is None:
            size, same = len(token), -1
            numbers = {self.short[p] for i in range(size - 2) if (p := token[i : i + MIN_TERM_LENGTH]) in self.short}
            for i in range(size - MIN_TERM_LENGTH):
                for word, number in self.long.get(token[i : i + MIN_TERM_LENGTH + 1], ()):
                    if token.startswith(word, i):
                        numbers.add(number)
                        if len(word) == size:
                            same = number
            same = self.short.get(token, same)
            if len(self.known) >= REMEMBERED_TOKENS:
                self.known.clear()
            found = self.known[token] = (list(numbers), same)
        return found


class _Numbers(dict):
    """Tokens by order of appearance."""

    def __missing__(self, token: bytes) -> int:
        self[token] = number = len(self)
        return number


def _runs(starts, lengths):
    """Places of runs of an array, one run after the other."""
    import numpy as np

    return np.repeat(starts, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _best_of_batches(rows: DataFrame, said: DataFrame, limit: int) -> DataFrame:
    """Rows (query, chunk, score): of each batch of chunks, all that may be among the best of a question.

    ``said`` is collected: at most about ``QUESTION_ROWS`` rows.
    """
    table = said.collect()
    words = sorted({r["term"].encode() for r in table})
    queries = list(dict.fromkeys((r["query"], r["charts"]) for r in table))
    number, place = {w: i for i, w in enumerate(words)}, {q[0]: i for i, q in enumerate(queries)}
    # who asks for a word, as runs of one array
    askers = sorted((number[r["term"].encode()], place[r["query"]], r["times"]) for r in table)
    shared = rows.sparkSession.sparkContext.broadcast((words, queries, askers))
    schema = T.StructType([T.StructField("query", said.schema["query"].dataType), T.StructField("chunk", rows.schema["chunk"].dataType), T.StructField("score", T.LongType())])

    def score(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        words, queries, askers = shared.value
        arrow, known = to_arrow_schema(schema), _Words(words)
        askers = np.array(askers, np.int64).reshape(-1, 3)
        starts = np.searchsorted(askers[:, 0], np.arange(len(words) + 1))
        charts = np.array([c for _, c in queries], np.int64)
        asking = pa.array([q for q, _ in queries], arrow.field("query").type)
        # chunks whose scores for all questions are held at once
        size = max(1, min(256, SCORES // max(1, len(queries))))
        for batch in batches if queries else ():
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                numbers, tokens, counts, sizes = _Numbers(), [], [], []
                for text in part.column("body").cast(pa.large_binary()).to_pylist():
                    said_here = Counter((text or b"").split())
                    tokens += map(numbers.__getitem__, said_here)
                    counts += said_here.values()
                    sizes.append(len(said_here))
                tokens, counts = np.array(tokens, np.int64), np.array(counts, np.int64)
                owners = np.repeat(np.arange(part.num_rows), sizes)
                # words inside each different token of the batch, as runs of one array
                inside = [known.inside(token) for token in numbers]
                same = np.array([s for _, s in inside], np.int64)
                held = np.array([len(w) for w, _ in inside], np.int64)
                flat = np.fromiter(chain.from_iterable(w for w, _ in inside), np.int64, held.sum())
                at = _runs((np.cumsum(held) - held)[tokens], held[tokens])
                cells = np.unique(np.repeat(owners, held[tokens]) * len(words) + flat[at])
                weights = np.ones(len(cells), np.int64)
                exact = same[tokens] >= 0
                weights[np.searchsorted(cells, owners[exact] * len(words) + same[tokens][exact])] += counts[exact]
                owners, found = np.divmod(cells, len(words))
                runs = starts[found + 1] - starts[found]
                at = _runs(starts[found], runs)
                cell = np.repeat(owners, runs) * len(queries) + askers[at, 1]
                shape = (part.num_rows, len(queries))
                scores = np.bincount(cell, np.repeat(weights, runs) * askers[at, 2], shape[0] * shape[1]).reshape(shape).astype(np.int64)
                scores += (scores > 0) * part.column("bonus").to_numpy()[:, None] * charts
                # the last of the best, ties included; nothing below it can be one
                least = np.sort(scores, axis=0)[-limit:][0]
                rows_, columns = np.nonzero((scores > 0) & (scores >= least))
                yield pa.RecordBatch.from_arrays(
                    [asking.take(pa.array(columns)), part.column("chunk").take(pa.array(rows_)), pa.array(scores[rows_, columns])], schema=arrow
                )

    return rows.select("chunk", "bonus", "body").mapInArrow(score, schema)


def first_chunks(chunks: DataFrame, chunk_key: str, limit: int = TOP_CHUNKS) -> DataFrame:
    """What a query without any hit is given: the first chunks by key."""
    return chunks.orderBy(chunk_key).limit(limit)


def artifact_corpus(tables: dict[str, DataFrame]) -> DataFrame:
    """Text rows (title, text) from result tables, one per row of each.

    Charts are titled as such; other tables with a ``title`` column name their
    rows, and the rest take the table's own title.
    """
    corpus = None
    for name, table in tables.items():
        title = F.col("title") if "title" in table.columns else F.lit(TABLE_TITLES.get(name, name))
        if name == "charts":
            title = F.concat(F.lit("Chart: "), title)
        text = F.to_json(F.struct(*[ref(c) for c in table.columns if c != "title"]))
        rows = table.select(title.cast("string").alias("title"), text.alias("text"))
        corpus = rows if corpus is None else corpus.unionByName(rows)
    return corpus
