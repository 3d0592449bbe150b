"""Code length of texts under a context-tree weighting model learned from the corpus.

A text (A-Z lower-cased) is one run of bytes, closed by a byte that no text
has.  A byte is eight binary decisions; each has a Krichevsky-Trofimov
estimate in the context of the last 0, 1, ..., DEPTH bytes of the text, across
words and lines, and the estimates of all depths are mixed with the weights
that context-tree weighting gives them.

The weights depend on counts alone, so the tree is made bottom-up by grouping,
level by level, and the predictions top-down by joins.  Contexts that occur
only in documents held out take part with counts of 0, as contexts never seen
do.  A text's score is the sum over its bytes: frequent predictions are looked
up where the text is read, the others are joined, and so are counts of words.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BATCH, as_list, written

DEPTH = 5
# Fixed value: what is added to each token's count in the base score.
ADDED = 0.1
# Words, and predictions (16 bytes each), of which a table may be sent to every task.
HEAD_UNITS = 200_000
FEW_PREDICTIONS = 4_000_000
# Different words, and contexts with their bytes, that a task counts before it hands them on.
HELD_UNITS = 300_000
HELD_KEYS = 600_000
# Bytes of text of which a task holds the contexts at once.
STRETCH = 1 << 20
# What stands before a text, and after it: bytes that UTF-8 does not have.
GAP, LAST = b"\xfe", b"\xff"


def held_out(key: Column) -> Column:
    """Documents from which nothing is learned."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def units_of(text: bytes | None) -> tuple[list[bytes], Counter]:
    """The runs of bytes that the model reads: the whole text is one, and no word is a run of its own."""
    return [], Counter([GAP + (text or b"").lower() + LAST])


def words_of(text: bytes | None) -> list[bytes]:
    """The lower-cased words of a text."""
    return (text or b"").lower().split()


def _texts(batches, *columns: str):
    """The values of columns, of some rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            yield [as_list(batch.column(c).slice(start, BATCH)) for c in columns]


def _word_counts(docs: DataFrame) -> DataFrame:
    """Rows (unit, c, n): occurrences of words in training documents, and in all."""

    def count(batches):
        import pyarrow as pa

        held = {True: Counter(), False: Counter()}

        def flush():
            for out, counter in held.items():
                if counter:
                    n = pa.array(list(counter.values()), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(counter), pa.binary()), pa.array([0] * len(n), pa.int64()) if out else n, n], ["unit", "c", "n"]
                    )
                counter.clear()

        for texts, out in _texts(batches, "text", "held_out"):
            for text, o in zip(texts, out):
                held[o].update(words_of(text))
            if len(held[True]) + len(held[False]) > HELD_UNITS:
                yield from flush()
        yield from flush()

    counts = docs.select("text", "held_out").mapInArrow(count, "unit binary, c bigint, n bigint")
    return counts.groupBy("unit").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def positions(runs: list[bytes]):
    """For each byte to predict: context and byte as one number, and the place of its run."""
    import numpy as np

    # the first byte stands for all before it
    buffer = np.frombuffer(b"".join(r[:1] * (DEPTH - 1) + r for r in runs), dtype=np.uint8)
    sizes = np.fromiter((len(r) + DEPTH - 1 for r in runs), dtype=np.int64, count=len(runs))
    n = max(0, len(buffer) - DEPTH)
    key = np.zeros(n, dtype=np.int64)
    for i in range(DEPTH + 1):
        key <<= 8
        key |= buffer[i : i + n]
    # contexts that begin in one run do not reach into the next
    owner = np.repeat(np.arange(len(runs)), sizes - DEPTH)
    at = np.arange(len(owner)) + owner * DEPTH
    return key[at], owner


def _stretches(texts: list, size: int):
    """Places that cut a list of texts into stretches of about ``size`` bytes."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or b"")
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _runs(texts: list) -> list[bytes]:
    return [run for text in texts for run in units_of(text)[1]]


def _leaves(docs: DataFrame) -> DataFrame:
    """Rows (key, c, n): how often each byte follows each context of full depth in training texts, and in all."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        def folded(parts):
            key, c, n = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(key)
            key = key[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            return key[starts], np.add.reduceat(c[order], starts), np.add.reduceat(n[order], starts)

        held, size = [], 0
        for texts, out in _texts(batches, "text", "held_out"):
            for training in (True, False):
                chosen = [t for t, o in zip(texts, out) if o != training]
                for start, end in _stretches(chosen, STRETCH):
                    found, n = np.unique(positions(_runs(chosen[start:end]))[0], return_counts=True)
                    held.append((found, n * training, n))
                    size += len(found)
                    if size > 2 * HELD_KEYS:
                        held = [folded(held)]
                        size = len(held[0][0])
                        if size > HELD_KEYS:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["key", "c", "n"])
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in folded(held)], ["key", "c", "n"])

    counts = docs.select("text", "held_out").mapInArrow(count, "key bigint, c bigint, n bigint")
    return counts.groupBy("key").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def log_gamma(x: str) -> str:
    """SQL: logarithm of the gamma function for x >= 0.5 (Stirling's series beyond 6.5)."""
    product = " * ".join(f"({x} + {i}D)" for i in range(6))
    z = f"({x} + 6D)"
    series = f"1 / (12 * {z}) - 1 / (360 * pow({z}, 3)) + 1 / (1260 * pow({z}, 5)) - 1 / (1680 * pow({z}, 7)) + 1 / (1188 * pow({z}, 9))"
    return f"(({z} - 0.5D) * ln({z}) - {z} + {0.5 * math.log(2 * math.pi)!r}D + {series} - ln({product}))"


# Log probability that Krichevsky and Trofimov's estimate gives to a sequence of a zeros and b ones.
BLOCK = f"({log_gamma('(a + 0.5D)')} + {log_gamma('(b + 0.5D)')} - {log_gamma('(a + b + 1D)')} - {math.log(math.pi)!r}D)"
# The decisions of a byte: node 1, then the bits so far after a leading 1.
BITS = "transform(sequence(7, 0, -1), i -> struct(cast(shiftright(256 + (key & 255), i + 1) as int) AS node, cast(shiftright(key, i) & 1 as int) AS bit))"


def _predictions(leaves: DataFrame) -> DataFrame:
    """Rows (key, score, n): log10 probability of each byte in its context, and how often both occur."""
    # dealt by context before each becomes eight rows
    leaves = leaves.withColumn("context", F.shiftright("key", 8))
    bits = leaves.repartition("context").select("context", "c", F.explode(F.expr(BITS)).alias("d")).select("context", "c", "d.node", "d.bit")
    level = bits.groupBy("context", "node").agg(
        F.sum(F.expr("if(bit = 0, c, 0)")).alias("a"), F.sum(F.expr("if(bit = 1, c, 0)")).alias("b")
    )
    levels = [written(level.withColumn("tree", F.expr(BLOCK)), "tree-level")]
    for depth in range(DEPTH - 1, -1, -1):
        parent = F.col("context") % F.lit(256**depth)
        level = levels[-1].groupBy(parent.alias("context"), "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("tree").alias("below"))
        # log of the mean of stopping here and of going on
        level = level.withColumn("stop", F.expr(BLOCK)).withColumn("most", F.greatest("stop", "below"))
        level = level.withColumn("tree", F.expr(f"most + ln(exp(stop - most) + exp(below - most)) - {math.log(2)!r}D"))
        level = level.withColumn("weight", F.expr(f"exp(stop - {math.log(2)!r}D - tree)"))
        levels.append(written(level.select("context", "node", "a", "b", "tree", "weight"), "tree-level"))
    ones = "(b + 0.5D) / (a + b + 1D)"
    levels.reverse()
    # so far: what the shallower contexts give to a one, and what is left for the deeper
    known = levels[0].select("context", "node", F.expr(f"weight * {ones}").alias("one"), F.expr("1 - weight").alias("rest"))
    for depth in range(1, DEPTH + 1):
        weight = "weight" if depth < DEPTH else "1D"
        level = levels[depth].withColumn("parent", F.col("context") % F.lit(256 ** (depth - 1)))
        above = known.select(F.col("context").alias("parent"), "node", "one", "rest")
        known = level.join(above, ["parent", "node"]).select(
            "context", "node", F.expr(f"one + rest * {weight} * {ones}").alias("one"), F.expr(f"rest * (1 - {weight})").alias("rest")
        )
    # a context has at most 256 bytes, and 255 decisions
    known = known.groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("node", "one"))).alias("ones"))
    followed = leaves.groupBy("context").agg(F.collect_list(F.struct("key", "n")).alias("bytes"))
    chosen = followed.join(known, "context").select("ones", F.inline("bytes"))
    return chosen.select("key", F.expr(f"aggregate({BITS}, 0D, (sum, d) -> sum + log10(if(d.bit = 1, ones[d.node], 1 - ones[d.node])))").alias("score"), "n")


def _head(counts: DataFrame, most: int) -> DataFrame:
    """The rows of most occurrences n, at most ``most`` of them."""
    place = F.floor(F.log2("n") * 8).cast("int")
    sizes = counts.groupBy(place.alias("place")).agg(F.count("*").alias("rows")).collect()  # some hundreds at most
    held, least = 0, None
    for row in sorted(sizes, reverse=True):
        held += row["rows"]
        if held > most:
            break
        least = row["place"]
    return counts.filter(F.lit(False) if least is None else place >= least)


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: ``key``, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are lower-cased words and one end for each text; n_known counts
    those that occur in training documents.  base_score is the log10
    probability of the tokens by their counts, score that of the whole text
    under the context-tree model; both learn from documents not held out.
    Null counts as an empty text; repeated rows count, and are scored, each.
    """
    import numpy as np

    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), held_out(F.col(key)).alias("held_out")
    )
    units = written(_word_counts(rows), "word-counts")
    totals = units.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    ends = rows.filter(~F.col("held_out")).count()
    trained, different = (totals[0] or 0) + ends, (totals[1] or 0) + (ends > 0)
    below = trained + ADDED * (different + 1)
    predictions = written(_predictions(written(_leaves(rows), "leaves")), "predictions")
    found = _head(predictions, FEW_PREDICTIONS).select("key", "score").toArrow()
    keys, logs = found.column("key").to_numpy(), found.column("score").to_numpy()
    order = np.argsort(keys)
    words = _head(units, HEAD_UNITS).select("unit", "c").toArrow()
    known = dict(zip(words.column("unit").to_pylist(), words.column("c").to_pylist()))
    shared = docs.sparkSession.sparkContext.broadcast((known, keys[order], logs[order]))
    end_score = math.log10((ends + ADDED) / below)

    def score_texts(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        known, keys, logs = shared.value
        head = {u: (c, math.log10((c + ADDED) / below)) for u, c in known.items()}
        row = TaskContext.get().partitionId() << 33
        schema = pa.schema(
            [("row", pa.int64()), ("key", kind), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()),
             ("base", pa.float64()), ("score", pa.float64()), ("unit", pa.binary()), ("times", pa.int64())]
        )

        def scored(texts):
            """Scores of the frequent predictions by text, and the others as (text, key, times)."""
            key, owner = positions(_runs(texts))
            order = np.argsort(key)
            key, owner = key[order], owner[order]
            place = np.searchsorted(keys, key)
            there = np.zeros(len(key), dtype=bool)
            if len(keys):
                place = np.minimum(place, len(keys) - 1)
                there = keys[place] == key
            total = np.bincount(owner[there], weights=logs[place[there]], minlength=len(texts))
            rare = Counter(zip(owner[~there].tolist(), key[~there].tolist()))
            return total.tolist(), rare

        for names, held, texts in _texts(batches, "key", "held_out", "text"):
            for start, end in _stretches(texts, STRETCH // 2):
                total, rare = scored(texts[start:end])
                out = []
                for i in range(start, end):
                    known, base, counts = int(ends > 0), end_score, Counter(words_of(texts[i]))
                    for unit, n in counts.items():
                        found = head.get(unit)
                        if found is None:
                            out.append((row + i, None, None, None, 0, 0.0, 0.0, unit, n))
                        else:
                            known += n * (found[0] > 0)
                            base += n * found[1]
                    # a key that nothing has keeps the rows of texts spread over the join
                    no_unit = LAST + (row + i).to_bytes(8)
                    out.append((row + i, names[i], held[i], counts.total() + 1, known, base, total[i - start], no_unit, 1))
                for (owner, key), n in rare.items():
                    out.append((row + start + owner, None, None, None, 0, 0.0, 0.0, GAP + key.to_bytes(8), n))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            row += len(texts)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema[key].dataType)
    name = docs.schema[key].dataType.simpleString()
    found = rows.mapInArrow(
        score_texts, f"row bigint, key {name}, held_out boolean, n_tokens bigint, known bigint, base double, score double, unit binary, times bigint"
    )
    # words start with no byte that UTF-8 does not have, contexts with GAP
    context = F.concat(F.lit(GAP), F.unhex(F.lpad(F.hex("key"), 16, "0")))
    looked_up = units.select("unit", "c", F.lit(None).cast("double").alias("log"))
    looked_up = looked_up.unionByName(predictions.select(context.alias("unit"), F.lit(None).cast("long").alias("c"), F.col("score").alias("log")))
    found = found.join(looked_up, "unit", "left")
    found = found.select(
        "row", "key", "held_out", "n_tokens",
        (F.col("known") + F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"),
        (F.col("base") + F.coalesce(F.col("times") * F.log10((F.col("c") + ADDED) / below), F.lit(0.0))).alias("base"),
        (F.col("score") + F.coalesce(F.col("times") * F.col("log"), F.lit(0.0))).alias("score"),
    )
    found = found.groupBy("row").agg(
        F.max("key").alias(key), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score"),
    )
    return found.select(key, "held_out", "n_tokens", "n_known", F.lit(trained).cast("long").alias("train_tokens"), "base_score", "score")
