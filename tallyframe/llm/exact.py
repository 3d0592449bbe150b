"""Exact duplicates by Grace hashing: partition by hash, then compare whole contents in tables.

1. Each task folds the copies it meets in its own input, so a text with a
   third of all rows leaves a task once per full table, not once per row.
2. One representative of each fold is dealt out by the hash of its content.
3. A task keeps its bucket's contents in an open-addressing table (a dict of
   the whole normalised texts) of bounded size.  Contents that no longer fit
   are written out whole, dealt again by another hash, and so on until none is
   left over.  What is over goes to the shared folder, so lost executors cost
   a task only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import TABLE_BYTES, as_list, written

# What one entry of a table takes beside its text.
ENTRY_BYTES = 400


def normalised(text: bytes | None) -> bytes:
    """White-space runs (space, tab to carriage return) as one space; null as empty."""
    if not text:
        return b""
    inner = b" ".join(text.split())
    if not inner:
        return b" "
    return b" " * text[:1].isspace() + inner + b" " * text[-1:].isspace()


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``key``, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical once every run of white space is
    one space; null counts as empty.  Of equal texts the row with the smallest
    key stays; nulls come last, and of rows with one key a single row stays.
    keep_id is null where no row of the group has a key.  Other columns are not
    looked at; no rows give no rows.
    """
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    levels = [written(_tables(_folded(rows, kind, table_bytes), kind, table_bytes, 0), "compared-texts")]
    while levels[-1].filter("spilled").limit(1).count():
        over = levels[-1].filter("spilled")
        levels.append(written(_tables(over, kind, table_bytes, len(levels)), "spilled-texts"))
    done = levels[0]
    for level in levels[1:]:
        done = done.unionByName(level)
    done = done.filter("not spilled")
    leaders = done.filter("n is not null").select(
        F.col("leader"), F.col("best").alias("keep_id"), F.col("best_row").alias("keep_row"),
        F.col("n").alias("group_size"), F.col("sha").alias("text_sha256"),
    )
    # a row folded on the map side names its representative, which names its leader
    own = done.filter("member = rep")
    others = done.filter("member <> rep").select("member", "key", "rep")
    others = others.join(own.select("rep", "leader"), "rep")
    members = own.select("member", "key", "leader").unionByName(others.select("member", "key", "leader"))
    return members.join(leaders, "leader").select(
        F.col("key").alias(key), "keep_id", "group_size",
        (F.col("member") == F.col("keep_row")).alias("kept"), "text_sha256",
    )


def _schema(kind: T.DataType) -> T.StructType:
    """member: the row; rep: what it was folded into; leader: the first of equal contents.

    n, best, best_row: size and row to keep, of what the row stands for.
    text: the content where it is still to be compared.
    """
    return T.StructType(
        [T.StructField(n, t) for n, t in (
            ("route", T.LongType()), ("member", T.LongType()), ("key", kind), ("rep", T.LongType()),
            ("leader", T.LongType()), ("n", T.LongType()), ("best", kind), ("best_row", T.LongType()),
            ("text", T.BinaryType()), ("sha", T.StringType()), ("spilled", T.BooleanType()),
        )]
    )


def _batches(rows: list, schema) -> Iterator:
    import pyarrow as pa

    for start in range(0, len(rows), 1024):
        part = rows[start : start + 1024]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)


def _hash(content: bytes, level: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(content, seed=level) - (1 << 63)


def _better(a: tuple, b: tuple) -> tuple:
    """The row to keep of two (key, row): keys before nulls, then smallest."""
    if a[0] is None or b[0] is None:
        return b if a[0] is None and (b[0] is not None or b[1] < a[1]) else a
    return min(a, b)


def _folded(rows: DataFrame, kind: T.DataType, table_bytes: int) -> DataFrame:
    schema = _schema(kind)

    def fold(batches: Iterator) -> Iterator:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        row = TaskContext.get().partitionId() << 33
        table, held, others = {}, 0, []

        def flushed():
            for content, (rep, key, n, best) in table.items():
                yield (_hash(content, 0), rep, key, rep, None, n, best[0], best[1], content, None, True)

        for batch in batches:
            for key, text in zip(*(as_list(batch.column(i)) for i in (0, 1))):
                content = normalised(text)
                entry = table.get(content)
                if entry is None:
                    table[content] = [row, key, 1, (key, row)]
                    held += len(content) + ENTRY_BYTES
                else:
                    entry[2] += 1
                    entry[3] = _better(entry[3], (key, row))
                    others.append((_hash(row.to_bytes(8), 0), row, key, entry[0], None, None, None, None, None, None, False))
                row += 1
                if held > table_bytes:
                    yield from _batches(list(flushed()), arrow)
                    table, held = {}, 0
                if len(others) >= 4096:
                    yield from _batches(others, arrow)
                    others = []
        yield from _batches([*flushed(), *others], arrow)

    return rows.mapInArrow(fold, schema)


def _tables(rows: DataFrame, kind: T.DataType, table_bytes: int, level: int) -> DataFrame:
    """Each bucket through a table: links to leaders, sizes, and what did not fit."""
    schema = _schema(kind)
    names = [f.name for f in schema]

    def compare(batches: Iterator) -> Iterator:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        table, held = {}, 0
        for batch in batches:
            out = []
            for values in zip(*(batch.column(n).to_pylist() for n in names)):
                route, member, key, rep, _, n, best, best_row, text, _, spilled = values
                if not spilled:
                    out.append(values)
                    continue
                entry = table.get(text)
                if entry is None and held > table_bytes:
                    out.append((_hash(text, level + 1), member, key, rep, None, n, best, best_row, text, None, True))
                    continue
                if entry is None:
                    table[text] = entry = [rep, n, (best, best_row)]
                    held += len(text) + ENTRY_BYTES
                else:
                    entry[1] += n
                    entry[2] = _better(entry[2], (best, best_row))
                out.append((route, member, key, rep, entry[0], None, None, None, None, None, False))
            yield from _batches(out, arrow)
        totals = [
            (0, None, None, None, leader, n, best[0], best[1], None, hashlib.sha256(text).hexdigest(), False)
            for text, (leader, n, best) in table.items()
        ]
        yield from _batches(totals, arrow)

    return rows.repartition("route").mapInArrow(compare, schema)


ORACLE = """WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
 doc_id = min(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256 FROM t"""
