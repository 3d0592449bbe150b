import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("copy", T.StringType()),
     T.StructField("N_Tokens", T.StringType()), T.StructField("Score", T.StringType()), T.StructField("_row", T.StringType()), T.StructField("_key", T.StringType()), T.StructField("document", T.StringType())]
)

LONG = " ".join(f"w{i * 7919 % 1009}" for i in range(20_000))
DIRTY = [
    (0, None), (1, ""), (2, "   "), (3, "\n\n\t"), (4, "one"), (5, "One"), (6, "one  two"), (7, "one two"), (8, " one two"),
    (9, LONG), (10, LONG + " more"), (11, LONG), (None, "one two"), (None, None), (7, "one two"), (12, "x" * 30_000),
    (13, "The same long line stands here again and again, 17 times.\nother"),
    (14, "the same long line stands here again and again 99 times\nand more"),
    (15, "é ▁ñ\x00\U0001F600  <s> <0x0A> ends  "), (16, "\n".join(["a line that is said twice in one text"] * 2)),
]


@pytest.fixture(scope="session")
def dirty(spark):
    """Null ids and texts, empty, blank, very long and repeated ones, and columns that operators name, too."""
    rows = [(i, t, "en", None if i in (3, 4) else "a" if i is None or i % 3 else "b", len(t or ""), "c", "n", "s", "r", "k", "d") for i, t in DIRTY]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
