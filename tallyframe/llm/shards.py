"""Training order: token sequences permuted by a keyed Feistel network into fixed-stride shards.

Texts become token ids, cut into sequences.  Sequence i of n goes to slot
permuted(i), a bijection of 0..n-1 that needs no table: the network permutes
the next power of four, and places outside are walked on until they are
inside.  Tasks take ranges of slots and write records of one length in slot
order, so that a reader finds slot s by arithmetic and can resume anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import vocabulary
from .shared import few, mapped, written

ROUNDS = 6
LENGTH = 512
SHARD_RECORDS = 4096


def permuted(index, size: int, seed: int):
    """Slots of an array of indices below ``size``: a bijection that the seed chooses."""
    import numpy as np

    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = np.random.Generator(np.random.Philox(seed)).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)

    def network(x):
        left, right = x >> shift, x & mask
        for key in keys:
            mixed = (right ^ key) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        return (left << shift) | right

    with np.errstate(over="ignore"):
        slots = network(np.asarray(index, dtype=np.uint64))
        while (outside := slots >= size).any():
            slots[outside] = network(slots[outside])
    return slots.astype(np.int64)


TOKENS = T.StructType([T.StructField("tokens", T.BinaryType()), T.StructField("n_sequences", T.LongType()), T.StructField("digest", T.BinaryType())])
# Columns of a training order beside the key.
ADDED = ("shard", "slot", "index", "part", "n_tokens", "record")
# Bytes of records in a task that writes shards.
TASK_BYTES = 64 << 20


def _tokens(rows: DataFrame, model_path: str, length: int) -> DataFrame:
    """Adds packed ids (with begin and end), the number of sequences they fill, and a digest of the ids."""
    with open(model_path, "rb") as file:
        shared = rows.sparkSession.sparkContext.broadcast(file.read())

    def work():
        import numpy as np
        import xxhash

        vocab = vocabulary(shared.value)
        width = id_width(vocab.library.get_piece_size())

        def do(texts):
            packed, counts = [], []
            for ids in vocab.ids_of(texts):
                ids = np.concatenate([[vocab.begin], ids, [vocab.end]]).astype(f"<u{width}")
                packed.append(ids.tobytes())
                counts.append(-(-len(ids) // length))
            return [packed, counts, [xxhash.xxh3_128_digest(p) for p in packed]]

        return do

    return mapped(rows, ["text"], TOKENS, work).drop("text")


def id_width(vocabulary_size: int) -> int:
    """Bytes of an id in a record."""
    return 2 if vocabulary_size <= 1 << 16 else 4


def _numbered(tokens: DataFrame) -> tuple[DataFrame, int]:
    """Rows (row, first): the number of a text's first sequence, and how many sequences there are.

    Texts are numbered by key and digest of their ids, so that numbers do not
    depend on how rows lie in partitions.  Rows equal in both are sorted by
    their place in the table of tokens; their sequences are the same in any
    order.  The sort is by ranges of all three, which splits a frequent key;
    what reaches the driver is one sum for each range.
    """

    def before(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            counts = batch.column("n_sequences").to_numpy()
            ends = done + counts.cumsum()
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(ends - counts), pa.array(counts), pa.array([task] * batch.num_rows, pa.int32())],
                names=["row", "first", "n", "range"],
            )
            done = int(ends[-1]) if batch.num_rows else done

    order = ["key", "digest", "row"]
    narrow = tokens.select(*order, "n_sequences").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(narrow.select("row", "n_sequences").mapInArrow(before, "row bigint, first bigint, n bigint, range int"), "places")
    size, starts = 0, []
    for place, n in sorted(tuple(r) for r in placed.groupBy("range").agg(F.sum("n")).collect()):
        starts.append((place, size))
        size += n
    starts = tokens.sparkSession.createDataFrame(starts, "range int, start bigint")
    return placed.join(F.broadcast(starts), "range").select("row", (F.col("first") + F.col("start")).alias("first")), size


def _sequences(docs: DataFrame, model_path: str, key: str, text: str, length: int, seed: int, shard_records: int) -> tuple[DataFrame, DataFrame]:
    """The training order with records, and without."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from sentencepiece import SentencePieceProcessor

    width = id_width(SentencePieceProcessor(model_file=model_path).get_piece_size())
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    tokens = _tokens(rows, model_path, length).withColumn("row", F.monotonically_increasing_id())
    tokens = written(tokens, "tokens")
    places, size = _numbered(tokens)
    tokens = tokens.join(few(places), "row")
    step = length * width
    name = f"{key}_key" if key.lower() in ADDED else key
    fields = [("shard", T.LongType()), ("slot", T.LongType()), ("index", T.LongType()), (name, docs.schema[key].dataType), ("part", T.LongType()), ("n_tokens", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def cut_up(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                counts, sizes = part.column("n_sequences").to_numpy(), part.column("n_ids").to_numpy()
                owner = np.repeat(np.arange(len(counts)), counts)
                place = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
                index = part.column("first").to_numpy()[owner] + place
                slot = permuted(index, size, seed)
                columns = [
                    pa.array(slot // shard_records), pa.array(slot), pa.array(index), part.column("key").take(pa.array(owner)), pa.array(place),
                    pa.array(np.minimum(sizes[owner] - place * length, length)),
                ]
                if "tokens" in part.schema.names:
                    whole = part.column("tokens").to_pylist()
                    columns.append(pa.array([whole[o][p * step : (p + 1) * step] for o, p in zip(owner, place)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema=to_arrow_schema(schemas[len(columns)]))

    schemas = {len(s): s for s in (schema, T.StructType([*schema, T.StructField("record", T.BinaryType())]))}
    narrow = tokens.select("key", "n_sequences", "first", (F.octet_length("tokens") / width).cast("long").alias("n_ids"))
    whole = tokens.select("tokens", *narrow.columns[:-1], (F.octet_length("tokens") / width).cast("long").alias("n_ids"))
    found = whole.mapInArrow(cut_up, schemas[len(schema) + 1])
    # tasks take ranges of shards
    shards = max(1, -(-size // shard_records))
    tasks = max(1, min(shards, -(-size * step // TASK_BYTES)))
    found = found.repartitionById(tasks, F.floor(F.col("shard") * tasks / shards).cast("int")).sortWithinPartitions("shard", "slot")
    return found.withColumn("record", F.rpad("record", F.lit(step), F.lit(b"\0"))), narrow.mapInArrow(cut_up, schema)


def training_order(
    docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text",
    length: int = LENGTH, seed: int = 0, shard_records: int = SHARD_RECORDS,
) -> DataFrame:
    """One row per sequence: shard, slot, index, ``key``, part, n_tokens, record; rows of a shard are together, by slot.

    Each text's ids, with begin and end, are cut into parts of ``length`` ids;
    the record is a part's ids, little-endian, filled up with zero bytes to
    the full length.  index counts the sequences by key (nulls first), digest
    of the text's ids and part, so it is the same however rows lie in
    partitions; slot is its place in the training order, and shard is slot div
    ``shard_records``.  A null or empty text has begin and end only; repeated
    rows give sequences each; no rows give no rows.  Other columns are left
    out; a key named like an added column is returned as ``<key>_key``.
    """
    return _sequences(docs, model_path, key, text, length, seed, shard_records)[0]


def materialised(
    docs: DataFrame, model_path: str, path: str, key: str = "doc_id", text: str = "text",
    length: int = LENGTH, seed: int = 0, shard_records: int = SHARD_RECORDS,
) -> DataFrame:
    """Writes the shards of :func:`training_order` to ``path`` and gives back what the files hold.

    One row per record read from the shards: slot, record_sha256 (hex), and of
    the training order shard, index, ``key``, part and n_tokens.
    """
    from sentencepiece import SentencePieceProcessor

    whole, narrow = _sequences(docs, model_path, key, text, length, seed, shard_records)
    write_shards(whole, path)
    step = length * id_width(SentencePieceProcessor(model_file=model_path).get_piece_size())
    records = read_shards(docs.sparkSession, path, step, shard_records)
    return narrow.join(records.select("slot", F.sha2("record", 256).alias("record_sha256")), "slot")


def write_shards(sequences: DataFrame, path: str) -> None:
    """Writes the records as ``path``/shard=<k>/part-*: in slot order, one line feed after each.

    Spark's own writer commits whole tasks, so executors may be lost.
    """
    lines = sequences.select("shard", F.col("record").cast("string").alias("value"))
    lines.write.partitionBy("shard").text(path)


def read_shards(spark: SparkSession, path: str, stride: int, shard_records: int = SHARD_RECORDS, start: int = 0) -> DataFrame:
    """Rows (slot, record) from slot ``start`` on; earlier shards are not opened. ``stride``: bytes of a record.

    No rows where no sequences were written.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    if "shard" not in files.columns:
        return spark.createDataFrame([], "slot bigint, record binary")
    files = files.filter(F.col("shard") >= start // shard_records).select("shard", "content")
    rows = files.select("shard", "content", F.explode(F.expr(f"sequence(0, cast(length(content) / {stride + 1} as int) - 1)")).alias("i"))
    rows = rows.select(
        (F.col("shard") * shard_records + F.col("i")).cast("long").alias("slot"), F.substring("content", F.col("i") * (stride + 1) + 1, F.lit(stride)).alias("record")
    )
    return rows.filter(F.col("slot") >= start)
