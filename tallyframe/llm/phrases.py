"""Phrase collocations, counted in counting quotient filters.

1. Tasks split texts into pieces and words and write blocks of words, each
   with a dictionary of its own.  Words that are frequent in their language get
   dense ids; blocks are then rewritten in ids, by a join of dictionaries.
2. For phrases of two, three and four words each task packs the ids of every
   place into one number, permutes it by an invertible mix and keeps it in a
   counting quotient filter: the leading bits are the place (shard and slot),
   all other bits are stored, so nothing is lost and every count is exact.
3. Filters are sorted by construction.  A shard receives those of all tasks for
   its range of quotients, merges them, and turns frequent entries back into ids.
   A place is counted only if both phrases that are one word shorter may be
   frequent; a bitmap of fixed size, which may say yes too often, tells.
4. Cuts, scores and containment are joins of the frequent phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .shared import as_list, written

# Separators of pieces; they become a byte that UTF-8 lacks.
SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
BREAK = b"\xff"
PIECES = bytes.maketrans(SEPARATORS, BREAK * len(SEPARATORS))
LONGEST = 4
MIN_COUNT = 30
CONTAINED_PERCENT = 80
TOP = 2000
SCALE = 2_000_000
# Words that a task holds before it writes them as blocks.
BLOCK_WORDS = 1 << 21
# Entries that a task folds at once, those of its table from which it is written, and numbers in one row of encoded words.
FOLD = 1 << 19
TABLE = 3 << 20
ROW_IDS = 1 << 18
# Encoded words of all blocks that one shard of counters stands for.
SHARD_BYTES = 16 << 20
ID_SPREAD = 4096
# Bits of the bitmap of shorter phrases, and of one row of it.
MAP_BITS = 26
MAP_ROW_BITS = 16


class _Numbers(dict):
    """Words by order of appearance; a break of pieces is -1."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 1
        return number


def _blocks(docs: DataFrame) -> DataFrame:
    """Rows (block, lang, words, counts, codes): a dictionary, and the numbers of words in it as int32."""
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("words", T.ArrayType(T.StringType())),
         T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("codes", T.BinaryType())]
    )

    def split(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 32, {}, 0

        def flushed():
            nonlocal block
            for lang, (numbers, parts) in held.items():
                codes = np.concatenate(parts)
                counts = np.bincount(codes + 1, minlength=len(numbers))[1:]
                words = list(numbers)[1:]
                if words:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block]), pa.array([lang]),
                         pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words, pa.binary()).cast(pa.string())),
                         pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(counts, pa.int64())),
                         pa.array([codes.tobytes()], pa.binary())],
                        names=schema.names,
                    )
                    block += 1
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), as_list(batch.column(1))):
                # split() also takes the other ASCII white space, which has become breaks
                words = text.lower().translate(PIECES).replace(BREAK, b" \xff ").split()
                if lang not in held:
                    held[lang] = (_Numbers({BREAK: -1}), [])
                numbers, parts = held[lang]
                words.append(BREAK)
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                size += len(words)
                if size >= BLOCK_WORDS:
                    yield from flushed()
                    size = 0
        yield from flushed()

    return docs.mapInArrow(split, schema)


def _dense_ids(vocabulary: DataFrame) -> DataFrame:
    """Adds id: 0, 1, ... by the hash of (lang, word), so whatever the partitions are.

    Numbers start anew in each of ``ID_SPREAD`` parts and are moved by the sizes of the parts before.
    """
    rows = vocabulary.withColumn("part", F.pmod(F.xxhash64("lang", "word"), F.lit(ID_SPREAD)))
    sizes = rows.groupBy("part").count()
    # one row per part: a window over all of them is small whatever the vocabulary
    before = F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("part").orderBy("lang", "word"))
    rows = rows.withColumn("place", place).join(F.broadcast(sizes), "part")
    return rows.select("lang", "word", "a", (F.col("before") + F.col("place") - 1).alias("id"))


def _encoded(blocks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows (ids): frequent words as int32; breaks, rare words and ends as -1."""
    words = blocks.select("block", "lang", F.posexplode("words").alias("code", "word"))
    found = words.join(vocabulary.select("lang", "word", "id"), ["lang", "word"])
    found = found.groupBy("block").agg(F.collect_list("code").alias("from"), F.collect_list(F.col("id").cast("int")).alias("to"))
    rows = blocks.select("block", F.size("words").alias("size"), "codes").join(found, "block")

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                size, codes = batch.column("size")[i].as_py(), np.frombuffer(batch.column("codes")[i].as_py(), np.int32)
                ids = np.full(size + 1, -1, np.int32)
                ids[batch.column("from")[i].values.to_numpy()] = batch.column("to")[i].values.to_numpy()
                out = ids[codes]
                # a number with none beside it starts no phrase
                known = out >= 0
                joined = known & (np.append(known[1:], False) | np.append(False, known[:-1]))
                out = np.where(joined, out, np.int32(-1))
                out = out[joined | np.append(True, joined[:-1])]
                for start in range(0, len(out), ROW_IDS):
                    # rows overlap by what a phrase needs, which is told by where it starts
                    part = out[start : start + ROW_IDS + LONGEST - 1]
                    yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary())], names=["ids"])

    return rows.select("size", "codes", "from", "to").mapInArrow(encode, "ids binary")


# Odd constants of the mix.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


def _mixed(x, constant: int):
    import numpy as np

    x = (x + np.uint64(1)) * np.uint64(constant)
    return x ^ (x >> np.uint64(29)) ^ (x >> np.uint64(47))


def _mask(bits: int):
    import numpy as np

    return np.uint64((1 << bits) - 1)


def permuted(left, right, bits: tuple[int, int], back: bool = False):
    """A permutation of numbers of two halves: halves are mixed into each other in turn, or out of each other."""
    masks = [_mask(b) for b in bits]
    for step, constant in list(enumerate(MIX))[:: -1 if back else 1]:
        if step % 2:
            right = right ^ (_mixed(left, constant) & masks[1])
        else:
            left = left ^ (_mixed(right, constant) & masks[0])
    return left, right


def halves(size: int, id_bits: int) -> tuple[int, int]:
    """Bits of the leading and the trailing words of a phrase of ``size`` words."""
    return id_bits * (size - size // 2), id_bits * (size // 2)


def packed(ids, starts, size: int, id_bits: int):
    """The ids of the phrases that start at ``starts`` as two numbers."""
    import numpy as np

    lead, parts = size - size // 2, []
    for first, last in ((0, lead), (lead, size)):
        x = np.zeros(len(starts), np.uint64)
        for i in range(first, last):
            x = (x << np.uint64(id_bits)) | ids[starts + i].astype(np.uint64)
        parts.append(x)
    return parts


def folded(left, right, counts, bits: tuple[int, int]):
    """Sorted different entries with the sums of their counts (None: each counts once)."""
    import numpy as np

    if sum(bits) <= 64:
        keys = (left << np.uint64(bits[1])) | right
        if counts is None:
            keys, sums = np.unique(keys, return_counts=True)
            return keys >> np.uint64(bits[1]), keys & _mask(bits[1]), sums
        order = np.argsort(keys, kind="stable")
    else:
        order = np.lexsort((right, left))
    left, right = left[order], right[order]
    new = np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1]))[: len(left)]
    firsts = np.flatnonzero(new)
    ones = np.ones(len(left), np.int64) if counts is None else counts[order]
    sums = np.add.reduceat(ones, firsts) if len(firsts) else ones
    return left[firsts], right[firsts], sums


def merged(table, new, bits: tuple[int, int]):
    """Sorted different entries of both, with the sums of their counts; ``table`` may be changed.

    The new entries are looked up in the table, so that beside it only its keys and one column of it are held.
    """
    import numpy as np

    if sum(bits) > 64 or not len(table[0]):
        return folded(*[np.concatenate(x) for x in zip(table, new)], bits)
    left, right, counts = table
    keys = left << np.uint64(bits[1])
    keys |= right
    wanted = (new[0] << np.uint64(bits[1])) | new[1]
    places = np.searchsorted(keys, wanted)
    known = keys[np.minimum(places, len(keys) - 1)] == wanted
    del keys, wanted
    # the keys of either side are different, so no place is named twice
    counts[places[known]] += new[2][known]
    places, other = places[~known], [x[~known] for x in new]
    left = np.insert(left, places, other[0])
    right = np.insert(right, places, other[1])
    return left, right, np.insert(counts, places, other[2])


def _small(values) -> tuple[bytes, bytes]:
    """One byte each; 255 sends to the second list."""
    import numpy as np

    large = values >= 255
    return np.where(large, 255, values).astype(np.uint8).tobytes(), values[large].astype(np.int64).tobytes()


def _unsmall(small: bytes, large: bytes):
    import numpy as np

    values = np.frombuffer(small, np.uint8).astype(np.int64)
    values[values == 255] = np.frombuffer(large, np.int64)
    return values


def filter_of(left, right, counts, bits: tuple[int, int], shard_bits: int) -> dict:
    """The counting quotient filter of sorted entries of one shard.

    The quotient of an entry is its shard and slot, as many slots as entries
    (rounded down to a power of two).  A slot keeps how many remainders fall to
    it; remainders are whole and in order, counters stand beside them.
    """
    import numpy as np

    slot_bits = max(0, min(len(left).bit_length() - 1, bits[0] - shard_bits))
    low = bits[0] - shard_bits - slot_bits
    slots = (left >> np.uint64(low)) & _mask(slot_bits)
    runs = np.bincount(slots.astype(np.int64), minlength=1 << slot_bits)
    out = {"slots": slot_bits}
    out["runs"], out["long_runs"] = _small(runs)
    out["counts"], out["long_counts"] = _small(counts)
    for name, part, width in (("heads", left & _mask(low), low), ("tails", right, bits[1])):
        rows = np.ascontiguousarray(part.astype("<u8")).view(np.uint8).reshape(-1, 8)
        out[name] = rows[:, : -(-width // 8)].tobytes()
    return out


def entries_of(row: dict, bits: tuple[int, int], shard: int, shard_bits: int):
    """The sorted entries of a filter: what ``filter_of`` was given."""
    import numpy as np

    counts = _unsmall(row["counts"], row["long_counts"])
    low = bits[0] - shard_bits - row["slots"]
    parts = []
    for name, width in (("heads", low), ("tails", bits[1])):
        wide = np.zeros((len(counts), 8), np.uint8)
        nbytes = -(-width // 8)
        wide[:, :nbytes] = np.frombuffer(row[name], np.uint8).reshape(len(counts), nbytes)
        parts.append(wide.view("<u8").ravel())
    slots = np.repeat(np.arange(1 << row["slots"], dtype=np.uint64), _unsmall(row["runs"], row["long_runs"]))
    quotient = (np.uint64(shard) << np.uint64(row["slots"])) | slots
    return (quotient << np.uint64(low)) | parts[0], parts[1], counts


FILTER = T.StructType(
    [T.StructField("shard", T.LongType()), T.StructField("slots", T.IntegerType()),
     *[T.StructField(n, T.BinaryType()) for n in ("runs", "long_runs", "counts", "long_counts", "heads", "tails")]]
)
FREQUENT = T.StructType([T.StructField("p", T.ArrayType(T.LongType())), T.StructField("a", T.LongType()), T.StructField("spot", T.LongType())])


def _spots(left, right):
    import numpy as np

    return _mixed(_mixed(left, MIX[1]) ^ right, MIX[2]) >> np.uint64(64 - MAP_BITS)


def _bit(bitmap, spots):
    import numpy as np

    return (bitmap[(spots >> np.uint64(3)).astype(np.int64)] >> (spots & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _starts(ids, size: int, id_bits: int, bitmaps: dict):
    """Where phrases of ``size`` words start whose shorter parts may all be frequent."""
    import numpy as np

    known = ids >= 0
    starts = np.flatnonzero(known[:-1] & known[1:])
    for n in range(2, size):
        starts = starts[_bit(bitmaps[n], _spots(*packed(ids, starts, n, id_bits)))]
        # a longer phrase has two parts of this size, the second starts one word on
        starts = starts[:-1][starts[1:] == starts[:-1] + 1]
    return starts


def _filters(encoded: DataFrame, size: int, id_bits: int, shard_bits: int, bitmaps: dict) -> DataFrame:
    bits = halves(size, id_bits)

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        maps = {n: np.frombuffer(b.value, np.uint8) for n, b in bitmaps.items()}
        arrow = to_arrow_schema(FILTER)
        held, waiting, table = [], 0, None

        def fold():
            nonlocal table, held, waiting
            if held:
                left, right = (np.concatenate([h[i] for h in held]) for i in (0, 1))
                held, waiting = [], 0
                new = folded(left, right, None, bits)
                old, table = table, None
                table = new if old is None else merged(old, new, bits)

        def flushed():
            nonlocal table
            if table is not None:
                left, right, counts = table
                shards = (left >> np.uint64(bits[0] - shard_bits)).astype(np.int64)
                firsts = np.flatnonzero(np.append(True, shards[1:] != shards[:-1]))
                for a, b in zip(firsts, [*firsts[1:], len(shards)]):
                    row = filter_of(left[a:b], right[a:b], counts[a:b], bits, shard_bits) | {"shard": int(shards[a])}
                    yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in arrow], schema=arrow)
                table = None

        for batch in batches:
            for whole in batch.column(0):
                ids = np.frombuffer(whole.as_buffer(), np.int32)
                starts = _starts(ids, size, id_bits, maps)
                starts = starts[starts < ROW_IDS]
                starts = starts[starts + size <= len(ids)]
                if len(starts):
                    held.append(permuted(*packed(ids, starts, size, id_bits), bits))
                    waiting += len(starts)
                if waiting >= FOLD:
                    fold()
                    if len(table[0]) >= TABLE:
                        yield from flushed()
        fold()
        yield from flushed()

    return encoded.mapInArrow(count, FILTER)


def _merged(filters: DataFrame, size: int, id_bits: int, shard_bits: int, min_count: int) -> DataFrame:
    """Rows (p, a, spot) of the frequent phrases of merged filters."""
    bits, lead = halves(size, id_bits), size - size // 2

    def merge(part):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        shard = part.column("shard")[0].as_py()
        kept, waiting, table = [], 0, None
        rows = part.drop_columns("shard")
        for i in range(rows.num_rows):
            kept.append(entries_of(rows.slice(i, 1).to_pylist()[0], bits, shard, shard_bits))
            waiting += len(kept[-1][0])
            if waiting >= FOLD or i + 1 == rows.num_rows:
                new = folded(*[np.concatenate(x) for x in zip(*kept)], bits)
                kept, waiting = [], 0
                table = new if table is None else merged(table, new, bits)
        left, right, counts = table
        often = counts >= min_count
        left, right = permuted(left[often], right[often], bits, back=True)
        ids = []
        for half, words in ((left, lead), (right, size - lead)):
            ids += [(half >> np.uint64(id_bits * (words - 1 - i))) & _mask(id_bits) for i in range(words)]
        ids = np.stack(ids, axis=1).astype(np.int64) if len(left) else np.zeros((0, size), np.int64)
        p = pa.ListArray.from_arrays(pa.array(np.arange(len(left) + 1) * size, pa.int32()), pa.array(ids.ravel()))
        columns = [p, pa.array(counts[often], pa.int64()), pa.array(_spots(left, right).astype(np.int64))]
        schema = to_arrow_schema(FREQUENT)
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return filters.groupBy("shard").applyInArrow(merge, FREQUENT)


def _bitmap(frequent: DataFrame):
    """Broadcast bitmap of the spots of frequent phrases: 2 ** ``MAP_BITS`` bits whatever their number."""
    size = 1 << MAP_ROW_BITS

    def mark(part):
        import numpy as np
        import pyarrow as pa

        row = part.column("row")[0].as_py()
        bits = np.zeros(size, np.uint8)
        bits[part.column("spot").to_numpy() - row * size] = 1
        return pa.table({"row": pa.array([row], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    spots = frequent.select(F.floor(F.col("spot") / size).cast("long").alias("row"), "spot").distinct()
    whole = bytearray(1 << (MAP_BITS - 3))
    for row, bits in spots.groupBy("row").applyInArrow(mark, "row bigint, bits binary").collect():
        whole[row * size // 8 : (row + 1) * size // 8] = bits
    return frequent.sparkSession.sparkContext.broadcast(bytes(whole))


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables (lang, n), (lang, word, a, id) and (p, a): all words, frequent words, frequent phrases of 2 to 4.

    p holds ids of words.  Words of different languages have different ids.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    blocks = written(_blocks(rows), "word-blocks")
    words = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    counted = written(words.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("a")), "word-counts")
    totals = counted.groupBy("lang").agg(F.sum("a").alias("n"))
    vocabulary = written(_dense_ids(counted.filter(F.col("a") >= min_count)), "frequent-words")
    id_bits = max(1, vocabulary.count().bit_length())
    if id_bits > 31:
        raise ValueError("more than 2 ** 31 frequent words")
    encoded = written(_encoded(blocks, vocabulary), "encoded-words")
    n_bytes = encoded.agg(F.sum(F.length("ids"))).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_bytes // SHARD_BYTES)
    found, bitmaps = None, {}
    for size in range(2, LONGEST + 1):
        shard_bits = min(shards.bit_length(), halves(size, id_bits)[0])
        filters = _filters(encoded, size, id_bits, shard_bits, bitmaps)
        frequent = written(_merged(filters, size, id_bits, shard_bits, min_count), "frequent-phrases")
        if size < LONGEST:
            bitmaps[size] = _bitmap(frequent)
        found = frequent.select("p", "a") if found is None else found.unionByName(frequent.select("p", "a"))
    return totals, vocabulary, found


def _wide(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(20,0)")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are A-Z lower-cased and split at ``.,;:!?`` and line breaks into
    pieces, these at spaces and tabs into words.  A phrase is 2 to 4 words that
    stand side by side in a piece ``a`` times, ``min_count`` or more.  A cut
    into two parts that occur l and r times scores 2000000 a / (l + r), rounded
    down; the lowest counts, of equal ones that with the shorter first part.
    Phrases with 80 % of their places in one longer phrase are left out.
    Order: score and a falling, then the phrase by bytes.

    n counts all words of a language.  A null text is empty and a null language
    ``und``; repeated rows count each; other columns are not looked at; no rows
    give no rows.  Counts are exact; products have 38 digits.
    """
    totals, vocabulary, phrases = frequent_phrases(docs, text, lang, min_count)
    counts = phrases.unionByName(vocabulary.select(F.array(F.col("id").cast("long")).alias("p"), "a"))
    size = F.size("p")
    # of each sub-phrase, the most frequent phrase around it
    inner = F.expr("flatten(transform(sequence(2, greatest(size(p) - 1, 2)), n -> transform(sequence(1, size(p) - n + 1), i -> slice(p, i, n))))")
    around = phrases.filter(size > 2).select(F.explode(inner).alias("p"), F.col("a").alias("longer")).groupBy("p").agg(F.max("longer").alias("longer"))
    kept = phrases.join(around, "p", "left").filter(
        F.coalesce(_wide("longer") * 100 < _wide("a") * CONTAINED_PERCENT, F.lit(True))
    ).select("p", "a")
    cuts = kept.select("p", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("p", "a", "k", F.slice("p", F.lit(1), F.col("k")).alias("head"), F.slice("p", F.col("k") + 1, size - F.col("k")).alias("tail"))
    cuts = cuts.join(counts.select(F.col("p").alias("head"), F.col("a").alias("l")), "head")
    cuts = cuts.join(counts.select(F.col("p").alias("tail"), F.col("a").alias("r")), "tail")
    cuts = cuts.withColumn("score", F.expr(f"(cast(a as decimal(20,0)) * cast({SCALE} as decimal(17,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    scored = cuts.groupBy("p").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c")).select("p", "c.score", "c.a", "c.l", "c.r")
    spelled = scored.select("p", F.posexplode("p").alias("at", "id")).join(vocabulary.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("p").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    spelled = spelled.select("p", "lang", F.array_join("words.word", " ").alias("phrase"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    # the limit on the bare rank lets Spark apply it before the shuffle
    ranked = scored.join(spelled, "p").withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
 unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_ALPHABET}', '{_ALPHABET.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces),
g AS (SELECT lang, k, ws[i:i + k - 1] AS p FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, p, count(*)::HUGEINT AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= {MIN_COUNT}),
around AS (SELECT lang, q AS p, max(a) AS longer FROM (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: p[i:i + m - 1])))) AS q FROM c WHERE k > 2) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN around USING (lang, p) WHERE longer IS NULL OR 100 * longer < {CONTAINED_PERCENT} * c.a),
cuts AS (SELECT lang, p, a, k, j, p[1:j] AS head, p[j + 1:] AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)),
scored AS (SELECT c.lang, c.p, c.a, l.a AS l, r.a AS r, ({SCALE} * c.a) // (l.a + r.a) AS score,
 row_number() OVER (PARTITION BY c.lang, c.p ORDER BY ({SCALE} * c.a) // (l.a + r.a), j) AS o
 FROM cuts c JOIN f l ON l.lang = c.lang AND l.p = c.head JOIN f r ON r.lang = c.lang AND r.p = c.tail),
ranked AS (SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM scored WHERE o = 1)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}"""
