"""Near duplicates by min-max hashing, confirmed on whole shingle sets.

Each hash function gives two signature values, its minimum and its maximum
over a document's shingles; both agree between two documents with probability
equal to their Jaccard similarity.  Bands of values deal documents into
buckets, and buckets make groups by comparing members with few centres.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import cut
from .shared import bucket_groups, mapped, written

# Values to a band, and the largest chance that a pair at the threshold shares no band.
ROWS = 4
MISS = 1e-6
# Keys of at most so many rows (16 bytes each) may be broadcast; more are joined by shuffle.
FEW_KEYS = 1_000_000
# Documents of either side, and shingles, of which a task compares all at once.
BLOCK, COLUMNS = 512, 1 << 13


def bands_for(percent: int) -> int:
    """Bands so that a pair at the threshold is missed with a chance of at most MISS."""
    needed = math.log(MISS) / math.log(1 - (percent / 100) ** ROWS)
    return 2 * math.ceil(needed / 2)


def _mix(x):
    """Finaliser of a 64-bit hash, for arrays."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Signer:
    """Shingle hashes and band values of token sequences."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, words: int, bands: int, seed: int = 1):
        import numpy as np

        draw = np.random.Generator(np.random.Philox(seed))
        self.words, self.bands = words, bands
        functions = bands * ROWS // 2
        self.factors = draw.integers(0, 1 << 63, functions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.offsets = draw.integers(0, 1 << 63, functions, dtype=np.uint64)
        self.places = draw.integers(0, 1 << 63, max(words, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.band_salt = _mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(self.BASE))
        self.order = draw.permutation(bands * ROWS)

    def word_hashes(self, tokens: list[bytes]):
        import numpy as np
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        return np.fromiter(map(digest, tokens), dtype=np.uint64, count=len(tokens))

    def shingles(self, hashes):
        """Distinct shingle hashes; a shorter text is one shingle."""
        import numpy as np

        n = min(self.words, len(hashes))
        starts = len(hashes) - n + 1
        total = np.full(starts, n, dtype=np.uint64)
        for k in range(n):
            total += hashes[k : k + starts] * self.places[k]
        return np.unique(_mix(total))

    def band_values(self, shingles):
        import numpy as np

        low = np.full(len(self.factors), ~np.uint64(0))
        high = np.zeros(len(self.factors), dtype=np.uint64)
        for start in range(0, len(shingles), 4096):
            values = shingles[start : start + 4096, None] * self.factors + self.offsets
            low, high = np.minimum(low, values.min(axis=0)), np.maximum(high, values.max(axis=0))
        values = np.concatenate([low, high])[self.order].reshape(self.bands, ROWS)
        return _mix((_mix(values) * self.places[:ROWS]).sum(axis=1, dtype=np.uint64) + self.band_salt).astype(np.int64)


SIGNED = T.StructType(
    [
        T.StructField("_node", T.BinaryType()),
        T.StructField("_n_shingles", T.LongType()),
        T.StructField("_bands", T.ArrayType(T.LongType())),
        T.StructField("_words", T.BinaryType()),
    ]
)


def _signed(rows: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """Adds _node (digest of the token sequence), the number of shingles, band values and the tokens."""
    bands = bands_for(percent)

    def work():
        import numpy as np
        import xxhash

        signer = Signer(words, bands)
        np.seterr(over="ignore")

        def do(texts):
            nodes, counts, values, sequences = [], [], [], []
            for t in texts:
                tokens = t.lower().split() if t else []
                if not tokens:
                    nodes.append(None), counts.append(0), values.append(None), sequences.append(None)
                    continue
                sequence = b" ".join(tokens)
                found = signer.shingles(signer.word_hashes(tokens))
                nodes.append(xxhash.xxh3_128_digest(sequence))
                counts.append(len(found))
                values.append(signer.band_values(found))
                sequences.append(sequence)
            return [nodes, counts, values, sequences]

        return do

    return mapped(rows, [text], SIGNED, work)


def _shingle_set(sequence: bytes, words: int) -> set[bytes]:
    tokens = sequence.split(b" ")
    n = min(words, len(tokens))
    return {b" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1)}


def _similar_enough(shared, x, y, percent: int):
    return 100 * shared >= percent * (x + y - shared)


def _compared(words: int, percent: int):
    """Comparison of token sequences by their whole shingle sets: with centres, and block by block."""
    held: dict[bytes, set] = {}

    def of(sequence):
        if sequence not in held:
            if len(held) > 32:
                held.clear()
            held[sequence] = _shingle_set(sequence, words)
        return held[sequence]

    def star(loads, centre_loads):
        distances, linked = [], []
        for x, y in zip(loads, centre_loads):
            x, y = _shingle_set(x, words), of(y)
            shared = len(x & y)
            distances.append(1 - shared / (len(x) + len(y) - shared))
            linked.append(_similar_enough(shared, len(x), len(y), percent))
        return [distances, linked]

    def pairs(left, right):
        import numpy as np

        left, right = ([_shingle_set(x, words) for x in side] for side in (left, right))
        both = set().union(*left) & set().union(*right)
        places = {x: i for i, x in enumerate(both)}
        found = [[np.fromiter((places[s] for s in x if s in places), dtype=np.int64) for x in side] for side in (left, right)]
        shared = np.zeros((len(left), len(right)), dtype=np.float32)
        for start in range(0, len(both), COLUMNS):
            sides = []
            for side in found:
                marks = np.zeros((len(side), min(COLUMNS, len(both) - start)), dtype=np.float32)
                for i, at in enumerate(side):
                    marks[i, at[(at >= start) & (at < start + COLUMNS)] - start] = 1
                sides.append(marks)
            shared += sides[0] @ sides[1].T
        sizes = [np.array([len(x) for x in side]) for side in (left, right)]
        return _similar_enough(shared.astype(np.int64), sizes[0][:, None], sizes[1][None, :], percent)

    return star, pairs


def _resolved(rows: DataFrame, text: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and for each token sequence its group: least key and the row that stays.

    The first row of a token sequence stands for it; its number is the node.
    """
    signed = written(_signed(rows.withColumn("_row", F.monotonically_increasing_id()), text, words, percent), "signed-documents")
    best = F.min(F.struct(F.col("_key").isNull().alias("no_key"), "_key", "_row"))
    nodes = signed.filter("_node is not null").groupBy("_node").agg(F.min("_row").alias("node"), best.alias("best"))
    nodes = written(nodes, "token-sequences")
    firsts = signed.join(nodes.select(F.col("node").alias("_row")), "_row", "left_semi")
    spread = firsts.select(F.col("_row").alias("node"), F.explode("_bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")

    def attach(wanted: DataFrame) -> DataFrame:
        wanted = cut(wanted)
        few = wanted.count() <= FEW_KEYS
        texts = signed.select(F.col("_row").alias("node"), F.col("_words").alias("load"))
        return texts.join(F.broadcast(wanted) if few else wanted, "node")

    star, pairs = _compared(words, percent)
    roots = bucket_groups(spread.join(shared, "bucket"), attach, star, pairs, 1 - percent / 100, BLOCK)
    roots = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = written(roots, "sequence-groups")
    groups = roots.groupBy("root").agg(F.min("best").alias("stays"))
    return signed, roots.join(groups, "root").select("_node", "stays")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``key``, n_shingles, component_id, kept.

    Documents whose sets of ``words``-word shingles have a Jaccard similarity
    of ``percent`` or more are linked.  Words are what white space divides,
    A-Z lower-cased; a text of fewer words is one shingle; texts without words
    (null, empty, blank) are groups of their own.  component_id is the smallest
    key reachable (nulls last), kept is key = component_id; rows that repeat a
    key are kept alike.  Other columns are not looked at.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    signed, groups = _resolved(rows, "_text", words, percent)
    found = signed.select("_key", "_node", "_n_shingles").join(groups, "_node", "left")
    component = F.when(F.col("_node").isNull(), F.col("_key")).otherwise(F.col("stays._key"))
    return found.select(
        F.col("_key").alias(key), F.col("_n_shingles").alias("n_shingles"), component.alias("component_id"),
        F.col("_key").eqNullSafe(component).alias("kept"),
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of :func:`near_groups`, whole: that of the smallest key, then the first."""
    packed = docs.select(
        F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"),
        F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("_document"),
    )
    signed, groups = _resolved(packed, "_text", words, percent)
    rows = signed.select("_row", "_node").filter("_node is not null").join(groups, "_node")
    gone = cut(rows.filter(F.col("_row") != F.col("stays._row")).select("_row"))
    if gone.count() <= FEW_KEYS:
        gone = F.broadcast(gone)
    return signed.select("_row", "_document").join(gone, "_row", "left_anti").select("_document.*")
