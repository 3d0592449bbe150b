"""Document quality by nearest-neighbour voting among labelled latent-semantic vectors.

A document's terms are hashed byte pairs and triples, weighted by how few of
all documents hold them, and a few shares of its writing (repeated words,
capitals, signs, ...).  A truncated singular value decomposition of a bounded
sample of labelled documents gives the latent space.  The sample's vectors
(FIT_ROWS x RANK numbers) are broadcast, every document is compared with each
of them, block by block, and its nearest neighbours vote by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import cut
from .shared import BATCH, as_list, mapped

# Bound of the sample: so many labelled documents at most, half of them of either label.
FIT_ROWS = 2000
RANK = 48
NEIGHBOURS = 8
# The vote of a neighbour is its similarity to this power.
SHARPNESS = 8
PAIRS, TRIPLES = 2048, 2048
TERMS = PAIRS + TRIPLES
STYLE = 6
ACCEPT = 0.7


def held_out(key: str = "doc_id") -> F.Column:
    """Rows from which no label is learned."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _byte_classes():
    import numpy as np

    classes = np.zeros(256, dtype=np.uint8)
    classes[ord("A") : ord("Z") + 1] = 1
    classes[ord("0") : ord("9") + 1] = 2
    for c in range(33, 127):
        if not chr(c).isalnum():
            classes[c] = 3
    return classes


class Terms:
    """Term counts and style shares of texts given as bytes."""

    def __init__(self):
        import numpy as np

        self.classes = _byte_classes()
        self.pairs = np.random.Generator(np.random.Philox(7)).integers(0, PAIRS, 1 << 16)

    def counts(self, texts):
        """A row per text: occurrences of each hashed term."""
        import numpy as np

        out = np.zeros((len(texts), TERMS), dtype=np.float32)
        for i, text in enumerate(texts):
            # windows bound the memory that a very long text takes
            for start in range(0, len(text), 1 << 20):
                b = np.frombuffer(text[start : start + (1 << 20) + 2], dtype=np.uint8).astype(np.uint32)
                if len(b) > 1:
                    two = (b[:-1] << 8) | b[1:]
                    out[i, :PAIRS] += np.bincount(self.pairs[two[: 1 << 20]], minlength=PAIRS)
                if len(b) > 2:
                    three = (((two[:-1] << 8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(21)
                    out[i, PAIRS:] += np.bincount(three, minlength=TRIPLES)
        return out

    def style(self, texts):
        """Shares: words like the one before, different words, capitals, digits, signs; mean length of a word."""
        import numpy as np

        out = np.zeros((len(texts), STYLE), dtype=np.float32)
        for i, text in enumerate(texts):
            if not text:
                continue
            words = text.split()
            n = max(1, len(words))
            kinds = np.bincount(self.classes[np.frombuffer(text, dtype=np.uint8)], minlength=4) / len(text)
            out[i] = [sum(map(eq, words, words[1:])) / n, len(set(words)) / n, *kinds[1:], min(1.0, len(text) / n / 16)]
        return out

    def vectors(self, texts, weights):
        import numpy as np

        terms = np.sqrt(self.counts(texts)) * weights
        terms /= np.maximum(1e-9, np.linalg.norm(terms, axis=1, keepdims=True))
        return np.hstack([terms, self.style(texts)])


def term_weights(docs: DataFrame, text: str = "text"):
    """Inverse document frequency of each term over all documents, as an array of TERMS numbers."""
    import numpy as np

    def count(batches):
        import pyarrow as pa

        terms, found, rows = Terms(), np.zeros(TERMS, dtype=np.int64), 0
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                texts = [t or b"" for t in as_list(batch.column(0).slice(start, BATCH))]
                for part in range(0, len(texts), 128):
                    found += (terms.counts(texts[part : part + 128]) > 0).sum(axis=0)
                rows += len(texts)
        yield pa.RecordBatch.from_pydict({"term": list(range(-1, TERMS)), "n": [rows, *found.tolist()]})

    partial = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "term bigint, n bigint")
    totals = dict(partial.groupBy("term").agg(F.sum("n").alias("n")).collect())
    found = np.array([totals.get(i, 0) for i in range(TERMS)], dtype=np.float64)
    return (np.log((totals.get(-1, 0) + 1) / (found + 1)) + 0.2).astype(np.float32)


@dataclass
class Model:
    """Term weights, latent directions, the sample's unit vectors and its labels."""

    weights: object
    directions: object
    vectors: object
    labels: object

    def latent(self, terms: Terms, texts):
        import numpy as np

        found = terms.vectors(texts, self.weights) @ self.directions
        return found / np.maximum(1e-9, np.linalg.norm(found, axis=1, keepdims=True))

    def scores(self, terms: Terms, texts) -> list[float]:
        import numpy as np

        if not len(self.labels):
            return [1.0] * len(texts)
        near = np.maximum(self.latent(terms, texts) @ self.vectors.T, 0)
        k = min(NEIGHBOURS, near.shape[1])
        # neighbours as near as the last one vote as well
        last = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
        votes = np.where(near >= last, near, 0).astype(np.float64) ** SHARPNESS
        total = votes.sum(axis=1)
        score = np.where(total > 0, votes @ self.labels / np.maximum(total, 1e-300), 0)
        return [round(float(s), 6) if t else 0.0 for s, t in zip(score, texts)]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Model:
    """The model of a bounded sample of labelled documents that are not held out.

    Documents with both labels are left out, and so are labels other than 0 and
    1.  The sample is the first ``rows`` / 2 of either label by a digest of the key.
    """
    import numpy as np

    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("key").isNotNull() & ~held_out("key"))
    known = known.groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("high")).filter("label = high")
    known = known.join(docs.select(F.col(key).alias("key")).distinct(), "key", "left_semi")
    known = cut(known.select("key", "label", F.md5(F.col("key").cast("string")).alias("place")))
    chosen = known.filter("label = 0").orderBy("place", "key").limit(rows // 2).unionByName(
        known.filter("label = 1").orderBy("place", "key").limit(rows // 2)
    )
    chosen = cut(chosen.select("key", "label"))  # at most ``rows`` rows
    sample = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "key")
    weights = term_weights(docs, text)

    def work():
        terms = Terms()

        def do(texts):
            return [[v.tobytes() for v in terms.vectors([t or b"" for t in texts], weights)]]

        return do

    adds = T.StructType([T.StructField("vector", T.BinaryType())])
    found = mapped(sample, ["text"], adds, work).groupBy("key").agg(F.min("vector").alias("vector"), F.first("label").alias("label"))
    found = sorted(found.collect())
    if not found:
        return Model(weights, None, None, np.zeros(0))
    matrix = np.stack([np.frombuffer(bytes(r["vector"]), dtype=np.float32) for r in found])
    start = np.random.Generator(np.random.Philox(3)).standard_normal((matrix.shape[1], RANK + 8)).astype(np.float32)
    basis = matrix @ start
    for _ in range(3):
        basis = matrix @ (matrix.T @ np.linalg.qr(basis)[0])
    directions = np.linalg.svd(np.linalg.qr(basis)[0].T @ matrix, full_matrices=False)[2][:RANK].T
    model = Model(weights, directions, None, np.array([r["label"] for r in found], dtype=np.float64))
    latent = matrix @ directions
    model.vectors = latent / np.maximum(1e-9, np.linalg.norm(latent, axis=1, keepdims=True))
    return model


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if accepted) of each whole text; columns so named are replaced.

    Null and empty texts have score 0.  Without labelled rows nothing speaks
    against a document: all scores are 1.  Texts alone decide, so equal texts
    have equal scores; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        terms = Terms()

        def do(texts):
            found = []
            for start in range(0, len(texts), 128):
                found += shared.value.scores(terms, [t or b"" for t in texts[start : start + 128]])
            return [found, [int(s >= ACCEPT) for s in found]]

        return do

    adds = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return mapped(docs, [text], adds, work)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their own columns."""
    found = scored(docs.select(F.struct("*").alias("document"), F.col("text").cast("string").alias("text")), fit(docs, labels))
    return found.filter("predicted = 1").select("document.*")


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    found = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
