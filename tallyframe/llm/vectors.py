"""Near-duplicate vectors by an exact metric range join.

Unit vectors with a cosine of at least c lie at most r = sqrt(2 - 2c) apart.
Pivots divide the vectors of a label into cells, each vector in that of its
nearest pivot.  A vector can have neighbours in another cell only if it is
within r of that cell's boundary: by the triangle inequality only if its
distances to the two pivots differ by at most 2r, and in Euclidean space only
if its distance from the plane between the pivots is at most r.  Such vectors
are copied to the other cell, and cells are joined on their own, in blocks of
bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import as_list, blocked, components, mapped, spread_least, written

# Vectors to a pivot, and pivots (they are broadcast) at most; larger cells are joined in more blocks.
CELL = 512
MOST_PIVOTS = 4096
# Vectors of either side that a task holds at once.
BLOCK = 4096
SLACK = 1e-9

UNITS = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("unit", T.BinaryType())])


def _units(rows: DataFrame) -> DataFrame:
    """Adds the unit vector, and a digest of group and vector; null where a row links with nothing."""

    def work():
        import numpy as np
        import xxhash

        def do(groups, vectors):
            nodes, units = [], []
            for group, vector in zip(groups, vectors):
                x = None
                if group is not None and vector and None not in vector:
                    x = np.asarray(vector, dtype=np.float64)
                    largest = np.abs(x).max()
                    x = x / largest if np.isfinite(largest) and largest > 0 else None
                if x is None:
                    nodes.append(None), units.append(None)
                    continue
                given = group + b"|" + np.asarray(vector, dtype="<f8").tobytes()
                nodes.append(xxhash.xxh3_128_digest(given))
                units.append((x / np.sqrt((x * x).sum())).tobytes())
            return [nodes, units]

        return do

    return mapped(rows, ["label", "vector"], UNITS, work)


def _cells(nodes: DataFrame, pivots: list, radius: float) -> DataFrame:
    """Rows (cluster, cell, core, node, n, unit): each vector in its own cell and those it may have neighbours in."""
    import numpy as np

    by_label: dict = {}
    for p in pivots:
        by_label.setdefault(p["label"], []).append(np.frombuffer(bytes(p["unit"])))
    shared = nodes.sparkSession.sparkContext.broadcast({k: np.stack(v) for k, v in by_label.items()})

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                label, node, n, unit = (as_list(batch.column(c).slice(start, 1024)) for c in ("label", "node", "n", "unit"))
                rows = {}
                for i, name in enumerate(label):
                    rows.setdefault(name.decode(), []).append(i)
                out = []
                for name, at in rows.items():
                    centres = shared.value.get(name)
                    if centres is None:
                        out += [(i, 0, True) for i in at]
                        continue
                    cosine = np.stack([np.frombuffer(unit[i]) for i in at]) @ centres.T
                    home = cosine.argmax(axis=1)
                    own = cosine[np.arange(len(at)), home][:, None]
                    apart = np.sqrt(np.maximum(0, 2 - 2 * cosine)) - np.sqrt(np.maximum(0, 2 - 2 * own))
                    between = np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T)))[home]
                    # (d_j^2 - d_i^2) / 2 d_ij is the distance from the plane between pivots i and j
                    near = (apart <= 2 * radius + SLACK) & (own - cosine <= (radius + SLACK) * between + SLACK)
                    near[np.arange(len(at)), home] = True
                    r, c = np.nonzero(near)
                    out += [(at[i], int(j), bool(j == home[i])) for i, j in zip(r, c)]
                if out:
                    at, cell, core = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([label[i].decode() for i in at]), pa.array(cell, pa.int64()), pa.array(core),
                         pa.array([node[i] for i in at], pa.binary()), pa.array([n[i] for i in at], pa.int64()),
                         pa.array([unit[i] for i in at], pa.binary())],
                        ["cluster", "cell", "core", "node", "n", "unit"],
                    )

    return nodes.select("label", "node", "n", "unit").mapInArrow(
        assign, "cluster string, cell bigint, core boolean, node binary, n bigint, unit binary"
    )


def _joined(cells: DataFrame, cosine: float) -> DataFrame:
    """Rows (node, links, root): copies that a vector is linked with, and the least node of its group, per block."""
    rows = blocked(cells, BLOCK)

    def join(part):
        import numpy as np
        import pandas as pd

        node = part["node"].to_numpy()
        order = np.argsort(node, kind="stable")
        part, node = part.iloc[order], node[order]
        unit = np.stack([np.frombuffer(u) for u in part["unit"]])
        left, right = (np.flatnonzero(part[s].to_numpy(dtype=bool)) for s in ("left", "right"))
        linked = np.zeros((len(left), len(right)), dtype=bool)
        for i in range(0, len(left), 1024):
            linked[i : i + 1024] = unit[left[i : i + 1024]] @ unit[right].T >= cosine
        linked[left[:, None] == right[None, :]] = False
        links = linked @ part["n"].to_numpy()[right] if len(right) else np.zeros(len(left), dtype=np.int64)
        least = spread_least(len(part), left, right, linked)
        counts = np.zeros(len(part), dtype=np.int64)
        counts[left] = links
        told = (counts > 0) | (least != np.arange(len(part)))
        return pd.DataFrame({"node": node[told], "links": counts[told], "root": node[least[told]]})

    grouped = rows.groupBy("cluster", "cell", "a", "b")
    return grouped.applyInPandas(join, "node binary, links bigint, root binary")


def linked_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", group: str = "label", cosine: float = 0.98) -> DataFrame:
    """One row per row of ``vectors``: ``key``, n_links, component_id, kept.

    Vectors of one group (and length) are linked when their cosine in double
    precision is at least ``cosine``, copies included.  n_links counts the rows
    linked directly; component_id is the smallest key reachable (nulls last),
    kept is key = component_id.  Rows with a null group, or a vector that is
    null, empty, zero or holds null or non-finite components, link with
    nothing.  Equal vectors of a group are joined as one.  No rows give no rows.
    """
    name = F.concat_ws("|", F.size(vector), F.col(group).cast("string"))
    rows = vectors.select(
        F.col(key).alias("key"), F.when(F.col(group).isNotNull() & F.col(vector).isNotNull(), name).alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    )
    held = written(_units(rows).drop("vector"), "unit-vectors")
    valid = held.filter("node is not null")
    nodes = valid.groupBy("node").agg(
        F.min("label").alias("label"), F.min("unit").alias("unit"), F.count("*").alias("n"), F.min("key").alias("key")
    )
    nodes = written(nodes, "distinct-vectors")
    labels = nodes.groupBy("label").agg(F.count("*").alias("of")).filter(F.col("of") > CELL)
    share = F.conv(F.substring(F.hex("node"), 1, 8), 16, 10).cast("double") / float(1 << 32)
    pivots = nodes.join(labels, "label").filter(share < 1.0 / CELL).orderBy("node").limit(MOST_PIVOTS).select("label", "unit")
    radius = (2 - 2 * cosine) ** 0.5
    joined = written(_joined(_cells(nodes, pivots.collect(), radius), cosine), "linked-vectors")
    roots = components(joined.filter("node <> root"), "node", "root")
    counts = joined.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = nodes.select("node", "n", "key").join(counts, "node", "left").join(roots, "node", "left")
    nodes = nodes.withColumn("root", F.coalesce("root", "node")).select(
        "node", "root", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")
    )
    nodes = written(nodes, "vector-groups")
    least = nodes.groupBy("root").agg(F.min("key").alias("component_id"))
    nodes = nodes.join(least, "root").select("node", "n_links", "component_id")
    found = held.select("key", "node").join(nodes, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return found.select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.col("key").eqNullSafe(component).alias("kept"),
    )


ORACLE = """WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, label, v FROM e WHERE label IS NOT NULL AND len(v) > 0 AND list_bool_and(list_transform(v, lambda x: x IS NOT NULL AND isfinite(x))) AND list_sum(list_transform(v, lambda x: abs(x))) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
 WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT vec_id, vec_id AS m FROM e UNION SELECT p.b, r.m FROM r JOIN p ON p.a = r.vec_id),
c AS (SELECT vec_id, min(m) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM p GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM e JOIN c USING (vec_id) LEFT JOIN n ON n.a = e.vec_id"""
