"""Helpers of the corpus operators: shared tables, added columns, connected groups."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import cut

SPACES = "[\\x20\\x09-\\x0D]"


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: that of ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        cut(spark.range(1))  # sets a folder of its own where none is named
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a compressed table in the shared folder: lineage is cut."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without the columns whose names (in any case) an operator sets."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in taken])


def mapped(df: DataFrame, reads: Sequence[str], adds: T.StructType, work: Callable) -> DataFrame:
    """Adds columns computed batch by batch in Arrow.

    ``work()`` is called once per task and returns a function from the lists
    of the ``reads`` columns (text as bytes) to the lists of the added ones.
    An input column named like an added one is dropped.
    """
    names = {f.name.lower() for f in adds}
    kept = [c for c in df.columns if c.lower() not in names]
    wanted = list(dict.fromkeys([*kept, *reads]))
    rows = df.select(*[F.col(f"`{c.replace('`', '``')}`") for c in wanted])
    schema = T.StructType([*[rows.schema[c] for c in kept], *adds])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in adds]
        do = work()
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                piece = batch.slice(start, BATCH)
                inputs = [as_list(piece.column(c)) for c in reads]
                outputs = [pa.array(v, t) for v, t in zip(do(*inputs), types)]
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c) for c in kept], *outputs], names=[f.name for f in schema]
                )

    return rows.mapInArrow(run, schema)


# Rows that a task holds as Python objects at once.
BATCH = 1024


def as_list(column) -> list:
    """Values of an Arrow column; text as UTF-8 bytes."""
    import pyarrow as pa

    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


# A task's Python tables of text hold at most this many bytes of it.
TABLE_BYTES = 48 << 20


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, root) for each node of the links: the smallest node it reaches.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours to its smallest neighbour, then its smaller ones.  The longest
    path shrinks by half or more in each round.  Both steps are a partial
    minimum and a join that adaptive execution may split, so a node with a
    third of all links is no task's burden.
    """
    edges = cut(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        following = cut(small)
        # settled: each node has one link, and what it links to has none
        counts = following.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        open_nodes = counts.filter("n > 1").select("u").unionByName(
            counts.join(counts.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        )
        edges = following
        if not open_nodes.limit(1).count():
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.withColumn("root", F.col("node"))
    )


# Keys of at most so many rows (some ten bytes each) may be broadcast; more are joined by shuffle.
FEW_KEYS = 1_000_000
# Bytes of loads that a side of a block holds, if its rows are more than one.
BLOCK_BYTES = 4 << 20


def few(df: DataFrame) -> DataFrame:
    """The rows, marked for a broadcast if they are counted to be at most FEW_KEYS."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= FEW_KEYS else df


def blocked(cells: DataFrame, block: int) -> DataFrame:
    """Rows of cells dealt into blocks: adds a, b, left and right, a group being (cluster, cell, a, b).

    Every core of a cell (column core) meets every other row of the cell in
    exactly one group as left against right; a group has about ``block`` rows
    of either side, or BLOCK_BYTES where rows have a column size, however
    large the cell.  Cells of a single row are left out.
    """
    share = F.lit(1.0 / block)
    if "size" in cells.columns:
        share = F.greatest(share, F.col("size") / BLOCK_BYTES)
    sizes = cells.groupBy("cluster", "cell").agg(
        F.sum(F.when(F.col("core"), share)).alias("cores"), F.sum(share).alias("all"), F.count("*").alias("rows")
    )
    sizes = sizes.filter("cores > 0 and rows > 1").select(
        "cluster", "cell", F.ceil("cores").alias("lefts"), F.ceil("all").alias("rights")
    )
    place = F.xxhash64("node")
    rows = cells.drop("size").join(few(sizes), ["cluster", "cell"])
    rows = rows.withColumn("_a", F.pmod(place, "lefts")).withColumn("_b", F.pmod(place, "rights"))
    # a core meets every block of the cell's rows, every row meets each block of cores
    parts = F.expr(
        """concat(transform(filter(sequence(0, lefts - 1), x -> NOT core OR x <> _a), x -> struct(x AS a, _b AS b, false AS left, true AS right)),
        if(core, transform(sequence(0, rights - 1), y -> struct(_a AS a, y AS b, true AS left, y = _b AS right)), array()))"""
    )
    rows = rows.withColumn("p", F.explode(parts)).drop("lefts", "rights", "_a", "_b", "core")
    return rows.select(*[c for c in rows.columns if c != "p"], "p.a", "p.b", "p.left", "p.right")


def spread_least(size: int, left, right, linked):
    """Places 0 to size - 1, each replaced by the least place that links lead to.

    ``linked`` is a boolean matrix between the places ``left`` and ``right``.
    """
    import numpy as np

    least = np.arange(size)
    used = linked.any(axis=1)
    left, linked = left[used], linked[used]
    while True:
        before = least.copy()
        for i in range(0, len(left), 256):
            rows, at = linked[i : i + 256], left[i : i + 256]
            least[at] = np.minimum(least[at], np.where(rows, least[right][None, :], size).min(axis=1))
            least[right] = np.minimum(least[right], np.where(rows, least[at][:, None], size).min(axis=0))
        if (before == least).all():
            return least


def bucket_groups(members: DataFrame, attach: Callable, star: Callable, pairs: Callable, reach: float, block: int) -> DataFrame:
    """Rows (node, root) of the groups that links between members of buckets make.

    ``members`` has bucket, node (a number) and n, the size of the bucket (over
    1).  ``attach`` adds to rows with a node its load, what it is compared by,
    ``star`` the distances of loads from those of their centres and whether
    they are linked, ``pairs`` the matrix of links between two lists of loads.
    Distances are a metric in which linked loads are at most ``reach`` apart.

    Buckets that share members make a cluster.  All members are compared with
    the cluster's centre, the one that shares most buckets with others; where
    most are copies of one text that settles nearly all.  Those not linked to
    it are compared with the members of the buckets that hold one of them, but
    by the triangle inequality only with those about as far from the centre,
    in blocks of bounded size.
    """
    members = cut(members)
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    least = members.groupBy("bucket").agg(F.min("node").alias("least"))
    clusters = components(members.join(least, "bucket").select("node", "least"), "node", "least")
    clusters = clusters.join(degree, "node").select("node", F.col("root").alias("cluster"), "degree")
    clusters = cut(clusters)
    centres = clusters.groupBy("cluster").agg(F.max(F.struct("degree", "node")).alias("c"), F.count("*").alias("members"))
    centres = centres.select("cluster", "members", F.col("c.node").alias("centre"))
    loads = written(attach(clusters.drop("degree").join(centres, "cluster")), "loads")
    rows = loads.join(loads.filter("node = centre").select("centre", F.col("load").alias("centre_load")), "centre")
    adds = T.StructType([T.StructField("distance", T.DoubleType()), T.StructField("linked", T.BooleanType())])
    rows = mapped(rows.withColumn("size", F.octet_length("load")), ["load", "centre_load"], adds, lambda: star).drop("load", "centre_load")
    rows = written(rows.filter("node <> centre"), "compared-with-centres")
    # a cluster of which all are linked, or of a centre and one other, is settled
    alone = rows.filter("members > 2 and not linked").select("node")
    touched = members.join(alone, "node", "left_semi").select("bucket").distinct()
    compared = few(members.join(touched, "bucket", "left_semi").select("node").distinct())
    home = F.floor(F.col("distance") / (reach + 1e-9))
    near = rows.join(compared, "node", "left_semi").withColumn("home", home)
    near = near.withColumn("cell", F.explode(F.array(F.col("home") - 1, F.col("home"), F.col("home") + 1)))
    near = near.withColumn("core", ~F.col("linked") & (F.col("cell") == F.col("home"))).select("cluster", "cell", "core", "node", "size")
    dealt = blocked(near, block).join(loads.select("node", "load"), "node")

    def join(part):
        import numpy as np
        import pandas as pd

        part = part.sort_values("node", ignore_index=True)
        left, right = (np.flatnonzero(part[side].to_numpy(dtype=bool)) for side in ("left", "right"))
        load, node = part["load"].to_numpy(), part["node"].to_numpy()
        least = spread_least(len(part), left, right, pairs(load[left], load[right]))
        told = least != np.arange(len(part))
        return pd.DataFrame({"node": node[told], "root": node[least[told]]})

    found = dealt.groupBy("cluster", "cell", "a", "b").applyInPandas(join, "node bigint, root bigint")
    links = rows.filter("linked").select("node", F.col("centre").alias("root")).unionByName(found)
    return components(links, "node", "root")
