"""Nearest neighbours: one block of training rows, or cells around pivots and a shrinking radius."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.values import ref
from ..lineage import cut, spread

NEIGHBOURS = 5
# Training rows, and rows to predict, that a task holds at once.
BLOCK_ROWS = 15_000
CHUNK_ROWS = 50_000
# Training rows that cells are built around; every task holds them, and three numbers for each cell.
MOST_PIVOTS = 2_048
# A search with at most this share of the training side's rows, and so many numbers in all, sends its rows to every task.
FEW_ROWS_SHARE = 0.1
FEW_NUMBERS = 8_000_000
# Blocks of which the row counts may be broadcast.
FEW_BLOCKS = 1_000_000


def nearest_neighbours(
    train: DataFrame,
    rows: DataFrame,
    key: str,
    features: str,
    label: str,
    classify: bool,
    k: int = NEIGHBOURS,
    block_rows: int = BLOCK_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Rows (key, prediction): majority vote or mean of the k nearest.

    ``features`` is an array column; ``key`` names both sides' key.  Distance
    ties go to the smaller training key and vote ties to the smaller label.

    A training side counted to fit one block is broadcast.  Of a larger one,
    few rows to predict are sent to all tasks, and each task keeps the k best
    of its training rows for them, block by block.  Otherwise it is
    dealt into cells, by the nearest of its pivots.  A row meets a block of its
    own cell first; the distance of the k-th it finds there bounds the cells it
    must still meet, by the triangle inequality.  Cells meet their rows in
    shuffled groups of bounded size, block by chunk, and no pair that may
    count is left out.  A task forwards only the k best per row and block.
    """
    train = train.select(
        ref(key).alias("key"), ref(features).alias("features"), ref(label).cast("double").alias("label")
    )
    given = rows.select(ref(key).alias("key"), ref(features).alias("features"))
    # rows without features, and training rows without features or label, have no neighbours
    rows = given.filter(F.col("features").isNotNull())
    train = train.na.drop()
    n = train.count()
    schema = "key {}, neighbour {}, distance double, label double".format(
        rows.schema["key"].dataType.simpleString(), train.schema["key"].dataType.simpleString()
    )
    if n <= block_rows:
        found = _broadcast_block(train, spread(rows, "key"), schema, k)
    else:
        # counted up to the bound only
        few = rows.limit(int(n * FEW_ROWS_SHARE) + 1).agg(F.count(F.lit(1)), F.sum(F.size("features"))).first()
        if few[0] <= n * FEW_ROWS_SHARE and (few[1] or 0) <= FEW_NUMBERS:
            found = _broadcast_rows(spread(train, "key"), rows, schema, k, block_rows)
        else:
            found = _within_cells(train, rows, n, schema, k, block_rows, chunk_rows)
        order = W.partitionBy("key").orderBy(F.col("distance").asc_nulls_last(), "neighbour")
        found = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    choice = F.mode("label", True) if classify else F.avg("label")
    chosen = found.groupBy("key").agg(choice.alias("prediction"))
    # a row that meets no training row stays, without a prediction
    return given.select("key").join(chosen, "key", "left").select(F.col("key").alias(key), "prediction")


def _searcher(k: int) -> Callable:
    """Function from rows and sorted training arrays to the nearest rows."""

    def search(part, keys, points, labels):
        import numpy as np
        import pandas as pd

        used = min(k, len(keys))
        norms = (points**2).sum(axis=1)
        for start in range(0, len(part), 512):
            piece = part.iloc[start : start + 512]
            x = np.stack(piece["features"].to_numpy()).astype(float)
            squared = (x**2).sum(axis=1)[:, None] - 2 * x @ points.T + norms[None, :]
            # rounded, so that equal distances tie whatever the summation order
            squared = np.round(squared, 9)
            order = _first(squared, used)
            yield pd.DataFrame(
                {
                    "key": np.repeat(piece["key"].to_numpy(), used),
                    "neighbour": keys[order].ravel(),
                    "distance": np.take_along_axis(squared, order, axis=1).ravel(),
                    "label": labels[order].ravel(),
                }
            )

    return search


def _first(squared, used: int):
    """Columns of the ``used`` smallest numbers of each row, in order; of equal ones the first columns."""
    import numpy as np

    if used * 8 >= squared.shape[1] or np.isnan(squared).any():
        return np.argsort(squared, axis=1, kind="stable")[:, :used]
    # only what is no larger than the last of them is sorted
    last = np.partition(squared, used - 1, axis=1)[:, used - 1]
    row, column = np.nonzero(squared <= last[:, None])
    order = np.lexsort((column, squared[row, column], row))
    row, column = row[order], column[order]
    starts = np.searchsorted(row, np.arange(len(squared)))
    return column[starts[:, None] + np.arange(used)]


def _broadcast_block(train: DataFrame, rows: DataFrame, schema: str, k: int) -> DataFrame:
    held = sorted(train.collect(), key=lambda r: r["key"])
    packed = ([r["key"] for r in held], [list(r["features"]) for r in held], [r["label"] for r in held])
    shared = rows.sparkSession.sparkContext.broadcast(packed)
    search = _searcher(k)

    def batches_of(batches: Iterator) -> Iterator:
        import numpy as np

        keys, points, labels = (np.asarray(part) for part in shared.value)
        if not len(keys):
            return
        for batch in batches:
            yield from search(batch, keys, points.astype(float), labels)

    return rows.mapInPandas(batches_of, schema)


def _broadcast_rows(train: DataFrame, rows: DataFrame, schema: str, k: int, block_rows: int) -> DataFrame:
    """The k nearest of each task's training rows, for rows counted to be few."""
    held = rows.collect()
    packed = ([r["key"] for r in held], [list(r["features"]) for r in held])
    shared = rows.sparkSession.sparkContext.broadcast(packed)
    search = _searcher(k)

    def batches_of(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        asks = pd.DataFrame({"key": shared.value[0], "features": shared.value[1]})
        if not len(asks):
            return
        best = None

        def merged(best, block):
            block = block.sort_values("key")
            points = np.stack(block["features"].to_numpy()).astype(float)
            found = [best] if best is not None else []
            found += search(asks.assign(key=np.arange(len(asks))), block["key"].to_numpy(), points, block["label"].to_numpy())
            found = pd.concat(found).sort_values(["key", "distance", "neighbour"], kind="stable")
            return found[found.groupby("key").cumcount() < k]

        parts, size = [], 0
        for batch in batches:
            for start in range(0, len(batch), block_rows):
                parts.append(batch.iloc[start : start + block_rows])
                size += len(parts[-1])
                if size >= block_rows:
                    best = merged(best, pd.concat(parts))
                    parts, size = [], 0
        if parts:
            best = merged(best, pd.concat(parts))
        if best is not None:
            names = asks["key"].to_numpy()
            for start in range(0, len(best), 8192):
                part = best.iloc[start : start + 8192]
                yield part.assign(key=names[part["key"].to_numpy()])

    return train.mapInPandas(batches_of, schema)


def _within_cells(
    train: DataFrame, rows: DataFrame, n: int, schema: str, k: int, block_rows: int, chunk_rows: int
) -> DataFrame:
    cells = Cells(train, n, block_rows)
    first = cut(_met(cells.home(rows), cells.rows, schema, k, chunk_rows))
    second = _met(cells.within_bound(first.filter("neighbour IS NULL"), k), cells.rows, schema, k, chunk_rows)
    names = ["key", "neighbour", "distance", "label"]
    return first.unionByName(second).filter("neighbour IS NOT NULL").select(*names)


class Cells:
    """Training rows (cell, block, key, features, label), each in the cell of its nearest pivot."""

    def __init__(self, train: DataFrame, n: int, block_rows: int):
        import numpy as np

        pivots = min(MOST_PIVOTS, max(16, 4 * -(-n // block_rows)))
        picked = train.orderBy(F.xxhash64("key"), "key").limit(pivots).select("features").collect()
        # copies of one pivot would share a cell
        self.pivots = np.unique(np.array([r["features"] for r in picked], dtype=float), axis=0)
        points = self.pivots

        def assign(batches: Iterator) -> Iterator:
            import numpy as np

            for batch in batches:
                for start in range(0, len(batch), 512):
                    part = batch.iloc[start : start + 512]
                    far = _distances(part["features"], points)
                    cell = far.argmin(axis=1)
                    yield part.assign(cell=cell.astype("int32"), far=far[np.arange(len(cell)), cell])

        types = [f"{f.name} {f.dataType.simpleString()}" for f in train.schema]
        held = cut(train.mapInPandas(assign, ", ".join([*types, "cell int", "far double"])))
        sizes = held.groupBy("cell").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("n"))
        sizes = cut(sizes.withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int")))
        self.low, self.high = np.full(len(points), np.inf), np.full(len(points), -np.inf)
        self.counts, self.blocks = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        for r in sizes.collect():
            i = r["cell"]
            self.low[i], self.high[i], self.counts[i], self.blocks[i] = r["low"], r["high"], r["n"], r["blocks"]
        block = F.pmod(F.xxhash64("key", "features"), F.col("blocks")).cast("int")
        held = held.join(F.broadcast(sizes.select("cell", "blocks")), "cell").withColumn("block", block)
        self.rows = held.select("cell", "block", "key", "features", "label")

    def home(self, rows: DataFrame) -> DataFrame:
        """Each row with the cell of its nearest pivot, and one block of that."""
        points, blocks = self.pivots, self.blocks

        def ask(batches: Iterator) -> Iterator:
            import numpy as np

            for batch in batches:
                for start in range(0, len(batch), 512):
                    part = batch.iloc[start : start + 512]
                    far = np.where(blocks > 0, _distances(part["features"], points), np.inf)
                    cell = far.argmin(axis=1)
                    # a row without finite distances may point to a cell without rows
                    cell = np.where(blocks[cell] > 0, cell, int(blocks.argmax()))
                    yield part.assign(cell=cell.astype("int32"), blocks=blocks[cell].astype("int32"))

        fields = f"key {rows.schema['key'].dataType.simpleString()}, features array<double>, cell int, blocks int"
        rows = rows.select("key", F.col("features").cast("array<double>").alias("features"))
        asked = rows.mapInPandas(ask, fields)
        block = F.pmod(F.xxhash64("key", "features"), F.col("blocks")).cast("int")
        return asked.select("key", "features", "cell", block.alias("block"))

    def within_bound(self, asked: DataFrame, k: int) -> DataFrame:
        """Rows (key, features, cell, block, bound) with every block they must still meet."""
        points, low, high, counts, blocks = self.pivots, self.low, self.high, self.counts, self.blocks

        def ask(batches: Iterator) -> Iterator:
            import numpy as np
            import pandas as pd

            between = _distances(points, points)
            np.fill_diagonal(between, np.inf)
            used = blocks > 0
            owner = np.repeat(np.arange(len(blocks)), blocks)
            number = np.arange(len(owner)) - (np.cumsum(blocks) - blocks)[owner]
            size = 1 + np.sqrt((points**2).sum(axis=1)).max() + high[used].max()
            for batch in batches:
                for start in range(0, len(batch), 512):
                    part = batch.iloc[start : start + 512]
                    cell, block = part["cell"].to_numpy(), part["block"].to_numpy()
                    far = _distances(part["features"], points)
                    # k training rows are no farther than this, whichever cells hold them
                    most = np.where(used, far + high, np.inf)
                    order = np.argsort(most, axis=1)
                    enough = np.cumsum(counts[order], axis=1) >= k
                    reach = np.take_along_axis(most, order, axis=1)[np.arange(len(part)), enough.argmax(axis=1)]
                    reach = np.where(enough.any(axis=1), reach, np.inf)
                    met = np.sqrt(part["bound"].to_numpy(dtype=float, na_value=np.inf) + 1e-9)
                    bound = np.minimum(reach, met) + 1e-6 * (size + far.min(axis=1))
                    # from the ring of distances that a cell has, and from the plane between two pivots
                    least = np.maximum(far - high, low - far)
                    own = far.argmin(axis=1)
                    plane = (far**2 - far[np.arange(len(own)), own][:, None] ** 2) / (2 * between[own])
                    least = np.maximum(least, plane)
                    wanted = ~(least > bound[:, None]) & used
                    wanted = wanted[:, owner]
                    wanted &= (owner[None, :] != cell[:, None]) | (number[None, :] != block[:, None])
                    i, j = np.nonzero(wanted)
                    features = part["features"].to_numpy()
                    for at in range(0, len(i), 8192):
                        x, y = i[at : at + 8192], j[at : at + 8192]
                        yield pd.DataFrame(
                            {"key": part["key"].to_numpy()[x], "features": features[x],
                             "cell": owner[y].astype("int32"), "block": number[y].astype("int32")}
                        )

        fields = f"key {asked.schema['key'].dataType.simpleString()}, features array<double>, cell int, block int"
        return asked.select("key", "features", "cell", "block", F.col("distance").alias("bound")).mapInPandas(ask, fields)


def _distances(features, points):
    """Matrix of distances of rows from points."""
    import numpy as np

    x = np.stack(list(features)).astype(float)
    squared = (x**2).sum(axis=1)[:, None] - 2 * x @ points.T + (points**2).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(squared, 0))


def _met(asked: DataFrame, held: DataFrame, schema: str, k: int, chunk_rows: int) -> DataFrame:
    """The k nearest of each asked block; and a row without neighbour for each row that asks.

    That row has the features, cell and block again, and as distance that of
    the k-th neighbour, null where the block has fewer.
    """
    asked = cut(asked)
    sizes = asked.groupBy("cell", "block").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))
    sizes = cut(sizes)
    if sizes.count() <= FEW_BLOCKS:
        sizes = F.broadcast(sizes)
    left = asked.join(sizes, ["cell", "block"]).withColumn("chunk", F.pmod(F.xxhash64("key"), "chunks").cast("int")).drop("chunks")
    right = held.join(sizes, ["cell", "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    search = _searcher(k)

    def meet(part, block):
        import numpy as np
        import pandas as pd

        part, block = part.reset_index(drop=True), block.sort_values("key")
        found = []
        if len(block) and len(part):
            points = np.stack(block["features"].to_numpy()).astype(float)
            found = list(search(part, block["key"].to_numpy(), points, block["label"].to_numpy()))
        # objects, as whole numbers beside nulls would become floats
        found = [f.astype({"neighbour": object}).assign(features=None) for f in found]
        asks = part[["key", "features", "cell", "block"]].assign(neighbour=None)
        enough = len(block) >= k
        if enough and len(part):
            asks = asks.assign(distance=np.concatenate([f["distance"].to_numpy().reshape(-1, k)[:, -1] for f in found]))
        return pd.concat([asks, *found]).reindex(columns=columns)

    fields = schema + ", features array<double>, cell int, block int"
    columns = [f.split()[0] for f in fields.split(", ")]
    keys = ["cell", "block", "chunk"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, fields)
