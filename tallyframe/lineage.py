"""Cutting lineage, and spreading rows before work that is heavy per row."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints to the shared folder named by ``spark.checkpoint.dir``.

    A local master, as in tests, may go without: it then has a temporary one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that the executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tallyframe-"))
    return df.checkpoint()


# Tables that the plan puts below this size are spread.
SMALL_BYTES = 256 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A small table over all shuffle partitions, where a scan leaves it in few.

    The plan's own estimate decides, so nothing is run for it, and larger
    tables stay as they are.
    """
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if estimate > SMALL_BYTES:
        return df
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
