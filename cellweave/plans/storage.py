"""Small results that several parts of a plan read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def once(df: DataFrame) -> DataFrame:
    """df, computed now and read from the checkpoint folder, so that it isn't computed by each part of a plan that reads it.

    The folder is that of spark.checkpoint.dir; where none is set, one is made on a single machine, and df is left as it is on
    a cluster.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        at = context.getConf().get("spark.checkpoint.dir", None)
        if at is None and not context.master.startswith("local[") and context.master != "local":
            return df
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="cellweave-"))
    return df.checkpoint()
