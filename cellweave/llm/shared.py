"""Results kept between jobs, where all executors can read them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where that is unset a temporary one is set, on one machine (as in tests) only."""
    context = spark.sparkContext
    if not (path := context.getConf().get("spark.checkpoint.dir", None)):
        set_here = context._jsc.sc().getCheckpointDir()
        if set_here.isDefined():
            return set_here.get()
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="cellweave-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


def path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/{what.replace(' ', '-')}-{uuid.uuid4().hex}"


def keep(df: DataFrame, what: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: its lineage ends there, and it survives the loss of executors."""
    at = path(df.sparkSession, what)
    df.write.parquet(at)
    kept = df.sparkSession.read.schema(df.schema).parquet(at)
    kept._kept_at = at
    return kept


def forget(*kept: DataFrame) -> None:
    """Deletes tables of keep() that nothing reads any more."""
    for df in kept:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spare(columns: Iterable[str], name: str) -> str:
    """name, or name with underscores in front, such that no column is called that."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
