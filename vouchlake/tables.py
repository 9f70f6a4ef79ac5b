"""Reading the input tables by name, and cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``; any file system that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialized(df: DataFrame) -> DataFrame:
    """``df`` written to the session's ``spark.checkpoint.dir`` and read from there: several uses cost one computation, lost executors none.

    Where that setting is unset a temporary folder is made, which only a local master can share; others are refused.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As :func:`materialized`, as Parquet under that folder: compressed, and each use reads the columns it needs."""
    folder = f"{_checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return sc.getCheckpointDir()


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: each row's number from 1 in ``order``. Rows are sorted within range partitions, whose sizes (a row each) give the offsets; no task sees more than its share."""
    laid = materialized(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    sizes = sorted((r["__part"], r["count"]) for r in laid.groupBy("__part").count().collect())
    rows, n = [], 0
    for part, size in sizes:
        rows.append((part, n - (part << 33) + 1))
        n += size
    offsets = df.sparkSession.createDataFrame(rows, "__part int, __offset long")
    return laid.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__at") + F.col("__offset")).drop("__part", "__at", "__offset")
