"""Tables that an operator cuts its lineage with."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; in local mode, where that is unset, one of our own."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.nonEmpty():
        return found.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="docledger-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def written(rows: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder, for large ones: a fraction of a checkpoint's size, and only columns that are asked for are read again."""
    path = f"{shared_dir(rows.sparkSession)}/written-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def checkpoint(rows: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint, which survives lost executors."""
    shared_dir(rows.sparkSession)
    return rows.checkpoint()
