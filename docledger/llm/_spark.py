"""Helpers that the corpus operators share: intermediate tables and Arrow batches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: For our own actions: shuffle files go with the action, so that phases do not add up on disk, and Arrow batches are small, as rows hold whole texts.
ACTION = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset in local mode, one of our own.

    On a cluster a folder of the driver's machine would be another on each executor, so there the setting has to be made.
    """
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


@contextlib.contextmanager
def action(spark: SparkSession) -> Iterator[None]:
    """Settings for an action of our own; those of the session come back after it."""
    before = {k: spark.conf.get(k, None) for k in ACTION}
    for k, v in ACTION.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through a reliable checkpoint; Spark removes its files once no plan refers to them."""
    shared_dir(df.sparkSession)
    with action(df.sparkSession):
        return df.checkpoint()


def least_hashes(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """Of each group the rows (group, key) with the `most` least hashes of distinct keys, or nearly so many.

    The number of distinct keys, estimated by an aggregate that combines before the shuffle, tells below which hash about
    twice as many lie; only those are sorted, so a group that holds most rows is not gathered.
    """
    place = F.shiftrightunsigned(F.xxhash64(key), 1)
    sizes = rows.groupBy(group).agg(F.approx_count_distinct(key, 0.02).alias("keys")).withColumnRenamed(group, "of")
    sizes = Tables(rows.sparkSession, "sizes").write(sizes, "groups")  # written, so that Spark knows how small it is
    few = rows.join(sizes, F.col(group) == F.col("of")).filter(place / F.lit(float(1 << 63)) < F.lit(2.0 * most) / F.col("keys"))
    order = Window.partitionBy(group).orderBy(place, key)
    return few.select(group, key).distinct().withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= most).select(group, key)


class Ranges:
    """Rows sorted into ranges over all tasks, and the place of each row in its group, without a window over a group.

    A reliable checkpoint keeps which rows a partition has, and their order. The driver gets one count for each partition
    and group in it: as groups are contiguous, no more than partitions and groups together.
    """

    def __init__(self, rows: DataFrame, group: str, *order: str) -> None:
        keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
        self.rows = checkpoint(rows.repartitionByRange(*keys).sortWithinPartitions(*keys))
        counts = self.rows.groupBy(F.spark_partition_id().alias("part"), F.col(group).alias("of")).agg(F.count("*").alias("n"))
        #: Rows of each group, and for each partition the number of rows of a group before it.
        self.totals: dict = {}
        self.before: dict[int, dict] = {}
        for part, of, n in sorted(counts.collect(), key=lambda r: r[0]):
            self.before.setdefault(part, {})[of] = self.totals.get(of, 0)
            self.totals[of] = self.totals.get(of, 0) + n


def runs(values: list) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    start = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[start]:
            yield start, i
            start = i


class Tables:
    """Intermediate Parquet tables in the shared folder, each dropped as soon as the next phase no longer reads it."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with action(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def byte_blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts Arrow batches into slices of about `limit` text bytes: (slice, its bytes, offsets of its rows; null texts are empty).

    A single text longer than the limit forms a slice of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        if col.null_count:
            col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
        kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
        _, offs, data = col.buffers()
        offsets = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start), raw[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
            start = end
