"""Places of rows in an order within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.shared import checkpoint


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Rows with their place (from 1) within each key, by an order without ties.

    Two levels: rows are sorted into ranges over all tasks, a large key into as many as it needs; each range counts its rows
    of each key, counts add up to offsets, and a row's place is its offset and its place in the range. Only counts, at most one
    for each range and key, are summed in a window. Eager: the sorted rows are checkpointed, which fixes the ranges.
    """
    by = [F.col(k) for k in keys]
    sorted_ = checkpoint(rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order))
    # within a partition this numbers the rows in their order
    numbered = sorted_.withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    counts = numbered.groupBy("_range", *keys).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = F.col("r._range") == F.col("o._range")
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}"))
    place = F.col("_row") - F.col("_first") + F.col("_before") + 1
    return numbered.alias("r").join(offsets.alias("o"), same).select(*(F.col(f"r.{c}") for c in rows.columns), place.cast("int").alias(name))
