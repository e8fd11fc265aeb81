"""Files into the ledger: type detection, digests, safe keys, and what becomes of each upload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docledger.functions.text import sanitize_filename

#: How files of the supported types begin.
MAGIC = {"application/pdf": "255044462D", "image/png": "89504E470D0A1A0A", "image/jpeg": "FFD8FF"}
MOST_BYTES, CAPACITY = 4 << 20, 25


def detect_type(content: Column) -> Column:
    out = F.lit(None).cast("string")
    for mime, start in MAGIC.items():
        out = F.when(F.hex(F.substring(content, 1, len(start) // 2)) == start, mime).otherwise(out)
    return out


def is_safe_key(key: Column) -> Column:
    """Keys of letters, digits and ._/- that start with a letter or digit and never climb."""
    return key.rlike("^[A-Za-z0-9][A-Za-z0-9._/-]*$") & ~key.contains("..")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Blobs under a path: path, length, content, sha256."""
    return spark.read.format("binaryFile").load(path).withColumn("sha256", F.sha2("content", 256))


def outcomes(files: DataFrame, known: DataFrame | None = None, most_bytes: int = MOST_BYTES, capacity: int = CAPACITY) -> DataFrame:
    """What becomes of uploaded files (file_id, workspace_id, filename, content): accepted, duplicate or rejected, with the reason.

    Checks run in this order: empty, too large, not a supported type, the same bytes in the workspace already (or earlier
    among the files), the workspace full. `known` holds documents that are there (workspace_id, sha256). The file ids give
    the order of arrival. Contents are not shuffled, only their digests.
    """
    rows = files.select("file_id", "workspace_id", sanitize_filename(F.col("filename")).alias("filename"), F.octet_length("content").alias("byte_size"), detect_type(F.col("content")).alias("mime"), F.sha2("content", 256).alias("sha256"))
    why = F.when(F.coalesce("byte_size", F.lit(0)) == 0, "empty").when(F.col("byte_size") > most_bytes, "too_large").when(F.col("mime").isNull(), "unsupported_type")
    rows = rows.withColumn("why", why).withColumn("fit", F.col("why").isNull())
    there = F.lit(False)
    if known is not None:
        rows = rows.join(known.select("workspace_id", "sha256").distinct().withColumn("there", F.lit(True)), ["workspace_id", "sha256"], "left")
        there = F.coalesce("there", F.lit(False))
        held = known.groupBy("workspace_id").agg(F.count("*").alias("held"))
        rows = rows.join(held, "workspace_id", "left")
    turn = F.row_number().over(Window.partitionBy("workspace_id", "sha256", "fit").orderBy("file_id"))
    rows = rows.withColumn("duplicate", F.col("fit") & (there | (turn > 1)))
    new = (F.col("fit") & ~F.col("duplicate")).cast("bigint")
    place = F.sum(new).over(Window.partitionBy("workspace_id").orderBy("file_id")) + (F.coalesce("held", F.lit(0)) if known is not None else 0)
    full = (new == 1) & (place > capacity)
    return rows.withColumn("full", full).select(
        "file_id", "workspace_id", "filename", "mime", "byte_size", "sha256",
        F.when(~F.col("fit") | F.col("full"), "rejected").when(F.col("duplicate"), "duplicate").otherwise("accepted").alias("outcome"),
        F.coalesce("why", F.when(F.col("full"), "workspace_full")).alias("reason"),
    )
