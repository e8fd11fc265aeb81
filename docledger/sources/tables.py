"""Sources and sinks for the domain's tables: JSON documents, recordings, and Parquet tables replaced by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCALAR = "struct<value:string,display:string,page:int>"
HEADER = ("vendorName", "invoiceNumber", "issueDate", "dueDate", "currency", "subtotal", "tax", "shipping", "discount", "total")
GROUND_TRUTH = (
    f"name string, docType string, fields struct<{','.join(f'{f}:{SCALAR}' for f in HEADER)}>, "
    "lineItems array<struct<description:string,quantity:string,unitPrice:string,amount:string,display:struct<quantity:string,unitPrice:string,amount:string>,page:int>>, expectedIssues array<string>, notes string"
)
MANIFEST = "name string, file string, mime string, sha256 string, pages int, kind string"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of a declared shape; one that does not have it fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def truth_fields(truth: DataFrame) -> DataFrame:
    """Ground truth as extracted values: (name, field_path, value, source_text, page, confidence)."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field_path"), F.col(f"fields.{f}").alias("s")) for f in HEADER))
    return truth.select("name", F.explode(pairs).alias("x")).select(
        "name", "x.field_path", F.col("x.s.value").alias("value"), F.when(F.col("x.s.value").isNotNull(), F.coalesce("x.s.display", "x.s.value")).alias("source_text"), F.when(F.col("x.s").isNotNull(), F.coalesce("x.s.page", F.lit(1))).alias("page"), F.lit(0.9).alias("confidence")
    )


def read_recordings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Recorded answers `{sha256}.{kind}.json`; a file whose content names another digest or kind fails the read."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    good = F.col("file") == F.concat("sha256", F.lit("."), "kind", F.lit(".json"))
    return rows.filter(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("recording does not match its name: "), "file")).cast("boolean"))).drop("file")


def write_recordings(recordings: DataFrame, path: str) -> None:
    """Recordings as JSON, nulls included, partitioned by digest and kind."""
    body = F.to_json(F.struct(*recordings.columns), {"ignoreNullFields": "false"})
    recordings.select(F.col("sha256").alias("digest"), F.col("kind").alias("of"), body.alias("value")).write.mode("append").partitionBy("digest", "of").text(path)


def answers(documents: DataFrame, recordings: DataFrame, truth: DataFrame) -> DataFrame:
    """The stand-in for a model: for each document (document_id, sha256) its recording, else its ground truth, else `other`.

    Both tables have sha256 and result (JSON); documents are few columns wide, so the joins move digests only.
    """
    one = recordings.groupBy("sha256").agg(F.min("result").alias("recorded"))
    two = truth.groupBy("sha256").agg(F.min("result").alias("true"))
    other = F.lit('{"docType":"other"}')
    return documents.join(one, "sha256", "left").join(two, "sha256", "left").select("document_id", F.coalesce("recorded", "true", other).alias("result"), F.when(F.col("recorded").isNotNull(), "recording").when(F.col("true").isNotNull(), "truth").otherwise("none").alias("origin"))


def replaced(old: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """A child table after all rows of the documents in `new` are replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """A table after rows are put in or put over those with the same keys; of several new rows the latest counts."""
    last = new.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at)))).filter("turn = 1").drop("turn")
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last)


def inserted_if_absent(old: DataFrame, new: DataFrame, keys: list[str], order: str, live: str = "true") -> DataFrame:
    """A table after new rows are added for keys without a live row; of several new rows of a key the first counts."""
    first = new.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("turn = 1").drop("turn")
    return old.unionByName(first.join(old.filter(live).select(*keys).distinct(), keys, "left_anti"))


def append(rows: DataFrame, path: str) -> DataFrame:
    """Adds rows to a table of records that are never changed; returns the whole table."""
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_truth(truth: DataFrame, path: str, files: int = 64) -> None:
    """Ground truth (of the shape GROUND_TRUTH) as JSON, many documents to a file, nulls included."""
    body = F.to_json(F.struct(*truth.columns), {"ignoreNullFields": "false"})
    part = F.pmod(F.xxhash64("name"), F.lit(files))
    rows = truth.select(part.alias("part"), body.alias("body")).groupBy("part").agg(F.array_join(F.collect_list("body"), ",").alias("all"))
    rows.select("part", F.concat(F.lit("["), "all", F.lit("]")).alias("value")).write.partitionBy("part").text(path)


def publish(rows: DataFrame, path: str, version: str) -> str:
    """Writes a table's next version beside the ones before, so that readers of those are not disturbed; returns its path."""
    target = f"{path}/version={version}"
    rows.write.mode("errorifexists").parquet(target)
    return target


def api_json(rows: DataFrame) -> DataFrame:
    """Rows as JSON text, null members kept, times in ISO form."""
    columns = [F.date_format(F.col(n), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(n) if t.startswith("timestamp") else F.col(n) for n, t in rows.dtypes]
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))
