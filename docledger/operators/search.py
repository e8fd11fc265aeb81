"""Full-text search through postings: for each word the documents that have it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.functions.text import search_tokens

BUCKETS = 64


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def postings(documents: DataFrame, text: Column) -> DataFrame:
    """(bucket, token, document_id) of documents (document_id, ...), once for each distinct word of a document."""
    words = documents.select("document_id", F.explode(search_tokens(text)).alias("token"))
    return words.select(bucket(F.col("token")).alias("bucket"), "token", "document_id")


def write_postings(documents: DataFrame, text: Column, path: str) -> None:
    """Writes postings in folders by bucket, sorted by word, so that a lookup reads its words' buckets, and in them few row groups.

    Rows are dealt by ranges of word and document, so that a word which most documents have is spread over many files.
    """
    rows = postings(documents, text)
    keys = ("bucket", "token", "document_id")
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    return spark.read.schema(f"token string, document_id {id_type}, bucket int").parquet(path)


def matching(index: DataFrame, query: str) -> DataFrame:
    """Documents that have every word of a query; a query without words matches nothing.

    The words' buckets are computed first, and reach the scan as a filter on its folders.
    """
    spark = index.sparkSession
    words = spark.range(1).select(F.explode(search_tokens(F.lit(query))).alias("token")).select("token", bucket(F.col("token")).alias("bucket")).collect()  # the words of one query
    if not words:
        return index.select("document_id").limit(0)
    own = index.filter(F.col("bucket").isin(sorted({r.bucket for r in words})) & F.col("token").isin([r.token for r in words]))
    return own.groupBy("document_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(words)).select("document_id")


def matching_all(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, document_id) of many queries (query_id, text) at once: words meet postings by bucket and word, and are counted."""
    words = queries.select("query_id", F.explode(search_tokens(F.col("text"))).alias("token"))
    sizes = words.groupBy("query_id").agg(F.count("*").alias("words"))
    met = words.withColumn("bucket", bucket(F.col("token"))).join(index, ["bucket", "token"])
    return met.groupBy("query_id", "document_id").agg(F.count("*").alias("n")).join(sizes, "query_id").filter("n = words").select("query_id", "document_id")


def counted(index: DataFrame) -> DataFrame:
    """How many distinct words each document has."""
    return index.groupBy("document_id").agg(F.count("*").alias("n_words"))
