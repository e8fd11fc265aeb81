"""Queries of the corpus operators over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.llm import decontam, html, jaccard, langid, lines, merkle, mixing, mtree, packing, quality, suffix, warc, whitening
from docledger.llm._spark import Tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Tables(spark, 'archive').root}/warc"
    return warc.archive_pages(table(spark, sf_dir, "pages"), path).drop("uri")


def op3_mtree_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_products(table(spark, sf_dir, "embeddings"))


def op4_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("removed", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ";")
    text = F.coalesce("text", F.lit(""))
    done = lines.remove_repeated_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_units", F.size("removed").cast("long").alias("n_removed"), spans.alias("removed"), F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("kept_md5"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # documents carry no URL: their source stands for the host, its part in one language for the path
    return quality.posteriors(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return done.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = {"text": F.translate("text", merkle.UPPERCASE, merkle.UPPERCASE.lower())}
    return merkle.manifest(table(spark, sf_dir, "documents"), changed=tampered, where=F.crc32(F.col("doc_id").cast("string")) % 3 == 0).drop("n_siblings")


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_mtree_top": op3_mtree_top,
    "op4_repeated_lines": op4_repeated_lines,
    "op5_language_id": op5_language_id,
    "op6_site_quality": op6_site_quality,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_main_text": op8_main_text,
    "op9_mix_sources": op9_mix_sources,
    "op10_benchmark_leaks": op10_benchmark_leaks,
    "op11_whitening": op11_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_best_fit": op13_best_fit,
}

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": suffix.SQL,
    "op7_jaccard_join": jaccard.SQL,
    "op2_warc_revisits": warc.SQL,
    "op3_mtree_top": mtree.SQL,
    "op4_repeated_lines": lines.SQL,
    "op9_mix_sources": mixing.SQL.format(docs="documents"),
    "op12_merkle_manifest": merkle.SQL,
}
