"""A corpus pipeline of the llm operators: each stage works on what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.llm import decontam, jaccard, langid, mixing, suffix
from docledger.llm._spark import Tables

LEAST_SCORE = 0.1


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those unlike any language that the labelled ones are in.

    Null, blank and letterless texts go; a null id, lang or source does not matter. Repeated rows are judged alike and all
    stay or go, texts are read whole, and further columns are left out. An empty table, or one without labels, gives no rows.
    """
    found = langid.languages(docs, carry=("text", "lang", "source", "n_chars"))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("doc_id", "text", "lang", "source", "n_chars")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose word 5-gram sets have a Jaccard coefficient of 0.8 or more, directly or through others, one stays.

    The least id stays, a null id ranking last; of rows equal in id and text one stays. Texts without words, null ones
    included, are like no other and stay. Further columns stay, an empty table gives an empty one.
    """
    return jaccard.distinct(docs, k=5, num=80, den=100)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out what 50 bytes or more of an earlier document repeat, whole characters only; documents left blank by that go.

    A null text becomes an empty one and stays, as do texts that were blank before. A null id ranks last. Rows of one id do
    not affect each other, so repeated rows stay repeated. Further columns are left out; an empty table gives an empty one.
    """
    cut = suffix.remove_repeats(docs, characters=True, carry=("lang", "source"))
    text = F.decode("kept", "UTF-8")
    return cut.filter((F.col("n_removed") == 0) | text.rlike(r"\S")).select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to a fifth of its words edited, go.

    Null and empty texts hold no item and stay. All rows of an id go with it, a null id counting as one. Blank items are not
    looked for. Further columns stay; an empty table gives an empty one, and without items all documents stay.
    """
    leaks = decontam.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = Tables(spark, "leaks").write(leaks.select(F.col("doc_id").alias("leaked")).distinct(), "documents")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["leaked"]), "left_anti")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document that it takes, with its whole copies and words.

    Null and blank texts have no words and are not taken; a null source is a source, the last in order; a null id is an id,
    and equal ids are separate documents. Ties in rank are settled by id. An empty table gives an empty mix.
    """
    mix = mixing.mix_sources(docs).filter("taken > 0")
    return mix.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") + F.col("sampled").cast("long")).alias("copies"), "taken")


STAGES = [
    ("language", known_language),
    ("near copies", without_near_copies),
    ("repeats", without_repeats),
    ("benchmarks", without_benchmarks),
    ("mix", mixed_sources),
]

#: The regression of the first stage and the random walks of the fourth have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of a folder; each result is written as Parquet and read by the next stage."""
    tables, docs, before = Tables(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for n, (_, stage) in enumerate(STAGES):
        docs = tables.write(stage(spark, docs, sf_dir), str(n))
        if before:
            tables.drop(before)
        before = str(n)
    return docs
