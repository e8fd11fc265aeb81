"""Where extractions come from: any answering function in batches, and the recording of its answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.sources import tables

ANSWER = "document_id long, sha256 string, kind string, result string, model string, input_tokens long, output_tokens long"


def extracted(documents: DataFrame, answer: Callable[[pd.DataFrame], pd.DataFrame], focus: str | None = None) -> DataFrame:
    """Asks a provider about documents (document_id, sha256, content) in batches.

    `answer` takes a batch with the column `focus` (what a second look should attend to, or null) and gives rows of ANSWER.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield answer(batch)

    return documents.withColumn("focus", F.lit(focus).cast("string")).mapInPandas(ask, ANSWER)


def replayed(documents: DataFrame, recordings: DataFrame, kind: str) -> DataFrame:
    """Recorded answers of one kind for documents; a document without one has a null result."""
    own = recordings.filter(F.col("kind") == kind).groupBy("sha256").agg(F.min("result").alias("result"))
    return documents.select("document_id", "sha256").join(own, "sha256", "left")


def record(answers: DataFrame, path: str) -> None:
    tables.write_recordings(answers.select("sha256", "kind", "result"), path)


def unsettled(manifest: DataFrame, documents: DataFrame) -> DataFrame:
    """Samples of a manifest whose document is not settled yet."""
    done = documents.filter(F.col("status").isin("needs_review", "verified", "rejected", "failed")).select("sha256").distinct()
    return manifest.join(done, "sha256", "left_anti")
