"""From extracted values to the draft invoice: metadata of fields with their risk, and the typed header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions import dates, money, risk, text
from docledger.operators.ledger import beside, field_issue_counts, with_grounding
from docledger.plans.derived import MONEY_FIELDS


def field_metadata(fields: DataFrame, groundings: DataFrame, issues: DataFrame) -> DataFrame:
    """Fields (document_id, field_path, value, confidence) with their place, issues, risk and its band.

    A null value has nothing to be located: its risk counts it as located, its stored score is 0.
    """
    joined = beside(with_grounding(fields, groundings), field_issue_counts(issues))
    found = F.coalesce("score", F.lit(0.0))
    for_risk = F.when(F.col("value").isNull(), 1.0).otherwise(found)
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    value = risk.risk(for_risk, count("blocking"), count("warning"), F.col("confidence"), risk.criticality(F.col("field_path")))
    return joined.withColumns(
        {"risk": value, "band": risk.risk_band(F.round(value, 9)), "score": F.when(F.col("value").isNull(), 0.0).otherwise(found), "method": F.coalesce("method", F.lit("none")), "blocking": count("blocking"), "warning": count("warning"), "status": F.lit("pending")}
    )


def value_of(name: str) -> Column:
    """A field's value out of long rows, for use in an aggregate by document."""
    return F.max(F.when(F.col("field_path") == name, F.col("value")))


def header(fields: DataFrame) -> DataFrame:
    """The typed header of each document from its long field rows; printed dates and amounts that do not read are null."""
    rows = fields.groupBy("document_id").agg(*(value_of(f).alias(f) for f in ("vendorName", "invoiceNumber", "issueDate", "dueDate", "currency", *MONEY_FIELDS)))
    return rows.select(
        "document_id", F.col("vendorName").alias("vendor_name"), text.vendor_key(F.col("vendorName")).alias("vendor_key"), F.col("invoiceNumber").alias("invoice_number"),
        dates.draft_date(F.col("issueDate")).alias("issue_date"), dates.draft_date(F.col("dueDate")).alias("due_date"), F.upper("currency").alias("currency"),
        *(money.parse_money(F.col(f)).alias(f) for f in MONEY_FIELDS), F.col("issueDate").alias("printed_issue_date"), F.col("total").alias("printed_total"),
    )


def unreadable_money(metadata: DataFrame) -> DataFrame:
    """Metadata in which header amounts that were printed but cannot be read have the highest risk."""
    bad = F.col("field_path").isin(*MONEY_FIELDS) & (F.col("value") != "") & money.parse_money(F.col("value")).isNull()
    return metadata.withColumn("risk", F.when(bad, 1.0).otherwise(F.col("risk"))).withColumn("band", risk.risk_band(F.round("risk", 9)))
