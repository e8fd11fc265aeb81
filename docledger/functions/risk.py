"""Risk of a field, model cost and budget, and the delay before a retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Micro-dollars a token (in, out, written to the cache, read from it), and models that cost nothing.
PRICES = (2.0, 10.0, 2.5, 0.2)
FREE_MODELS = ("mock", "replay")


def criticality(path: Column) -> Column:
    money = r"^(subtotal|tax|shipping|discount|total)$|^lineItems\.\d+\.(amount|unitPrice)$"
    return F.when(path.rlike(money), 1.0).when(path.rlike("^(vendorName|invoiceNumber|issueDate|dueDate|currency)$"), 0.8).otherwise(0.5)


def risk(grounding: Column, blocking: Column, warnings: Column, confidence: Column, weight: Column) -> Column:
    raw = (F.lit(1.0) - grounding) + F.lit(0.5) * blocking + F.lit(0.25) * F.least(warnings, F.lit(2)) + F.lit(0.2) * (F.lit(1.0) - confidence)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw * weight))


def risk_band(value: Column) -> Column:
    return F.when(value < 0.2, "low").when(value < 0.5, "medium").otherwise("high")


def cost_micros(model: Column, tokens_in: Column, tokens_out: Column, cache_write: Column, cache_read: Column) -> Column:
    priced = sum((F.lit(p) * t for p, t in zip(PRICES, (tokens_in, tokens_out, cache_write, cache_read), strict=True)), F.lit(0.0))
    return F.when(model.isin(*FREE_MODELS), 0).otherwise(F.floor(priced + 0.5)).cast("bigint")


def budget_micros(dollars: Column) -> Column:
    return F.floor(dollars * 1e6 + 0.5).cast("bigint")


def within_budget(spent: Column, cap: Column) -> Column:
    return spent < cap


def next_utc_midnight(moment: Column) -> Column:
    return F.date_trunc("day", moment) + F.expr("interval 1 day")


def backoff_seconds(attempts: Column) -> Column:
    """30 seconds, doubled for each attempt after the first."""
    return F.lit(30) * F.pow(F.lit(2), F.greatest(F.lit(0), attempts - 1)).cast("bigint")
