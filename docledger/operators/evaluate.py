"""Scores extracted records against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.text import same_value
from docledger.plans.derived import MONEY_FIELDS


def paired(expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of both sides by their keys, one for each key on a side: keys, e and a, structs of the values, null where the side has no such row.

    The sides are put together and grouped, not joined: rows that are dealt by document, as those made of an invoice and its
    lines are, stay where they are, while a join by two keys would deal both sides anew. Null keys meet nothing.
    """
    side = lambda rows, name: rows.select(*keys, F.lit(name).alias("side"), F.struct(*values).alias("own"))
    every = side(expected, "e").unionByName(side(actual, "a"))
    lone = F.when(F.greatest(*(F.col(k).isNull() for k in keys)), F.col("side"))
    of = lambda name: F.max(F.when(F.col("side") == name, F.col("own"))).alias(name)
    return every.groupBy(*keys, lone.alias("lone")).agg(of("e"), of("a")).drop("lone")


def alike(kind: str, one: Column, other: Column) -> Column:
    """`same_value`; what is printed the same is not read."""
    return one.eqNullSafe(other) | same_value(kind, one, other)


def field_scores(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Of each document the header fields that agree (rows: document_id, field_path, value, one for each field); a field that one side lacks counts as null."""
    both = paired(expected, actual, ["document_id", "field_path"], ["value"])
    e, a = F.col("e.value"), F.col("a.value")
    ok = (e.isNull() & a.isNull()) | F.when(F.col("field_path").isin(*MONEY_FIELDS), alike("money", e, a)).otherwise(alike("text", e, a))
    return both.groupBy("document_id").agg(F.count("*").alias("fields"), F.sum(ok.cast("bigint")).alias("fields_ok"))


def line_scores(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Of each document the lines that agree in all their cells, by position (document_id, idx, description, quantity, unit_price, amount as printed; one for each position)."""
    cells = {"description": "text", "quantity": "decimal", "unit_price": "decimal", "amount": "money"}
    both = paired(expected, actual, ["document_id", "idx"], list(cells))
    ok = F.col("e").isNotNull() & F.col("a").isNotNull()
    for cell, kind in cells.items():
        ok = ok & alike(kind, F.col(f"e.{cell}").cast("string"), F.col(f"a.{cell}").cast("string"))
    return both.groupBy("document_id").agg(F.count("e").alias("lines"), F.sum(F.coalesce(ok, F.lit(False)).cast("bigint")).alias("lines_ok"))


def scores(fields: DataFrame, lines: DataFrame, grounded: DataFrame, codes: DataFrame) -> DataFrame:
    """One row for each document: what agrees, what is located, which issue codes are missed or extra, and whether it passes.

    `grounded` has document_id, values, found; `codes` has document_id, code, kind (missed or extra).
    """
    off = codes.groupBy("document_id").agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("kind") == "missed", F.col("code")))), ",").alias("missed"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("kind") == "extra", F.col("code")))), ",").alias("extra"))
    out = fields.join(lines, "document_id", "left").join(grounded, "document_id", "left").join(off, "document_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("lines", "lines_ok", "values", "found")}).withColumns({c: F.coalesce(c, F.lit("")) for c in ("missed", "extra")})
    return out.withColumn("passed", (F.col("fields") == F.col("fields_ok")) & (F.col("lines") == F.col("lines_ok")) & (F.col("missed") == "") & (F.col("extra") == ""))


HEAD = ("document", "fields", "lines", "grounded", "missed", "extra", "pass")


def report_lines(rows: DataFrame) -> DataFrame:
    """A line of a Markdown table for each scored document: document_id, line."""
    of = lambda one, all_: F.concat_ws("/", one, all_)
    codes = lambda c: F.when(F.col(c) == "", "-").otherwise(F.col(c))
    cells = (F.col("document_id").cast("string"), of("fields_ok", "fields"), of("lines_ok", "lines"), of("found", "values"), codes("missed"), codes("extra"), F.when(F.col("passed"), "yes").otherwise("no"))
    return rows.select("document_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def report(rows: DataFrame) -> str:
    """The whole table of a set of samples, which are few; larger results stay lines of a DataFrame."""
    lines = [r.line for r in report_lines(rows).orderBy("document_id").collect()]
    passed = rows.filter("passed").count()
    return "\n".join(["| " + " | ".join(HEAD) + " |", "|" + " --- |" * len(HEAD), *lines, "", f"{passed} of {len(lines)} pass."])
