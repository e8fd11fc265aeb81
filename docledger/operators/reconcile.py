"""A second look at documents whose amounts contradict each other, kept only where it makes them easier to review."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.operators.queue import adoption
from docledger.shared import written
from docledger.sources.tables import replaced

#: The issues of sums that do not agree.
ARITHMETIC = ("V002", "V003")
#: What of an issue is looked at here.
LOOKED_AT = ("code", "severity", "field_paths", "message", "place")


@dataclass
class Answer:
    """What was read from documents: invoices and lines (with document_id), and their types (document_id, doc_type)."""

    invoices: DataFrame
    lines: DataFrame
    types: DataFrame | None = None


@dataclass
class Reconciled:
    """The tables after second looks, and what came of each look: document_id, round, before, after, doc_type, adopted, skipped."""

    answer: Answer
    issues: DataFrame
    looks: DataFrame


def focus(issues: DataFrame) -> DataFrame:
    """Documents that need a second look: document_id, the field paths that do not agree, and why, in the order of their issues."""
    wrong = issues.filter((F.col("severity") == "blocking") & F.col("code").isin(*ARITHMETIC))
    own = F.sort_array(F.collect_list(F.struct("code", "place", "field_paths", "message")))  # a few issues of one document
    rows = wrong.groupBy("document_id").agg(own.alias("own"))
    return rows.select("document_id", F.array_distinct(F.flatten(F.transform("own", lambda x: x["field_paths"]))).alias("field_paths"), F.array_join(F.transform("own", lambda x: x["message"]), " ").alias("reason"))


def blocking(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """How many blocking issues each document has, 0 included."""
    counts = issues.filter("severity = 'blocking'").groupBy("document_id").agg(F.count("*").alias("blocking"))
    return documents.join(counts, "document_id", "left").select("document_id", F.coalesce("blocking", F.lit(0).cast("long")).alias("blocking"))


def reconcile(
    first: Answer, issues: DataFrame, look: Callable[[DataFrame], Answer], validate: Callable[[DataFrame, DataFrame], DataFrame], looked: DataFrame | None = None, paused: Column | None = None, rounds: int = 1, alone: bool = False
) -> Reconciled:
    """Looks again at documents with arithmetic contradictions, all at once, and adopts second answers that have fewer blocking issues.

    `look` takes documents with their focus (document_id, field_paths, reason) and gives what a second reading found, for
    instance from recordings; `validate` grounds and checks invoices and lines and gives their issues. An answer of type `other`
    is never adopted, nor one that does not lessen the blocking issues, so that no document gets harder to review. Documents in
    `looked` had their second look and are skipped, and so are those that `paused` holds for (a spent budget is no reason to keep
    a document back); documents without an answer keep their first. With several rounds, documents whose new answer still
    contradicts itself are looked at again, at most once a round, until nothing is adopted any more.

    Issues that depend on other documents are made anew for all adopted documents once their answers have taken
    effect. Where each document's issues are its own (`alone`), those that decided on its answer are kept, and nothing is validated again. Calling it again with the looks it gave as `looked` changes nothing. Tables may be empty; a document's rows all
    go or all stay. Eager: each round's second answers, counts and decisions are written before they take effect.
    """
    answer, looks = first, []
    asked = looked.select("document_id").distinct() if looked is not None else None
    issues = written(issues)  # gone through for the focus, for the counts and for what stays as it is
    wanted = focus(issues)
    for number in range(1, rounds + 1):
        skipped = F.lit(None).cast("string") if paused is None else F.when(paused, "budget_paused")
        if asked is not None:
            wanted = wanted.join(asked.withColumn("asked", F.lit(True)), "document_id", "left").withColumn("skipped", F.when(F.col("asked"), "already_reconciled").otherwise(skipped)).drop("asked")
        else:
            wanted = wanted.withColumn("skipped", skipped)
        wanted = written(wanted)
        found = look(wanted.filter("skipped is null").drop("skipped"))
        found = Answer(written(found.invoices), written(found.lines), None if found.types is None else written(found.types))
        there = found.invoices.select("document_id").distinct().join(wanted.filter("skipped is null").select("document_id"), "document_id", "left_semi")
        types = there.withColumn("doc_type", F.lit("invoice")) if found.types is None else there.join(found.types.select("document_id", "doc_type"), "document_id", "left")
        checked = validate(found.invoices.join(there, "document_id", "left_semi"), found.lines.join(there, "document_id", "left_semi"))
        checked = written(checked) if alone else checked
        second = blocking(there, checked).join(types.withColumn("doc_type", F.coalesce("doc_type", F.lit("invoice"))), "document_id")
        judged = adoption(blocking(wanted.select("document_id"), issues), second)
        result = wanted.select("document_id", "skipped").join(judged, "document_id", "left").withColumn("adopted", F.coalesce("adopted", F.lit(False)))
        result = written(result.withColumns({"round": F.lit(number), "skipped": F.when(F.col("after").isNull(), F.coalesce("skipped", F.lit("no_answer")))}))
        looks.append(result.select("document_id", "round", "before", "after", "doc_type", "adopted", "skipped"))
        adopted = result.filter("adopted").select("document_id")
        if adopted.isEmpty():
            break
        own = lambda rows: rows.join(adopted, "document_id", "left_semi")  # noqa: B023, E731
        without = lambda rows: rows.join(adopted, "document_id", "left_anti")  # noqa: B023, E731
        # lines go with their document even where the new answer has none
        lines = without(answer.lines).unionByName(own(found.lines).select(*answer.lines.columns))
        answer = Answer(replaced(answer.invoices, own(found.invoices).select(*answer.invoices.columns)), lines, answer.types)
        if number < rounds:  # after the last round they are two written tables put together, and not copied once more
            answer = Answer(written(answer.invoices), written(answer.lines), answer.types)
        new = checked if alone else validate(answer.invoices, answer.lines)
        issues = written(without(issues).unionByName(own(new).select(*issues.columns)))
        asked, wanted = None, focus(own(issues))
    every = looks[0]
    for more in looks[1:]:
        every = every.unionByName(more)
    return Reconciled(answer, issues, every)
