"""Reads over the ledger: lookups, joins, aggregates, latest rows and orders. All of them take and give DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.functions import money
from docledger.operators.ranks import ranked
from docledger.operators.rules import severity_rank

IN_FLIGHT = ("queued", "processing")


# Filters and projections


def in_workspace(rows: DataFrame, workspace_id: Column | int, document_id: Column | int | None = None) -> DataFrame:
    """Rows of one workspace, and of one document if given; both predicates reach the scan."""
    out = rows.filter(F.col("workspace_id") == workspace_id)
    return out if document_id is None else out.filter(F.col("document_id") == document_id)


def by_id(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of documents by their ids alone, whatever their workspace; for the pipeline, not for requests."""
    return rows.join(ids.select("document_id").distinct(), "document_id", "left_semi")


def by_digest(documents: DataFrame, digests: DataFrame) -> DataFrame:
    """Documents whose (workspace_id, sha256) is among the digests."""
    return documents.join(digests.select("workspace_id", "sha256").distinct(), ["workspace_id", "sha256"], "left_semi")


def active(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("deleted_at").isNull())


def stage_done(runs: DataFrame) -> DataFrame:
    """(document_id, stage, done): whether some run of the stage has succeeded."""
    return runs.groupBy("document_id", "stage").agg(F.bool_or(F.col("status") == "succeeded").alias("done"))


def page_summaries(pages: DataFrame) -> DataFrame:
    """Pages without their tokens, which the scan then does not read."""
    return pages.select(*(c for c in pages.columns if c != "tokens"))


def open_issues(issues: DataFrame) -> DataFrame:
    """Issues that nobody has resolved or dismissed."""
    return issues.filter(F.col("status") == "open")


def in_flight(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("status").isin(*IN_FLIGHT))


def paused(documents: DataFrame) -> DataFrame:
    return documents.filter((F.col("status") == "queued") & (F.col("failure_code") == "budget_paused"))


def retryable(documents: DataFrame) -> DataFrame:
    """Documents that may be retried, and for the others the refusal: adds `refusal` (409 or null)."""
    return documents.withColumn("refusal", F.when(~F.col("status").isin("failed", "rejected"), 409))


def set_status(documents: DataFrame, status: str, code: str | None = None, message: str | None = None) -> DataFrame:
    """Sets the status; the failure's columns are cleared unless given."""
    return documents.withColumns({"status": F.lit(status), "failure_code": F.lit(code).cast("string"), "failure_message": F.lit(message).cast("string")})


# Joins


def with_lines(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Invoices with their lines as an array in order; an invoice's lines are bounded by its pages."""
    grouped = lines.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("idx", "description", "quantity", "unit_price", "amount"))).alias("lines"))
    return invoices.join(grouped, "document_id", "left")


def latest(rows: DataFrame, keys: list[str], at: str = "created_at", tie: str = "id") -> DataFrame:
    """The newest row of each key, ties going to the largest id; an aggregate, so it combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(at, tie)).alias("row")
    return rows.groupBy(*keys).agg(best).select(*keys, *(F.col(f"row.{c}").alias(c) for c in rest))


def latest_job(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents with the attempts and status of their newest job."""
    newest = latest(jobs.select("document_id", "id", "created_at", "attempts", F.col("status").alias("job_status")), ["document_id"]).drop("id", "created_at")
    return documents.join(newest, "document_id", "left")


def counted(invoices: DataFrame, lines: DataFrame, issues: DataFrame) -> DataFrame:
    """Invoices with counts and sums of their lines and issues, each aggregated before the join; `rules.tallied` counts issues without listing them."""
    own = lines.groupBy("document_id").agg(F.count("*").alias("n_lines"), F.sum("amount").cast(money.MONEY).alias("line_total"))
    found = issues.groupBy("document_id").agg(F.count("*").alias("n_issues"), F.sum((F.col("severity") == "blocking").cast("bigint")).alias("n_blocking"))
    return invoices.join(own, "document_id", "left").join(found, "document_id", "left")


def details(counted: DataFrame, runs: DataFrame, usage: DataFrame) -> DataFrame:
    """One row for each invoice with counts and sums of its children: those of lines and issues that it has, and of runs and usage, aggregated before the join."""
    out = counted.select("document_id", "workspace_id", "filename", "total", "n_lines", "line_total", "n_issues", "n_blocking")
    for part in (runs.groupBy("document_id").agg(F.count("*").alias("n_runs"), F.max("started_at").alias("last_run")), usage_totals(usage)):
        out = out.join(part, "document_id", "left")
    counts = ("n_lines", "n_issues", "n_blocking", "n_runs", "calls", "input_tokens", "output_tokens", "cache_read_tokens", "cost_micros")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in counts})


def issue_fields(issues: DataFrame) -> DataFrame:
    """(document_id, field_path, severity): one row for each field that an issue names, for equi-joins with fields."""
    return issues.select("document_id", F.explode("field_paths").alias("field_path"), "severity")


def with_grounding(fields: DataFrame, groundings: DataFrame) -> DataFrame:
    """Fields with their groundings; both are brought together by document and not dealt anew by field, a document's are bounded by its pages."""
    return beside(fields, groundings)


def beside(fields: DataFrame, rows: DataFrame) -> DataFrame:
    """The left join by document_id and field_path; a document's `rows` become an array, so that the many fields stay dealt by document."""
    rest = [c for c in rows.columns if c not in ("document_id", "field_path")]
    own = rows.filter("field_path is not null").groupBy("document_id").agg(F.collect_list(F.struct("field_path", *rest)).alias("_own"))
    found = F.filter("_own", lambda r: r["field_path"] == F.col("field_path"))
    first = ["document_id", "field_path", *(c for c in fields.columns if c not in ("document_id", "field_path"))]
    return fields.join(own, "document_id", "left").select(*first, F.explode_outer(found).alias("_one")).select(*first, *(F.col(f"_one.{c}").alias(c) for c in rest))


def aligned(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Expected and actual values (value) side by side; a key on one side only has null on the other."""
    return expected.withColumnRenamed("value", "expected").join(actual.withColumnRenamed("value", "actual"), keys, "full_outer")


# Aggregates


def count_by(rows: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def queued(jobs: DataFrame) -> DataFrame:
    """Queued jobs of each workspace, and of all (workspace null), in one grouping."""
    return jobs.rollup("workspace_id").agg(F.sum((F.col("status") == "queued").cast("bigint")).alias("queued"))


def daily_spend(usage: DataFrame) -> DataFrame:
    return usage.groupBy(F.date_trunc("day", "created_at").cast("date").alias("day")).agg(F.sum("cost_micros").cast("bigint").alias("cost_micros"))


def spent_on(usage: DataFrame, day: Column) -> DataFrame:
    """One row: what a UTC day has cost, 0 without any use."""
    start = day.cast("timestamp")
    own = usage.filter((F.col("created_at") >= start) & (F.col("created_at") < start + F.expr("interval 1 day")))
    return own.agg(F.coalesce(F.sum("cost_micros"), F.lit(0)).cast("bigint").alias("cost_micros"))


def usage_totals(usage: DataFrame) -> DataFrame:
    sums = (F.sum(c).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cost_micros"))
    return usage.groupBy("document_id").agg(F.count("*").alias("calls"), *sums)


def grounding_stats(fields: DataFrame, groundings: DataFrame) -> DataFrame:
    """Of each document: values, values located by each method, values not located."""
    found = with_grounding(fields.filter(F.col("value").isNotNull()), groundings)
    by = {m: F.sum((F.col("method") == m).cast("bigint")) for m in ("exact", "normalized", "fuzzy")}
    columns = [F.coalesce(c, F.lit(0)).cast("bigint").alias(m) for m, c in by.items()]
    return found.groupBy("document_id").agg(F.count("*").alias("n_values"), *columns, F.sum(F.col("method").isNull().cast("bigint")).alias("ungrounded"))


def issue_stats(issues: DataFrame) -> DataFrame:
    """Issues of each document by severity, and their codes in the order in which they are listed."""
    counts = (F.sum((F.col("severity") == s).cast("bigint")).alias(s) for s in ("blocking", "warning", "info"))
    codes = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "code"))), lambda x: x["code"]))
    return issues.groupBy("document_id").agg(*counts, F.array_join(codes, ",").alias("codes"))


def field_issue_counts(issues: DataFrame) -> DataFrame:
    counts = (F.sum((F.col("severity") == s).cast("bigint")).alias(s) for s in ("blocking", "warning"))
    return issue_fields(issues).groupBy("document_id", "field_path").agg(*counts)


def parse_stats(pages: DataFrame) -> DataFrame:
    """Of each document: pages by source and the mean OCR confidence, a missing one counting as 0, null without OCR pages."""
    source = lambda s: F.sum((F.col("text_source") == s).cast("bigint"))
    mean = F.avg(F.when(F.col("text_source") == "ocr", F.coalesce("ocr_mean_confidence", F.lit(0.0))))
    return pages.groupBy("document_id").agg(F.count("*").alias("pages"), source("pdf").alias("text_pages"), source("ocr").alias("ocr_pages"), source("none").alias("unreadable_pages"), mean.alias("mean_confidence"))


def finalise_stats(fields: DataFrame, issues: DataFrame) -> DataFrame:
    """Of each document: fields, line items, high-risk fields, blocking issues; fields carry `risk`."""
    own = fields.groupBy("document_id").agg(
        F.sum((~F.col("field_path").startswith("lineItems.")).cast("bigint")).alias("fields"), F.count_distinct(F.nullif(F.regexp_extract("field_path", r"^lineItems\.(\d+)\.", 1), F.lit(""))).alias("line_items"), F.sum((F.col("risk") >= 0.5).cast("bigint")).alias("high_risk")
    )
    blocking = issues.filter("severity = 'blocking'").groupBy("document_id").agg(F.count("*").alias("blocking"))
    return own.join(blocking, "document_id", "left").withColumn("blocking", F.coalesce("blocking", F.lit(0)))


def search_text(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """What a ledger search looks at: vendor, number, currency and line descriptions, null and empty ones left out."""
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    words = lines.filter(F.col("description") != "").groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "description"))), lambda x: x["description"]).alias("words"))
    return invoices.join(words, "document_id", "left").select("document_id", F.concat_ws(" ", full("vendor_name"), full("invoice_number"), full("currency"), F.col("words")).alias("search_text"))


# Windows and orders


def workspace_rank(jobs: DataFrame) -> DataFrame:
    """Queued jobs with their place in the workspace, behind its running ones; a workspace may hold most of the jobs."""
    placed = ranked(jobs.filter("status = 'queued'"), ["workspace_id"], [F.col("created_at"), F.col("id")], "place")
    return behind_running(placed, jobs)


def behind_running(placed: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs with a place in their workspace, moved behind its running ones."""
    running = jobs.filter("status = 'running'").groupBy("workspace_id").agg(F.count("*").alias("running"))
    return placed.join(running, "workspace_id", "left").withColumn("workspace_rank", F.col("place") + F.coalesce("running", F.lit(0))).drop("place", "running")


def issue_order(issues: DataFrame) -> DataFrame:
    """Issues with their place in the document's list: by severity, then code, then the order in which they were found."""
    order = Window.partitionBy("document_id").orderBy(severity_rank(F.col("severity")), "code", "place")
    return issues.withColumn("position", F.row_number().over(order))


def first_files(files: DataFrame, most: int = 5) -> DataFrame:
    """Files of each request with whether they are among the first ones, which are taken."""
    return files.withColumn("taken", F.row_number().over(Window.partitionBy("request_id").orderBy("position")) <= most)


# Set operations


def missed_and_extra(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(document_id, code, kind): codes expected and not there, and there but not expected."""
    side = lambda rows, is_expected: rows.select("document_id", "code", F.lit(is_expected).alias("expected"))
    return off(side(expected, True).unionByName(side(actual, False)))


def off(rows: DataFrame) -> DataFrame:
    """The same of one table with codes of both sides (document_id, code, expected: whether the row is of the expected ones), which is read once."""
    seen = rows.groupBy("document_id", "code").agg(F.bool_or("expected").alias("expected"), F.bool_and("expected").alias("missed"))
    return seen.filter(F.col("missed") | ~F.col("expected")).select("document_id", "code", F.when(F.col("missed"), "missed").otherwise("extra").alias("kind"))


def merged_workspace(documents: DataFrame, source: int, target: int) -> DataFrame:
    """Documents after a workspace joins another: its documents move, but for those whose bytes the target has."""
    known = documents.filter(F.col("workspace_id") == target).select("sha256").distinct()
    moving = documents.filter(F.col("workspace_id") == source).join(known, "sha256", "left_anti").withColumn("workspace_id", F.lit(target).cast(documents.schema["workspace_id"].dataType))
    return documents.filter(F.col("workspace_id") != source).unionByName(moving)


def without_documents(children: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of a child table after documents are deleted (cascade)."""
    return children.join(gone.select("document_id").distinct(), "document_id", "left_anti")


def with_null_documents(children: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of a child table that outlive their document, whose id then is null."""
    marked = gone.select("document_id").distinct().withColumn("is_gone", F.lit(True))
    return children.join(marked, "document_id", "left").withColumn("document_id", F.when(F.col("is_gone").isNull(), F.col("document_id"))).drop("is_gone")


def complete(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: whether each sample of a manifest that is not empty has been scored."""
    n, m = rows.select("name").distinct(), manifest.select("name").distinct()
    both = m.join(n.withColumn("scored", F.lit(1)), "name", "left").agg(F.count("*").alias("samples"), F.count("scored").alias("scored"))
    return both.withColumn("complete", (F.col("samples") > 0) & (F.col("samples") == F.col("scored")))


# Views for an API


def summaries(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents as a list shows them, newest first: times in ISO form, the attempts of the newest job."""
    attempts = latest(jobs.select("document_id", "id", "created_at", "attempts"), ["document_id"]).select("document_id", "attempts")
    iso = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return documents.join(attempts, "document_id", "left").select("document_id", "filename", "status", iso.alias("created_at"), F.coalesce("attempts", F.lit(0)).alias("attempts"))


def client_invoice(invoices: DataFrame) -> DataFrame:
    """Invoices without what only the search needs."""
    return invoices.drop("search_text", "vendor_key")


def newest_first(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Rows with their position from the newest on, within each key, of which one may hold most rows."""
    return ranked(rows, keys, [F.desc(at), F.desc(tie)], "position")


def global_rank(jobs: DataFrame, most: int) -> DataFrame:
    """The first `most` queued jobs, oldest first, with their place behind all running ones; only they are ranked."""
    running = jobs.filter("status = 'running'").agg(F.count("*").alias("running"))
    first = jobs.filter("status = 'queued'").orderBy("created_at", "id").limit(most)
    ranked = first.withColumn("place", F.row_number().over(Window.orderBy("created_at", "id")))  # at most `most` rows
    return ranked.join(F.broadcast(running)).select("id", (F.col("place") + F.col("running")).alias("global_rank"))  # one row


def field_paths(issues: DataFrame) -> DataFrame:
    """Of each document the distinct fields that its issues name, in order."""
    return issue_fields(issues).groupBy("document_id").agg(F.array_join(F.sort_array(F.collect_set("field_path")), ",").alias("field_paths"))


def health(usage: DataFrame, day: Column, cap_micros: int) -> DataFrame:
    """One row: what the day has cost, and whether the budget still allows work."""
    return spent_on(usage, day).withColumn("within", F.col("cost_micros") < cap_micros)
