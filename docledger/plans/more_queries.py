"""Queries of the smaller operators, and their SQL."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions import dates, money, text
from docledger.operators import evaluate, ledger, queue, rules, tokens
from docledger.plans.derived import CTES, Ledger
from docledger.plans.function_queries import ORACLE_SQL as FUNCTION_SQL
from docledger.plans.function_queries import WORDS, evaluation, word_pages
from docledger.plans.ledger_queries import ISSUES, STATUS, issues, over, with_status
from docledger.plans.rule_queries import amount
from docledger.shared import shared_dir
from docledger.sources import providers, tables

EVALUATION = FUNCTION_SQL["e01_evaluation"]

DAY = "date '2024-01-10'"


def uploads(x: Ledger):
    n = F.col("doc_id")
    return x.read("documents").select(n.alias("document_id"), F.col("source").alias("workspace_id"), F.sha2("text", 256).alias("sha256"), F.when(n % 6 == 0, F.lit("2024-01-01").cast("timestamp")).alias("deleted_at"))


def image_pages(x: Ledger):
    n = F.col("document_id")
    return word_pages(x).select((n % 200).alias("document_id"), F.floor(n / 200).cast("int").alias("page_no"), "tokens", F.when(n % 200 % 9 == 0, "image/png").otherwise("application/pdf").alias("mime"), (n % 4 != 1).alias("has_image"))


PAGES = f"""{WORDS}, a as (select document_id, flatten(list(ws order by line)) as ws from t group by 1),
p as (select document_id % 200 as d, document_id // 200 as page_no, len(list_filter(ws, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))) >= 20 as is_text, document_id % 4 <> 1 as has_image, case when document_id % 200 % 9 = 0 then 'image/png' else 'application/pdf' end as mime from a)"""


def reviewed() -> Column:
    """What reviewers did about the issues of a document."""
    n = F.col("document_id")
    return F.when(n % 3 == 0, "open").when(n % 3 == 1, "resolved").otherwise("dismissed")


def iso_forms(x: Ledger):
    """Days as they are, in another order, outside the calendar, and what is no day."""
    n, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    shown = F.when(n % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(n % 4 == 1, F.date_format(day, "dd.MM.yyyy")).when(n % 4 == 2, F.date_format(day, "yyyy-02-31"))
    return x.read("orders").select(n.alias("id"), shown.alias("shown"), F.when(n % 3 == 0, "2024-02-29").otherwise(F.date_format(day, "yyyy-MM-dd")).alias("iso"))


def repaired(x: Ledger):
    codes = F.explode(F.split(F.when(F.col("id") % 5 == 0, "V001,V002").when(F.col("id") % 5 == 1, "V003"), ",")).alias("code")
    return queue.repaired(x.extractions, x.extractions.select(F.col("id").alias("extraction_id"), codes)).select("document_id", "code")


def replays(x: Ledger):
    docs = uploads(x).select("document_id", "sha256")
    kept = docs.filter("document_id % 3 <> 0").select("sha256", F.when(F.col("document_id") % 2 == 0, "initial").otherwise("reconcile").alias("kind"), F.concat(F.lit("r"), F.lpad(F.col("document_id").cast("string"), 9, "0")).alias("result"))
    return providers.replayed(docs, kept, "initial").select("document_id", "result")


def waiting(x: Ledger):
    status = F.element_at(F.array(*map(F.lit, ("queued", "processing", "needs_review", "verified", "failed", "rejected"))), (F.col("document_id") % 6 + 1).cast("int"))
    docs = uploads(x).select("document_id", "sha256")
    return providers.unsettled(docs, docs.withColumn("status", status)).select("document_id")


def items(x: Ledger):
    """Each document's whole text as one printed item: its words, and a digest of them with their places in millionths."""
    box = F.struct(F.lit(0.1).alias("x"), F.lit(0.2).alias("y"), F.lit(0.5).alias("w"), F.lit(0.02).alias("h"))
    own = x.read("documents").select("doc_id", tokens.words_of_item(F.regexp_replace("text", f"[{text.SPACES}]", " "), box).alias("t"))
    millionths = lambda c: F.floor(c * 1e6 + 0.5).cast("bigint").cast("string")
    shown = F.array_join(F.transform("t", lambda t: F.concat_ws(" ", t["text"], millionths(t["x"]), millionths(t["w"]))), "\n")
    return own.select("doc_id", F.size("t").alias("n"), F.md5(shown).alias("places_md5"))


def ocr(x: Ledger):
    n = F.col("doc_id")
    word = lambda w, i: F.struct(w.alias("text"), (F.length(w) % 10 * 10.0).cast("double").alias("confidence"), (i * 10.0).cast("double").alias("x0"), F.lit(0.0).alias("y0"), (i * 10.0 + 8).cast("double").alias("x1"), F.lit(10.0).alias("y1"))
    pages = x.read("documents").select(n.alias("document_id"), F.lit(1).alias("page_no"), F.lit(1000.0).alias("width"), F.lit(1000.0).alias("height"), F.transform(F.split(F.regexp_replace("text", r"\n", " "), " "), word).alias("words"))
    return tokens.ocr_pages(pages).select("document_id", F.size("tokens").alias("n"), F.round("ocr_mean_confidence", 9).alias("confidence"))


def recordings(x: Ledger):
    docs = uploads(x).select("document_id", "sha256")
    named = lambda rows, label: rows.select("sha256", F.concat(F.lit(label), "document_id").alias("result"))
    return tables.answers(docs, named(docs.filter("document_id % 3 = 0"), "r"), named(docs.filter("document_id % 2 = 0"), "t")).select("document_id", "origin")


def finalised(x: Ledger):
    fields = x.fields
    metadata = fields.select("document_id", F.lit(0.5).alias("risk"))
    old = x.invoices.select("document_id", "vendor_name", F.lit(None).cast("decimal(18,2)").alias("total"))
    new, _ = queue.finalised(metadata, fields, old, x.invoices.select("document_id").withColumn("status", F.lit("processing")))
    return new


def truth(x: Ledger):
    """Ground truth of all invoices, written as JSON and read again."""
    n = F.col("document_id")
    scalar = lambda c, shown=None: F.struct(F.col(c).cast("string").alias("value"), (F.lit(None) if shown is None else shown).cast("string").alias("display"), (n % 3 + 1).cast("int").alias("page"))
    names = dict(zip(tables.HEADER, ("vendor_name", "invoice_number", "printed_issue_date", "printed_due_date", "currency", "subtotal", "tax", "shipping", "discount", "total"), strict=True))
    fields = F.struct(*(scalar(c, F.when(n % 2 == 0, F.concat("symbol", F.col(c).cast("string"))) if c == "total" else None).alias(f) for f, c in names.items()))
    rows = x.invoices.select(n.cast("string").alias("name"), F.lit("invoice").alias("docType"), fields.alias("fields"))
    path = f"{shared_dir(x.spark)}/truth-{uuid.uuid4().hex}"
    tables.write_truth(rows, path)
    return tables.truth_fields(tables.read_json(x.spark, path, tables.GROUND_TRUTH)).select("name", "field_path", "value", "source_text", "page")


def appended(x: Ledger):
    """Usage recorded in two goes, and what all of it comes to."""
    path = f"{shared_dir(x.spark)}/usage-{uuid.uuid4().hex}"
    tables.append(x.usage.filter("id % 2 = 0"), path)
    return tables.append(x.usage.filter("id % 2 = 1"), path).groupBy("workspace_id").agg(F.count("*").alias("n"), F.sum("cost_micros").alias("cost_micros"))


def asked(x: Ledger):
    """A provider that answers with the size of what it is shown."""

    def answer(batch: pd.DataFrame) -> pd.DataFrame:
        sizes = batch.content.map(lambda c: len(c or b""))
        return pd.DataFrame({"document_id": batch.document_id, "sha256": batch.sha256, "kind": "initial", "result": sizes.astype(str) + " bytes, " + batch.focus, "model": "mock", "input_tokens": sizes // 4, "output_tokens": 3})

    docs = x.read("documents").select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("sha256"), F.col("text").cast("binary").alias("content"))
    return providers.extracted(docs, answer, "totals").select("document_id", "result", "input_tokens", "output_tokens")


QUERIES = {
    "p02_unscoped": over(lambda x: ledger.by_id(x.invoices, x.runs).select("document_id", "workspace_id")),
    "s10_truth": over(truth),
    "s15_append": over(appended),
    "s17_report": over(lambda x: evaluate.report_lines(evaluation(x))),
    "u01_extract": over(asked),
    "p03_by_digest": over(lambda x: ledger.by_digest(uploads(x), uploads(x).filter("document_id % 10 = 0")).select("document_id")),
    "p04_active": over(lambda x: ledger.active(uploads(x)).select("document_id")),
    "p06_page_summaries": over(lambda x: ledger.page_summaries(word_pages(x)).select("document_id", "page_no")),
    "p07_summaries": over(lambda x: ledger.summaries(with_status(x).join(x.jobs.select("document_id", "created_at"), "document_id").withColumn("filename", F.concat(F.lit("inv-"), "document_id")), x.jobs)),
    "p08_client_invoice": over(lambda x: ledger.client_invoice(x.invoices).select("document_id", "vendor_name", "invoice_number", "total")),
    "p09_open_issues": over(lambda x: ledger.open_issues(issues(x).withColumn("status", reviewed())).select("document_id", "code")),
    "p14_kind": over(lambda x: tokens.document_kinds(image_pages(x)).select("document_id", "kind")),
    "p15_ocr_pick": over(lambda x: tokens.pages_to_read(image_pages(x)).select("document_id", "page_no")),
    "p16_set_status": over(lambda x: ledger.set_status(with_status(x), "failed", "parse_failed", "No text").select("document_id", "status", "failure_code", "failure_message")),
    "j07_running_counts": over(lambda x: x.jobs.groupBy("workspace_id").agg(F.count_if(F.col("status") == "running").alias("running"))),
    "j11_field_grounding": over(lambda x: ledger.with_grounding(x.fields, x.groundings).select("document_id", "field_path", "method")),
    "a11_mean_confidence": over(ocr),
    "a16_upload_tally": over(lambda x: ledger.count_by(uploads(x).withColumn("kind", F.when(F.col("document_id") % 3 == 0, "accepted").otherwise("rejected")), "workspace_id", "kind")),
    "w02_global_rank": over(lambda x: ledger.global_rank(x.jobs, 300)),
    "w04_newest_initial": over(lambda x: ledger.latest(x.extractions.filter("kind = 'initial'"), ["document_id"]).select("document_id", "id")),
    "o01_newest_first": over(lambda x: ledger.newest_first(x.jobs, ["workspace_id"], "created_at", "id").select("id", "position")),
    "o04_oldest_due": over(lambda x: x.jobs.filter("status = 'queued'").orderBy("created_at", "id").limit(25).select("id")),
    "o07_first_files": over(lambda x: ledger.first_files(x.lines.select(F.col("document_id").alias("request_id"), F.col("idx").alias("position")), 2)),
    "t02_field_paths": over(lambda x: ledger.field_paths(rules.due_before_issue(x.invoices).unionByName(rules.negative_total(x.invoices)))),
    "t05_complete": over(lambda x: ledger.complete(x.read("nation").filter("n_nationkey < 20").select(F.col("n_name").alias("name")), x.read("nation").select(F.col("n_name").alias("name")))),
    "f04_cents": over(lambda x: x.lines.filter("amount is not null").select("document_id", "idx", money.to_cents(F.col("amount")).alias("cents"))),
    "f09_trim_zeros": over(lambda x: x.lines.select("document_id", "idx", text.trim_zeros(F.col("unit_price").cast("string")).alias("shown"))),
    "f19_item_words": over(items),
    "f23_list_words": over(lambda x: x.read("nation").groupBy("n_regionkey").agg(text.list_words(F.array_sort(F.collect_list("n_name"))).alias("names"), text.format_bytes(F.sum(F.col("n_nationkey") * 999)).alias("bytes"))),
    "f25_currency": over(lambda x: x.invoices.select("document_id", "currency")),
    "f27_contrast": over(lambda x: x.read("nation").select("n_nationkey", F.round(text.contrast_ratio(F.concat(F.lit("#"), F.lpad(F.hex(F.col("n_nationkey") * 671088), 6, "0")), F.lit("#ffffff")), 6).alias("ratio"))),
    "s12_replace": over(lambda x: tables.replaced(x.lines.select("document_id", "idx"), x.lines.filter("document_id % 4 = 0").select("document_id", (F.col("idx") + 100).alias("idx")))),
    "s14_insert_absent": over(lambda x: tables.inserted_if_absent(x.read("customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("owner"), F.lit(0).cast("long").alias("at")), x.read("orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("at")), ["owner"], "at")),
    "s16_api_json": over(lambda x: tables.api_json(x.read("nation").select("n_nationkey", F.nullif("n_name", F.lit("CHINA")).alias("n_name")))),
    "u03_answers": over(recordings),
    "u04_replay": over(replays),
    "e03_unsettled": over(waiting),
    "f14_iso_date": over(lambda x: iso_forms(x).select("id", dates.is_iso_date(F.col("shown")).alias("iso"), dates.date_equals(F.col("shown"), F.col("iso")).alias("same"))),
    "f14b_draft_date": over(lambda x: iso_forms(x).select("id", dates.draft_date(F.col("shown")).alias("day"))),
    "q10_repair": over(repaired),
    "q11_finalise": over(finalised),
    "q13_duration": over(lambda x: queue.with_duration(x.runs.withColumn("finished_at", F.timestamp_add("SECOND", F.col("id") % 90, F.col("started_at")))).select("id", "duration_ms")),
    "q14_budget_guard": over(lambda x: queue.blocked_by_budget(x.usage, x.invoices.select("document_id"), F.expr(DAY), 1_000_000, False).select("document_id", "blocked")),
    "x01_health": over(lambda x: ledger.health(x.usage, F.expr(DAY), 1_000_000_000_000)),
}

ISO = "with s as (select o_orderkey as id, o_orderkey % 4 as k, cast(o_orderdate as date) as day, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%d.%m.%Y') when 2 then strftime(o_orderdate, '%Y') || '-02-31' end as shown from orders)"

ORACLE_SQL = {
    "p02_unscoped": CTES + "select document_id, workspace_id from invoices where document_id in (select document_id from runs)",
    "s10_truth": CTES + f"""select cast(document_id as varchar) as name, f as field_path, v as value, case when v is not null and f = 'total' and document_id % 2 = 0 then symbol || v else v end as source_text, cast(document_id % 3 + 1 as integer) as page from (
  select document_id, symbol, unnest(['vendorName', 'invoiceNumber', 'issueDate', 'dueDate', 'currency', 'subtotal', 'tax', 'shipping', 'discount', 'total']) as f,
    unnest([vendor_name, invoice_number, printed_issue_date, strftime(due_date, '%Y-%m-%d'), currency, {', '.join(amount(c) for c in ('subtotal_c', 'tax_c', 'shipping_c', 'discount_c', 'total_c'))}]) as v from invoices)""",
    "s15_append": CTES + "select workspace_id, count(*) as n, cast(sum(cost_micros) as bigint) as cost_micros from usage group by 1",
    "s17_report": f"""select document_id, '| ' || document_id || ' | ' || fields_ok || '/' || fields || ' | ' || lines_ok || '/' || lines || ' | ' || found || '/' || "values" || ' | ' || case when missed = '' then '-' else missed end || ' | ' || case when extra = '' then '-' else extra end || ' | ' || case when passed then 'yes' else 'no' end || ' |' as line from ({EVALUATION})""",
    "u01_extract": "select doc_id as document_id, coalesce(strlen(text), 0) || ' bytes, totals' as result, coalesce(strlen(text), 0) // 4 as input_tokens, cast(3 as bigint) as output_tokens from documents",
    "p03_by_digest": "with d as (select doc_id, source, sha256(text) as h from documents) select doc_id as document_id from d where (source, h) in (select (source, h) from d where doc_id % 10 = 0)",
    "p04_active": "select doc_id as document_id from documents where doc_id % 6 <> 0",
    "p06_page_summaries": "select doc_id as document_id, 1 as page_no from documents",
    "p07_summaries": CTES + f", {STATUS} select j.document_id, 'inv-' || j.document_id as filename, st.status, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') as created_at, attempts from jobs j join st using (document_id)",
    "p08_client_invoice": CTES + "select document_id, vendor_name, invoice_number, cast(total_c / 100.0 as decimal(18,2)) as total from invoices",
    "p09_open_issues": CTES + f", {ISSUES} select document_id, code from issues where document_id % 3 = 0",
    "p14_kind": f"with {PAGES} select d as document_id, case when any_value(mime) <> 'application/pdf' then 'image' when count(*) filter (where not is_text and has_image) > count(*) filter (where is_text) then 'pdf_scan' else 'pdf_text' end as kind from p group by 1",
    "p15_ocr_pick": f"with {PAGES}, r as (select d, page_no, row_number() over (partition by d order by page_no) as k from p where not is_text and has_image) select d as document_id, cast(page_no as integer) as page_no from r where k <= 5",
    "p16_set_status": CTES + "select document_id, 'failed' as status, 'parse_failed' as failure_code, 'No text' as failure_message from invoices",
    "j07_running_counts": CTES + "select workspace_id, count(*) filter (where status = 'running') as running from jobs group by 1",
    "j11_field_grounding": CTES + "select i.document_id, f.field_path, g.method from invoices i cross join (select unnest(['vendorName', 'invoiceNumber', 'issueDate', 'dueDate', 'currency', 'subtotal', 'tax', 'shipping', 'discount', 'total']) as field_path) f left join groundings g on g.document_id = i.document_id and g.field_path = f.field_path",
    "a11_mean_confidence": "with w as (select doc_id, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') as ws from documents) select doc_id as document_id, cast(len(ws) as integer) as n, round(case when len(ws) = 0 then 0 else list_avg(list_transform(ws, lambda x: (length(x) % 10) / 10.0::double)) end, 9) as confidence from w",
    "a16_upload_tally": "select source as workspace_id, case when doc_id % 3 = 0 then 'accepted' else 'rejected' end as kind, count(*) as n from documents group by 1, 2",
    "w02_global_rank": CTES + "select id, (select count(*) from jobs where status = 'running') + row_number() over (order by created_at, id) as global_rank from jobs where status = 'queued' order by created_at, id limit 300",
    "w04_newest_initial": CTES + "select document_id, arg_max(id, (created_at, id)) as id from extractions where kind = 'initial' group by 1",
    "o01_newest_first": CTES + "select id, cast(row_number() over (partition by workspace_id order by created_at desc, id desc) as integer) as position from jobs",
    "o04_oldest_due": CTES + "select id from jobs where status = 'queued' order by created_at, id limit 25",
    "o07_first_files": CTES + "select document_id as request_id, idx as position, idx < 2 as taken from lines",
    "t02_field_paths": CTES + "select document_id, concat_ws(',', case when due_date < issue_date then 'dueDate,issueDate' end, case when total_c < 0 then 'total' end) as field_paths from invoices where due_date < issue_date or total_c < 0",
    "t05_complete": "select count(*) as samples, count(*) filter (where n_nationkey < 20) as scored, false as complete from nation",
    "f04_cents": CTES + "select document_id, idx, amount_c as cents from lines where amount_c is not null",
    "f09_trim_zeros": CTES + "select document_id, idx, case when price_e4 % 10000 = 0 then cast(price_e4 // 10000 as varchar) else (price_e4 // 10000) || '.' || rtrim(lpad(cast(price_e4 % 10000 as varchar), 4, '0'), '0') end as shown from lines",
    "f19_item_words": r"""with s as (select doc_id, regexp_replace(text, '[\t-\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]', ' ', 'g') as t from documents),
w as (select doc_id, length(t) as l, unnest(string_split(t, ' ')) as word, generate_subscripts(string_split(t, ' '), 1) as k from s),
p as (select *, coalesce(sum(length(word) + 1) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0)::bigint as before from w),
x as (select doc_id, k, word, 0.1::double + 0.5::double * before / l as x0, 0.1::double + 0.5::double * (before + length(word)) / l as x1 from p where word <> '')
select s.doc_id, cast(count(word) as integer) as n, md5(coalesce(string_agg(word || ' ' || floor(x0 * 1e6 + 0.5)::bigint || ' ' || floor((x1 - x0) * 1e6 + 0.5)::bigint, chr(10) order by k), '')) as places_md5 from s left join x on x.doc_id = s.doc_id group by s.doc_id""",
    "f23_list_words": "with g as (select n_regionkey, list(n_name order by n_name) as l, sum(n_nationkey * 999) as b from nation group by 1) select n_regionkey, array_to_string(l[:-2], ', ') || ' and ' || l[-1] as names, case when b < 1024 then b || ' B' else cast(round(b / 1024.0) as bigint) || ' KB' end as bytes from g",
    "f25_currency": CTES + "select document_id, currency from invoices",
    "f27_contrast": """with c as (select n_nationkey, n_nationkey * 671088 as v from nation), p as (select n_nationkey, [(v // 65536) % 256 / 255.0::double, (v // 256) % 256 / 255.0::double, v % 256 / 255.0::double] as ch from c),
l as (select n_nationkey, list_transform(ch, lambda x: case when x <= 0.04045 then x / 12.92 else pow((x + 0.055) / 1.055, 2.4) end) as k from p) select n_nationkey, round(1.05 / (0.2126 * k[1] + 0.7152 * k[2] + 0.0722 * k[3] + 0.05), 6) as ratio from l""",
    "s12_replace": CTES + "select document_id, idx from lines where document_id % 4 <> 0 union all select document_id, idx + 100 from lines where document_id % 4 = 0",
    "s14_insert_absent": "select c_custkey as owner, cast(0 as bigint) as at from customer where c_custkey % 2 = 0 union all select o_custkey, min(o_orderkey) from orders where o_custkey not in (select c_custkey from customer where c_custkey % 2 = 0) group by 1",
    "s16_api_json": "select '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":' || case when n_name = 'CHINA' then 'null' else '\"' || n_name || '\"' end || '}' as json from nation",
    "u03_answers": "with d as (select doc_id, sha256(text) as h from documents) select doc_id as document_id, case when h in (select h from d where doc_id % 3 = 0) then 'recording' when h in (select h from d where doc_id % 2 = 0) then 'truth' else 'none' end as origin from d",
    "u04_replay": "with d as (select doc_id, sha256(text) as h from documents), r as (select h, 'r' || lpad(min(doc_id)::varchar, 9, '0') as result from d where doc_id % 3 <> 0 and doc_id % 2 = 0 group by 1) select doc_id as document_id, result from d left join r on r.h = d.h",
    "e03_unsettled": "with d as (select doc_id, sha256(text) as h from documents) select doc_id as document_id from d where h is null or h not in (select h from d where doc_id % 6 >= 2 and h is not null)",
    "f14_iso_date": f"{ISO} select id, shown is not null and k = 0 as iso, k < 2 and not (id % 3 = 0 and day <> date '2024-02-29') as same from s",
    "f14b_draft_date": f"{ISO} select id, case when k = 0 then day end as day from s",
    "q10_repair": CTES + ", e as (select document_id, arg_max(id, (created_at, id)) as id from extractions where adopted group by 1) select document_id, unnest(case id % 5 when 0 then ['V001', 'V002'] when 1 then ['V003'] else [] end) as code from e",
    "q11_finalise": CTES + "select document_id, vendor_name, cast(total_c / 100.0 as decimal(18,2)) as total from invoices",
    "q13_duration": CTES + "select id, (id % 90) * 1000 as duration_ms from runs",
    "q14_budget_guard": CTES + f"select document_id, (select coalesce(sum(cost_micros), 0) from usage where cast(created_at as date) = {DAY}) >= 1000000 as blocked from invoices",
    "x01_health": CTES + f"select cast(coalesce(sum(cost_micros), 0) as bigint) as cost_micros, coalesce(sum(cost_micros), 0) < 1000000000000 as within from usage where cast(created_at as date) = {DAY}",
}
