"""Queries of the validation rules over derived invoices, and their SQL in integer cents."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.operators import rules
from docledger.plans.derived import CTES, Ledger

TODAY = date(2005, 8, 1)


def flat(issues: DataFrame, *more: str) -> DataFrame:
    """Issues with their paths in one string, so that rows compare as scalars."""
    return issues.select("document_id", "code", "severity", F.array_join("field_paths", ",").alias("field_paths"), "message", "suggest_path", "suggest_value", *more)


def printed(ledger: Ledger) -> DataFrame:
    return ledger.invoices.withColumn("printed_money", F.concat(F.col("symbol"), F.coalesce(F.col("total").cast("string"), F.lit(""))))


def pages(ledger: Ledger) -> DataFrame:
    n = F.col("doc_id")
    return ledger.read("documents").select(n.alias("document_id"), (n % 3 + 1).cast("int").alias("page_no"), F.when(n % 2 == 0, "ocr").otherwise("pdf").alias("text_source"), F.when(n % 7 != 0, (n % 10) / 10).alias("ocr_mean_confidence"))


def rule(work):
    return lambda spark, sf_dir: flat(work(Ledger(spark, sf_dir)))


def all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Ledger(spark, sf_dir)
    issues = rules.validate(printed(ledger), ledger.lines, ledger.groundings, TODAY, F.col("printed_money"))
    return issues.select("document_id", "ordinal", "code", "severity")


QUERIES = {
    "r01_missing_fields": rule(lambda x: rules.missing_fields(x.invoices)),
    "r02_line_sum_differs": rule(lambda x: rules.line_sum_differs(x.invoices, x.lines)),
    "r03_total_differs": rule(lambda x: rules.total_differs(x.invoices, x.lines)),
    "r04_line_product_differs": rule(lambda x: rules.line_product_differs(x.lines)),
    "r05_due_before_issue": rule(lambda x: rules.due_before_issue(x.invoices)),
    "r06_odd_issue_date": rule(lambda x: rules.odd_issue_date(x.invoices, TODAY)),
    "r07_odd_symbol": rule(lambda x: rules.odd_symbol(printed(x), F.col("printed_money"))),
    "r08_duplicate_invoice": rule(lambda x: rules.duplicate_invoice(x.invoices)),
    "r09_negative_total": rule(lambda x: rules.negative_total(x.invoices)),
    "r10_not_located": rule(lambda x: rules.not_located(x.invoices, x.lines, x.groundings)),
    "r11_not_an_invoice": rule(lambda x: rules.not_an_invoice(x.read("documents").select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 9 == 0, "other").otherwise("invoice").alias("doc_type")))),
    "r12_badly_read": rule(lambda x: rules.badly_read(pages(x))),
    "r13_all_rules": all_rules,
}


def amount(c: str) -> str:
    """Cents as a printed amount."""
    return f"(case when {c} < 0 then '-' else '' end || cast(abs({c}) // 100 as varchar) || '.' || lpad(cast(abs({c}) % 100 as varchar), 2, '0'))"


def swap(one: str, other: str) -> str:
    """Whether two printed amounts differ by one swap of neighbouring digits."""
    at = f"lambda i: {one}[1:i-1] || {one}[i+1:i+1] || {one}[i:i] || {one}[i+2:]"
    some = f"lambda i: {one}[i:i] between '0' and '9' and {one}[i+1:i+1] between '0' and '9' and {one}[i:i] <> {one}[i+1:i+1]"
    return f"(list_contains(list_transform(list_filter(range(1, length({one})), {some}), {at}), {other}) and not regexp_matches({other}, '^-?0[0-9]'))"


def scaled(c: str) -> str:
    """Ten-thousandths without zeros at the end."""
    return f"regexp_replace(regexp_replace(cast({c} // 10000 as varchar) || '.' || lpad(cast({c} % 10000 as varchar), 4, '0'), '0+$', ''), '\\.$', '')"


SUMMED = f"""summed as (
  select document_id, cast(sum(amount_c) as bigint) as line_sum, count(*) as n_lines, list(struct_pack(i := idx, a := amount_c) order by idx) as items, string_agg('lineItems.' || idx || '.amount', ',' order by idx) as paths
  from lines where amount_c is not null group by document_id)"""

V001 = CTES + """
select document_id, 'V001' as code, 'blocking' as severity, p as field_paths, case when shown is null then label || ' is missing or could not be read.' else label || ' could not be read as a date (printed as ' || shown || ').' end as message,
  null::varchar as suggest_path, null::varchar as suggest_value
from (
  select document_id, 'vendorName' as p, 'Vendor name' as label, null as shown from invoices where vendor_name is null
  union all select document_id, 'invoiceNumber', 'Invoice number', null from invoices where invoice_number is null
  union all select document_id, 'issueDate', 'Issue date', printed_issue_date from invoices where issue_date is null
  union all select document_id, 'currency', 'Currency', null from invoices where currency is null
  union all select document_id, 'total', 'Total', null from invoices where total_c is null)
"""

NEED = "(subtotal_c - (line_sum - x.a))"
V002 = CTES + f""", {SUMMED},
off as (select document_id, subtotal_c, line_sum, items, paths, {swap(amount('subtotal_c'), amount('line_sum'))} as whole from invoices join summed using (document_id) where subtotal_c is not null and abs(line_sum - subtotal_c) > greatest(5, n_lines)),
each as (select document_id, subtotal_c, line_sum, unnest(items) as x from off where not whole),
hit as (select document_id, min(x.i) as i from each where {NEED} > 0 and {swap(amount('x.a'), amount(NEED))} group by document_id),
fix as (select e.document_id, e.x.i as i, e.subtotal_c - (e.line_sum - e.x.a) as need from each e join hit h on e.document_id = h.document_id and e.x.i = h.i)
select document_id, 'V002' as code, 'blocking' as severity, 'subtotal,' || paths as field_paths, 'The line items add up to ' || {amount('line_sum')} || ' but the subtotal reads ' || {amount('subtotal_c')} || '.' as message,
  case when whole then 'subtotal' when need is not null then 'lineItems.' || i || '.amount' end as suggest_path, case when whole then {amount('line_sum')} when need is not null then {amount('need')} end as suggest_value
from off left join fix using (document_id)
"""

V003 = CTES + f""", {SUMMED},
b as (select *, coalesce(subtotal_c, line_sum) as base from invoices left join summed using (document_id) where total_c is not null),
e as (select *, base + coalesce(tax_c, 0) + coalesce(shipping_c, 0) - abs(coalesce(discount_c, 0)) as expected from b where base is not null),
w as (select *, list_filter([case when subtotal_c is null then 'line items' else 'subtotal' end, case when tax_c is not null then 'tax' end, case when shipping_c is not null then 'shipping' end, case when discount_c is not null then 'discount' end], lambda x: x is not null) as named,
  {swap(amount('total_c'), amount('expected'))} as sw from e where abs(expected - total_c) > 5)
select document_id, 'V003' as code, 'blocking' as severity,
  concat_ws(',', 'total', case when subtotal_c is null then paths else 'subtotal' end, case when tax_c is not null then 'tax' end, case when shipping_c is not null then 'shipping' end, case when discount_c is not null then 'discount' end) as field_paths,
  case when len(named) = 1 and subtotal_c is not null then 'The subtotal is ' else 'The ' || case when len(named) = 1 then named[1] else array_to_string(named[:-2], ', ') || ' and ' || named[-1] end || ' add up to ' end || {amount('expected')} || ' but the total reads ' || {amount('total_c')} || '.' as message,
  case when sw then 'total' when tax_c is null and total_c > expected then 'tax' end as suggest_path, case when sw then {amount('expected')} when tax_c is null and total_c > expected then {amount('(total_c - expected)')} end as suggest_value
from w
"""

V004 = CTES + f""",
m as (select *, (qty * price_e4 + 50) // 100 as product from lines where amount_c is not null)
select document_id, 'V004' as code, 'warning' as severity, 'lineItems.' || idx || '.amount,lineItems.' || idx || '.quantity,lineItems.' || idx || '.unitPrice' as field_paths,
  'Line ' || (idx + 1) || ': ' || qty || ' times ' || {scaled('price_e4')} || ' is ' || {amount('product')} || ', not ' || {amount('amount_c')} || '.' as message, 'lineItems.' || idx || '.amount' as suggest_path, {amount('product')} as suggest_value
from m where abs(product - amount_c) > 2
"""


def simple(code: str, severity: str, paths: str, message: str, where: str, path: str = "null::varchar", value: str = "null::varchar", source: str = "invoices") -> str:
    return CTES + f"select document_id, '{code}' as code, '{severity}' as severity, {paths} as field_paths, {message} as message, {path} as suggest_path, {value} as suggest_value from {source} where {where}"


V010 = CTES + f""",
a as (
  select document_id, unnest(['subtotal', 'tax', 'shipping', 'discount', 'total']) as p, unnest(['Subtotal', 'Tax', 'Shipping', 'Discount', 'Total']) as label, unnest([subtotal_c, tax_c, shipping_c, discount_c, total_c]) as v, 'blocking' as severity from invoices
  union all select document_id, 'lineItems.' || idx || '.amount', 'Line ' || (idx + 1) || ' amount', amount_c, 'warning' from lines)
select document_id, 'V010' as code, severity, p as field_paths, label || ' (' || {amount('v')} || ') could not be found on the document.' as message, null::varchar as suggest_path, null::varchar as suggest_value
from a where v is not null and not exists (select 1 from groundings g where g.document_id = a.document_id and g.field_path = a.p)
"""

V008 = CTES + """
select a.document_id, 'V008' as code, 'warning' as severity, 'invoiceNumber,vendorName' as field_paths,
  'Another document in this workspace has the same vendor and invoice number: ' || arg_min(b.filename, b.document_id) || '.' as message, 'duplicate' as suggest_path, cast(min(b.document_id) as varchar) as suggest_value
from invoices a join invoices b on a.workspace_id = b.workspace_id and a.vendor_key = b.vendor_key and a.invoice_number = b.invoice_number and a.document_id <> b.document_id group by a.document_id
"""

ORACLE_SQL = {
    "r01_missing_fields": V001,
    "r02_line_sum_differs": V002,
    "r03_total_differs": V003,
    "r04_line_product_differs": V004,
    "r05_due_before_issue": simple("V005", "warning", "'dueDate,issueDate'", "'The due date (' || due_date || ') is before the issue date (' || issue_date || ').'", "due_date < issue_date"),
    "r06_odd_issue_date": simple("V006", "warning", "'issueDate'", "'The issue date (' || issue_date || ')' || case when issue_date < date '1995-08-01' then ' is more than ten years ago.' else ' is more than 30 days in the future.' end", "issue_date < date '1995-08-01' or issue_date > date '2005-08-31'"),
    "r07_odd_symbol": simple("V007", "warning", "'currency'", "'Amounts are printed with \"' || symbol || '\" but the currency reads ' || currency || '.'", "(symbol = '€' and currency = 'USD') or (symbol = '$' and currency = 'EUR')", "'currency'", "case symbol when '€' then 'EUR' else 'USD' end"),
    "r08_duplicate_invoice": V008,
    "r09_negative_total": simple("V009", "info", "'total'", f"'The total is negative (' || {amount('total_c')} || '). This may be a credit note.'", "total_c < 0"),
    "r10_not_located": V010,
    "r11_not_an_invoice": simple("V011", "blocking", "''", "'This document does not look like an invoice.'", "document_id % 9 = 0", source="(select doc_id as document_id from documents)"),
    "r12_badly_read": simple("V012", "warning", "''", "'Text on page ' || (document_id % 3 + 1) || ' was read by OCR with low confidence (' || (document_id % 10 * 10) || '%). Check values from this page carefully.'", "document_id % 2 = 0 and document_id % 7 <> 0 and document_id % 10 < 6", source="(select doc_id as document_id from documents)"),
}
PARTS = [ORACLE_SQL[x] for x in ORACLE_SQL if x[:3] not in ("r11", "r12")]
ORACLE_SQL["r13_all_rules"] = "with every as (" + " union all ".join(f"select document_id, code, severity, field_paths from ({p})" for p in PARTS) + """)
select document_id, cast(row_number() over (partition by document_id order by case severity when 'blocking' then 0 when 'warning' then 1 else 2 end, code) as integer) as ordinal, code, severity from every
"""
