"""The driver's star-schema tables read as the domain's: invoices with planted faults, their lines, jobs, runs and usage."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docledger.functions import money, text
from docledger.shared import written

MONEY_FIELDS = ("subtotal", "tax", "shipping", "discount", "total")
FIELDS = ("vendorName", "invoiceNumber", "issueDate", "dueDate", "currency", *MONEY_FIELDS)
STAGES = ("parse", "extract", "ground", "validate", "reconcile", "finalise")


def swapped(cents: Column) -> Column:
    """An amount with its tens and units exchanged."""
    return cents + 900 * (F.floor(cents / 100) % 10 - F.floor(cents / 1000) % 10)


@dataclass
class Ledger:
    """Domain tables of one folder; each is a lazy DataFrame over the Parquet files."""

    spark: SparkSession
    folder: str

    def fixed(self) -> Ledger:
        """The same with lines and invoices written once, for work that goes through them many times."""
        out = Ledger(self.spark, self.folder)
        out.lines = written(self.lines)
        out.invoices = written(out.invoices)
        return out

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        # numbered by all columns that are read, and only then made into what is printed: whatever a query takes of its
        # lines, they are shuffled as the same few columns, and Spark shuffles them once for all their uses
        raw = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
        order = Window.partitionBy("l_orderkey").orderBy(*raw)
        key = F.col("document_id") + F.col("idx")
        return (
            self.read("lineitem")
            .select("l_orderkey", *raw)
            .withColumn("idx", F.row_number().over(order) - 1)
            .select(F.col("l_orderkey").alias("document_id"), "idx", F.concat(F.lit("Part "), F.col("l_partkey")).alias("description"), F.col("l_quantity").cast("bigint").alias("qty"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"))
            .withColumn("price", F.floor((F.col("cents") * 200 + F.col("qty")) / (2 * F.col("qty"))) + F.when(key % 29 == 0, 5000).otherwise(0))
            .select(
                "document_id", "idx", "description", "cents",
                F.col("qty").cast(money.EXACT).alias("quantity"),
                (F.col("price").cast("decimal(18,0)") * F.lit(Decimal("0.0001"))).cast(money.EXACT).alias("unit_price"),
                F.when(key % 41 != 0, money.from_cents(F.when((F.col("document_id") % 6 == 5) & (F.col("idx") == 0), swapped(F.col("cents"))).otherwise(F.col("cents")))).alias("amount"),
            )
        )

    @cached_property
    def invoices(self) -> DataFrame:
        """One row for each order: typed header, and what was printed."""
        sums = self.lines.groupBy("document_id").agg(F.sum("cents").alias("sum"))
        n, total = F.col("document_id"), F.col("sum")
        tax = F.floor((total * 5 + 50) / 100)
        due = total + tax + F.when(n % 5 == 0, 2500).otherwise(0) - F.when(n % 9 == 0, 1000).otherwise(0)
        vendor = F.concat(F.lit("Vendor "), (F.col("o_custkey") % 40).cast("string"), F.element_at(F.array(*map(F.lit, (" Inc.", " GmbH", "", ", LLC"))), (n % 4 + 1).cast("int")))
        day = F.to_date("o_orderdate")
        amounts = {
            "subtotal": F.when(n % 6 == 1, total + 3).when(n % 6 == 2, total + 100).when(n % 6 == 3, swapped(total)).when(n % 6 == 4, None).otherwise(total),
            "tax": F.when(n % 7 != 0, tax),
            "shipping": F.when((n % 5 == 0) & total.isNotNull(), 2500),
            "discount": F.when((n % 9 == 0) & total.isNotNull(), F.when(n % 2 == 0, -1000).otherwise(1000)),
            "total": F.when(n % 13 == 0, None).when(n % 17 == 0, -due).when(n % 11 == 0, swapped(due)).otherwise(due),
        }
        return (
            self.read("orders")
            .select(F.col("o_orderkey").alias("document_id"), "o_custkey", "o_orderdate")
            .join(sums, "document_id", "left")
            .select(
                "document_id",
                (F.col("o_custkey") % 10).alias("workspace_id"),
                F.concat(F.lit("inv-"), n, F.lit(".pdf")).alias("filename"),
                F.when(n % 19 != 0, vendor).alias("vendor_name"),
                F.when(n % 23 != 0, F.concat(F.lit("INV-"), F.lpad((n % 997).cast("string"), 4, "0"))).alias("invoice_number"),
                F.when(n % 37 == 0, "not a date").when(n % 31 != 0, F.date_format(day, "yyyy-MM-dd")).alias("printed_issue_date"),
                F.date_format(F.date_add(day, F.when(n % 12 == 0, -5).otherwise(30)), "yyyy-MM-dd").alias("printed_due_date"),
                F.upper(F.element_at(F.array(F.lit("USD"), F.lit("EUR"), F.lit("usd"), F.lit(None)), (n % 4 + 1).cast("int"))).alias("currency"),
                F.when(n % 10 == 3, "€").otherwise("$").alias("symbol"),
                *(money.from_cents(c).alias(name) for name, c in amounts.items()),
            )
            .withColumns({"vendor_key": text.vendor_key(F.col("vendor_name")), "issue_date": F.col("printed_issue_date").try_cast("date"), "due_date": F.col("printed_due_date").try_cast("date")})
        )

    @cached_property
    def jobs(self) -> DataFrame:
        n = F.col("o_orderkey")
        status = F.when(F.col("o_orderstatus") == "O", "queued").when((F.col("o_orderstatus") == "P") & (n % 50 == 0), "running").otherwise("succeeded")
        created = F.col("o_orderdate").cast("timestamp")
        return self.read("orders").select(
            n.alias("id"), n.alias("document_id"), (F.col("o_custkey") % 10).alias("workspace_id"), status.alias("status"), (n % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"),
            created.alias("created_at"), F.when(n % 8 == 0, created + F.expr("interval 9000 days")).otherwise(created).alias("run_after"), F.when(status == "running", created).alias("locked_at"),
            F.when(status == "running", "runner").alias("locked_by"), F.when(n % 3 == 0, "boom").alias("last_error"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        """Stage runs out of the event stream."""
        n = F.col("event_id")
        return self.read("events").select(
            n.alias("id"), F.col("user_id").alias("document_id"), F.element_at(F.array(*map(F.lit, STAGES)), (n % 6 + 1).cast("int")).alias("stage"),
            F.when(n % 5 == 0, "running").when(n % 5 == 1, "failed").otherwise("succeeded").alias("status"), F.col("ts").cast("timestamp").alias("started_at"), F.when(n % 7 != 0, F.col("user_id")).alias("job_id"),
        )

    @cached_property
    def extractions(self) -> DataFrame:
        n = F.col("event_id")
        return self.read("events").select(n.alias("id"), F.col("user_id").alias("document_id"), F.when(n % 3 == 0, "reconcile").otherwise("initial").alias("kind"), (n % 4 != 0).alias("adopted"), F.col("ts").cast("timestamp").alias("created_at"), F.when(n % 3 == 0, n % 3).otherwise(n % 5).alias("blocking"))

    @cached_property
    def usage(self) -> DataFrame:
        n = F.col("event_id")
        return self.read("events").select(
            n.alias("id"), F.col("user_id").alias("document_id"), (F.col("user_id") % 10).alias("workspace_id"), F.when(n % 6 == 0, "mock").otherwise("model").alias("model"),
            (n % 1000).alias("input_tokens"), (n % 300).alias("output_tokens"), (n % 70).alias("cache_write_tokens"), (n % 50).alias("cache_read_tokens"), F.col("ts").cast("timestamp").alias("created_at"), F.round(F.abs(F.col("value")) * 1e6).cast("bigint").alias("cost_micros"),
        )

    @cached_property
    def groundings(self) -> DataFrame:
        """(document_id, field_path, score, method) of header fields and line amounts; some are not found."""
        header = self.invoices.select("document_id", F.posexplode(F.array(*map(F.lit, FIELDS))).alias("n", "field_path"))
        # a document's lines are numbered without gaps, so their number is enough, and they need not be put in order again
        numbers = self.lines.groupBy("document_id").agg(F.count("*").cast("int").alias("lines"))
        lines = numbers.select("document_id", F.explode(F.sequence(F.lit(0), F.col("lines") - 1)).alias("idx"))
        lines = lines.select("document_id", (F.col("idx") + 10).alias("n"), F.concat(F.lit("lineItems."), "idx", F.lit(".amount")).alias("field_path"))
        turn = (F.col("document_id") + F.col("n")) % 8
        method = F.when(turn < 4, "exact").when(turn < 6, "normalized").otherwise("fuzzy")
        return header.unionByName(lines).filter(turn != 7).select("document_id", "field_path", F.when(turn < 4, 1.0).when(turn < 6, 0.9).otherwise(0.7).alias("score"), method.alias("method"))

    @cached_property
    def fields(self) -> DataFrame:
        """(document_id, field_path, value, confidence) of the header."""
        names = dict(zip(FIELDS, ("vendor_name", "invoice_number", "printed_issue_date", "printed_due_date", "currency", *MONEY_FIELDS), strict=True))
        pairs = F.array(*(F.struct(F.lit(path).alias("field_path"), F.col(c).cast("string").alias("value")) for path, c in names.items()))
        return self.invoices.select("document_id", F.posexplode(pairs).alias("n", "f")).select("document_id", "f.field_path", "f.value", (F.lit(1.0) - ((F.col("document_id") + F.col("n")) % 5) * 0.1).alias("confidence"))


def sql_swapped(c: str) -> str:
    return f"({c} + 900 * ((({c}) // 100) % 10 - (({c}) // 1000) % 10))"


#: The same tables for DuckDB, amounts in integer cents.
CTES = f"""
with raw_lines as (
  select l_orderkey as document_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 as idx, 'Part ' || l_partkey as description,
    cast(l_quantity as bigint) as qty, cast(round(l_extendedprice * 100) as bigint) as cents from lineitem),
lines as (
  select document_id, cast(idx as integer) as idx, description, qty, cents, (cents * 200 + qty) // (2 * qty) + case when (document_id + idx) % 29 = 0 then 5000 else 0 end as price_e4,
    case when (document_id + idx) % 41 = 0 then null when document_id % 6 = 5 and idx = 0 then {sql_swapped('cents')} else cents end as amount_c from raw_lines),
sums as (select document_id, cast(sum(cents) as bigint) as s from lines group by document_id),
due as (
  select o_orderkey as n, o_custkey, o_orderdate, s, (s * 5 + 50) // 100 as t,
    s + (s * 5 + 50) // 100 + case when o_orderkey % 5 = 0 then 2500 else 0 end - case when o_orderkey % 9 = 0 then 1000 else 0 end as due
  from orders left join sums on document_id = o_orderkey),
invoices as (
  select n as document_id, o_custkey % 10 as workspace_id, 'inv-' || n || '.pdf' as filename,
    case when n % 19 <> 0 then 'Vendor ' || (o_custkey % 40) || [' Inc.', ' GmbH', '', ', LLC'][n % 4 + 1] end as vendor_name,
    case when n % 19 <> 0 then 'vendor ' || (o_custkey % 40) end as vendor_key,
    case when n % 23 <> 0 then 'INV-' || lpad(cast(n % 997 as varchar), 4, '0') end as invoice_number,
    case when n % 37 = 0 then 'not a date' when n % 31 <> 0 then strftime(o_orderdate, '%Y-%m-%d') end as printed_issue_date,
    case when n % 37 <> 0 and n % 31 <> 0 then cast(o_orderdate as date) end as issue_date,
    cast(o_orderdate as date) + case when n % 12 = 0 then -5 else 30 end as due_date,
    ['USD', 'EUR', 'USD', null][n % 4 + 1] as currency, case when n % 10 = 3 then '€' else '$' end as symbol,
    case n % 6 when 1 then s + 3 when 2 then s + 100 when 3 then {sql_swapped('s')} when 4 then null else s end as subtotal_c,
    case when n % 7 <> 0 then t end as tax_c, case when n % 5 = 0 and s is not null then 2500 end as shipping_c, case when n % 9 = 0 and s is not null then case when n % 2 = 0 then -1000 else 1000 end end as discount_c,
    case when n % 13 = 0 then null when n % 17 = 0 then -due when n % 11 = 0 then {sql_swapped('due')} else due end as total_c
  from due),
jobs as (
  select o_orderkey as id, o_orderkey as document_id, o_custkey % 10 as workspace_id, case when o_orderstatus = 'O' then 'queued' when o_orderstatus = 'P' and o_orderkey % 50 = 0 then 'running' else 'succeeded' end as status,
    cast(o_orderkey % 4 as integer) as attempts, 3 as max_attempts, o_orderdate as created_at, case when o_orderkey % 8 = 0 then o_orderdate + interval 9000 day else o_orderdate end as run_after,
    case when o_orderkey % 3 = 0 then 'boom' end as last_error from orders),
runs as (
  select event_id as id, user_id as document_id, ['parse', 'extract', 'ground', 'validate', 'reconcile', 'finalise'][event_id % 6 + 1] as stage,
    case event_id % 5 when 0 then 'running' when 1 then 'failed' else 'succeeded' end as status, ts as started_at, case when event_id % 7 <> 0 then user_id end as job_id from events),
extractions as (
  select event_id as id, user_id as document_id, case when event_id % 3 = 0 then 'reconcile' else 'initial' end as kind, event_id % 4 <> 0 as adopted, ts as created_at,
    case when event_id % 3 = 0 then event_id % 3 else event_id % 5 end as blocking from events),
usage as (
  select event_id as id, user_id as document_id, user_id % 10 as workspace_id, case when event_id % 6 = 0 then 'mock' else 'model' end as model, event_id % 1000 as input_tokens, event_id % 300 as output_tokens,
    event_id % 70 as cache_write_tokens, event_id % 50 as cache_read_tokens, ts as created_at, cast(round(abs(value) * 1e6) as bigint) as cost_micros from events),
all_paths as (
  select document_id, unnest(range(10)) as n, unnest(['vendorName', 'invoiceNumber', 'issueDate', 'dueDate', 'currency', 'subtotal', 'tax', 'shipping', 'discount', 'total']) as field_path from invoices
  union all select document_id, idx + 10, 'lineItems.' || idx || '.amount' from lines),
groundings as (
  select document_id, field_path, case when (document_id + n) % 8 < 4 then 1.0 when (document_id + n) % 8 < 6 then 0.9 else 0.7 end::double as score,
    case when (document_id + n) % 8 < 4 then 'exact' when (document_id + n) % 8 < 6 then 'normalized' else 'fuzzy' end as method from all_paths where (document_id + n) % 8 <> 7)
"""
