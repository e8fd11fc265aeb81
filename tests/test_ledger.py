"""Queries against their SQL on the smallest tables, state machines of the queue, sources, sinks and streams."""

import json
import random
import time
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest
from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import Window
from pyspark.sql import functions as F

from docledger.operators import draft, ledger, queue, ranks, reconcile, rules, search
from docledger.plans import catalogue
from docledger.shared import checkpoint
from docledger.sources import commits, ingest, tables
from docledger.streaming import drain

SMALL = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")
HEADER = "document_id long, vendor_name string, invoice_number string, issue_date date, due_date date, currency string, subtotal decimal(18,2), tax decimal(18,2), shipping decimal(18,2), discount decimal(18,2), total decimal(18,2), workspace_id long, filename string, vendor_key string"
LINES = "document_id long, idx int, description string, quantity decimal(18,4), unit_price decimal(18,4), amount decimal(18,2)"
TODAY = date(2026, 9, 15)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_sql(spark, name):
    frame = catalogue.QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(r)) for r in frame.select(*columns).collect())
    assert got or name == "r06_odd_issue_date"
    if name in catalogue.ORACLE_SQL:
        base = duckdb.connect()
        for table in TABLES:
            base.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
        found = base.execute(catalogue.ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())


def invoice(i, **own):
    base = {"vendor_name": "Vela Inc.", "invoice_number": f"A-{i}", "issue_date": date(2026, 8, 3), "due_date": date(2026, 9, 2), "currency": "USD", "subtotal": None, "tax": None, "shipping": None, "discount": None, "total": None, "workspace_id": 1, "filename": f"{i}.pdf", "vendor_key": "vela"} | own
    money = {k: None if base[k] is None else Decimal(base[k]) for k in ("subtotal", "tax", "shipping", "discount", "total")}
    return (i, *((base | money)[c.split()[0]] for c in HEADER.split(", ")[1:]))


def found(issues):
    return {(r.document_id, r.suggest_path, r.suggest_value) for r in issues.collect()}


def test_line_sums(spark):
    """Two lines of 517.00 and 164.00, and subtotals that differ by a swap, a swapped line, and little by little."""
    heads = [invoice(1, subtotal="618.00"), invoice(2, subtotal="681.00"), invoice(3, subtotal="681.03"), invoice(4, subtotal="681.05"), invoice(5, subtotal="681.06"), invoice(6, subtotal="10.00"), invoice(7)]
    items = [(i, n, "x", None, None, Decimal(a)) for i in range(1, 6) for n, a in enumerate(("571.00" if i == 2 else "517.00", "164.00"))] + [(6, 0, "x", None, None, None)]
    got = found(rules.line_sum_differs(spark.createDataFrame(heads, HEADER), spark.createDataFrame(items, LINES)))
    assert got == {(1, "subtotal", "681.00"), (2, "lineItems.0.amount", "517.00"), (5, None, None)}


def test_totals(spark):
    heads = [
        invoice(1, subtotal="638.00", tax="44.66", total="862.66"), invoice(2, subtotal="2200.00", total="2341.35"), invoice(3, subtotal="300.00", discount="45.00", total="255.00"), invoice(4, subtotal="300.00", discount="-45.00", total="255.00"),
        invoice(5, subtotal="60.00", total="60.05"), invoice(6, subtotal="60.00", total="59.94"), invoice(7, total="5.00"), invoice(8, subtotal="638.00", tax="44.66", total="682.66"),
    ]
    issues = rules.total_differs(spark.createDataFrame(heads, HEADER), spark.createDataFrame([], LINES))
    assert found(issues) == {(1, "total", "682.66"), (2, "tax", "141.35"), (6, None, None)}
    first = issues.filter("document_id = 1").first()
    assert first.field_paths == ["total", "subtotal", "tax"] and first.message == "The subtotal and tax add up to 682.66 but the total reads 862.66."


def test_products(spark):
    items = [(1, 0, "m", Decimal("30000"), Decimal("0.0175"), Decimal("525.00")), (1, 1, "m", Decimal("14"), Decimal("27.5"), Decimal("358.00")), (1, 2, "m", Decimal("1"), Decimal("1.02"), Decimal("1.00")), (1, 3, "m", Decimal("1"), Decimal("1.03"), Decimal("1.00")), (1, 4, "m", None, Decimal("1"), Decimal("9"))]
    issues = rules.line_product_differs(spark.createDataFrame(items, LINES))
    assert found(issues) == {(1, "lineItems.1.amount", "385.00"), (1, "lineItems.3.amount", "1.03")}
    assert "Line 2: 14 times 27.5 is 385.00, not 358.00." in {r.message for r in issues.collect()}


def test_dates_and_symbols(spark):
    heads = [invoice(1, due_date=date(2026, 8, 1)), invoice(2, issue_date=date(2012, 8, 3)), invoice(3, issue_date=date(2026, 11, 30)), invoice(4, issue_date=date(2016, 9, 15)), invoice(5, issue_date=date(2026, 10, 15)), invoice(6, issue_date=None)]
    frame = spark.createDataFrame(heads, HEADER)
    assert {r.document_id for r in rules.due_before_issue(frame).collect()} == {1, 3, 5}
    assert {r.document_id for r in rules.odd_issue_date(frame, TODAY).collect()} == {2, 3}
    assert rules.odd_issue_date(frame, date(2024, 2, 29)).count() >= 1
    shown = spark.createDataFrame([invoice(1, currency="USD"), invoice(2, currency="AUD"), invoice(3), invoice(4, currency=None)], HEADER)
    printed = F.when(F.col("document_id") == 1, "1.190,00 €").when(F.col("document_id") == 2, "$5").when(F.col("document_id") == 3, "$5 €6").otherwise("€1")
    assert found(rules.odd_symbol(shown, printed)) == {(1, "currency", "EUR")}


def test_missing_and_order(spark):
    heads = spark.createDataFrame([invoice(1, issue_date=None, total="-5.00"), invoice(2, vendor_name=None, currency=None)], HEADER).withColumns({"printed_issue_date": F.when(F.col("document_id") == 1, "2026/13/01"), "printed_total": F.lit(None).cast("string")})
    messages = {r.message for r in rules.missing_fields(heads).collect()}
    assert messages == {"Issue date could not be read as a date (printed as 2026/13/01).", "Vendor name is missing or could not be read.", "Currency is missing or could not be read.", "Total is missing or could not be read."}
    pages = spark.createDataFrame([(1, 1, "ocr", 0.45), (1, 2, "ocr", 0.9), (1, 3, "ocr", None)], "document_id long, page_no int, text_source string, ocr_mean_confidence double")
    every = rules.validate(heads, spark.createDataFrame([], LINES), spark.createDataFrame([], "document_id long, field_path string"), TODAY, F.lit("$"), pages)
    assert [r.code for r in every.filter("document_id = 1").orderBy("ordinal").collect()] == ["V001", "V010", "V012", "V009"]


def test_draft(spark):
    fields = spark.createDataFrame([(1, "total", "abc", 0.9), (1, "issueDate", "2026-02-31", 0.9), (1, "currency", "usd", 0.9), (1, "vendorName", None, 0.9)], "document_id long, field_path string, value string, confidence double")
    head = draft.header(fields).first()
    assert (head.total, head.issue_date, head.currency, head.printed_total) == (None, None, "USD", "abc")
    meta = draft.unreadable_money(draft.field_metadata(fields, spark.createDataFrame([], "document_id long, field_path string, score double, method string"), spark.createDataFrame([], "document_id long, field_paths array<string>, severity string")))
    got = {r.field_path: (r.risk, r.score, r.band) for r in meta.collect()}
    assert got["total"] == (1.0, 0.0, "high") and got["vendorName"][1] == 0.0 and got["vendorName"][2] == "low"


JOBS = "id long, document_id long, workspace_id long, status string, attempts int, max_attempts int, created_at timestamp, run_after timestamp, locked_at timestamp, locked_by string, last_error string"


def now():
    return F.lit("2026-09-15 12:00:00").cast("timestamp")


def job(i, workspace=1, status="queued", attempts=0, locked=None, after=datetime(2026, 9, 1)):
    return (i, i, workspace, status, attempts, 3, datetime(2026, 9, 1, 0, 0, i), after, locked, None, None)


def states(jobs):
    return {r.id: (r.status, r.attempts) for r in jobs.collect()}


def test_claims(spark):
    three = spark.createDataFrame([job(i, workspace=i) for i in range(3)], JOBS)
    assert states(queue.claim(three, "r", now(), 9, 2, 2)) == {0: ("running", 1), 1: ("running", 1), 2: ("queued", 0)}
    same = spark.createDataFrame([job(i) for i in range(3)] + [job(3, workspace=2)], JOBS)
    once = queue.claim(same, "r", now(), 9, 2, 5)
    assert states(once) == {0: ("running", 1), 1: ("running", 1), 2: ("queued", 0), 3: ("running", 1)}
    assert states(queue.claim(once, "r", now(), 9, 2, 5)) == states(once)
    blocked = spark.createDataFrame([job(0), job(1), job(2), job(3, workspace=2)], JOBS)
    assert states(queue.claim(blocked, "r", now(), 9, 2, 3))[3] == ("queued", 0)  # the third of a full workspace takes the last place
    assert states(queue.claim(spark.createDataFrame([job(0, after=datetime(2027, 1, 1))], JOBS), "r", now(), 9, 2, 3)) == {0: ("queued", 0)}


def test_failures(spark):
    jobs = spark.createDataFrame([job(1)], JOBS)
    seen = []
    for _ in range(3):
        jobs = queue.claim(jobs.withColumn("run_after", F.lit("2026-01-01").cast("timestamp")), "r", now(), 1, 1, 1)
        jobs = queue.fail(jobs, spark.createDataFrame([(1, "x" * 3000, False)], "id long, error string, fatal boolean"), now())
        row = jobs.first()
        seen.append((row.status, row.attempts, len(row.last_error), row.locked_by))
    assert seen == [("queued", 1, 2000, None), ("queued", 2, 2000, None), ("dead", 3, 2000, None)]
    fatal = queue.fail(spark.createDataFrame([job(1, status="running", attempts=1)], JOBS), spark.createDataFrame([(1, "no", True)], "id long, error string, fatal boolean"), now())
    assert states(fatal) == {1: ("dead", 1)}
    assert states(queue.defer(fatal, F.lit(True), now())) == {1: ("queued", 0)} and states(queue.finish(fatal, F.lit(True))) == {1: ("succeeded", 1)}
    assert states(queue.enqueue(fatal, spark.createDataFrame([(9, 9, 1)], "id long, document_id long, workspace_id long"), now()))[9] == ("queued", 0)


def test_sweep(spark):
    old, new = datetime(2026, 9, 15, 11, 50), datetime(2026, 9, 15, 11, 59)
    jobs = spark.createDataFrame([job(1, status="running", attempts=1, locked=old), job(2, status="running", attempts=3, locked=old), job(3, status="running", attempts=1, locked=new)], JOBS)
    swept = queue.sweep(jobs, now(), 360)
    assert states(swept) == {1: ("queued", 1), 2: ("dead", 3), 3: ("running", 1)}
    runs = spark.createDataFrame([(1, 1, "running", old), (2, 2, "running", old), (3, None, "running", old), (4, 2, "running", new)], "id long, job_id long, status string, started_at timestamp")
    assert {r.id: r.status for r in queue.sweep_runs(runs, swept, now(), 360).collect()} == {1: "running", 2: "failed", 3: "failed", 4: "running"}


def test_budget(spark):
    usage = spark.createDataFrame([(datetime(2026, 9, 15, 5), 2_999_999), (datetime(2026, 9, 14, 23), 9)], "created_at timestamp, cost_micros long")
    docs = spark.createDataFrame([(1,)], "document_id long")
    day = F.lit("2026-09-15").cast("date")
    assert not queue.blocked_by_budget(usage, docs, day, 3_000_000, False).first().blocked
    more = usage.union(spark.createDataFrame([(datetime(2026, 9, 15, 23, 59), 1)], usage.schema))
    assert queue.blocked_by_budget(more, docs, day, 3_000_000, False).first().blocked and not queue.blocked_by_budget(more, docs, day, 3_000_000, True).first().blocked


def test_ingest(spark):
    pdf, png = b"%PDF-1.7 a", bytes.fromhex("89504E470D0A1A0A00")
    files = [(1, 1, "a.pdf", pdf), (2, 1, "b.pdf", b"hello"), (3, 1, "c.pdf", pdf), (4, 1, "", b""), (5, 2, "d.png", png), (6, 1, "e.pdf", pdf + b"x" * 99), (7, 1, "f.png", png), (8, 1, "g.pdf", pdf + b"2")]
    frame = spark.createDataFrame(files, "file_id long, workspace_id long, filename string, content binary")
    known = spark.createDataFrame([(1, "0" * 64)], "workspace_id long, sha256 string")
    got = {r.file_id: (r.outcome, r.reason) for r in ingest.outcomes(frame, known, most_bytes=50, capacity=3).collect()}
    assert got == {1: ("accepted", None), 2: ("rejected", "unsupported_type"), 3: ("duplicate", None), 4: ("rejected", "empty"), 5: ("accepted", None), 6: ("rejected", "too_large"), 7: ("accepted", None), 8: ("rejected", "workspace_full")}


def test_sources(spark, tmp_path):
    truth = {"name": "s", "docType": "invoice", "fields": {"total": {"value": "5.00", "display": "$5.00", "page": 2}, "currency": {"value": "USD"}}, "lineItems": [], "expectedIssues": ["V003"], "notes": None}
    (tmp_path / "truth").mkdir()
    (tmp_path / "truth" / "s.json").write_text(json.dumps(truth))
    rows = {r.field_path: (r.value, r.source_text, r.page) for r in tables.truth_fields(tables.read_json(spark, f"{tmp_path}/truth", tables.GROUND_TRUTH)).collect()}
    assert rows["total"] == ("5.00", "$5.00", 2) and rows["currency"] == ("USD", "USD", 1) and rows["tax"] == (None, None, None)
    (tmp_path / "rec").mkdir()
    (tmp_path / "rec" / "abc.initial.json").write_text(json.dumps({"sha256": "abc", "kind": "initial", "result": "{}"}))
    shape = "sha256 string, kind string, result string"
    assert tables.read_recordings(spark, f"{tmp_path}/rec", shape).count() == 1
    (tmp_path / "rec" / "wrong.initial.json").write_text(json.dumps({"sha256": "abc", "kind": "initial", "result": "{}"}))
    with pytest.raises(PySparkException):
        tables.read_recordings(spark, f"{tmp_path}/rec", shape).collect()
    docs = spark.createDataFrame([(1, "abc"), (2, "def"), (3, "ghi")], "document_id long, sha256 string")
    got = {r.document_id: r.origin for r in tables.answers(docs, spark.createDataFrame([("abc", "R")], "sha256 string, result string"), spark.createDataFrame([("abc", "T"), ("def", "T")], "sha256 string, result string")).collect()}
    assert got == {1: "recording", 2: "truth", 3: "none"}
    (text,) = tables.api_json(spark.createDataFrame([(1, None, datetime(2026, 1, 2, 3))], "a int, b string, c timestamp")).first()
    assert json.loads(text) == {"a": 1, "b": None, "c": "2026-01-02T03:00:00.000Z"}


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "document_id long, v string")
    assert sorted(map(tuple, tables.replaced(old, spark.createDataFrame([(1, "z")], old.schema)).collect())) == [(1, "z"), (2, "c")]
    owners = spark.createDataFrame([(1, "x", 0, None), (2, "y", 0, 5)], "owner long, name string, at int, deleted_at int")
    new = spark.createDataFrame([(1, "n1", 1, None), (2, "n2", 1, None), (2, "n3", 2, None)], owners.schema)
    assert sorted(r.name for r in tables.inserted_if_absent(owners, new, ["owner"], "at", "deleted_at is null").collect()) == ["n2", "x", "y"]
    assert spark.read.parquet(tables.publish(old, f"{tmp_path}/t", "1")).count() == 3
    gone = spark.createDataFrame([(1,)], "document_id long")
    assert ledger.without_documents(old, gone).count() == 1 and ledger.with_null_documents(old, gone).filter("document_id is null").count() == 2
    assert ledger.complete(spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([("a",), ("b",)], "name string")).first().complete is False


def test_drain(spark, tmp_path):
    shape = "document_id long, due_date date, issue_date date"
    rows = spark.createDataFrame([(i, date(2026, 1, 1 + i % 2), date(2026, 1, 2)) for i in range(40)], shape)
    rows.repartition(4).write.parquet(f"{tmp_path}/in")

    def run():
        stream = drain.read_stream(spark, f"{tmp_path}/in", shape, files_per_batch=1)
        query = drain.drain(stream, rules.due_before_issue, f"{tmp_path}/out", f"{tmp_path}/state")
        query.awaitTermination(120)
        return sorted(r.document_id for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == list(range(0, 40, 2)) == run()
    rows.limit(2).withColumn("document_id", F.col("document_id") + 100).write.mode("append").parquet(f"{tmp_path}/in")
    assert len(run()) == 21


def test_streams(spark, tmp_path):
    shape = "workspace_id long, sha256 string, arrived_at timestamp, created_at timestamp, cost_micros long, address string"
    at = datetime(2026, 9, 15, 12)
    spark.createDataFrame([(1, "a", at, at, 5, "x"), (1, "a", at, at, 7, "x"), (2, "a", at, datetime(2026, 9, 16), 1, "y")], shape).write.parquet(f"{tmp_path}/in")
    for name, work, mode in (("unique", drain.without_repeats, "append"), ("spend", drain.spend_by_day, "complete"), ("limit", drain.uploads_by_address, "complete")):
        query = work(drain.read_stream(spark, f"{tmp_path}/in", shape)).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert spark.table("unique").count() == 2
    assert {(r.day, r.cost_micros) for r in spark.table("spend").collect()} == {(date(2026, 9, 15), 12), (date(2026, 9, 16), 1)}
    assert {(r.address, r.requests) for r in spark.table("limit").collect()} == {("x", 2), ("y", 1)}


def test_providers(spark, tmp_path):
    import pandas as pd

    from docledger.sources import providers

    docs = spark.createDataFrame([(1, "abc", b"x"), (2, "def", b"yy")], "document_id long, sha256 string, content binary")

    def answer(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"document_id": batch.document_id, "sha256": batch.sha256, "kind": "initial", "result": [f"{len(c)}:{f}" for c, f in zip(batch.content, batch.focus, strict=True)], "model": "mock", "input_tokens": 1, "output_tokens": 2})

    got = providers.extracted(docs, answer, focus="totals")
    assert {(r.document_id, r.result) for r in got.collect()} == {(1, "1:totals"), (2, "2:totals")}
    providers.record(got, f"{tmp_path}/rec")
    assert spark.read.text(f"{tmp_path}/rec").count() == 2
    again = providers.replayed(docs, got.filter("document_id = 1"), "initial")
    assert {r.document_id: r.result for r in again.collect()} == {1: "1:totals", 2: None}
    manifest = spark.createDataFrame([("a", "abc"), ("b", "def")], "name string, sha256 string")
    done = spark.createDataFrame([("abc", "needs_review"), ("def", "processing")], "sha256 string, status string")
    assert [r.name for r in providers.unsettled(manifest, done).collect()] == ["b"]


def test_repair(spark):
    extractions = spark.createDataFrame([(1, 10, True, 1), (1, 11, True, 2), (1, 12, False, 3)], "document_id long, id long, adopted boolean, created_at int")
    stored = spark.createDataFrame([(1, 10, "V002"), (1, 11, "V003"), (1, 12, "V001")], "document_id long, extraction_id long, code string")
    assert [(r.document_id, r.code) for r in queue.repaired(extractions, stored).collect()] == [(1, "V003")]


def test_report(spark):
    from docledger.operators import evaluate

    rows = spark.createDataFrame([(1, 10, 10, 3, 3, "", "", 20, 20, True), (2, 10, 9, 3, 3, "V003", "", 20, 18, False)], "document_id long, fields int, fields_ok int, lines int, lines_ok int, missed string, extra string, values int, found int, passed boolean")
    text = evaluate.report(rows)
    assert "| 2 | 9/10 | 3/3 | 18/20 | V003 | - | no |" in text and text.endswith("1 of 2 pass.")


def arriving(spark, path, batches):
    """Files of arriving jobs, one for each batch, in order."""
    shape = "id long, document_id long, workspace_id long, at timestamp"
    for n, ids in enumerate(batches):
        rows = [(i, i, i % 3, datetime(2026, 1, 1, 12, 10 * n)) for i in ids]
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.1)  # files are taken by their times
    return drain.read_stream(spark, path, shape, files_per_batch=1)


def came(jobs):
    """Outcomes by id: 0 succeeds, 1 fails, 2 fails for good, 3 is put off, 4 says nothing; at the second attempt all succeed."""
    kind = F.when(F.col("attempts") > 1, "succeeded").otherwise(F.element_at(F.array(*map(F.lit, ("succeeded", "failed", "failed", "deferred", "silent"))), (F.col("id") % 5 + 1).cast("int")))
    return jobs.withColumn("kind", kind).filter("kind <> 'silent'").select("id", "attempts", "kind", F.lit("boom").alias("error"), (F.col("id") % 5 == 2).alias("fatal"), F.timestamp_add("MINUTE", F.lit(5), F.col("locked_at")).alias("until"))


LIMITS = drain.Limits(claim=4, per_workspace=3, overall=7, stale_seconds=900)


def test_drain_queue(spark, tmp_path):
    """A stream that stops in the middle, and is started again, ends in the table that sweeps, claims and outcomes give one by one."""
    batches = [range(20), [*range(20, 25), 3, 4], [], range(40, 45), [50], [51]]
    stream = arriving(spark, f"{tmp_path}/in", [b for b in batches if b])
    calls = []

    def breaking(jobs):
        calls.append(1)
        if len(calls) == 9:
            raise RuntimeError("lost")
        return came(jobs)

    query = drain.drain_queue(stream, breaking, f"{tmp_path}/jobs", f"{tmp_path}/state", LIMITS)
    with pytest.raises(StreamingQueryException):
        query.awaitTermination(240)
    assert len(calls) == 9
    drain.drain_queue(stream, came, f"{tmp_path}/jobs", f"{tmp_path}/state", LIMITS).awaitTermination(240)
    jobs = spark.createDataFrame([], drain.JOBS)
    for n, ids in enumerate(b for b in batches if b):
        now = F.lit(datetime(2026, 1, 1, 12, 10 * n))
        new = spark.createDataFrame([(i, i, i % 3) for i in ids], "id long, document_id long, workspace_id long").join(jobs.select("id"), "id", "left_anti")
        jobs = checkpoint(queue.sweep(queue.enqueue(jobs, new, now).select(*jobs.columns), now, 900))
        while True:
            after = checkpoint(queue.claim(jobs, f"batch {n}", now, 4, 3, 7))
            won = after.filter("status = 'running'").join(jobs.filter("status = 'running'").select("id"), "id", "left_anti")
            if won.isEmpty():
                break
            jobs = checkpoint(queue.settle(after, came(won), now))
    want = sorted(map(repr, jobs.collect()))
    got = sorted(map(repr, spark.read.schema(drain.JOBS).parquet(f"{tmp_path}/jobs/batch=4").collect()))
    assert got == want
    ends = {r.id: (r.status, r.attempts) for r in jobs.collect()}
    assert ends[0] == ("succeeded", 1) and ends[2] == ("dead", 1) and ends[1] == ("succeeded", 2) and ends[4] == ("succeeded", 2)


def test_drain_caps(spark):
    """Running jobs count towards the caps; silent ones stay running until their lock is stale; late outcomes change nothing."""
    now = F.lit(datetime(2026, 1, 1, 12))
    ids = spark.createDataFrame([(i, i, 0) for i in range(10)], "id long, document_id long, workspace_id long")
    jobs = queue.enqueue(spark.createDataFrame([], drain.JOBS), ids, now).select(*[f.split()[0] for f in drain.JOBS.split(", ")])
    silent = lambda rows: came(rows).filter("false")
    held, claimed, swept = drain.drain_jobs(jobs, silent, now, limits=drain.Limits(claim=9, per_workspace=3, overall=5))
    assert (claimed, swept) == (3, 0) and held.filter("status = 'running'").count() == 3
    later = F.lit(datetime(2026, 1, 1, 13))
    late = held.filter("status = 'running'").select("id", "attempts", F.lit("succeeded").alias("kind"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("fatal"), F.lit(None).cast("timestamp").alias("until"))
    again, claimed, swept = drain.drain_jobs(held, silent, later, limits=drain.Limits(claim=9, per_workspace=3, overall=5))
    assert swept == 3 and claimed == 3
    assert queue.settle(again, late, later).filter("status = 'succeeded'").isEmpty()
    parked = lambda rows: came(rows).withColumn("kind", F.lit("parked"))
    rest, claimed, _ = drain.drain_jobs(jobs, parked, now, limits=drain.Limits(claim=2, per_workspace=3, overall=5))
    assert claimed == 2 and rest.filter("status = 'queued' and attempts = 0").count() == 10
    assert drain.drain_jobs(spark.createDataFrame([], drain.JOBS), came, now)[1:] == (0, 0)


def test_ranks(spark):
    """Places in groups, of which one has nine tenths of the rows, as a window gives them; no range holds over three times its share."""
    rng = random.Random(9)
    rows = [(rng.choice([1] * 9 + [2, None]), rng.randrange(50), i) for i in range(20_000)]
    frame = spark.createDataFrame(rows, "k long, at long, id long")
    for order in ([F.col("at"), F.col("id")], [F.desc("at"), F.desc("id")]):
        want = frame.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
        assert ranks.ranked(frame, ["k"], order, "place").exceptAll(want).isEmpty()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranks.ranked(frame, ["k"], order, "place").withColumn("part", F.spark_partition_id())
        sizes = [n for (n,) in frame.repartitionByRange("k", "at", "id").groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert max(sizes) <= 3 * sum(sizes) / len(sizes) and got.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranks.ranked(frame.limit(0), ["k"], order, "place").count() == 0


def test_reconcile(spark):
    """Second answers are adopted only with fewer blocking issues; skipped and unanswered documents keep their first; again changes nothing."""
    header = lambda n, subtotal, total, number="A": (n, f"v{n}", f"{number}{n}", date(2026, 9, 1), date(2026, 9, 30), "USD", Decimal(subtotal), Decimal("0.00"), None, None, Decimal(total), 1, f"{n}.pdf", f"v{n}")
    line = lambda n, amount: (n, 0, "x", Decimal("1"), Decimal(amount), Decimal(amount))
    first = reconcile.Answer(
        spark.createDataFrame([header(1, "10.00", "10.00"), *(header(n, "15.00", "11.00") for n in (2, 3, 4, 5, 6, 7, 8))], HEADER),
        spark.createDataFrame([line(n, "10.00") for n in range(1, 9)], LINES),
    )
    answers = {2: ("10.00", "10.00", "invoice", "10.00"), 3: ("15.00", "11.00", "invoice", "10.00"), 4: ("10.00", "10.00", "other", "10.00"), 5: ("15.00", "15.00", "invoice", "10.00"), 6: ("10.00", "10.00", "invoice", "10.00"), 8: ("20.00", "20.00", "invoice", "20.00")}

    def validate(invoices, lines):
        return rules.line_sum_differs(invoices, lines).unionByName(rules.total_differs(invoices, lines)).unionByName(rules.duplicate_invoice(invoices))

    asked = []

    def look(focus):
        rows = {r.document_id: r for r in focus.collect()}
        asked.append(set(rows))
        assert all("subtotal" in r.field_paths and "total" in r.field_paths and "but the total reads 11.00." in r.reason for r in rows.values() if len(rows) == 6)
        own = {n: a for n, a in answers.items() if n in rows}
        return reconcile.Answer(
            spark.createDataFrame([header(n, a[0], a[1]) for n, a in own.items()], HEADER), spark.createDataFrame([line(n, a[3]) for n, a in own.items()], LINES), spark.createDataFrame([(n, a[2]) for n, a in own.items()], "document_id long, doc_type string")
        )

    issues = validate(first.invoices, first.lines)
    before = spark.createDataFrame([(6,)], "document_id long")
    done = reconcile.reconcile(first, issues, look, validate, looked=before)
    looks = {r.document_id: (r.before, r.after, r.adopted, r.skipped) for r in done.looks.collect()}
    assert asked == [{2, 3, 4, 5, 7, 8}]
    assert looks == {2: (2, 0, True, None), 3: (2, 2, False, None), 4: (2, 0, False, None), 5: (2, 1, True, None), 6: (None, None, False, "already_reconciled"), 7: (None, None, False, "no_answer"), 8: (2, 0, True, None)}
    assert {r.document_id: str(r.total) for r in done.answer.invoices.collect()} == {1: "10.00", 2: "10.00", 3: "11.00", 4: "11.00", 5: "15.00", 6: "11.00", 7: "11.00", 8: "20.00"}
    assert {r.document_id: str(r.amount) for r in done.answer.lines.collect()}[8] == "20.00" and done.answer.lines.count() == 8
    assert sorted((r.document_id, r.code) for r in done.issues.collect()) == [(3, "V002"), (3, "V003"), (4, "V002"), (4, "V003"), (5, "V002"), (6, "V002"), (6, "V003"), (7, "V002"), (7, "V003")]
    again = reconcile.reconcile(done.answer, done.issues, look, validate, looked=done.looks)
    assert again.looks.filter("adopted").isEmpty() and again.answer.invoices.exceptAll(done.answer.invoices).isEmpty()
    paused = reconcile.reconcile(first, issues, look, validate, paused=F.col("document_id") == 2)
    assert {r.document_id: r.skipped for r in paused.looks.collect()}[2] == "budget_paused"
    answers[5] = ("10.00", "10.00", "invoice", "10.00")
    asked.clear()
    twice = reconcile.reconcile(done.answer, done.issues, look, validate, rounds=3)
    assert {r.document_id for r in twice.looks.filter("adopted").collect()} == {5, 6} and len(asked) == 2
    none = reconcile.reconcile(reconcile.Answer(first.invoices.limit(0), first.lines.limit(0)), issues.limit(0), lambda f: reconcile.Answer(first.invoices.limit(0), first.lines.limit(0)), validate)
    assert none.looks.isEmpty() and none.issues.isEmpty()


def test_commits(spark, tmp_path):
    """Readers see all tables of a commit or none; of two writers the second has to start again."""
    store = commits.Tables(spark, f"{tmp_path}/store")
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "v long")
    seen = lambda: {n: sorted(r.v for r in t.collect()) for n, t in store.read().items()}
    assert seen() == {} and store.version() == 0
    assert store.commit({"a": rows(1), "b": rows(2)}, 0) == 1 and seen() == {"a": [1], "b": [2]}
    broken = rows(5).select(F.raise_error(F.lit("lost")).cast("long").alias("v"))
    with pytest.raises(PySparkException):
        store.commit({"a": rows(3), "b": broken}, 1)
    assert seen() == {"a": [1], "b": [2]} and store.version() == 1
    old = store.read()
    assert store.commit({"b": rows(4)}, 1) == 2 and seen() == {"a": [1], "b": [4]}
    assert [r.v for r in old["b"].collect()] == [2]  # who began to read goes on with the old version
    with pytest.raises(commits.Conflict):
        store.commit({"a": rows(9)}, 1)
    assert seen() == {"a": [1], "b": [4]}
    tries = []

    def change(tables_):
        tries.append(1)
        if len(tries) == 1:
            store.commit({"a": rows(7)}, store.version())  # another writer comes first
        return {"a": tables_["a"].select((F.col("v") + 1).alias("v")), "b": tables.replaced(tables_["b"], rows(6), "v")}

    assert store.update(change) == 4 and len(tries) == 2 and seen() == {"a": [8], "b": [4, 6]}
    assert len(store.vacuum(keep=1)) >= 4 and seen() == {"a": [8], "b": [4, 6]} and store.vacuum(keep=1) == []


def test_postings(spark, tmp_path):
    docs = [(1, "The red fox, the RED den"), (2, "red"), (3, None), (4, ""), (5, "fox red 7"), (6, "Füchse & fox")]
    frame = spark.createDataFrame(docs, "document_id long, text string")
    search.write_postings(frame, F.col("text"), f"{tmp_path}/index")
    index = search.read_postings(spark, f"{tmp_path}/index")
    queries = {"red": [1, 2, 5], "RED fox": [1, 5], "fox": [1, 5, 6], "füchse": [6], "none": [], "": [], "- &": [], "red red": [1, 2, 5], "7": [5]}
    for query, want in queries.items():
        assert sorted(r.document_id for r in search.matching(index, query).collect()) == want
    asked = spark.createDataFrame([(q,) for q in queries], "text string").withColumn("query_id", F.col("text"))
    got = {}
    for r in search.matching_all(index, asked).collect():
        got.setdefault(r.query_id, []).append(r.document_id)
    assert {q: sorted(d) for q, d in got.items()} == {q: d for q, d in queries.items() if d}
    plan = search.matching(index, "fox")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(token), EqualTo(token,fox)]" in plan
    assert {r.document_id: r.n_words for r in search.counted(index).collect()} == {1: 4, 2: 1, 5: 3, 6: 2}


def test_rules_plan(spark):
    """All rules together read each table once for the invoices and once for their lines."""
    plan = catalogue.QUERIES["r13_all_rules"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    single = catalogue.QUERIES["r02_line_sum_differs"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") < 6 and plan.count("Union") <= 1 and single.count("Union") == 0
