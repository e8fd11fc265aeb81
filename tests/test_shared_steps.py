"""Steps that many queries share: what is read, shuffled and computed once."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docledger.operators import ledger, rules

SMALL = "/root/testdata/sf0.001"


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def scans(rows, table):
    """How often the plan reads a table, told by one of its columns."""
    return sum("Relation" in line and table in line for line in plan(rows).splitlines())


def test_missed_and_extra_reads_issues_once(spark):
    """both sides come of one pass over the issues, and of an issue only its code is made."""
    rows = entry.queries()["t01_missed_extra"](spark, SMALL)
    assert scans(rows, "l_orderkey") <= 3
    assert "The line items add up to" not in plan(rows) and "could not be found" not in plan(rows)


def test_off_is_missed_and_extra(spark):
    one = spark.createDataFrame([(1, "A"), (1, "A"), (1, "B"), (2, "C"), (None, "D")], "document_id long, code string")
    two = spark.createDataFrame([(1, "B"), (1, "C"), (2, "C"), (3, "E")], "document_id long, code string")
    marked = one.withColumn("expected", F.lit(True)).unionByName(two.withColumn("expected", F.lit(False)))
    want = {(1, "A", "missed"), (1, "C", "extra"), (3, "E", "extra"), (None, "D", "missed")}
    assert {tuple(r) for r in ledger.off(marked).collect()} == {tuple(r) for r in ledger.missed_and_extra(one, two).collect()} == want


@pytest.mark.parametrize("columns", [("code",), ("severity", "field_paths"), rules.ALL])
def test_issues_with_some_columns_are_the_same(spark, columns):
    from docledger.plans.derived import Ledger
    from docledger.plans.ledger_queries import issues

    x = Ledger(spark, SMALL)
    every = issues(x).select("document_id", *columns).collect()
    some = issues(x, *columns).select("document_id", *columns).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(every, key=key) == sorted(some, key=key) and len(every) > 100


def test_lines_are_shuffled_as_the_same_columns(spark):
    """whatever is taken of the lines, one shuffle of them serves all uses."""
    from docledger.plans.derived import Ledger

    x = Ledger(spark, SMALL)
    shuffled = [[line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line][0] for rows in (x.lines, x.lines.select("document_id", "idx"), x.lines.select("document_id", "idx", "amount"))]
    assert len({s.split("Batched")[0].split("[", 1)[1].count(",") for s in shuffled}) == 1


@pytest.fixture
def as_large(spark):
    """Small tables are not broadcast, so that plans are those of large ones."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(rows, *keys):
    """Shuffles of the first plan that deal rows by all of these columns."""
    own = [line.split("hashpartitioning(", 1)[1].split("), ", 1)[0] for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(" in line]
    return sum(all(k in line for k in keys) for line in own)


def test_sides_of_an_evaluation_stay_dealt_by_document(spark, as_large):
    """neither fields nor lines are shuffled by document and field or position; issues are gone through once."""
    for name in ("e01_evaluation", "s17_report"):
        rows = entry.queries()[name](spark, SMALL)
        assert exchanges(rows, "field_path") == 0 and exchanges(rows, "idx") == 0
        assert "The line items add up to" not in plan(rows)


def test_paired_is_a_full_outer_join(spark):
    from docledger.operators import evaluate

    one = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (2, 0, "b"), (None, 0, "n"), (4, None, "x")], "document_id long, idx int, value string")
    two = spark.createDataFrame([(1, 0, "c"), (1, 1, None), (3, 0, "d"), (None, 0, "m"), (4, None, "x")], "document_id long, idx int, value string")
    side = lambda rows, name: rows.select("document_id", "idx", F.struct("value").alias(name))
    want = side(one, "e").join(side(two, "a"), ["document_id", "idx"], "full_outer").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(evaluate.paired(one, two, ["document_id", "idx"], ["value"]).collect(), key=key) == sorted(want, key=key)


def test_alike_reads_only_what_differs(spark):
    from docledger.operators import evaluate

    rows = spark.createDataFrame([("1,00", "1.00", True), ("x", "x", True), (None, None, True), (None, "1", False), ("2", "3", False)], "a string, b string, want boolean")
    got = rows.select("want", evaluate.alike("money", F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


@pytest.mark.parametrize("name", ["f30_field_risk", "a12_finalise_stats", "a06_grounding_stats"])
def test_fields_stay_dealt_by_document(spark, as_large, name):
    """groundings and issues come to the fields by document."""
    assert exchanges(entry.queries()[name](spark, SMALL), "field_path") <= (name == "a12_finalise_stats")  # there, counts of checkpointed issues


def test_beside_is_a_left_join(spark):
    one = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (1, None, 4), (None, "a", 5), (2, "a", 6)], "document_id long, field_path string, n int")
    two = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, None, "z"), (None, "a", "w"), (3, "a", "v")], "document_id long, field_path string, method string")
    got, want = ledger.beside(one, two), one.join(two, ["document_id", "field_path"], "left")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_finalise_stats_finds_issues_once(spark):
    """fields and documents count the same checkpointed issues."""
    assert scans(entry.queries()["a12_finalise_stats"](spark, SMALL), "l_quantity") < scans(entry.queries()["f30_field_risk"](spark, SMALL), "l_quantity")


def test_reconcile_finds_issues_once(spark):
    """first issues are checkpointed, though the focus, the counts and what stays all read them."""
    from docledger.operators import reconcile

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def code(c):
        made.add(1)
        return c

    kind = "document_id long, code string, severity string, field_paths array<string>, message string, place int"
    issues = spark.createDataFrame([(1, "V002", "blocking", ["subtotal"], "m", 0), (2, "V001", "blocking", ["total"], "m", 0)], kind).withColumn("code", code(F.col("code")))
    invoices = spark.createDataFrame([(1, "a"), (2, "b")], "document_id long, total string")
    lines = spark.createDataFrame([(1, 0)], "document_id long, idx int")
    none = spark.createDataFrame([], kind)
    done = reconcile.reconcile(reconcile.Answer(invoices, lines), issues, lambda f: reconcile.Answer(invoices.join(f.select("document_id"), "document_id"), lines), lambda i, n: none)
    assert [tuple(r)[:6] for r in done.looks.collect()] == [(1, 1, 1, 0, "invoice", True)]
    assert {r.document_id for r in done.issues.collect()} == {2} and {r.document_id for r in done.answer.invoices.collect()} == {1, 2}
    assert made.value == 2


def test_reconcile_validates_answers_once(spark):
    """where issues are a document's own, those that decided on an answer are kept: the same tables, and no second validation."""
    from docledger.operators import reconcile
    from docledger.plans.derived import Ledger
    from docledger.plans.ledger_queries import arithmetic_issues, second_look

    x, calls, got = Ledger(spark, SMALL).fixed(), [], []
    first = reconcile.Answer(x.invoices, x.lines.drop("cents"))

    def validate(invoices, lines):
        calls.append(1)
        return arithmetic_issues(x, invoices, lines)

    issues = arithmetic_issues(x, first.invoices, first.lines)
    for alone in (False, True):
        calls.clear()
        done = reconcile.reconcile(first, issues, lambda asked: second_look(x, asked), validate, rounds=2, alone=alone)
        got.append([sorted(map(str, rows.collect())) for rows in (done.issues, done.looks, done.answer.invoices, done.answer.lines)])
        times = len({r.round for r in done.looks.select("round").collect()})
        assert len(calls) in ((times,) if alone else (2 * times, 2 * times - 1))
    assert got[0] == got[1] and any("adopted=True" in r for r in got[0][1])


def test_reconcile_writes_columns(spark):
    """what is gone through many times is written as columns, of which only those that are asked for are read again; no checkpoint of rows is left."""
    rows = entry.queries()["q09_reconcile"](spark, SMALL)
    assert "RDD" not in plan(rows) and all("/written-" in path for path in rows.inputFiles())


def test_words_of_item_are_cut_once(spark):
    """a word is taken out of its piece once; one for trimming the text, one for words."""
    from docledger.operators import tokens

    box = F.struct(F.lit(0.1).alias("x"), F.lit(0.2).alias("y"), F.lit(0.5).alias("w"), F.lit(0.02).alias("h"))
    rows = spark.createDataFrame([("  ab \t c",), ("",), (" ",), (None,)], "t string").select("t", tokens.words_of_item(F.col("t"), box).alias("own"))
    assert plan(rows).count("regexp_replace") <= 2
    assert [[(w.text, round(w.x, 6), round(w.w, 6)) for w in r.own or []] for r in rows.collect()][0] == [("ab", 0.225, 0.125), ("c", 0.5375, 0.0625)]


def test_details_count_issues_without_listing_them(spark):
    """lines are put in order once, and neither lines nor issues become arrays."""
    text = plan(entry.queries()["j04_document_detail"](spark, SMALL))
    assert text.count("Window [row_number") == 1 and "collect_list" not in text and "explode(concat" not in text


def test_groundings_do_not_put_lines_in_order(spark):
    """a document's lines are numbered without gaps, also where it has many or its key is null."""
    from docledger.plans.derived import Ledger

    x = Ledger(spark, SMALL)
    raw = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    x.read = lambda name: raw.unionByName(raw.withColumn("l_orderkey", F.when(F.col("l_orderkey") % 3 == 0, 5))) if name == "lineitem" else spark.read.parquet(f"{SMALL}/{name}.parquet")
    assert "Window [" not in plan(x.groundings)
    turn = (F.col("document_id") + F.col("idx") + 10) % 8
    want = x.lines.filter(turn != 7).select("document_id", F.concat(F.lit("lineItems."), "idx", F.lit(".amount")).alias("field_path"), F.when(turn < 4, "exact").when(turn < 6, "normalized").otherwise("fuzzy").alias("method"))
    found = x.groundings.filter("field_path like 'lineItems%'").select("document_id", "field_path", "method")
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty() and want.filter("document_id = 5").count() > 1000


def test_tallied_issues_are_those_that_are_listed(spark):
    """also for documents without lines, located fields or an id, of one id, and for fields that are located twice."""
    from docledger.plans.derived import Ledger
    from docledger.plans.ledger_queries import issues

    x = Ledger(spark, SMALL)
    few, here = x.invoices.filter("document_id < 300").cache(), x.groundings.filter("document_id < 300 and document_id % 10 <> 1").cache()
    x.lines = x.lines.filter("document_id < 300 and document_id % 14 <> 3").cache()
    x.invoices = few.unionByName(few.filter("document_id < 40")).unionByName(few.filter("document_id % 5 = 0").withColumn("document_id", F.lit(None).cast("long")))
    x.groundings = here.unionByName(here.filter("document_id % 4 = 0")).unionByName(here.filter("document_id = 8").withColumn("field_path", F.lit(None).cast("string")))
    key = ("document_id", "workspace_id", "total", "line_total")
    shown = lambda rows: rows.select(*key, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_lines", "n_issues", "n_blocking")))
    want, found = shown(ledger.counted(x.invoices, x.lines, issues(x, "severity"))), shown(rules.tallied(x.invoices, x.lines, x.groundings))
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()
    assert found.filter("n_lines = 0 and n_issues > 0").count() > 5 and found.filter("n_issues > n_blocking and n_blocking > 0").count() > 50
