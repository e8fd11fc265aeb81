"""Grounding cases: pages of plain lines, values looked for, and where they have to be found."""

import math
import random

import pytest
from pyspark.sql import functions as F

from docledger.functions import fuzzy
from docledger.operators import grounding, tokens
from docledger.plans import function_queries
from docledger.plans.derived import Ledger
from tests import plain_grounding

SUMS = ["Net amount 3.480,00", "Sales tax 661,20", "Amount due 41,41,200.00"]
DAYS = ["Payable by 05.11.2025", "Issued Nov 19, 2025"]
ORDER = ["Order 8052 dated 7 May 2025", "VAT 19% 1,092.15"]
KIT = ["Repair kit 2 9.50 19.00", "Net 480.00", "Freight 19.00", "Grand total 499.00"]
PAY = ["Kindly settle now EUR 5,310.75"]
CASES = [
    # page lines, path, kind, value, source text, (method, score, line, start, end) or None
    (PAY, "total", "money", "5310.75", "EUR 5,310.75", ("exact", 1.0, 0, 3, 5)),
    (["Marlow & Finch Ltd", "Grand total 2,905.60"], "total", "money", "2905.60", "2,905.60", ("exact", 1.0, 1, 6, 7)),
    (["Marlow & Finch Ltd", "Grand total 2,905.60"], "vendorName", "text", "Marlow & Finch Ltd", None, ("exact", 1.0, 0, 0, 4)),
    (SUMS, "subtotal", "money", "3480.00", None, ("normalized", 0.9, 0, 2, 3)),
    (SUMS, "tax", "money", "661.20", None, ("normalized", 0.9, 1, 5, 6)),
    (SUMS, "total", "money", "4141200.00", None, ("normalized", 0.9, 2, 8, 9)),
    (DAYS, "dueDate", "date", "2025-11-05", None, ("normalized", 0.9, 0, 2, 3)),
    (DAYS, "issueDate", "date", "2025-11-19", "Nov 19, 2025", ("exact", 1.0, 1, 4, 7)),
    (["Dated 19 November 2025"], "issueDate", "date", "2025-11-19", None, ("normalized", 0.9, 0, 1, 4)),
    (["Balance due 6,071.3S"], "total", "money", "6071.35", "6,071.35", ("fuzzy", 0.7, 0, 2, 3)),
    (KIT, "shipping", "money", "19.00", "19.00", ("exact", 1.0, 2, 8, 9)),
    (KIT, "discount", "money", "987.65", None, None),
    (KIT, "vendorName", "text", "Nobody of that name", None, None),
    (ORDER, "tax", "money", "8052.00", None, None),
    (ORDER, "tax", "money", "19.00", None, None),
    (ORDER, "tax", "money", "1092.15", None, ("normalized", 0.9, 1, 8, 9)),
    (["Balance due 846.20"], "total", "money", "864.20", "846.20", None),
    (["Balance due 846.20"], "total", "money", "846.20", None, ("exact", 1.0, 0, 2, 3)),
    (["", ""], "total", "money", "1.00", None, None),
]


@pytest.fixture(scope="module")
def labels(spark):
    return grounding.label_table(spark)


def page_rows(spark, lines):
    return tokens.text_pages(spark.createDataFrame([(i, 1, "\n".join(x)) for i, x in enumerate(lines)], "document_id long, page_no int, text string"))


def test_values(spark, labels):
    pages = page_rows(spark, [c[0] for c in CASES])
    values = spark.createDataFrame([(i, *c[1:5], None) for i, c in enumerate(CASES)], "document_id long, field_path string, kind string, value string, source_text string, page int")
    want = {i: c[5] for i, c in enumerate(CASES) if c[5]}
    best = grounding.best_places(grounding.matches(pages, values, labels), values)
    assert {r.document_id: (r.method, r.score, r.line, r.start, r.end) for r in best.collect()} == want
    whole = grounding.ground(pages, values, labels).collect()
    assert {r.document_id: (r.method, r.score, r.line, r.start, r.end) for r in whole} == want
    box = next(r for r in whole if r.document_id == 0)
    assert (box.x, box.y, box.w, box.h) == (0.3, 0.0, 0.18, 0.02)


def test_candidates(spark):
    rows = [(0, "money", "5310.75", "EUR 5,310.75"), (1, "money", "864.20", "846.20"), (2, "number", "1450", "1,450"), (3, "number", "1450", "1,540"), (4, "date", "2025-11-19", "Nov 20, 2025"), (5, "currency", "EUR", "€"), (6, "text", None, "  ")]
    frame = spark.createDataFrame([(i, "f", k, v, s, None) for i, k, v, s in rows], "document_id long, field_path string, kind string, value string, source_text string, page int")
    got = {}
    for r in grounding.candidates(frame).orderBy("document_id", "ordinal").collect():
        got.setdefault(r.document_id, []).append(r.raw)
    assert got == {0: ["EUR 5,310.75", "5310.75"], 1: ["864.20"], 2: ["1,450", "1450"], 3: ["1450"], 4: ["2025-11-19"], 5: ["€", "EUR"]}


def test_claims(spark, labels):
    lines = ["Oak shelf 3 21.50 64.50", "Wall bracket 1 21.50 21.50", "Net 86.00", "VAT 0.00", "Balance due 86.00"]
    values = [("total", "money", "86.00"), ("subtotal", "money", "86.00"), ("lineItems.0.description", "text", "Oak shelf"), ("lineItems.0.quantity", "number", "3"), ("lineItems.0.unitPrice", "money", "21.50"), ("lineItems.0.amount", "money", "64.50"),
              ("lineItems.1.description", "text", "Wall bracket"), ("lineItems.1.quantity", "number", "1"), ("lineItems.1.unitPrice", "money", "21.50"), ("lineItems.1.amount", "money", "21.50")]
    frame = spark.createDataFrame([(1, p, k, v, None, None) for p, k, v in values], "document_id long, field_path string, kind string, value string, source_text string, page int")
    pages = tokens.text_pages(spark.createDataFrame([(1, 1, "\n".join(lines))], "document_id long, page_no int, text string"))
    got = {r.field_path: (r.start, r.end) for r in grounding.ground(pages, frame, labels).collect()}
    assert got == {"total": (16, 17), "subtotal": (11, 12), "lineItems.0.description": (0, 2), "lineItems.0.quantity": (2, 3), "lineItems.0.unitPrice": (3, 4), "lineItems.0.amount": (4, 5), "lineItems.1.description": (5, 7), "lineItems.1.quantity": (7, 8), "lineItems.1.unitPrice": (8, 9), "lineItems.1.amount": (9, 10)}


def test_all_invoices(spark):
    """Every line of every invoice is grounded where it was printed, and so are the sums."""
    small = "/root/testdata/sf0.001"
    want, page, lines = {}, {}, {}
    for r in function_queries.lines(Ledger(spark, small)).select("document_id", "idx", "description", "quantity", "shown").orderBy("document_id", "idx").collect():
        at, n = page.get(r.document_id, 0), len(r.description.split())
        want[r.document_id, f"lineItems.{r.idx}.description"] = (at, at + n, "exact")
        page[r.document_id] = at + n + 1 + len(r.shown.split())
        lines[r.document_id] = lines.get(r.document_id, 0) + 1
    got = {(r.document_id, r.field_path): (r.start, r.end, r.method) for r in function_queries.QUERIES["g11_ground_document"](spark, small).collect()}
    assert {k: v for k, v in got.items() if k[1].endswith("description")} == want
    sums = {(d, f): (n + 1 + 2 * k, n + 2 + 2 * k) for d, n in page.items() for k, f in enumerate(("subtotal", "total"))}
    assert {k for k in got if k[1] in ("total", "subtotal")} == set(sums)
    assert all(got[k][:2] == v for k, v in sums.items() if lines[k[0]] > 1)  # a single line's amount is its sum, too


def test_lines(spark):
    rows = [(0, [("b", 0.5, 0.1, 0.1, 0.02), ("a", 0.1, 0.105, 0.1, 0.02), ("c", 0.1, 0.2, 0.1, 0.02)]), (1, [("small", 0.3, 0.14, 0.1, 0.02), ("TALL", 0.1, 0.1, 0.1, 0.06)]), (2, [])]
    frame = spark.createDataFrame(rows, "i int, t array<struct<text:string,x:double,y:double,w:double,h:double>>")
    got = {r.i: [(t.line, t.text) for t in r.t] for r in frame.select("i", tokens.assign_lines(F.col("t")).alias("t")).collect()}
    assert got == {0: [(0, "a"), (0, "b"), (1, "c")], 1: [(0, "TALL"), (0, "small")], 2: []}


def test_whole_texts(spark):
    small = "/root/testdata/sf0.001"
    texts = {r.doc_id: [[w for w in line.split(" ") if w] for line in r.text.split("\n")] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.document_id: (r.n, r.last_line) for r in function_queries.QUERIES["f21_lines"](spark, small).collect()}
    assert got == {i: (sum(map(len, rows)), sum(map(bool, rows)) - 1 if any(rows) else None) for i, rows in texts.items()}
    assert max(n for n, _ in got.values()) > 200


def test_lines_fold(spark):
    """The same as folding token by token, on tokens of all heights and in any order."""
    rng = random.Random(3)
    rows = [(i, [(f"w{n}", rng.randrange(4) / 4, rng.randrange(20) / 64, 0.1, rng.choice([1, 2, 4, 8]) / 64) for n in range(rng.choice([1, 5, 40]))]) for i in range(40)]
    frame = spark.createDataFrame([*rows, (99, None)], "i int, t array<struct<text:string,x:double,y:double,w:double,h:double>>")
    want = {99: None}
    for i, words in rows:
        line, base, height, out = -1, None, 0.0, []
        for n, (low, x, _, t) in enumerate(sorted((t[2] + t[4], t[1], k, t) for k, t in enumerate(words))):
            if base is None or abs(low - base) > max(t[4], height) * 0.5:
                line, base, height = line + 1, low, t[4]
            out.append((line, x, n, t[0]))
        want[i] = [(a, d) for a, _, _, d in sorted(out)]
    assert {r.i: r.t and [(t.line, t.text) for t in r.t] for r in frame.select("i", tokens.assign_lines(F.col("t")).alias("t")).collect()} == want


def test_ocr(spark):
    words = [("Total", 90.0, 100.0, 200.0, 160.0, 220.0), ("5,310.75", 70.0, 400.0, 200.0, 500.0, 220.0), (" ", 5.0, 0.0, 0.0, 1.0, 1.0), ("edge", 80.0, 900.0, 900.0, 1100.0, 920.0)]
    frame = spark.createDataFrame([(1, 1, 1000.0, 2000.0, words)], "document_id long, page_no int, width double, height double, words array<struct<text:string,confidence:double,x0:double,y0:double,x1:double,y1:double>>")
    (row,) = tokens.ocr_pages(frame).collect()
    assert [(t.text, t.line) for t in row.tokens] == [("Total", 0), ("5,310.75", 0), ("edge", 1)]
    assert row.tokens[0].x == 0.1 and round(row.tokens[0].w, 6) == 0.06 and row.tokens[2].x + row.tokens[2].w == 1.0 and round(row.ocr_mean_confidence, 6) == 0.8


def test_items(spark):
    frame = spark.createDataFrame([("ab  cde", (0.1, 0.2, 0.7, 0.02)), ("  ", (0.0, 0.0, 1.0, 1.0))], "text string, box struct<x:double,y:double,w:double,h:double>")
    one, two = [r.t for r in frame.select(tokens.words_of_item(F.col("text"), F.col("box")).alias("t")).collect()]
    assert [(t.text, round(t.x, 6), round(t.w, 6)) for t in one] == [("ab", 0.1, 0.2), ("cde", 0.5, 0.3)] and two == []


def test_kinds(spark):
    many = "w " * 25
    pages = tokens.text_pages(spark.createDataFrame([(1, 1, many), (1, 2, "x"), (2, 1, "x"), (3, 1, "x")], "document_id long, page_no int, text string")).withColumns({"mime": F.when(F.col("document_id") == 3, "image/png").otherwise("application/pdf"), "has_image": F.lit(True)})
    assert {r.document_id: r.kind for r in tokens.document_kinds(pages).collect()} == {1: "pdf_text", 2: "pdf_scan", 3: "image"}
    assert sorted((r.document_id, r.page_no) for r in tokens.pages_to_read(pages).collect()) == [(1, 2), (2, 1), (3, 1)]


VOCABULARY = ("Oak", "oak", "shelf", "Shelf,", "bracket", "brakcet", "Total", "Subtotal", "VAT", "Net", "due", "Invoice", "date", "3", "12", "21.50", "21,50", "1,021.50", "1.021,50", "2150", "$21.50", "EUR", "€", "(21.50)", "19", "May", "2025", "May,", "19.05.2025", "2025-05-19", "Marlow", "Marlo", "Ltd", "INV-2041", "INV-2014", "1021.5O")
VALUES = {
    "total": ("money", ("1021.50", "21.50")), "subtotal": ("money", ("21.50", "1021.50")), "tax": ("money", ("21.50", "3.00")), "vendorName": ("text", ("Marlow Ltd", "Marlow", "Oak shelf bracket Ltd")), "invoiceNumber": ("text", ("INV-2041", "2041")),
    "issueDate": ("date", ("2025-05-19",)), "dueDate": ("date", ("2025-05-19", "2025-05-03")), "currency": ("currency", ("EUR", "USD")),
}


def test_against_plain(spark, labels):
    """Random pages of few words, values that are printed often, nearly or not at all: the same places as by going through all windows."""
    rng = random.Random(11)
    texts, values = [], []
    for doc in range(160):
        for page in range(1, rng.choice([1, 1, 2]) + 1):
            texts.append((doc, page, "\n".join(" ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(1, 5)))))
        add = lambda path, kind, value: values.append((doc, path, kind, value, rng.choice([None, None, value, "1.021,50", "19 May 2025", "€ 21,50"]), rng.choice([None, 1, 2])))  # noqa: B023, E731
        for path in rng.sample(list(VALUES), rng.randint(1, 8)):
            add(path, VALUES[path][0], rng.choice(VALUES[path][1]))
        for row in range(rng.choice([0, 1, 2, 4])):
            cells = {"description": ("text", ("Oak shelf", "oak shelf", "bracket", "Oak brackte")), "quantity": ("number", ("3", "12")), "unitPrice": ("money", ("21.50",)), "amount": ("money", ("21.50", "1021.50"))}
            for cell in rng.sample(list(cells), rng.randint(1, 4)):
                add(f"lineItems.{row}.{cell}", cells[cell][0], rng.choice(cells[cell][1]))
    pages = tokens.text_pages(spark.createDataFrame(texts, "document_id long, page_no int, text string"))
    frame = spark.createDataFrame(values, "document_id long, field_path string, kind string, value string, source_text string, page int")
    prepared, wanted = {}, {}
    for r in grounding.prepared(pages).orderBy("document_id", "page_no").collect():
        prepared.setdefault(r.document_id, []).append((r.page_no, r.tokens))
    for r in grounding.candidates(frame).orderBy("ordinal").collect():
        wanted.setdefault(r.document_id, {}).setdefault(r.field_path, []).append(r)
    page_of = {(d, f): p for d, f, *_, p in values}
    want = {}
    for doc, fields in wanted.items():
        for path, found in plain_grounding.ground(prepared[doc], fields, {f: page_of[doc, f] for f in fields}).items():
            want[doc, path] = (*found[:3], math.floor(found[3] * 1000 + 0.5) / 1000, *found[4:])
    got = {(r.document_id, r.field_path): (r.page, r.start, r.end, r.score, r.method, r.line) for r in grounding.ground(pages, frame, labels).collect()}
    assert got == want
    assert len(want) > 300 and {m for *_, m, _ in want.values()} == {"exact", "normalized", "fuzzy"}


@pytest.mark.parametrize("name", ["g05_windows", "g10_ground_exact", "g11_ground_document"])
def test_no_window_is_shuffled(spark, name):
    """Documents and candidates are dealt by document; tokens, windows and places stay where their page is, and none is written."""
    query = function_queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = query._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("hashpartitioning(")[1].split(",")[0].split("#")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert set(keys) <= {"document_id", "l_orderkey"} and not any("page_no" in line or "sign" in line for line in plan.splitlines() if "Exchange hashpartitioning(" in line)
    assert "RDDScan" not in plan and "ExistingRDD" not in plan


def test_windows_are_compiled(spark):
    """What a window spells, and whether it reads as an amount, is made of fields of arrays; functions of single elements are not compiled."""
    plan = function_queries.QUERIES["g05_windows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    spelled = [line for line in plan.splitlines() if " AS w_" in line or " AS _w_amount" in line]
    assert spelled and not any("lambdafunction" in line.split(" AS w_day")[0] for line in spelled if " AS w_raw" in line or " AS _w_amount" in line)


def test_labels_are_literals(spark):
    """The first words of labels are not gathered anew for each token, and no amount is read to find them."""
    plan = function_queries.QUERIES["g09_labels"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan and "mwst" in plan


def test_labels_with_digits(spark):
    """Labels may have digits; then tokens with digits are read, and one that is not part of the label never drops out of it."""
    pages = page_rows(spark, [["2nd payment 5.00", "Total 7 due", "Total, due"]])
    labels = spark.createDataFrame([("a", "2nd payment"), ("b", "total due")], "field string, label string")
    found = lambda rows: sorted((r.field, round(r.cy, 6)) for r in grounding.label_centres(pages, rows).collect())
    assert found(labels) == [("a", 0.01), ("b", 0.11)]
    assert found(labels.filter("field = 'b'")) == [("b", 0.11)]


def test_few_edits(spark):
    """The distance of keys that are alike is that of optimal string alignment, swaps included."""
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        one = [rng.choice("ab12") for _ in range(rng.randint(1, 7))]
        other = list(one)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(other) + 1)
            if rng.random() < 0.5 and 0 < at < len(other):
                other[at - 1], other[at] = other[at], other[at - 1]
            else:
                other[at : at + rng.randint(0, 1)] = [rng.choice("ab12")] * rng.randint(0, 1)
        rows.append(("".join(one), "".join(other)))
    a, b = F.col("a"), F.col("b")
    got = spark.createDataFrame(rows, "a string, b string").filter("b <> ''").select(grounding.distance(a, b).alias("x"), fuzzy.osa_column(a, b).alias("y")).collect()
    assert all(r.x == r.y for r in got) and {r.x for r in got} >= {0, 1, 2, 3}
