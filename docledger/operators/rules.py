"""Validation rules: each takes tables of many documents and gives one row for each issue."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.functions import money, text
from docledger.plans.derived import MONEY_FIELDS

#: The required header fields, how they are called, and which currencies a symbol may stand for.
REQUIRED = (("vendorName", "Vendor name"), ("invoiceNumber", "Invoice number"), ("issueDate", "Issue date"), ("currency", "Currency"), ("total", "Total"))
SYMBOLS = (("€", ("EUR",)), ("£", ("GBP",)), ("₹", ("INR",)), ("¥", ("JPY", "CNY")), ("$", ("USD", "AUD", "CAD", "SGD", "NZD", "HKD", "MXN")))
SEVERITIES = ("blocking", "warning", "info")
LOW_CONFIDENCE = 0.6


ISSUE = {"code": "string", "severity": "string", "field_paths": "array<string>", "message": "string", "suggest_path": "string", "suggest_value": "string", "suggest_reason": "string", "place": "int"}
#: What is made of an issue; a caller that needs less names it, and the rest is not computed (Spark does not prune it out of arrays).
ALL = tuple(ISSUE)
SUGGESTED = ("suggest_path", "suggest_value", "suggest_reason")


def issue(code: str, severity: Column | str, paths: Column, message: Column, path: Column | None = None, value: Column | None = None, reason: Column | None = None, place: Column | None = None, columns: Sequence[str] = ALL) -> Column:
    """One issue, as a struct of some columns."""
    text_ = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    made = {
        "code": F.lit(code), "severity": F.lit(severity) if isinstance(severity, str) else severity, "field_paths": paths.cast("array<string>"), "message": message,
        "suggest_path": text_(path), "suggest_value": text_(value), "suggest_reason": text_(reason), "place": (F.lit(0) if place is None else place).cast("int"),
    }
    return F.struct(*(made[c].alias(c) for c in columns))


def nothing(columns: Sequence[str] = ALL) -> Column:
    return F.array().cast(f"array<struct<{','.join(f'{c}:{ISSUE[c]}' for c in columns)}>>")


def if_(wrong: Column, found: Column, columns: Sequence[str] = ALL) -> Column:
    """The issue where something is wrong, in an array that is empty elsewhere."""
    return F.when(F.coalesce(wrong, F.lit(False)), F.array(found)).otherwise(nothing(columns))


def every(issues: Column, columns: Sequence[str] = ALL) -> Column:
    return F.coalesce(issues, nothing(columns))


def listed(rows: DataFrame, *issues: Column) -> DataFrame:
    """One row for each issue of documents, of whatever rules are given, all evaluated in one pass over the rows."""
    return rows.select("document_id", F.explode(F.concat(*issues) if len(issues) > 1 else issues[0]).alias("x")).select("document_id", "x.*")


def gathered(invoices: DataFrame, lines: DataFrame, groundings: DataFrame | None = None) -> DataFrame:
    """Invoices with all that the rules look at: their lines in order (items), the amounts among them with sum and number, and which fields are located."""
    amount = F.col("amount")
    own = lines.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("idx", "quantity", "unit_price", "amount"))).alias("items"), F.sum("amount").cast(money.MONEY).alias("line_sum"), F.count(amount).alias("n_lines"))
    own = own.withColumn("amounts", F.filter("items", lambda x: x["amount"].isNotNull()))
    # rules take more time than reading: invoices are dealt by document with their lines, however small their table is
    rows = invoices.join(own.hint("merge"), "document_id", "left")
    if groundings is not None:
        wanted = F.col("field_path").isin(*MONEY_FIELDS) | of_line(F.col("field_path"))
        rows = rows.join(groundings.filter(wanted).groupBy("document_id").agg(F.collect_set("field_path").alias("located")), "document_id", "left")
    return rows


def tallied(invoices: DataFrame, lines: DataFrame, groundings: DataFrame) -> DataFrame:
    """Invoices with their numbers of lines and of issues (V002, V004, V005, V009, V010), and how many of these are blocking.

    The rules are the same as those that list issues, but are counted line by line: of a document, only the paths of its
    located lines are gathered, and neither its lines nor its issues become an array.
    """
    path, line = F.col("field_path"), F.struct("idx", "quantity", "unit_price", "amount")
    located = groundings.filter(of_line(path)).groupBy("document_id").agg(F.collect_set(path).alias("located"))
    heads = groundings.filter(path.isin(*MONEY_FIELDS)).groupBy("document_id").agg(*(F.bool_or(path == c).alias(f"{c}_located") for c in MONEY_FIELDS))
    own = lines.join(located, "document_id", "left").groupBy("document_id").agg(
        F.count("*").alias("n_all"), F.sum("amount").cast(money.MONEY).alias("line_sum"), F.count("amount").alias("n_lines"),
        F.count_if(product_differs(line)).alias("n_products"), F.count_if(is_lost(F.col("amount"), line_path(F.col("idx")))).alias("n_lost"),
    )
    one = lambda wrong: F.coalesce(wrong, F.lit(False)).cast("bigint")
    none = F.lit(0).cast("bigint")
    blocking = sum((one(F.col(c).isNotNull() & ~F.coalesce(f"{c}_located", F.lit(False))) for c in MONEY_FIELDS), one(sum_differs()))
    others = one(due_is_early()) + one(is_negative()) + F.coalesce("n_products", none) + F.coalesce("n_lost", none)
    rows = invoices.join(own, "document_id", "left").join(heads, "document_id", "left")
    rows = rows.select(*(F.col(c) for c in invoices.columns), F.col("n_all").alias("n_lines"), F.col("line_sum").alias("line_total"), (blocking + others).alias("n_issues"), blocking.alias("n_blocking"))
    # issues are a document's: rows of one id share them, and without an id there are none
    shared = lambda c: F.when(F.col("document_id").isNotNull(), F.sum(c).over(Window.partitionBy("document_id"))).otherwise(none)
    return rows.withColumns({c: shared(c) for c in ("n_issues", "n_blocking")})


def say(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def line_path(idx: Column, name: str = "amount") -> Column:
    return say("lineItems.", idx, f".{name}")


def of_line(path: Column) -> Column:
    """Whether a path is that of a line's amount."""
    return path.startswith("lineItems.") & path.endswith(".amount")


def line_sums(lines: DataFrame) -> DataFrame:
    """Of each document with a printed line amount: their exact sum, their number and themselves in order."""
    return lines.filter(F.col("amount").isNotNull()).groupBy("document_id").agg(F.sum("amount").cast(money.MONEY).alias("line_sum"), F.count("*").alias("n_lines"), F.sort_array(F.collect_list(F.struct("idx", "amount"))).alias("items"))


def missing_issues(columns_there: list[str], wanted: Sequence[str] = ALL) -> Column:
    """V001: a required field is empty, or was printed but could not be read."""
    columns = {"vendorName": ("vendor_name", None, ""), "invoiceNumber": ("invoice_number", None, ""), "issueDate": ("issue_date", "printed_issue_date", "a date"), "currency": ("currency", None, ""), "total": ("total", "printed_total", "an amount")}
    found = []
    for n, (path, label) in enumerate(REQUIRED):
        own, printed, reads_as = columns[path]
        shown = F.col(printed) if printed in columns_there else F.lit(None).cast("string")
        message = F.coalesce(say(f"{label} could not be read as {reads_as} (printed as ", shown, ")."), F.lit(f"{label} is missing or could not be read."))
        found.append(if_(F.col(own).isNull(), issue("V001", "blocking", F.array(F.lit(path)), message, place=F.lit(n), columns=wanted), wanted))
    return F.concat(*found)


def missing_fields(invoices: DataFrame) -> DataFrame:
    return listed(invoices, missing_issues(invoices.columns))


def sum_differs() -> Column:
    return F.abs(money.to_cents(F.col("line_sum")) - money.to_cents(F.col("subtotal"))) > F.greatest(F.lit(5), F.col("n_lines"))


def line_sum_issues(columns: Sequence[str] = ALL) -> Column:
    """V002: line amounts do not add up to the subtotal, by more than a cent a line and five cents at least."""
    subtotal, total = F.col("subtotal"), F.col("line_sum")
    off = sum_differs()
    need = lambda x: (subtotal - (total - x["amount"])).cast(money.MONEY)
    fits = F.filter("amounts", lambda x: (need(x) > 0) & money.is_digit_swap(x["amount"], need(x)))
    whole = money.is_digit_swap(subtotal, total)
    paths = F.concat(F.array(F.lit("subtotal")), F.transform("amounts", lambda x: line_path(x["idx"])))

    message = say("The line items add up to ", total, " but the subtotal reads ", subtotal, ".")
    if not set(columns) & set(SUGGESTED):
        return if_(off, issue("V002", "blocking", paths, message, columns=columns), columns)

    def made(x: Column) -> Column:
        line = x["line"]
        path = F.when(x["whole"], F.lit("subtotal")).otherwise(line_path(line["idx"]))
        value = F.when(x["whole"], total).otherwise(need(line))
        reason = F.when(x["whole"], F.lit("Two adjacent digits in the subtotal look swapped.")).otherwise(say("Two adjacent digits in line ", line["idx"] + 1, " look swapped."))
        return issue("V002", "blocking", paths, message, path, value, reason, columns=columns)

    known = text.bound(whole, lambda w: F.struct(w.alias("whole"), F.when(~w, F.try_element_at(fits, F.lit(1))).alias("line")))
    return if_(off, text.bound(known, made), columns)


def line_sum_differs(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    return listed(gathered(invoices, lines), line_sum_issues())


def total_issues(columns: Sequence[str] = ALL) -> Column:
    """V003: subtotal (or lines), tax and shipping less the discount are not the total, by more than five cents."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast(money.MONEY))
    sum_ = (F.coalesce("subtotal", "line_sum") + zero("tax") + zero("shipping") - F.abs(zero("discount"))).cast(money.MONEY)
    kept = lambda c: F.when(F.col(c).isNotNull(), F.array(F.lit(c))).otherwise(F.array().cast("array<string>"))
    extras = F.concat(kept("tax"), kept("shipping"), kept("discount"))
    from_lines = F.coalesce(F.transform("amounts", lambda x: line_path(x["idx"])), F.array().cast("array<string>"))
    paths = F.concat(F.array(F.lit("total")), F.when(F.col("subtotal").isNotNull(), F.array(F.lit("subtotal"))).otherwise(from_lines), extras)
    basis = F.when(F.col("subtotal").isNotNull(), "subtotal").otherwise("line items")
    named = F.concat(F.array(basis), extras)

    def made(expected: Column) -> Column:
        clause = F.when((F.size(named) == 1) & (basis == "subtotal"), say("The subtotal is ", expected)).otherwise(say("The ", text.list_words(named), " add up to ", expected))
        swap = money.is_digit_swap(F.col("total"), expected)
        untaxed = F.col("tax").isNull() & (F.col("total") > expected)
        path = F.when(swap, "total").when(untaxed, "tax")
        value = F.when(swap, expected).when(untaxed, (F.col("total") - expected).cast(money.MONEY))
        reason = F.when(swap, "Two adjacent digits in the total look swapped.").when(untaxed, "The difference looks like a tax amount that was not extracted.")
        return issue("V003", "blocking", paths, say(clause, " but the total reads ", F.col("total"), "."), path, value, reason, columns=columns)

    return if_(F.abs(sum_ - F.col("total")) > 0.05, text.bound(sum_, made), columns)


def total_differs(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    return listed(gathered(invoices, lines), total_issues())


def product_of(line: Column) -> Column:
    return money.times(line["quantity"], line["unit_price"])


def product_differs(line: Column) -> Column:
    return F.coalesce(F.abs(product_of(line) - line["amount"]) > F.lit(Decimal("0.02")), F.lit(False))


def product_issue(line: Column, columns: Sequence[str] = ALL) -> Column:
    """V004: quantity times unit price is not the line's amount, by more than two cents."""
    idx, plain = line["idx"], lambda c: text.trim_zeros(line[c].cast("string"))
    paths = F.array(line_path(idx), line_path(idx, "quantity"), line_path(idx, "unitPrice"))
    message = say("Line ", idx + 1, ": ", plain("quantity"), " times ", plain("unit_price"), " is ", product_of(line), ", not ", line["amount"], ".")
    return issue("V004", "warning", paths, message, line_path(idx), product_of(line), F.lit("Quantity times unit price."), idx, columns)


def product_issues(columns: Sequence[str] = ALL) -> Column:
    return every(F.transform(F.filter("items", product_differs), lambda x: product_issue(x, columns)), columns)


def line_product_differs(lines: DataFrame) -> DataFrame:
    line = F.struct("idx", "quantity", "unit_price", "amount")
    return lines.filter(product_differs(line)).select("document_id", product_issue(line).alias("x")).select("document_id", "x.*")


def due_is_early() -> Column:
    return F.col("due_date") < F.col("issue_date")


def due_issues(columns: Sequence[str] = ALL) -> Column:
    """V005."""
    return if_(due_is_early(), issue("V005", "warning", F.array(F.lit("dueDate"), F.lit("issueDate")), say("The due date (", F.col("due_date"), ") is before the issue date (", F.col("issue_date"), ")."), columns=columns), columns)


def due_before_issue(invoices: DataFrame) -> DataFrame:
    return listed(invoices, due_issues())


def odd_date_issues(today: date) -> Column:
    """V006: more than ten years ago, or more than 30 days ahead. A 29 February ten years from a common year counts as 1 March."""
    try:
        early = today.replace(year=today.year - 10)
    except ValueError:
        early = date(today.year - 10, 3, 1)
    old, late = F.col("issue_date") < F.lit(early), F.col("issue_date") > F.lit(today + timedelta(days=30))
    rest = F.when(old, " is more than ten years ago.").otherwise(" is more than 30 days in the future.")
    return if_(old | late, issue("V006", "warning", F.array(F.lit("issueDate")), say("The issue date (", F.col("issue_date"), ")", rest)))


def odd_issue_date(invoices: DataFrame, today: date) -> DataFrame:
    return listed(invoices, odd_date_issues(today))


def symbol_issues(printed: Column) -> Column:
    """V007: one kind of symbol stands by the amounts, and it is not the currency's."""
    kinds = F.array(*(F.struct(F.lit(s).alias("symbol"), F.array(*map(F.lit, codes)).alias("codes")) for s, codes in SYMBOLS))

    def made(seen: Column) -> Column:
        kind = seen[0]
        message = say('Amounts are printed with "', kind["symbol"], '" but the currency reads ', F.col("currency"), ".")
        found = issue("V007", "warning", F.array(F.lit("currency")), message, F.lit("currency"), kind["codes"][0], F.lit("The symbol printed next to the amounts."))
        return if_((F.size(seen) == 1) & ~F.array_contains(kind["codes"], F.col("currency")), found)

    return F.when(F.col("currency").isNotNull(), text.bound(F.filter(kinds, lambda x: F.contains(printed, x["symbol"])), made)).otherwise(nothing())


def odd_symbol(invoices: DataFrame, printed: Column) -> DataFrame:
    return listed(invoices, symbol_issues(printed))


def duplicates(invoices: DataFrame) -> DataFrame:
    """For each invoice, another document of its workspace with the same vendor and number: the one of least id.

    The two least ids of each group are found by an aggregate that combines before the shuffle, so large groups of
    duplicates do not multiply.
    """
    keyed = invoices.filter((F.col("vendor_key") != "") & (F.col("invoice_number") != ""))
    key = ["workspace_id", "vendor_key", "invoice_number"]
    firsts = keyed.groupBy(key).agg(F.min(F.struct("document_id", "filename")).alias("one"), F.count("*").alias("n"), F.max("document_id").alias("last")).filter("n > 1 and last <> one.document_id")
    second = keyed.join(firsts.select(*key, "one"), key).filter(F.col("document_id") != F.col("one.document_id")).groupBy(key).agg(F.min(F.struct("document_id", "filename")).alias("two"))
    pairs = firsts.select(*key, "one").join(second, key)
    other = F.when(F.col("document_id") == F.col("one.document_id"), F.col("two")).otherwise(F.col("one"))
    return keyed.join(pairs, key).select("document_id", other["document_id"].alias("other_id"), other["filename"].alias("other_filename"))


def duplicate_issues() -> Column:
    """V008, of rows with another document's id and name."""
    message = say("Another document in this workspace has the same vendor and invoice number: ", F.col("other_filename"), ".")
    return if_(F.col("other_id").isNotNull(), issue("V008", "warning", F.array(F.lit("invoiceNumber"), F.lit("vendorName")), message, F.lit("duplicate"), F.col("other_id"), F.col("other_filename")))


def duplicate_invoice(invoices: DataFrame) -> DataFrame:
    return listed(duplicates(invoices), duplicate_issues())


def is_negative() -> Column:
    return F.col("total") < 0


def negative_issues(columns: Sequence[str] = ALL) -> Column:
    """V009."""
    return if_(is_negative(), issue("V009", "info", F.array(F.lit("total")), say("The total is negative (", F.col("total"), "). This may be a credit note."), columns=columns), columns)


def negative_total(invoices: DataFrame) -> DataFrame:
    return listed(invoices, negative_issues())


def is_lost(value: Column, path: Column) -> Column:
    """Whether an amount is printed, but not among the located fields."""
    return value.isNotNull() & ~F.array_contains(F.coalesce("located", F.array().cast("array<string>")), path)


def located_issues(columns: Sequence[str] = ALL) -> Column:
    """V010: an amount that was not found on the document; blocking for the header, a warning for lines."""

    def kind(path: Column, label: Column, value: Column, severity: str, place: Column) -> Column:
        # what an issue is found by, and what the columns that are made of it need
        found = {"path": path, "value": value, "label": label, "severity": F.lit(severity), "place": place.cast("int")}
        needed = {"path", "value", "label" if "message" in columns else "path", *columns}
        return F.struct(*(c.alias(name) for name, c in found.items() if name in needed))

    header = F.array(*(kind(F.lit(c), F.lit(c.capitalize()), F.col(c), "blocking", F.lit(n)) for n, c in enumerate(MONEY_FIELDS)))
    own = F.transform("amounts", lambda x: kind(line_path(x["idx"]), say("Line ", x["idx"] + 1, " amount"), x["amount"], "warning", x["idx"] + len(MONEY_FIELDS)))
    lost = F.filter(F.concat(header, F.coalesce(own, F.filter(header, lambda x: F.lit(False)))), lambda x: is_lost(x["value"], x["path"]))
    return F.transform(lost, lambda x: issue("V010", x["severity"], F.array(x["path"]), say(x["label"], " (", x["value"], ") could not be found on the document."), place=x["place"], columns=columns))


def not_located(invoices: DataFrame, lines: DataFrame, groundings: DataFrame) -> DataFrame:
    return listed(gathered(invoices, lines, groundings), located_issues())


def not_an_invoice(documents: DataFrame) -> DataFrame:
    """V011: for documents of type `other` the only issue; they are rejected."""
    return listed(documents, if_(F.col("doc_type") == "other", issue("V011", "blocking", F.array(), F.lit("This document does not look like an invoice."))))


def read_issue(page: Column) -> Column:
    """V012: a page read by OCR with a measured confidence under 0.6."""
    share = F.floor(page["ocr_mean_confidence"] * 100 + 0.5).cast("int")
    message = say("Text on page ", page["page_no"], " was read by OCR with low confidence (", share, "%). Check values from this page carefully.")
    return issue("V012", "warning", F.array(), message, place=page["page_no"])


def badly_read(pages: DataFrame) -> DataFrame:
    rows = pages.filter((F.col("text_source") == "ocr") & (F.col("ocr_mean_confidence") < LOW_CONFIDENCE))
    return rows.select("document_id", read_issue(F.struct("page_no", "ocr_mean_confidence")).alias("x")).select("document_id", "x.*")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "blocking", 0).when(severity == "warning", 1).otherwise(2)


def validate(invoices: DataFrame, lines: DataFrame, groundings: DataFrame, today: date, printed: Column, pages: DataFrame | None = None) -> DataFrame:
    """All issues of invoices with their place in each document's list: by severity, code and order of detection.

    Everything that the rules need of a document is brought together once, then all of them are evaluated on that row; what is
    gathered is one document's lines, located fields and badly read pages.
    """
    rows = gathered(invoices, lines, groundings).join(duplicates(invoices), "document_id", "left")
    found = [missing_issues(invoices.columns), line_sum_issues(), total_issues(), product_issues(), due_issues(), odd_date_issues(today), symbol_issues(printed), duplicate_issues(), negative_issues(), located_issues()]
    if pages is not None:
        bad = pages.filter((F.col("text_source") == "ocr") & (F.col("ocr_mean_confidence") < LOW_CONFIDENCE))
        rows = rows.join(bad.groupBy("document_id").agg(F.collect_list(F.struct("page_no", "ocr_mean_confidence")).alias("bad_pages")), "document_id", "left")
        found.append(every(F.transform("bad_pages", read_issue)))
    order = lambda x: F.struct(severity_rank(x["severity"]).alias("rank"), x["code"].alias("code"), x["place"].alias("place"), x.alias("issue"))
    ranked = F.sort_array(F.transform(F.concat(*found), order))
    return rows.select("document_id", F.posexplode(ranked).alias("n", "x")).select("document_id", "x.issue.*", (F.col("n") + 1).alias("ordinal"))
