"""Grounding: where on its pages each extracted value is printed.

Candidates are brought to the pages of their document once, and everything else is made where a page is: a candidate is
tried only from tokens that it may begin with (first word, normal form, first character, digit, month), in windows of about
its own length. The places of one document then claim their tokens by a fold. All of it is one join, one aggregate and Column
expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.functions import dates, fuzzy, money, text
from docledger.operators.tokens import box_of, rounded, run_of
from docledger.plans.derived import FIELDS, MONEY_FIELDS

MOST_TOKENS = 12
LEAST_SIMILAR, FUZZY_SHARE = 0.85, 0.8
KINDS = {"vendorName": "text", "invoiceNumber": "text", "issueDate": "date", "dueDate": "date", "currency": "currency"} | dict.fromkeys(MONEY_FIELDS, "money")
ORDER = ("total", "subtotal", "tax", "shipping", "discount", "vendorName", "invoiceNumber", "issueDate", "dueDate", "currency")
#: Words printed next to each field, in English and German.
LABELS = {
    "invoiceNumber": ("invoice number", "invoice no", "invoice #", "invoice", "no.", "number", "rechnungsnummer", "rechnung nr", "inv"),
    "issueDate": ("invoice date", "date", "issued", "dated", "rechnungsdatum", "datum"),
    "dueDate": ("due date", "due", "payment due", "payable by", "fällig", "zahlbar bis"),
    "currency": ("currency", "amounts in", "prices in"),
    "subtotal": ("subtotal", "sub total", "sub-total", "net amount", "net total", "net", "nettobetrag"),
    "tax": ("tax", "vat", "gst", "sales tax", "ust", "mwst", "igst", "cgst", "sgst", "hst"),
    "shipping": ("shipping", "delivery", "freight", "postage", "carriage", "versand"),
    "discount": ("discount", "less", "rabatt"),
    "total": ("total", "total due", "amount due", "balance due", "grand total", "amount payable", "total payable", "gesamtbetrag", "payable"),
}
LETTERS = r"^[A-Za-z]+\z"
MONEY_TOKEN = rf"(?i)^(?:[(-]?[\d.,']*\d[\d.,']*[-)]?|[{text.MARKS}]|(?:{'|'.join(text.CODES)}))$"


def source_agrees(kind: Column, value: Column, source: Column) -> Column:
    """Whether a source text may stand for the value: it does not read as another amount, number or day."""
    day = lambda c: F.coalesce(F.when(dates.is_iso_date(c), c.try_cast("date")), dates.parse_date(c))
    same = (
        F.when(kind == "money", money.parse_money(source).eqNullSafe(money.parse_money(value)))
        .when(kind == "number", money.parse_decimal(source).eqNullSafe(money.parse_decimal(value)))
        .when(kind == "date", day(source).eqNullSafe(day(value)))
        .otherwise(True)
    )
    blank = lambda c: F.coalesce(text.strip(c), F.lit("")) == ""
    return blank(value) | blank(source) | same


def candidates(values: DataFrame) -> DataFrame:
    """Strings worth looking for, of values (document_id, field_path, kind, value, source_text): the source text first, then the value."""
    source = F.when(source_agrees(F.col("kind"), F.col("value"), F.col("source_text")), F.col("source_text"))
    raws = F.array_except(F.array(text.collapse(source), text.collapse(F.col("value"))), F.array(F.lit(""), F.lit(None)))  # distinct, in their order
    page = F.col("page") if "page" in values.columns else F.lit(None).cast("int").alias("page")
    rows = values.filter(F.col("value").isNotNull()).select("document_id", "field_path", "kind", page, F.posexplode(raws).alias("ordinal", "raw"))
    amount = F.col("kind").isin("money", "number")
    rows = money.with_money(rows.withColumn("shaped", text.is_money_shaped(F.col("raw"))), "raw", amount | F.col("shaped"), "read")
    day = F.when(F.col("kind") == "date", F.coalesce(F.when(dates.is_iso_date(F.col("raw")), F.col("raw").try_cast("date")), dates.parse_date(F.col("raw"))))
    norm = F.when(F.col("raw").contains(" "), text.normalize_words(F.col("raw"))).when(F.col("shaped"), F.col("read").cast("string"))
    norm = F.coalesce(norm, text.bare_words(F.col("raw")))
    return rows.select("*", norm.alias("norm"), text.fuzzy_key(F.col("raw")).alias("key"), F.size(F.split("raw", " ")).alias("words"), F.when(amount, F.col("read")).alias("amount"), day.alias("day")).drop("shaped", "read")


def prepared(pages: DataFrame) -> DataFrame:
    """Pages (document_id, page_no, tokens, and what else they have) whose tokens carry their normal form, key, and whether they can spell an amount or begin a day."""

    def made(t: Column, norm: Column, key: Column, money_: Column, digit: Column, month: Column, first: Column) -> Column:
        return F.struct(*(t[c].alias(c) for c in ("text", "x", "y", "w", "h", "line")), (t["x"] + t["w"]).alias("right"), (t["y"] + t["h"]).alias("bottom"), norm.alias("norm"), key.alias("key"), money_.alias("money"), digit.alias("digit"), month.alias("month"), first.alias("b_norm"), F.substring(key, 1, 1).alias("b_key"))

    def token(t: Column) -> Column:
        word = t["text"]
        spelled_ = F.struct(normal_form(word).alias("norm"), text.fuzzy_key(word).alias("key"))
        other = text.bound(spelled_, lambda k: made(t, k["norm"], k["key"], word.rlike(MONEY_TOKEN), word.rlike(r"\d"), k["norm"].isin(*dates.MONTHS), first_word(k["norm"])))
        # most words are plain letters or digits
        named = lambda low: F.struct(low.alias("low"), low.isin(*text.CODES).alias("code"))
        plain = text.bound(text.bound(F.lower(word), named), lambda k: made(t, k["low"], F.when(k["code"], "").otherwise(k["low"]), k["code"], F.lit(False), k["low"].isin(*dates.MONTHS), k["low"]))
        number = made(t, word, word, F.lit(True), F.lit(True), F.lit(False), word)
        return F.when(word.rlike(LETTERS), plain).when(word.rlike(r"^[0-9]+\z"), number).otherwise(other)

    return pages.withColumn("tokens", F.transform("tokens", token))


def normal_form(word: Column) -> Column:
    """That of a token."""
    return F.when(word.rlike(f"[{text.SPACES}]"), text.normalize_words(word)).otherwise(text.normalize_stripped(word))


def first_word(column: Column) -> Column:
    return F.substring_index(column, " ", 1)


def asked(wanted: DataFrame) -> DataFrame:
    """(document_id, wanted): the candidates of each document in one array, with what a place of theirs may begin with."""
    amount, day, keyed = F.col("amount").isNotNull(), F.col("day").isNotNull(), F.length("key") >= 3
    parts = F.split("field_path", r"\.")
    begins = (first_word(F.col("raw")).alias("b_raw"), first_word(F.col("norm")).alias("b_norm"), F.when(keyed, F.substring("key", 1, 1)).otherwise("").alias("b_key"), (amount | day).alias("b_digit"), day.alias("b_month"))
    named = F.when(F.size(parts) == 3, parts[1].cast("int")).alias("row"), F.element_at(parts, -1).alias("cell")
    return wanted.groupBy("document_id").agg(F.collect_list(F.struct("field_path", *named, "page", "ordinal", "raw", "norm", "key", "words", "amount", "day", F.length("key").alias("n"), *begins)).alias("wanted"))


def starts(tokens: Column, wanted: Column) -> Column:
    """Places at which a candidate may begin: n, who may begin there, and the tokens ahead.

    These are as many as a window from there may have: the words of the longest candidate that begins so, and two, at most 12.
    """

    def may(t: Column, c: Column) -> Column:
        return t["digit"] & c["b_digit"] | (t["b_key"] != "") & (t["b_key"] == c["b_key"]) | (t["text"] == c["b_raw"]) | (t["b_norm"] != "") & (t["b_norm"] == c["b_norm"]) | t["month"] & c["b_month"]

    some = F.filter(F.transform(tokens, lambda t, n: F.struct(n.alias("n"), F.filter(wanted, lambda c: may(t, c)).alias("who"))), lambda s: F.size(s["who"]) > 0)
    most = lambda s: F.least(F.lit(MOST_TOKENS), F.array_max(F.transform(s["who"], lambda c: c["words"])) + 2)
    return F.transform(some, lambda s: F.struct(s["n"].alias("n"), s["who"].alias("who"), run_of(tokens, s["n"], most(s)).alias("ahead")))


def with_wanted(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pages with the candidates of their document, tokens prepared. All that follows is made page by page, where the page is."""
    return prepared(pages.select("document_id", "page_no", "tokens").join(asked(wanted), "document_id"))


def spelled(pages: DataFrame, *kept: str) -> DataFrame:
    """Windows of pages with their candidates, from admitted starts, of as many tokens as a candidate admitted there allows, and what they spell.

    Amounts and days are only read where a candidate of the kind is admitted: amounts in up to three tokens, days in up to
    four.
    """
    rows = pages.select("document_id", "page_no", *kept, F.explode(starts(F.col("tokens"), F.col("wanted"))).alias("s")).select("document_id", "page_no", *kept, F.col("s.n").alias("start"), "s.who", "s.ahead")
    sized = rows.select("*", F.explode(F.sequence(F.lit(1), F.size("ahead"))).alias("size")).withColumn("own", F.slice("ahead", F.lit(1), F.col("size"))).drop("ahead")
    # fields of arrays, and no functions of their elements: these are compiled
    part = lambda c: F.col(f"own.{c}")
    words = sized.withColumns({"w_raw": F.array_join(part("text"), " "), "w_norm": F.array_join(F.array_remove(part("norm"), ""), " "), "w_key": F.array_join(part("key"), "")})
    asked_for = lambda c: F.array_max(F.col(f"who.{c}")).isNotNull()
    shaped = (F.col("size") <= 3) & asked_for("amount") & ~F.array_contains(part("money"), False) & text.is_money_shaped(F.col("w_raw"))
    dated = (F.col("size") <= 4) & asked_for("day")
    return money.with_money(words, "w_raw", shaped, "w_amount").withColumn("w_day", F.when(dated, dates.parse_date(F.col("w_raw"))))


def windows(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """All windows in which a candidate may be printed, and what they spell."""
    return spelled(with_wanted(pages, wanted)).select("document_id", "page_no", "start", "size", "w_raw", "w_norm", "w_key", "w_amount", "w_day")


def edits(longest: Column) -> Column:
    """How many edits leave keys of which the longer one has that length similar enough."""
    return F.floor(longest * (1 - LEAST_SIMILAR) + 1e-9)


def distance(one: Column, other: Column) -> Column:
    """Optimal string alignment of keys that are few edits apart. Only a swap makes it less than edits without swaps do, and it leaves the characters as they are."""
    plain = F.levenshtein(one, other)
    swapped = F.sort_array(F.split(one, "")) == F.sort_array(F.split(other, ""))
    return F.when((plain < 2) | (plain == 2) & ~swapped, plain).otherwise(fuzzy.osa_column(one, other))


def scored(found: DataFrame, *kept: str) -> DataFrame:
    """Windows that match a candidate admitted there, with score and method (exact, normalized, or fuzzy where the strings nearly agree) and, if `centres` are kept, the distance to the field's nearest label."""
    m = F.length("w_key")
    near = lambda c: (c["n"] >= 3) & (F.abs(m - c["n"]) <= F.greatest(F.lit(2), F.floor(c["n"] * 0.25))) & (F.abs(m - c["n"]) <= edits(F.greatest(c["n"], m)))
    # alignment has at least half as many edits as without swaps
    close = lambda c: near(c) & (F.levenshtein("w_key", c["key"]) <= 2 * edits(F.greatest(c["n"], m)))
    normal = lambda c: (c["norm"] != "") & (F.col("w_norm") == c["norm"]) | F.coalesce(F.col("w_amount") == c["amount"], F.lit(False)) | F.coalesce(F.col("w_day") == c["day"], F.lit(False))
    c = F.col("c")
    # rows and not an array of candidates, so that what is asked of each pair is compiled
    pairs = found.select("*", F.explode("who").alias("c")).drop("who")
    tried = pairs.filter((F.col("size") <= c["words"] + 2) & ((F.col("w_raw") == c["raw"]) | normal(c) | close(c)))
    sure = F.when(F.col("w_raw") == c["raw"], 1.0).when(normal(c), 0.9)
    similar = F.when(F.col("w_key") == c["key"], 1.0).otherwise(1 - distance(F.col("w_key"), c["key"]) / F.greatest(c["n"], m))
    judged = F.transform(F.array(F.struct(sure.alias("sure"))), lambda x: F.struct(x["sure"].alias("sure"), F.when(x["sure"].isNull(), similar).alias("similar")))
    # filtered in an array, as a filter of rows would move below the columns that it reads and make them once more
    met = F.filter(judged, lambda x: x["sure"].isNotNull() | (x["similar"] >= LEAST_SIMILAR))
    rows = tried.select("document_id", "page_no", *kept, "start", "size", "own", "w_raw", "c", F.explode(met).alias("x")).select("*", "x.*").drop("x")
    edges = {"b_x": F.array_min("own.x"), "b_y": F.array_min("own.y"), "b_right": F.array_max("own.right"), "b_bottom": F.array_max("own.bottom")}
    rows = rows.withColumns({name: rounded(edge) for name, edge in edges.items()})
    rows = rows.withColumns({"b_w": rounded(F.col("b_right") - F.col("b_x")), "b_h": rounded(F.col("b_bottom") - F.col("b_y"))})
    own = F.filter("centres", lambda l: l["field"] == F.col("c.field_path")) if "centres" in kept else None
    far = F.lit(None).cast("double") if own is None else F.array_min(F.transform(own, lambda l: F.abs(l["cy"] - F.col("mid_y")) * 3 + F.abs(l["cx"] - F.col("mid_x"))))
    rows = rows.withColumns({"mid_x": F.col("b_x") + F.col("b_w") / 2, "mid_y": F.col("b_y") + F.col("b_h") / 2}).withColumn("label_distance", far)
    method = F.when(F.col("sure") == 1.0, "exact").when(F.col("sure").isNotNull(), "normalized").otherwise("fuzzy")
    first = F.col("own")[0]
    return rows.select(
        "document_id", "page_no", "c.field_path", "c.row", "c.cell", "c.page", "c.ordinal", "start", (F.col("start") + F.col("size")).alias("end"),
        F.coalesce("sure", F.col("similar") * FUZZY_SHARE).alias("score"), method.alias("method"), F.col("w_raw").alias("matched_text"), first["line"].alias("line"), first["x"].alias("x"), F.struct(*(F.col(f"b_{c}").alias(c) for c in "xywh")).alias("box"), "label_distance",
    )


def label_phrases(labels: DataFrame) -> list[tuple[str, str]]:
    """Labels (field, label: a fixed list of some fifty) as field and phrase."""
    phrases = labels.select("field", text.normalize_words(F.col("label")).alias("phrase")).filter("phrase <> ''")
    return [(r.field, r.phrase) for r in phrases.collect()]


def label_norm(word: Column, phrases: list[tuple[str, str]]) -> Column:
    """The normal form of a token that may belong to a label, as far as labels need it: null where the token has a digit and no label does, which it keeps in any normal form."""
    plain = F.when(word.rlike(LETTERS), F.lower(word))
    return (plain if any(c.isdigit() for _, phrase in phrases for c in phrase) else plain.when(word.rlike(r"\d"), None)).otherwise(normal_form(word))


def centres(tokens: Column, phrases: list[tuple[str, str]]) -> Column:
    """Array of field, cx, cy: centres of the labels printed among tokens. Tokens are only followed where a label's first word stands."""
    by_word: dict[str, list[tuple[str, str]]] = {}
    for field, phrase in phrases:
        by_word.setdefault(phrase.split(" ")[0], []).append((field, phrase))
    none = F.array().cast("array<struct<field:string,phrase:string,n:int>>")
    named = lambda rows: F.array(*(F.struct(F.lit(field).alias("field"), F.lit(phrase).alias("phrase"), F.lit(phrase.count(" ") + 1).alias("n")) for field, phrase in rows))
    # the phrases are told by the word once it is known that one begins there: they stand in literals, which no token goes through
    of_word = lambda word: F.coalesce(*(F.when(word == first, named(rows)) for first, rows in by_word.items()), none)
    norm = lambda t: label_norm(t["text"], phrases)
    starts_ = F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("i"), first_word(norm(t)).alias("word"))), lambda b: b["word"].isin(*by_word))
    ahead = lambda b: F.transform(of_word(b["word"]), lambda p: F.struct(p["field"].alias("field"), p["phrase"].alias("phrase"), run_of(tokens, b["i"], p["n"]).alias("own")))
    # a token that no label has must not drop out of what is joined
    met = F.filter(F.flatten(F.transform(starts_, ahead)), lambda x: F.array_join(F.transform(x["own"], norm), " ", "0") == x["phrase"])
    boxed = F.transform(met, lambda x: F.struct(x["field"].alias("field"), box_of(x["own"]).alias("box")))
    return F.transform(boxed, lambda x: F.struct(x["field"].alias("field"), (x["box"]["x"] + x["box"]["w"] / 2).alias("cx"), (x["box"]["y"] + x["box"]["h"] / 2).alias("cy")))


def label_centres(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(document_id, page_no, field, cx, cy): centres of the labels (field, label: a fixed list) printed on pages."""
    return pages.select("document_id", "page_no", F.explode(centres(F.col("tokens"), label_phrases(labels))).alias("c")).select("document_id", "page_no", "c.*")


def matches(pages: DataFrame, values: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """All places of all values: score, method, box, line, and the distance to the field's nearest label (null without one)."""
    ready = with_wanted(pages, candidates(values))
    if labels is None:
        return scored(spelled(ready))
    return scored(spelled(ready.withColumn("centres", centres(F.col("tokens"), label_phrases(labels))), "centres"), "centres")


def label_table(spark) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame([(field, label) for field, names in LABELS.items() for label in names], "field string, label string")


def best_places(found: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """For each value by itself the best place: score, the preferred page, fewer tokens, a nearer label, then page order."""
    page = F.lit(None).cast("int")
    found = found.drop("page")
    if preferred is not None:
        found = found.join(preferred.select("document_id", "field_path", F.col("page").alias("preferred")), ["document_id", "field_path"], "left")
        page = F.col("preferred")
    order = Window.partitionBy("document_id", "field_path").orderBy(F.desc("score"), F.desc(F.coalesce(F.col("page_no") == page, F.lit(False))), F.col("end") - F.col("start"), F.col("label_distance").asc_nulls_last(), "page_no", "start", "ordinal")
    return found.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place", "preferred").withColumn("score", F.floor(F.col("score") * 1000 + 0.5) / 1000)


CELLS = ("quantity", "unitPrice", "amount")
PLACE = ("field_path", "row", "cell", "page", "ordinal", "page_no", "start", "end", "score", "method", "matched_text", "line", "x", "box")


def overlapping(one: Column, other: Column) -> Column:
    return (one["page_no"] == other["page_no"]) & (one["start"] < other["end"]) & (one["end"] > other["start"])


def preference(of: Callable[[str], Column], page: Column, *more: Column) -> Column:
    """What is least for the best place: score, the preferred page, fewer tokens, then further terms, page order."""
    return F.struct(-of("score"), ~F.coalesce(of("page_no") == page, F.lit(False)), of("end") - of("start"), *more, of("page_no"), of("start"), of("ordinal"))


def claimed(queue: Column) -> Column:
    """The places that fields get, of all places (turn, rank, p) of a document: in order of turn and rank, each field takes the first that shares no token with what was given."""
    none = F.transform(F.filter(queue, lambda x: F.lit(False)), lambda x: x["p"])

    def step(given: Column, x: Column) -> Column:
        served = F.coalesce(F.try_element_at(given, F.lit(-1))["field_path"] == x["p"]["field_path"], F.lit(False))
        return F.when(served | F.exists(given, lambda g: overlapping(g, x["p"])), given).otherwise(F.concat(given, F.array(x["p"])))

    return F.aggregate(F.sort_array(queue), none, step)


def drawn(rows: DataFrame) -> DataFrame:
    """Rows (cells: the places of one row's cells; described: that of its description or null) with `taken`: what they get, one after the other."""
    there = F.col("described").isNotNull()
    anchor = F.struct(F.col("described.page_no").alias("page"), F.col("described.line").alias("line"), F.col("described.end").alias("after"))
    none = F.filter("cells", lambda p: F.lit(False))
    rows = rows.select("*", F.when(there, anchor).alias("anchor"), F.when(there, F.array("described")).otherwise(none).alias("taken"))
    for step, cell in enumerate(CELLS):
        own = F.when(there, cell).otherwise(CELLS[-1 - step])
        anchor = F.col("anchor")
        able = F.filter("cells", lambda p: (p["cell"] == own) & ((p["cell"] != "quantity") | anchor.isNotNull()) & ~F.exists("taken", lambda t: overlapping(t, p)))  # noqa: B023

        def rank(p: Column) -> Column:
            here = F.coalesce(anchor["page"] == p["page_no"], F.lit(False))  # noqa: B023
            far = F.when(here, F.abs(p["line"] - anchor["line"]).cast("double")).otherwise(float("inf"))  # noqa: B023
            before = F.when(anchor["after"].isNotNull(), ~(here & (p["start"] >= anchor["after"]))).otherwise(False)  # noqa: B023
            return preference(lambda c: p[c], F.coalesce(p["page"], anchor["page"]), far, before, F.when(p["cell"] == "amount", -p["x"]).otherwise(p["x"]))  # noqa: B023

        rows = rows.withColumn("best", F.array_min(F.transform(able, lambda p: F.struct(rank(p).alias("rank"), p.alias("p"))))["p"])
        fixed = F.when(F.col("best").isNotNull(), F.struct(F.col("best.page_no").alias("page"), F.col("best.line").alias("line"), F.lit(None).cast("int").alias("after")))
        rows = rows.withColumns({"anchor": F.coalesce("anchor", fixed), "taken": F.when(F.col("best").isNull(), F.col("taken")).otherwise(F.concat("taken", F.array("best")))}).drop("best")
    return rows.drop("anchor")


def ground(pages: DataFrame, values: DataFrame, labels: DataFrame) -> DataFrame:
    """Grounds all values (document_id, field_path, kind, value, source_text, page) of all documents: one row for each that is found.

    Header fields claim their tokens in a fixed order, amounts first, and descriptions of line items in that of their rows.
    Then the cells of a row, which may only not share tokens within the row, are drawn to its description's line, amounts to the
    right and others to the left. Without a description the amount goes first, and whatever is found first fixes
    the row; a quantity is only looked for once something has. Nothing but pages and candidates is shuffled: the places of one
    document are claimed where its pages are.
    """
    found = matches(pages, values, labels)
    turns = F.create_map(*(F.lit(x) for i, name in enumerate(ORDER) for x in (name, i)))
    turn = F.when(F.col("row").isNull(), F.try_element_at(turns, F.col("field_path"))).when(F.col("cell") == "description", F.col("row"))
    label = F.when(F.col("row").isNull(), F.coalesce("label_distance", F.lit(float("inf")))).otherwise(0.0)
    rows = found.select("document_id", turn.alias("turn"), preference(F.col, F.col("page"), label).alias("rank"), F.struct(*PLACE).alias("p"))
    queue = lambda own: F.collect_list(F.when(own & F.col("turn").isNotNull(), F.struct("turn", "rank", "p")))
    of_row = F.col("p.row").isNotNull()
    all_ = rows.groupBy("document_id").agg(queue(~of_row).alias("header"), queue(of_row).alias("texts"), F.collect_list(F.when(of_row & F.col("p.cell").isin(*CELLS), F.col("p"))).alias("cells"))
    given = all_.select("document_id", "cells", claimed(F.col("header")).alias("header"), claimed(F.col("texts")).alias("texts"))
    own = lambda row: F.struct(F.filter("cells", lambda c: c["row"] == row).alias("cells"), F.get(F.filter("texts", lambda t: t["row"] == row), 0).alias("described"))
    lines = F.transform(F.array_distinct(F.transform(F.concat("texts", "cells"), lambda c: c["row"])), own)
    # the header is a row of its own, which has no cells
    whole = F.struct(F.filter("cells", lambda c: F.lit(False)).alias("cells"), F.get("header", 0).alias("described"))
    parts = given.select("document_id", "header", F.posexplode(F.concat(F.array(whole), lines)).alias("n", "x")).select("document_id", "n", F.when(F.col("n") == 0, F.col("header")).alias("header"), "x.cells", "x.described")
    places = drawn(parts).select("document_id", F.explode(F.coalesce("header", "taken")).alias("p"))
    score = F.floor(F.col("p.score") * 1000 + 0.5) / 1000
    return places.select("document_id", "p.field_path", F.col("p.page_no").alias("page"), "p.start", "p.end", score.alias("score"), "p.method", "p.matched_text", "p.line", *(F.col(f"p.box.{c}").alias(c) for c in "xywh"))


def count_values(values: DataFrame) -> DataFrame:
    return values.filter(F.col("value").isNotNull()).groupBy("document_id").agg(F.count("*").alias("n_values"))


assert set(ORDER) == set(FIELDS)
