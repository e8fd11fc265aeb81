"""Positioned tokens of pages: boxes, reading lines, and what kind of document they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.functions.text import SPACES, bound, strip

LEAST_READABLE, MOST_OCR_PAGES = 20, 5
BOX = "struct<text:string,x:double,y:double,w:double,h:double>"


def clamp(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def rounded(value: Column) -> Column:
    """To four decimals, halves upwards."""
    return F.floor(value * 10000 + 0.5) / 10000


def union_box(rows: DataFrame, *keys: str) -> DataFrame:
    """The box around the tokens of each key; edges are rounded before width and height are taken from them."""
    edges = rows.groupBy(*keys).agg(rounded(F.min("x")).alias("x"), rounded(F.min("y")).alias("y"), rounded(F.max(F.col("x") + F.col("w"))).alias("right"), rounded(F.max(F.col("y") + F.col("h"))).alias("bottom"))
    return edges.select(*keys, "x", "y", rounded(F.col("right") - F.col("x")).alias("w"), rounded(F.col("bottom") - F.col("y")).alias("h"))


def box_of(tokens: Column) -> Column:
    """The same for an array of tokens, as STRUCT<x, y, w, h>."""
    least = lambda c: rounded(F.array_min(F.transform(tokens, lambda t: t[c])))
    most = lambda c, size: rounded(F.array_max(F.transform(tokens, lambda t: t[c] + t[size])))
    x, y, right, bottom = least("x"), least("y"), most("x", "w"), most("y", "h")
    return F.struct(x.alias("x"), y.alias("y"), rounded(right - x).alias("w"), rounded(bottom - y).alias("h"))


def readable(tokens: Column) -> Column:
    """How many tokens have a letter or digit."""
    return F.size(F.filter(tokens, lambda t: t["text"].rlike(r"[\p{L}\p{N}]")))


def run_of(items: Column, start: Column, size: Column) -> Column:
    """Some elements from a place (from 0) on; reads these only, where a slice would go through the whole array each time."""
    return F.filter(F.transform(F.sequence(start, start + size - 1), lambda i: F.get(items, i)), lambda t: t.isNotNull())


def assign_lines(tokens: Column) -> Column:
    """Tokens (text, x, y, w, h) with the line that they stand on, in reading order.

    By their lower edges, then x, each token goes on the line of the one before unless its edge is further from that of the
    line's first token than half the taller of both. The anchor moves with the lines, so this is a fold and not a window; it
    keeps only where each line begins, so that no token is copied for those after it.
    """
    sorted_ = F.sort_array(F.transform(tokens, lambda t, i: F.struct((t["y"] + t["h"]).alias("base"), t["x"].alias("x"), i.alias("i"), t.alias("t"))))
    start = F.struct(F.lit(None).cast("double").alias("base"), F.lit(0.0).alias("h"), F.array().cast("array<int>").alias("begins"), F.lit(0).alias("n"))

    def step(state: Column, token: Column) -> Column:
        new = state["base"].isNull() | (F.abs(token["base"] - state["base"]) > F.greatest(token["t"]["h"], state["h"]) * 0.5)
        begins = F.when(new, F.concat(state["begins"], F.array(state["n"]))).otherwise(state["begins"])
        return F.struct(F.when(new, token["base"]).otherwise(state["base"]).alias("base"), F.when(new, token["t"]["h"]).otherwise(state["h"]).alias("h"), begins.alias("begins"), (state["n"] + 1).alias("n"))

    def placed(all_: Column, begins: Column) -> Column:
        def row(begin: Column, line: Column) -> Column:
            end = F.coalesce(F.get(begins, line + 1), F.size(all_))
            own = F.sort_array(F.transform(run_of(all_, begin, end - begin), lambda t, i: F.struct(t["x"].alias("x"), i.alias("i"), t["t"].cast(BOX).alias("t"))))
            return F.transform(own, lambda p: F.struct(*(p["t"][c].alias(c) for c in ("text", "x", "y", "w", "h")), line.alias("line")))

        return F.flatten(F.transform(begins, row))

    # sort_array, as array_sort interprets a comparison for each pair of tokens
    # an array of one element names what is used more than once, so that it is made once
    folded = F.transform(F.array(sorted_), lambda all_: F.struct(all_.alias("all"), F.aggregate(all_, start, step)["begins"].alias("begins")))
    return F.transform(folded, lambda x: placed(x["all"], x["begins"]))[0]


def prefix_sums(values: Column) -> Column:
    """For each value the sum of those before it. Sums of one, two, four and so on are added up, so that no value is added for each later one."""
    n = F.size(values)
    reach = lambda k: F.least(F.pow(F.lit(2), k).cast("int"), n)
    moved = lambda sums, by: F.concat(F.array_repeat(F.lit(0), by), F.slice(sums, F.lit(1), F.greatest(n - by, F.lit(0))))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int"))
    return F.aggregate(steps, moved(values, F.least(F.lit(1), n)), lambda sums, k: F.zip_with(sums, moved(sums, reach(k)), lambda a, b: a + b))


def words_of_item(text: Column, box: Column) -> Column:
    """Tokens of one printed item (box: x, y, w, h as fractions of the page): each word takes its share of the width by characters."""
    word = lambda p: F.regexp_replace(p, f"[{SPACES}]+", "")
    none = F.array().cast(f"array<{BOX}>")

    def item(known: Column) -> Column:
        x, y, w, h = (known["box"][c] for c in "xywh")

        def token(p: Column) -> Column:
            left = clamp(x + w * p["before"] / known["length"])
            right = clamp(x + w * (p["before"] + F.length(p["word"])) / known["length"])
            top, bottom = clamp(y), clamp(y + h)
            return F.struct(p["word"].alias("text"), left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h"))

        # a piece that has a word begins with it: blanks at the start of the text are a piece of their own, which is dropped
        words = F.zip_with(known["pieces"], prefix_sums(known["sizes"]), lambda p, before: F.struct(word(p).alias("word"), before.alias("before")))
        kept = F.transform(F.filter(words, lambda p: p["word"] != ""), token)
        return F.when(known["blank"] | (w <= 0) | (h <= 0), none).otherwise(kept.cast(f"array<{BOX}>"))

    # what is used for each word is made once
    cut = lambda t: F.struct(F.split(t, f"(?<=[{SPACES}])(?=[^{SPACES}])").alias("pieces"), F.length(t).alias("length"), (strip(t) == "").alias("blank"))
    sized = lambda c: F.struct(c["pieces"].alias("pieces"), F.transform(c["pieces"], F.length).alias("sizes"), c["length"].alias("length"), c["blank"].alias("blank"), box.alias("box"))
    return bound(bound(bound(text, cut), sized), item)


def ocr_pages(blocks: DataFrame) -> DataFrame:
    """Pages (document_id, page_no, width, height, words: array of text, confidence, x0, y0, x1, y1) as tokens on lines with their mean confidence."""
    words = F.filter("words", lambda w: strip(w["text"]) != "")
    edge = lambda w, c, size: clamp(w[c] / F.col(size))
    token = lambda w: F.struct(strip(w["text"]).alias("text"), edge(w, "x0", "width").alias("x"), edge(w, "y0", "height").alias("y"), (edge(w, "x1", "width") - edge(w, "x0", "width")).alias("w"), (edge(w, "y1", "height") - edge(w, "y0", "height")).alias("h"))
    mean = F.when(F.size(words) == 0, 0.0).otherwise(F.aggregate(words, F.lit(0.0), lambda n, w: n + w["confidence"] / 100) / F.size(words))
    return blocks.select("document_id", "page_no", assign_lines(F.transform(words, token)).alias("tokens"), mean.alias("ocr_mean_confidence"))


def text_pages(texts: DataFrame) -> DataFrame:
    """Pages out of plain text (document_id, page_no, text): a line for each line, a token of fixed size for each word."""
    line = lambda row, n: F.transform(F.filter(F.split(row, " "), lambda w: w != ""), lambda w, i: F.struct(w.alias("text"), (i * 0.1).alias("x"), (n * 0.05).alias("y"), F.lit(0.08).alias("w"), F.lit(0.02).alias("h"), n.alias("line")))
    return texts.select("document_id", "page_no", F.flatten(F.transform(F.split(F.col("text"), "\n"), line)).alias("tokens"))


def document_kinds(pages: DataFrame) -> DataFrame:
    """Of each document (pages: document_id, mime, tokens, has_image): pdf_scan if more pages are images than text, pdf_text, or image."""
    rows = pages.withColumn("text_page", readable(F.col("tokens")) >= LEAST_READABLE)
    counts = rows.groupBy("document_id").agg(F.first("mime").alias("mime"), F.sum(F.col("text_page").cast("bigint")).alias("text_pages"), F.sum((~F.col("text_page") & F.col("has_image")).cast("bigint")).alias("image_pages"))
    return counts.withColumn("kind", F.when(F.col("mime") != "application/pdf", "image").when(F.col("image_pages") > F.col("text_pages"), "pdf_scan").otherwise("pdf_text"))


def pages_to_read(pages: DataFrame) -> DataFrame:
    """The first five pages of each document that OCR has to read."""
    rows = pages.filter((readable(F.col("tokens")) < LEAST_READABLE) & F.col("has_image"))
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy("document_id").orderBy("page_no"))).filter(F.col("turn") <= MOST_OCR_PAGES).drop("turn")
