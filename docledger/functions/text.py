"""Text functions: normal forms for comparing printed and extracted values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the values' producers see it: ASCII and Unicode spaces, the BOM included.
SPACES = "\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
#: Printed currency marks and the ISO codes that read as one.
MARKS = "$€£₹¥"
CODES = ("usd", "eur", "gbp", "inr", "jpy", "aud", "cad", "chf", "sgd", "aed")
#: Legal forms that do not tell vendors apart.
LEGAL_FORMS = (
    "inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "gmbh", "pvt", "private",
    "plc", "sa", "ag", "bv", "srl", "sarl", "pty", "llp", "lp",
)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """A body in which a value stands many times, but is computed once; keeps generated code small."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")


def collapse(text: Column) -> Column:
    """Trims, and makes each run of white space one space."""
    return F.when(text.rlike(f"[{SPACES}]"), F.regexp_replace(strip(text), f"[{SPACES}]+", " ")).otherwise(text)


def is_money_shaped(text: Column) -> Column:
    """Whether a string reads as an amount: a digit, no percent sign, and a currency mark, a separator between digits or two decimals at the end."""
    amount = text.rlike(rf"[{MARKS}]|\d[.,']\d|[.,]\d{{2}}\D*\z")
    return text.rlike(r"\d") & ~text.contains("%") & amount


def normalize_text(text: Column) -> Column:
    """An amount in plain decimals; other text in lower case, with marks and punctuation as single spaces."""
    # letters alone and digits alone, as most words are, need not be read
    return F.when(is_plain(text), F.lower(text)).otherwise(bound(strip(text), normalize_stripped))


def is_plain(text: Column) -> Column:
    return text.rlike(r"^(?:[A-Za-z]+|[0-9]+)\z")


def normalize_stripped(text: Column) -> Column:
    """`normalize_text` of text without spaces around it."""
    from docledger.functions.money import parse_money

    return F.coalesce(F.when(is_money_shaped(text), parse_money(text).cast("string")), bare_words(text))


def bare_words(text: Column) -> Column:
    """Letters and digits in lower case, all between them as single spaces; marks are neither."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def normalize_words(text: Column) -> Column:
    """`normalize_text` word by word; words of which nothing is left drop out."""
    return F.array_join(F.filter(F.transform(F.split(text, f"[{SPACES}]+"), normalize_text), lambda x: x != ""), " ")


def fuzzy_key(text: Column) -> Column:
    """Lower case without currency codes, white space and currency marks."""
    key = F.regexp_replace(F.regexp_replace(F.lower(text), rf"\b(?:{'|'.join(CODES)})\b", ""), f"[{SPACES}{MARKS}]", "")
    return F.when(text.rlike(r"^[0-9.,]+\z"), text).otherwise(key)


def vendor_key(name: Column) -> Column:
    """A vendor's name in lower case without punctuation and without legal forms at its end; the first word always stays."""
    words = F.trim(F.regexp_replace(F.lower(name), rf"[^\p{{L}}\p{{N}}]+", " "))
    return F.regexp_replace(words, rf"( (?:{'|'.join(LEGAL_FORMS)}))+$", "")


def sanitize_filename(name: Column) -> Column:
    """The last part of a path without control characters, at most 120 characters with its extension; `document` if nothing is left."""
    base = F.trim(F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"[\x00-\x1f\x7f]", ""))
    extension = F.regexp_extract(base, r"(\.[^.]+)$", 1)
    short = F.when(F.length(base) <= 120, base).otherwise(F.concat(F.substring(base, F.lit(1), F.greatest(F.lit(0), F.lit(120) - F.length(extension))), extension))
    return F.when(F.coalesce(F.length(short), F.lit(0)) == 0, F.lit("document")).otherwise(short)


def list_words(words: Column) -> Column:
    """`a`, `a and b`, `a, b and c`."""
    many = F.concat(F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(words, -1))
    return F.when(F.size(words) < 2, F.array_join(words, "")).otherwise(many)


def format_bytes(size: Column) -> Column:
    kib = size / 1024
    return F.when(size < 1024, F.format_string("%d B", size)).when(kib < 1024, F.format_string("%.0f KB", kib)).otherwise(F.format_string("%.1f MB", kib / 1024))


def trim_zeros(decimal: Column) -> Column:
    """Drops zeros at the end of a fraction only: 38.5000 is 38.5, 100 stays 100."""
    return F.when(decimal.contains("."), F.rtrim(F.rtrim(decimal, F.lit("0")), F.lit("."))).otherwise(decimal)


def search_tokens(text: Column) -> Column:
    """Distinct words for full-text search: runs of letters and digits in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1))


def matches_all(tokens: Column, query: Column) -> Column:
    """Whether a document's search tokens hold every word of a query; a query without words matches nothing."""
    wanted = search_tokens(query)
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, tokens)) == 0)


def comparable(kind: str, value: Column) -> Column:
    """What tells printed values apart: as amounts, as decimals, or as text in any case; and whether there is one at all."""
    from docledger.functions.money import parse_decimal, parse_money

    read = {"money": parse_money, "decimal": parse_decimal}.get(kind, lambda x: F.lower(strip(x)))
    return F.struct(value.isNull().alias("missing"), read(value).alias("value"))


def same_value(kind: str, expected: Column, actual: Column) -> Column:
    """Whether two printed values agree; null only with null."""
    return comparable(kind, expected).eqNullSafe(comparable(kind, actual))


def luminance(colour: Column) -> Column:
    """Relative luminance of #rrggbb."""
    channel = lambda at: F.conv(F.substring(colour, at, 2), 16, 10).cast("double") / 255
    linear = lambda c: F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))
    return 0.2126 * linear(channel(2)) + 0.7152 * linear(channel(4)) + 0.0722 * linear(channel(6))


def contrast_ratio(one: Column, other: Column) -> Column:
    a, b = luminance(one), luminance(other)
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)
