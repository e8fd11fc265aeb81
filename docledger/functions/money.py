"""Amounts as they are printed: locale-aware parsing into decimals, exact arithmetic in cents, digit swaps."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.text import CODES, MARKS, SPACES, bound

MONEY, EXACT = "decimal(18,2)", "decimal(18,4)"


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"(?i)[{MARKS}]|\b(?:{'|'.join(CODES)})\b", ""), f"[{SPACES}']+", "")


def _is_alone(text: Column) -> Column:
    """Digits and separators alone have nothing to take off."""
    return text.rlike(r"^[\d.,]*\z")


def _negative(bare: Column) -> Column:
    return bare.rlike(r"(?i)^\(.*\)$|^-|-$|cr$")


def _plain(bare: Column) -> Column:
    return F.regexp_replace(bare, r"[^\d.,]", "")


def _digits(plain: Column) -> Column:
    return F.replace(F.replace(plain, F.lit(","), F.lit("")), F.lit("."), F.lit(""))


def _fraction(plain: Column) -> Column:
    """What is behind the last separator; all, if there is none."""
    return F.substring_index(F.replace(plain, F.lit(","), F.lit(".")), ".", -1)


def _point(plain: Column, digits: Column, fraction: Column) -> Column:
    grouped = (F.length(fraction) == 3) & plain.rlike(r"^[1-9][\d,]*,\d{3}\z|^[1-9][\d.]*\.\d{3}\z")
    point = F.concat(F.substring(digits, F.lit(1), F.length(digits) - F.length(fraction)), F.lit("."), fraction)
    return F.when((F.length(plain) == F.length(digits)) | grouped, digits).otherwise(point)


def split_decimal(text: Column) -> Column:
    """STRUCT<negative, digits> of a printed number, digits with at most a dot as its decimal point; null without a digit.

    Brackets, a minus at either end and CR at the end make it negative, once. With both separators the later one is the
    decimal point. One kind of separator whose last group has three digits, behind a first digit that is not 0, groups
    thousands; otherwise its last occurrence is the decimal point.
    """

    def cut(bare: Column) -> Column:
        return F.struct(_negative(bare).alias("negative"), _plain(bare).alias("plain"))

    def pointed(x: Column) -> Column:
        return F.struct(x["negative"].alias("negative"), x["plain"].alias("plain"), _digits(x["plain"]).alias("digits"), _fraction(x["plain"]).alias("fraction"))

    def read(x: Column) -> Column:
        return F.when(x["digits"] != "", F.struct(x["negative"].alias("negative"), _point(x["plain"], x["digits"], x["fraction"]).alias("digits")))

    alone = F.struct(F.lit(False).alias("negative"), text.alias("plain"))
    return bound(bound(F.when(_is_alone(text), alone).otherwise(bound(_bare(text), cut)), pointed), read)


def _value(negative: Column, digits: Column, kind: str) -> Column:
    amount = F.concat(F.lit("0"), digits).try_cast(kind)  # rounds half up, null where it does not fit
    return F.when(negative, -amount).otherwise(amount).cast(kind)


def _parsed(text: Column, kind: str) -> Column:
    return bound(split_decimal(text), lambda parts: _value(parts["negative"], parts["digits"], kind))


def with_money(rows: DataFrame, source: str, where: Column, name: str) -> DataFrame:
    """Rows with `parse_money` of a column where a condition holds, else null. A column for each step, so that all of it is compiled, which `bound` is not."""
    own = lambda step: f"_{name}_{step}"
    text, alone, bare, plain, digits, fraction = (F.col(own(step)) for step in ("text", "alone", "bare", "plain", "digits", "fraction"))
    for step, value in (
        ("text", F.when(where, F.col(source))),
        ("alone", _is_alone(text)),
        ("bare", F.when(alone, text).otherwise(_bare(text))),
        ("plain", F.when(alone, bare).otherwise(_plain(bare))),
        ("digits", _digits(plain)),
        ("fraction", _fraction(plain)),
    ):
        rows = rows.withColumn(own(step), value)
    amount = F.when(digits != "", _value(~alone & _negative(bare), _point(plain, digits, fraction), MONEY))
    return rows.withColumn(name, amount).drop(*(own(step) for step in ("text", "alone", "bare", "plain", "digits", "fraction")))


def parse_money(text: Column) -> Column:
    """A printed amount to two decimals, rounded half up by magnitude; null if it has no digit or does not fit."""
    return _parsed(text, MONEY)


def parse_decimal(text: Column) -> Column:
    """A printed number to four decimals."""
    return _parsed(text, EXACT)


def to_cents(amount: Column) -> Column:
    return (amount.cast(MONEY) * 100).cast("bigint")


def from_cents(cents: Column) -> Column:
    # a product is exact, and cheaper than the quotient of decimals
    return (cents.cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def times(quantity: Column, price: Column) -> Column:
    """Quantity times unit price, four decimals each, rounded to cents away from zero."""
    return F.round(quantity.cast(EXACT) * price.cast(EXACT), 2).cast(MONEY)


def digit_swaps(printed: Column) -> Column:
    """All strings that come of swapping two neighbouring, different digits, without those that get a leading zero."""
    at = F.sequence(F.lit(1), F.greatest(F.length(printed) - 1, F.lit(1)))
    one, two = (lambda i: F.substring(printed, i, F.lit(1))), (lambda i: F.substring(printed, i + 1, F.lit(1)))
    swap = lambda i: F.concat(F.substring(printed, F.lit(1), i - 1), two(i), one(i), F.substring(printed, i + 2, F.length(printed)))
    places = F.filter(at, lambda i: one(i).rlike("[0-9]") & two(i).rlike("[0-9]") & (one(i) != two(i)))
    return F.array_distinct(F.filter(F.transform(places, swap), lambda x: ~x.rlike(r"^-?0\d")))


def is_digit_swap(actual: Column, expected: Column) -> Column:
    one, other = actual.cast("string"), expected.cast("string")
    # a swap of two different digits is two replacements; few pairs get beyond this
    near = (F.length(one) == F.length(other)) & (F.levenshtein(one, other, 2) == 2)
    return F.coalesce(F.when(near, F.array_contains(digit_swaps(one), other)).otherwise(False), F.lit(False))
