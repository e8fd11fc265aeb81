"""Printed dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions.text import SPACES, bound, collapse

#: English month names and their short forms.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6,
    "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}


def _date(year: Column, month: Column, day: Column) -> Column:
    """A calendar date from 1900 to 2200, else null; the parts as text."""
    out = F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0")).try_cast("date")
    return F.when(year.between("1900", "2200"), out)


def month_number(word: Column) -> Column:
    names = F.create_map(*(F.lit(x) for name, n in MONTHS.items() for x in (name, str(n))))
    return F.try_element_at(names, F.lower(word))


def parse_date(text: Column, month_first: Column | bool = False) -> Column:
    """A printed date: year first, day or month first (the hint decides only where both are possible), or with an English month name.

    The text is cut into pieces, and each piece named by what it can be: Y a year, n a day or month, w a word. The row of
    names and what stands between the pieces tell which format it is.
    """
    hint = F.lit(month_first) if isinstance(month_first, bool) else month_first
    printed = collapse(F.regexp_replace(F.regexp_replace(text, r"(?i)(\d)(?:st|nd|rd|th)\b", "$1"), ",", " "))
    name = lambda p: F.when(p.rlike(r"^\d{4}$"), "Y").when(p.rlike(r"^\d{1,2}$"), "n").when(p.rlike("^[A-Za-z]+$"), "w").otherwise("?")

    def read(x: Column) -> Column:
        a, b, c = (F.get(x["pieces"], i) for i in range(3))
        row, spaced = x["row"], x["printed"].rlike("^[^ ]+ [^ ]+ [^ ]+$")
        tight, one, two = ~x["printed"].contains(" "), a.try_cast("int"), b.try_cast("int")
        month_leads = (two > 12) | (hint & (one <= 12))
        return (
            F.when((row == "wnY") & spaced, _date(c, month_number(a), b))
            .when((row == "nwY") & spaced, _date(c, month_number(b), a))
            .when((row == "Ynn") & tight, _date(a, b, c))
            .when((row == "nnY") & tight & month_leads, _date(c, a, b))
            .when((row == "nnY") & tight, _date(c, b, a))
        )

    # three pieces, of which one is a year of four digits: most strings are none of that
    gap = f"[-/.,{SPACES}]"
    likely = text.rlike(r"\d{4}") & text.rlike(f"^{gap}*[^{gap[1:]}+(?:{gap}+[^{gap[1:]}+){{2}}{gap}*$")
    row = lambda p: F.concat(*(name(F.get(p, i)) for i in range(3)))
    named = lambda x: F.struct(x["printed"].alias("printed"), x["pieces"].alias("pieces"), F.when(F.size(x["pieces"]) == 3, row(x["pieces"])).alias("row"))
    cut = bound(printed, lambda p: F.struct(p.alias("printed"), F.split(p, "[-/. ]").alias("pieces")))
    return F.when(likely, bound(bound(cut, named), read))


def is_iso_date(text: Column) -> Column:
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & _date(F.substring(text, 1, 4), F.substring(text, 6, 2), F.substring(text, 9, 2)).isNotNull()


def date_equals(one: Column, other: Column) -> Column:
    return F.coalesce(parse_date(one) == parse_date(other), F.lit(False))


def draft_date(text: Column) -> Column:
    """The date of a value that has the shape of an ISO date; one that is not in the calendar is null, and so is reported as missing."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
