"""Months as ordinals (year * 12 + month), dates, labels and names."""

from __future__ import annotations

import calendar
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.cleaning import stripped

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def ordinal(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def ordinal_year(o: Column) -> Column:
    return F.floor((o - 1) / 12).cast("int")


def ordinal_month(o: Column) -> Column:
    return ((o - 1) % 12 + 1).cast("int")


def ordinal_date(o: Column) -> Column:
    return F.make_date(ordinal_year(o), ordinal_month(o), F.lit(1))


def ordinal_label(o: Column) -> Column:
    """yyyy-MM"""
    return F.format_string("%04d-%02d", ordinal_year(o), ordinal_month(o))


def name_number(name: Column) -> Column:
    """1 to 12 of an abbreviation as in MONTHS."""
    return F.try_element_at(F.create_map(*chain.from_iterable((F.lit(m), F.lit(k)) for k, m in enumerate(MONTHS, 1))), name)


#: Each way to write a month's name -> its number; "sept" is usual too.
_NAMES = {name.lower(): k for names in (calendar.month_name, calendar.month_abbr) for k, name in enumerate(names) if name} | {"sept": 9}
_NAME = "(" + "|".join(sorted(_NAMES, key=len, reverse=True)) + ")"
#: What goes before a date's shape is looked at: a day of the week at the begin, a time at the end.
_AROUND = r"^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+|(?:t|\s+)\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:[ap]m)?\s*(?:z|utc|gmt|[+-]\d{2}:?\d{2})?$|(?<=\d{8})t\d{4,6}$"
_DAY, _BETWEEN, _NAMED = r"(\d{1,2})(?:st|nd|rd|th)?", "[-/., ]*", r"~(\d{1,2})~"
#: Shape of a date -> the date; a name stands as ~number~. In turn: year first; compact digits; month before day, unless
#: only the second can be a month; year and month; a year alone; names. YY is a year of four digits or of two.
_SHAPES = (
    (r"(\d{4})[-/. ](\d{1,2})[-/. ](\d{1,2})", "$1-$2-$3"),
    (r"(\d{4})(\d\d)(\d\d)", "$1-$2-$3"),
    (r"(\d\d)(\d\d)(\d\d)", "20$1-$2-$3"),
    (r"(0?[1-9]|1[0-2])[-/. ](\d{1,2})[-/. ]YY", "$3-$1-$2"),
    (r"(1[3-9]|2\d|3[01])[-/. ](\d{1,2})[-/. ]YY", "$3-$2-$1"),
    (r"(\d{4})[-/](\d{1,2})", "$1-$2-1"),
    (r"(\d{1,2})[-/](\d{4})", "$2-$1-1"),
    (r"(\d{4})", "$1-1-1"),
    (rf"{_DAY}[-/. ]*{_NAMED}{_BETWEEN}YY", "$3-$2-$1"),
    (rf"{_NAMED}[-/. ]*{_DAY}[-/., ]+YY", "$3-$1-$2"),
    (rf"{_NAMED}{_BETWEEN}(\d{{4}})", "$2-$1-1"),
    (rf"(\d{{4}}){_BETWEEN}{_NAMED}", "$1-$2-1"),
    (rf"(\d{{4}})[-/. ]{_NAMED}[-/. ](\d{{1,2}})", "$1-$2-$3"),
)


def _month_of_date(text: Column) -> Column:
    """The month of a lower-case text that has one of _SHAPES, if that date exists; else null. Each shape rewrites the
    text, if it fits, to the date and a mark that no later shape fits."""
    number = F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(f"~{v}~")) for k, v in _NAMES.items())), F.regexp_extract(text, f"(?<![a-z]){_NAME}(?![a-z])", 1))
    date = F.when(number.isNotNull(), F.regexp_replace(text, F.lit(f"(?<![a-z]){_NAME}(?![a-z])"), number)).otherwise(text)
    for shape, to in _SHAPES:
        years = ((r"(\d{4})", "$3"), (r"(\d\d)", "20$3")) if "YY" in shape else (("", ""),)
        for year, becomes in years:
            date = F.regexp_replace(date, f"^{shape.replace('YY', year)}$", (to.replace("$3", becomes) if becomes else to) + ";")
    return F.month(F.regexp_extract(date, "^(.*);$", 1).try_cast("date"))


def abbreviation(label: Column) -> Column:
    """The month that a label names: a number 1 to 12, a date of any of _SHAPES, or a name of which the first three
    letters tell. Days that don't exist (31 April) name none."""
    text = F.lower(stripped(label))
    n = F.when(text.rlike(r"^\d{1,2}(\.0+)?$"), text.try_cast("double").cast("int"))
    date = F.regexp_replace(F.regexp_replace(text, _AROUND, ""), r"^\s+|\s+$", "")
    quarter = F.regexp_extract(text, r"^\d{4}q([1-4])$", 1).try_cast("int") * 3 - 2
    of = F.array(*map(F.lit, MONTHS))
    at = F.coalesce(F.when(n.between(1, 12), n), _month_of_date(date), quarter)
    short = F.initcap(F.left(text, F.lit(3)))
    return F.coalesce(F.get(of, at - 1), F.when(short.isin(*MONTHS), short))
