"""Dates in text, and dates of feeds."""

from __future__ import annotations

import datetime
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: English and German month names by their first letters, in the order of the year.
MONTHS = ["jan", "feb", "mar|mär", "apr", "may|mai", "jun", "jul", "aug", "sep", "oct|okt", "nov", "dec|dez"]
_NAMES = "|".join(MONTHS)
#: One separator, the same twice, and no digit around.
_SEP = r"(?:{0}[.]{1}[.]{2}|{0}-{1}-{2}|{0}/{1}/{2}|{0}\s{1}\s{2})"
_YEAR_LAST = r"(?<!\d)" + _SEP.format(r"\d{1,2}", r"\d{1,2}", r"\d{4}") + r"(?!\d)"
_YEAR_FIRST = r"(?<!\d)" + _SEP.format(r"\d{4}", r"\d{1,2}", r"\d{1,2}") + r"(?!\d)"
_MONTH_FIRST = rf"(?i)\b(?:{_NAMES})\pL*\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}(?!\d)"
_DAY_FIRST = rf"(?i)(?<!\d)\d{{1,2}}(?:st|nd|rd|th|\.)?\s+(?:{_NAMES})\pL*\.?,?\s+\d{{4}}(?!\d)"
ANY = "|".join(f"(?:{p})" for p in (_YEAR_FIRST, _YEAR_LAST, _MONTH_FIRST, _DAY_FIRST))


def month_number(name: Column) -> Column:
    """1 to 12 by the name's first letters, else null."""
    out = F.lit(None).cast("int")
    for k, letters in enumerate(MONTHS, 1):
        out = F.when(F.lower(name).rlike(f"^(?:{letters})"), k).otherwise(out)
    return out


def _made(year: Column, month: Column, day: Column, least: int) -> Column:
    date = F.try_to_date(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")
    return F.when((F.year(date) >= least) & (F.year(date) <= F.year(F.current_date())), date)


def to_date(found: Column, least: int = 2005) -> Column:
    """The date of one place that ``ANY`` matches: y/m/d, month name, d/m/y or, where that is none, m/d/y; null if it is
    no date or not of the years from ``least`` to this one."""
    number = lambda k: F.element_at(F.regexp_extract_all(found, F.lit(r"(\d+)"), F.lit(1)), k)
    name = F.regexp_extract(found, rf"(?i)\b((?:{_NAMES})\pL*)", 1)
    day, year = number(1), number(-1)
    first = F.length(number(1)) == 4
    numbers = F.coalesce(_made(year, number(2), day, least), _made(year, day, number(2), least))
    return F.when(name != "", _made(year, month_number(name), day, least)).when(first, _made(day, number(2), number(3), least)).otherwise(numbers)


def dates_in(text: Column, least: int = 2005) -> Column:
    """All dates of a text in order."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1)), lambda d: to_date(d, least)), lambda d: d.isNotNull())


def first_date(text: Column, least: int = 2005) -> Column:
    return F.get(dates_in(text, least), F.lit(0))


#: Formats of feeds, in the order they are tried: W3C and ISO 8601, RFC 822, database and national ones.
FEED_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd HH:mm:ss", "yyyyMMdd'T'HHmmss", "yyyy-MM-dd", "yyyyMMdd", "yyyy-MM", "yyyy",
    "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMM yyyy",
]
#: Month names of Greek and Hungarian feeds.
GREEK = ["Ιαν", "Φεβ", "Μάρ", "Απρ", "Μάι", "Ιούν", "Ιούλ", "Αύγ", "Σεπ", "Οκτ", "Νοέ", "Δεκ"]
HUNGARIAN = ["január", "február", "március", "április", "május", "június", "július", "augusztus", "szeptember", "október", "november", "december"]
_ENGLISH = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def feed_date(text: Column) -> Column:
    """The timestamp (UTC) of a feed's date, by the first format that fits; else null."""
    tidy = F.trim(text)
    tidy = F.regexp_replace(tidy, r"^\pL+\.?,\s*", "")  # day of the week
    tidy = F.regexp_replace(tidy, r"^(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일.*?(\d{1,2}):(\d{2}):(\d{2}).*$", "$1-$2-$3 $4:$5:$6")
    for k, (greek, english) in enumerate(zip(GREEK, _ENGLISH)):
        tidy = F.regexp_replace(tidy, rf"(\d)\s+{greek}\pL*\s+(\d)", f"$1 {english} $2")
        tidy = F.regexp_replace(tidy, rf"^(\d{{4}})-{HUNGARIAN[k]}-(\d{{1,2}})", f"$1-{k + 1:02d}-$2")
    tidy = F.regexp_replace(tidy, r"^(\d{4})-(\d)-(\d)\b", "$1-0$2-0$3")
    tidy = F.regexp_replace(F.regexp_replace(tidy, r"^(\d{4})-(\d)-", "$1-0$2-"), r"^(\d{4}-\d{2})-(\d)(?=\D|$)", "$1-0$2")
    tidy = F.regexp_replace(F.regexp_replace(tidy, r"T(\d):", "T0$1:"), r"\b(GMT|UT|UTC)$", "+0000")
    return F.coalesce(*[F.try_to_timestamp(tidy, F.lit(f)) for f in FEED_FORMATS])


_WORDY, _DIGITS = re.compile(ANY.replace(r"\pL", r"[^\W\d_]").replace("(?i)", ""), re.I), re.compile(r"\d+")


def parse_date(text: str, least: int = 2005) -> datetime.date | None:
    """The first date in a text, as ``first_date`` finds it."""
    for m in _WORDY.finditer(text):
        found, numbers = m[0], [int(x) for x in _DIGITS.findall(m[0])]
        name = re.search(rf"(?i)\b({_NAMES})", found)
        if name:
            tries = [(numbers[1], next(k for k, p in enumerate(MONTHS, 1) if re.match(p, name[0].lower())), numbers[0])]
        elif numbers[0] > 999:
            tries = [tuple(numbers)]
        else:
            tries = [(numbers[2], numbers[1], numbers[0]), (numbers[2], numbers[0], numbers[1])]
        for y, month, day in tries:
            try:
                date = datetime.date(y, month, day)
            except ValueError:
                continue
            if least <= y <= datetime.date.today().year:
                return date
    return None


def nearest_date(nodes: list[str], at: int, most_nodes: int = 20, most_chars: int = 400) -> datetime.date | None:
    """The first date of the nearest of up to most_nodes text nodes from that at ``at`` backwards.

    Of a node the first most_chars characters count, and only if it has a digit and more than 6 characters.
    """
    for node in reversed(nodes[max(0, at - most_nodes) : at + 1]):
        if len(node) > 6 and any(c.isdigit() for c in node) and (found := parse_date(node[:most_chars])):
            return found
    return None


def fragment_dates(nodes: Column, term: str, most_nodes: int = 20) -> Column:
    """fragment, date (null if none) of each text node that holds the term in any case."""

    def run(pages: pd.Series) -> pd.Series:
        low = term.lower()
        return pages.map(lambda ns: [{"fragment": n, "date": nearest_date(list(ns), i, most_nodes)} for i, n in enumerate(ns) if low in n.lower()])

    return F.pandas_udf(run, "array<struct<fragment: string, date: date>>")(nodes)
