"""Fuzzy valid time as column expressions.

A missing bound is unknown, and an unknown bound rules nothing out: it satisfies
``possibly_active`` and never ``certainly_active``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimgraph.schema import BOUNDS, DATE_CODES, EARLIEST_DATE, LATEST_DATE

DATE_FORM = r"^-?\d{1,6}-\d{2}-\d{2}$"
YEAR_FORM = r"^-?\d{1,6}$"


def _columns(names) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def _date(value) -> Column:
    return F.lit(value).cast("date") if isinstance(value, str) else value


def expand_date_text(value: str | None, is_end: bool) -> str | None:
    """A bare year becomes its first or last day; any other form is an error."""
    if value is None or not value.strip():
        return None
    value = value.strip()
    if re.fullmatch(r"-?\d{1,6}", value):
        return value + ("-12-31" if is_end else "-01-01")
    if not re.fullmatch(r"-?\d{1,6}-\d{2}-\d{2}", value):
        raise ValueError(f"bad date {value!r}: expected YYYY or YYYY-MM-DD")
    return value


def expand_date(value: Column, is_end: bool) -> Column:
    """Column form of :func:`expand_date_text`; returns text, NULL for blank."""
    text = F.trim(value)
    return (
        F.when(value.isNull() | (text == ""), F.lit(None).cast("string"))
        .when(text.rlike(YEAR_FORM), F.concat(text, F.lit("-12-31" if is_end else "-01-01")))
        .when(text.rlike(DATE_FORM), text)
        .otherwise(F.raise_error(F.concat(F.lit("bad date: "), text)).cast("string"))
    )


def window_bounds(start: str | None, end: str | None) -> tuple[Column, Column]:
    """Date literals of a query window; an open end means all time."""
    return (
        F.lit(expand_date_text(start, False) or EARLIEST_DATE).cast("date"),
        F.lit(expand_date_text(end, True) or LATEST_DATE).cast("date"),
    )


def possibly_active(w0, w1, bounds=BOUNDS) -> Column:
    se, _, _, el = _columns(bounds)
    return (se.isNull() | (se <= _date(w1))) & (el.isNull() | (el >= _date(w0)))


def certainly_active(w0, w1, bounds=BOUNDS) -> Column:
    _, sl, ee, _ = _columns(bounds)
    known = sl.isNotNull() & ee.isNotNull()
    return known & F.coalesce((sl <= _date(w1)) & (ee >= _date(w0)), F.lit(False))


def is_undated(bounds=BOUNDS) -> Column:
    return reduce(Column.__and__, [c.isNull() for c in _columns(bounds)])


def inverted(bounds=BOUNDS) -> Column:
    """True when derived bounds contradict each other."""
    se, sl, ee, el = _columns(bounds)
    return (
        F.coalesce(se > sl, F.lit(False))
        | F.coalesce(ee > el, F.lit(False))
        | F.coalesce(se > el, F.lit(False))
    )


def year_of(date: Column) -> Column:
    return F.year(date)


def parse_year(raw: Column) -> Column:
    """``struct<year, bad>``: blank is unknown, anything but an integer is bad.

    Signs and single underscores between digits are accepted, as the integer
    grammar of the mapped sources does.
    """
    text = F.trim(F.coalesce(raw.cast("string"), F.lit("")))
    whole = text.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$")
    year = F.when(whole, F.regexp_replace(text, "_", "").try_cast("int"))
    return F.struct(year.alias("year"), ((text != "") & year.isNull()).alias("bad"))


def _edge(which: str, year: Column) -> Column:
    return F.make_date(year, *((F.lit(1), F.lit(1)) if which == "first" else (F.lit(12), F.lit(31))))


def clean_code(code: Column) -> Column:
    """The code as the source wrote it, ``IN`` when blank."""
    text = F.trim(F.coalesce(code, F.lit("")))
    return F.when(text == "", F.lit("IN")).otherwise(text)


def _coded_edge(key: Column, year: Column, side: int) -> Column:
    """The bound a code gives on one side; codes not listed read as ``IN``."""
    def codes(edge: str | None) -> list[str]:
        return [code for code, rule in DATE_CODES.items() if rule[side] == edge]

    usual = DATE_CODES["IN"][side]
    other = "last" if usual == "first" else "first"
    return F.when(key.isin(codes(other)), _edge(other, year)).when(
        ~key.isin(codes(None)), _edge(usual, year)
    )


def interpret_endpoint(code: Column, year: Column) -> Column:
    """``struct<earliest, latest, approximate>`` of one coded year; unknown code = IN."""
    return coded_point(F.upper(clean_code(code)), year)


def coded_point(key: Column, year: Column) -> Column:
    """:func:`interpret_endpoint` of a code that is clean and in capitals already; it is read several times."""
    circa = [name for name, rule in DATE_CODES.items() if rule[2]]
    return F.struct(
        _coded_edge(key, year, 0).alias("earliest"),
        _coded_edge(key, year, 1).alias("latest"),
        (year.isNotNull() & key.isin(circa)).alias("approximate"),
    )


def format_fuzzy(earliest: Column, latest: Column, approximate: Column | None = None) -> Column:
    """One fuzzy date as text: a year, ``c.`` year, a range, after, before, unknown."""
    e, lt = F.year(earliest).cast("string"), F.year(latest).cast("string")
    circa = F.coalesce(approximate, F.lit(False)) if approximate is not None else F.lit(False)
    mark = F.when(circa, F.lit("c. ")).otherwise(F.lit(""))
    return (
        F.when(e.isNull() & lt.isNull(), F.lit("date unknown"))
        .when(e == lt, F.concat(mark, e))
        .when(e.isNotNull() & lt.isNotNull(), F.concat(e, F.lit("–"), lt))
        .when(e.isNotNull(), F.concat(F.lit("after "), mark, e))
        .otherwise(F.concat(F.lit("before "), mark, lt))
    )


def format_valid_time(bounds=BOUNDS, approximate: Column | None = None) -> Column:
    se, sl, ee, el = _columns(bounds)
    start, end = format_fuzzy(se, sl, approximate), format_fuzzy(ee, el, approximate)
    no_start, no_end = se.isNull() & sl.isNull(), ee.isNull() & el.isNull()
    return (
        F.when(no_start & no_end, F.lit("date unknown"))
        .when(no_end, start)
        .when(no_start, end)
        .otherwise(F.concat(start, F.lit("–"), end))
    )


def format_life_dates(born_earliest, born_latest, died_earliest, died_latest) -> Column:
    be, bl, de, dl = _columns((born_earliest, born_latest, died_earliest, died_latest))
    born, died = format_fuzzy(be, bl), format_fuzzy(de, dl)
    no_born, no_died = be.isNull() & bl.isNull(), de.isNull() & dl.isNull()
    return (
        F.when(no_born & no_died, F.lit("dates unknown"))
        .when(no_died, F.concat(F.lit("b. "), born))
        .when(no_born, F.concat(F.lit("d. "), died))
        .otherwise(F.concat(born, F.lit("–"), died))
    )


def dates_or_null(names) -> Column:
    """A struct of dates, or NULL when every one of them is unknown."""
    cols = _columns(names)
    return F.when(~is_undated(names), F.struct(*cols))
