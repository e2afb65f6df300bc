"""Date parsing and calendar parts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Orders of the parts, month first (month-day-year stamps of the order export)
# and day first (the 'last update' stamps).  Any separators, or none beside a
# month's name, and years of two or four digits are read.
MDY_FORMATS: tuple[str, ...] = ("M d yyyy", "MMMM d yyyy", "MMM d yyyy", "MMddyyyy")
DMY_FORMATS: tuple[str, ...] = ("d M yyyy", "d MMMM yyyy", "d MMM yyyy", "ddMMyyyy")
# Two-digit years up to this one are of this century, later ones of the last.
LAST_SHORT_YEAR = 68


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once.

    Written out at each use, the patterns below would make generated code that is too
    large for the JVM to compile, and all lines would be run by its interpreter."""
    return F.transform(F.array(value), use)[0]


def spaced_date(c: Column | str) -> Column:
    """Date text with single spaces between its parts and a four-digit year."""
    s = F.trim(F.regexp_replace(_col(c), r"[^\p{L}\p{N}]+", " "))
    s = F.regexp_replace(s, r"(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})", " ")
    return _bound(s, _full_year)


def _full_year(s: Column) -> Column:
    head = F.regexp_extract(s, r"^(.* |\d{4})\d{2}$", 1)
    year = F.regexp_extract(s, r"(\d{2})$", 1)
    short = s.rlike(r"^(.*\D |\D* ?\d{1,2} )?(\d{1,2}|\p{L}+) \d{2}$") | s.rlike(r"^\d{6}$")
    century = F.when(F.try_to_number(year, F.lit("99")) <= LAST_SHORT_YEAR, "20").otherwise("19")
    return F.when(short, F.concat(head, century, year)).otherwise(s)


def parse_date(c: Column | str, formats: Sequence[str], month_at: int) -> Column:
    """First format that parses wins; text no format accepts is null.

    Text of the form ``00-00-0000``, as most exports spell it, is put together again as
    an ISO date: no pattern is run over it.  ``month_at``: the place of its month, 1 or 4.
    """
    text = _col(c)
    plain = (F.translate(text, "123456789", "0" * 9) == "00-00-0000") & ~text.endswith("-0000")
    parts = [text.substr(at, n) for at, n in ((7, 4), (month_at, 2), (5 - month_at, 2))]
    other = _bound(spaced_date(text), lambda s: F.coalesce(*[F.try_to_date(s, f) for f in formats]))
    return F.when(plain, F.concat_ws("-", *parts).try_cast("date")).otherwise(other)


def parse_mdy(c: Column | str) -> Column:
    return parse_date(c, MDY_FORMATS, 1)


def parse_dmy(c: Column | str) -> Column:
    return parse_date(c, DMY_FORMATS, 4)


def month_of(d: Column | str) -> Column:
    return F.month(_col(d))


def week_of(d: Column | str, rule: str = "yday_div7") -> Column:
    """Week number of a date (P19, decision D16).

    ``yday_div7`` (default): ``day_of_year // 7 + 1``, so 6 January is
    week 1 and 7 January week 2.  ``yday_minus1_div7``: ``(day_of_year - 1)
    // 7 + 1``, so 7 January is still week 1.  Neither is ISO week.
    """
    doy = F.dayofyear(_col(d))
    if rule == "yday_div7":
        return (F.floor(doy / 7) + 1).cast("int")
    if rule == "yday_minus1_div7":
        return (F.floor((doy - 1) / 7) + 1).cast("int")
    raise ValueError(f"unknown week rule {rule!r}")


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Whole days from ``earlier`` to ``later`` as double (P20)."""
    return F.datediff(_col(later), _col(earlier)).cast("double")
