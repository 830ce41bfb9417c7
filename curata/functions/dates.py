"""Date parsing and formatting expressions (typecast to date, C24, C25)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
# Text formats tried, in this order, when a string is cast to a date/timestamp,
# each with the text shape it can match (checked first: a failed parse is
# far more expensive than a regex test).
DATETIME_FORMATS = (
    ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
    ("yyyy-MM-dd'T'HH:mm:ss", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"),
    ("yyyy-M-d", r"^\d{4,}-\d{1,2}-\d{1,2}$"),
    ("yyyy/M/d", r"^\d{4,}/\d{1,2}/\d{1,2}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4,}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4,}$"),
)
# Orders tried by the mixed-format standardiser: four-digit years first, then
# two-digit years; within each, year-month-day, day-month-year, month-day-year.
MIXED_DATE_ORDERS = (
    ("yyyy-M-d", r"^\d{4,}-\d{1,2}-\d{1,2}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4,}$"),
    ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4,}$"),
    ("yy-M-d", r"^\d{2}-\d{1,2}-\d{1,2}$"),
    ("d-M-yy", r"^\d{1,2}-\d{1,2}-\d{2}$"),
    ("M-d-yy", r"^\d{1,2}-\d{1,2}-\d{2}$"),
)
# Two-digit years at or above this value are read as 19xx (00-68 -> 20xx).
TWO_DIGIT_YEAR_PIVOT = 69
# strftime directives understood by the formatter (Spark pattern equivalents).
STRFTIME_TOKENS = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%H": "HH",
    "%I": "hh",
    "%M": "mm",
    "%S": "ss",
    "%p": "a",
    "%b": "MMM",
    "%B": "MMMM",
    "%a": "EEE",
    "%A": "EEEE",
    "%j": "DDD",
}
# -----------------------------------------------------------------------------


def parse_dates(c: Column, formats: tuple[tuple[str, str], ...] = DATETIME_FORMATS) -> Column:
    """Parse text into a wall-clock TIMESTAMP_NTZ (independent of the session
    time zone) with a declared list of formats; unparsable text -> NULL.

    ``to_timestamp_ntz`` raises on bad input under ANSI mode, so each format
    is only applied where ``try_to_timestamp`` accepts the text.
    """
    s = F.trim(c.cast("string"))
    return F.coalesce(
        *[
            F.when(s.rlike(shape) & F.try_to_timestamp(s, F.lit(f)).isNotNull(), F.to_timestamp_ntz(s, F.lit(f)))
            for f, shape in formats
        ]
    )


def as_wall_clock(c: Column, dtype) -> Column:
    """A DATE/TIMESTAMP/TIMESTAMP_NTZ column as TIMESTAMP_NTZ; text is parsed."""
    name = dtype.simpleString()
    if name == "timestamp_ntz":
        return c
    if name in ("date", "timestamp"):
        return c.cast("timestamp_ntz")
    return parse_dates(c)


def parse_mixed_dates(c: Column) -> Column:
    """Parse dates written in mixed orders (ymd / dmy / mdy) into a DATE.

    Any run of separators becomes ``-`` first.  The first order that parses
    wins, so an ambiguous ``01/02/2020`` is read day-first.
    """
    s = F.regexp_replace(F.trim(c.cast("string")), "[^0-9A-Za-z]+", "-")
    four = [F.when(s.rlike(shape), F.try_to_date(s, f)) for f, shape in MIXED_DATE_ORDERS if "yyyy" in f]
    two = [F.when(s.rlike(shape), F.try_to_date(s, f)) for f, shape in MIXED_DATE_ORDERS if "yyyy" not in f]
    two_pivot = [
        F.when(F.year(d) >= 2000 + TWO_DIGIT_YEAR_PIVOT, F.add_months(d, -1200)).otherwise(d) for d in two
    ]
    return F.coalesce(*four, *two_pivot)


def _strftime_tokens(fmt: str) -> list[tuple[bool, str]]:
    """(is_directive, text) pieces of a strftime format."""
    out: list[tuple[bool, str]] = []
    i = 0
    while i < len(fmt):
        tok = fmt[i : i + 2]
        if tok in STRFTIME_TOKENS:
            out.append((True, tok))
            i += 2
        elif tok == "%%":
            out.append((False, "%"))
            i += 2
        else:
            out.append((False, fmt[i]))
            i += 1
    return out


def format_wall_clock(ts: Column, fmt: str) -> Column:
    """Render a wall-clock timestamp (TIMESTAMP_NTZ or DATE) with a strftime
    format without passing through the session time zone: numbers come from
    the date/time fields, month and day names from the DATE part."""
    d = F.to_date(ts)

    def pad(c: Column, n: int) -> Column:
        return F.lpad(c.cast("string"), n, "0")

    field = {
        "%Y": lambda: pad(F.year(ts), 4),
        "%y": lambda: pad(F.year(ts) % 100, 2),
        "%m": lambda: pad(F.month(ts), 2),
        "%d": lambda: pad(F.dayofmonth(ts), 2),
        "%H": lambda: pad(F.hour(ts), 2),
        "%I": lambda: pad((F.hour(ts) + 11) % 12 + 1, 2),
        "%M": lambda: pad(F.minute(ts), 2),
        "%S": lambda: pad(F.second(ts), 2),
        "%p": lambda: F.when(F.hour(ts) < 12, F.lit("AM")).otherwise(F.lit("PM")),
        "%j": lambda: pad(F.dayofyear(ts), 3),
        "%b": lambda: F.date_format(d, "MMM"),
        "%B": lambda: F.date_format(d, "MMMM"),
        "%a": lambda: F.date_format(d, "EEE"),
        "%A": lambda: F.date_format(d, "EEEE"),
    }
    parts = [field[t]() if is_dir else F.lit(t) for is_dir, t in _strftime_tokens(fmt)]
    return F.when(ts.isNotNull(), F.concat(*parts)) if parts else F.lit("")
