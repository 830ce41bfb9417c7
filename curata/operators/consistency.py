"""Duplicates, text and date consistency."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.functions import parse_mixed_dates, require_columns, title_case, trim_whitespace
from curata.functions.dates import as_wall_clock, format_wall_clock

CASES = ("lower", "upper", "title")


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Drop rows equal (all columns, NULLs equal) to another row."""
    return df.dropDuplicates()


def text_case(df: DataFrame, columns: Iterable[str], case: str = "lower") -> DataFrame:
    """C23a-c: lower / upper / title case; values become text, NULL stays NULL."""
    columns = list(columns)
    require_columns(df, columns)
    case = case.lower().replace("case", "")
    fn = {"lower": F.lower, "upper": F.upper, "title": title_case}.get(case)
    if fn is None:
        raise ValueError(f"unsupported case {case!r}; choose one of {CASES}")
    return df.withColumns({c: fn(F.col(f"`{c}`").cast("string")) for c in columns})


def trim(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """C23d: strip leading/trailing whitespace (tabs and newlines included)."""
    columns = list(columns)
    require_columns(df, columns)
    return df.withColumns({c: trim_whitespace(F.col(f"`{c}`").cast("string")) for c in columns})


def change_date_format(df: DataFrame, column: str, fmt: str) -> DataFrame:
    """Parse a date column and re-render it with a strftime format."""
    require_columns(df, [column])
    # parse once into its own column, then format from it (the formatter
    # reads the value several times)
    parsed = df.withColumn("_ts", as_wall_clock(F.col(f"`{column}`"), df.schema[column].dataType))
    return parsed.withColumn(column, format_wall_clock(F.col("_ts"), fmt)).drop("_ts")


def standardize_dates(df: DataFrame, column: str, output_format: str | None = None) -> DataFrame:
    """Read dates written in mixed orders (ymd, dmy, mdy; 2- or 4-digit
    years) into a DATE, or into text with ``output_format`` (strftime).
    Unparsable values become NULL; ``unparsed_dates`` counts them."""
    require_columns(df, [column])
    d = parse_mixed_dates(F.col(f"`{column}`"))
    if output_format is None:
        return df.withColumn(column, d)
    parsed = df.withColumn("_d", d)
    return parsed.withColumn(column, format_wall_clock(F.col("_d"), output_format)).drop("_d")


def unparsed_dates(df: DataFrame, column: str) -> int:
    """Number of non-NULL values that ``standardize_dates`` cannot read."""
    c = F.col(f"`{column}`")
    return df.agg(F.count_if(c.isNotNull() & parse_mixed_dates(c).isNull())).first()[0]
