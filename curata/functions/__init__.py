"""Column-expression helpers shared by the operators.

Everything here returns a ``pyspark.sql.Column`` built from built-in Spark
functions, so it stays inside whole-stage codegen.
"""

from curata.functions.columns import (
    NULL_TOKENS,
    READ_NULL_TOKENS,
    WHITESPACE_CLASS,
    count_below,
    is_numeric_type,
    is_string_type,
    nan_as_null,
    numeric_column,
    null_tokens,
    r_mod,
    require_columns,
    safe_divide,
    title_case,
    trim_whitespace,
)
from curata.functions.dates import format_wall_clock, parse_dates, parse_mixed_dates

__all__ = [
    "NULL_TOKENS",
    "READ_NULL_TOKENS",
    "WHITESPACE_CLASS",
    "count_below",
    "is_numeric_type",
    "is_string_type",
    "nan_as_null",
    "numeric_column",
    "null_tokens",
    "parse_dates",
    "parse_mixed_dates",
    "r_mod",
    "require_columns",
    "safe_divide",
    "format_wall_clock",
    "title_case",
    "trim_whitespace",
]
