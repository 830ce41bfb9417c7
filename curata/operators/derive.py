"""Derived columns from two numeric columns (V1-V5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.functions import is_numeric_type, numeric_column, r_mod, require_columns, safe_divide

OPERATIONS = ("add", "subtract", "multiply", "divide", "mod")


def derive(df: DataFrame, left: str, right: str, op: str, new_column: str) -> DataFrame:
    """``new_column = left <op> right``; divide/mod by zero give NULL and mod
    takes the sign of the divisor.  NaN and infinite values are missing, and a
    result that is not a finite number is NULL."""
    require_columns(df, [left, right])
    if not (is_numeric_type(df, left) and is_numeric_type(df, right)):
        raise ValueError("selected columns must be numeric")
    a, b = numeric_column(df, left), numeric_column(df, right)
    if op == "add":
        v = a + b
    elif op == "subtract":
        v = a - b
    elif op == "multiply":
        v = a * b
    elif op == "divide":
        v = safe_divide(a, b)
    elif op == "mod":
        v = r_mod(a, b)
    else:
        raise ValueError(f"unknown operation {op!r}; choose one of {OPERATIONS}")
    return df.withColumn(new_column, F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v))
