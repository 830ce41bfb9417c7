"""Column roles, coercion, typecasts and row filters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.functions.dates import as_wall_clock
from curata.functions import (
    is_numeric_type,
    is_string_type,
    null_tokens,
    nan_as_null, numeric_column,
    require_columns,
)

# --- fixed values ---------------------------------------------------------------
# A numeric column with more distinct non-null values than this is quantitative.
MAX_UNIQUE_CATEGORICAL = 10
# Above this approximate distinct count a column is quantitative without an
# exact check (HyperLogLog++ error cannot bring it down to 10).
_APPROX_SURE = 1000
# ---------------------------------------------------------------------------------


def r_type_name(dt: T.DataType) -> str:
    """Name of the value class a column has (integer, numeric, character, ...)."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "numeric"
    if isinstance(dt, T.BooleanType):
        return "logical"
    if isinstance(dt, T.DateType):
        return "Date"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "POSIXct"
    return "character"


def classify_columns(df: DataFrame, max_unique_cat: int = MAX_UNIQUE_CATEGORICAL) -> tuple[list[str], list[str]]:
    """Split columns into (qualitative, quantitative) lists."""
    qual, quant, _ = classify_and_count(df, max_unique_cat)
    return qual, quant


def classify_and_count(df: DataFrame, max_unique_cat: int = MAX_UNIQUE_CATEGORICAL) -> tuple[list[str], list[str], int]:
    """Column roles plus the row count, from the same aggregate pass.

    Numeric with more than ``max_unique_cat`` distinct non-null values ->
    quantitative; any other non-empty column -> qualitative; all-NULL columns
    are in neither list.  One aggregate gives non-null counts and HLL distinct
    estimates; only numeric columns with a small estimate get an exact distinct
    count, over a frame that holds few distinct values by construction.
    """
    cols = df.columns
    numeric = [c for c in cols if is_numeric_type(df, c)]
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cols)]
    aggs += [F.approx_count_distinct(numeric_column(df, c)).alias(f"d{i}") for i, c in enumerate(numeric)]
    row = df.agg(*aggs).first()
    nonempty = {c: row[f"n{i}"] > 0 for i, c in enumerate(cols)}
    approx = {c: row[f"d{i}"] for i, c in enumerate(numeric)}
    unsure = [c for c in numeric if nonempty[c] and approx[c] <= max(_APPROX_SURE, 2 * max_unique_cat)]
    exact: dict[str, int] = {}
    if unsure:
        exact = distinct_counts(df, unsure, numeric=True)
    qual, quant = [], []
    for c in cols:
        if not nonempty[c]:
            continue
        if c in approx:
            distinct = exact.get(c, approx[c])
            (quant if distinct > max_unique_cat else qual).append(c)
        else:
            qual.append(c)
    return qual, quant, row["_rows"]


def distinct_counts(df: DataFrame, columns: Sequence[str], numeric: bool = False) -> dict[str, int]:
    """Exact distinct non-null counts of several columns in one shuffle.

    Unpivot to (column, value), ``groupBy`` both (map-side combine), count per
    column.  Avoids the ``Expand`` that several ``count(DISTINCT)`` add.
    """
    if not columns:
        return {}
    val = (lambda c: numeric_column(df, c)) if numeric else (lambda c: F.col(f"`{c}`").cast("string"))
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), val(c).alias("v")) for c in columns])
    long = df.select(F.explode(pairs).alias("p")).select("p.k", "p.v").where(F.col("v").isNotNull())
    res = long.distinct().groupBy("k").count().collect()
    out = {c: 0 for c in columns}
    out.update({r["k"]: r["count"] for r in res})
    return out


def prepare(
    df: DataFrame,
    qualitative: Iterable[str] | None = None,
    quantitative: Iterable[str] | None = None,
) -> DataFrame:
    """Select and coerce columns by role.

    Qualitative columns become strings, quantitative ones DOUBLE (unparsable,
    NaN and +/-Inf -> NULL); string tokens ``null nan inf -inf`` become NULL.
    Output order: qualitative then quantitative.
    """
    qual = list(qualitative or [])
    quant = list(quantitative or [])
    if not qual and not quant:
        raise ValueError("no columns selected")
    require_columns(df, qual + quant)
    out: list[Column] = []
    for c in qual:
        out.append(null_tokens(F.col(f"`{c}`").cast("string")).alias(c))
    for c in quant:
        out.append(numeric_column(df, c).alias(c))
    return df.select(*out)


def normalize_nulls(df: DataFrame) -> DataFrame:
    """NaN/+-Inf -> NULL in floating columns, null tokens -> NULL in strings (T4)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(numeric_column(df, f.name).cast(f.dataType).alias(f.name))
        elif is_string_type(df, f.name):
            out.append(null_tokens(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Delete columns; unknown names are ignored."""
    return df.drop(*list(columns))


# --- typecast (T7) -----------------------------------------------------------------

TYPECAST_TARGETS = ("numeric", "integer", "character", "string", "factor", "logical", "date")


def typecast(df: DataFrame, column: str, target: str, strict: bool = False) -> DataFrame:
    """Cast one column to ``numeric | integer | character | string | factor | logical | date``.

    * numeric: text that does not parse, NaN and Inf -> NULL.
    * integer: fractional values -> NULL, or an error when ``strict``.
    * character/string/factor: text; NULL stays NULL.
    * logical: truthiness (numbers: non-zero; text: non-empty); NULL stays NULL.
    * date: declared list of text formats -> TIMESTAMP_NTZ; unparsable -> NULL.
    """
    require_columns(df, [column])
    target = target.lower()
    c = F.col(f"`{column}`")
    if target == "numeric":
        new = numeric_column(df, column)
    elif target == "integer":
        d = numeric_column(df, column)
        whole = d == F.floor(d)
        if strict:
            bad = df.where(d.isNotNull() & ~whole).limit(1).count()
            if bad:
                raise ValueError(f"column {column!r} holds fractional values")
        new = F.when(whole, d.cast("long"))
    elif target in ("character", "string", "factor"):
        new = c.cast("string")
    elif target == "logical":
        if is_numeric_type(df, column):
            new = c.cast("double") != 0
        elif isinstance(df.schema[column].dataType, T.BooleanType):
            new = c
        else:
            new = F.length(c.cast("string")) > 0
    elif target == "date":
        new = as_wall_clock(c, df.schema[column].dataType)
    else:
        raise ValueError(f"unknown target type {target!r}; choose one of {TYPECAST_TARGETS}")
    return df.withColumn(column, new)


# --- row filters (F1, F2) ------------------------------------------------------------


def drop_null_rows(df: DataFrame, column: str) -> DataFrame:
    """Keep rows whose ``column`` is neither NULL nor NaN (F1)."""
    require_columns(df, [column])
    return df.where(nan_as_null(df, column).isNotNull())


def factor_labels(df: DataFrame, column: str) -> DataFrame:
    """The sorted labels of a factor column, one row each (T7d)."""
    require_columns(df, [column])
    text = F.col(f"`{column}`").cast("string")
    return df.select(text.alias("label")).where(F.col("label").isNotNull()).distinct().orderBy("label")


def drop_flagged(df: DataFrame, mask: Column) -> DataFrame:
    """Remove rows where ``mask`` is true; a NULL mask keeps the row (F2)."""
    return df.where(~F.coalesce(mask, F.lit(False)))
