"""Scalar column expressions: numeric coercion, null tokens, text, arithmetic."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values (they decide which inputs count as missing / blank) -------
# Strings that become NULL on ingest, compared case-insensitively.
NULL_TOKENS = ("null", "nan", "inf", "-inf")
# Extra tokens that a CSV read treats as missing.
READ_NULL_TOKENS = ("", "NA")
# Characters stripped by ``trim_whitespace`` (ASCII whitespace).
WHITESPACE_CLASS = "[ \\t\\n\\r\\f\\x0B]"
# -----------------------------------------------------------------------------

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"column(s) not found: {missing}")


def _dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric_type(df: DataFrame, name: str) -> bool:
    return isinstance(_dtype(df, name), _NUMERIC)


def is_string_type(df: DataFrame, name: str) -> bool:
    return isinstance(_dtype(df, name), (T.StringType, T.VarcharType, T.CharType))


def numeric_column(df: DataFrame, name: str) -> Column:
    """Coerce a column to DOUBLE the way ``to_numeric(errors='coerce')`` does.

    Unparsable text becomes NULL, and so do NaN and +/-Inf (they are missing
    values in this library's null model).
    """
    dt = _dtype(df, name)
    c = F.col(f"`{name}`")
    if isinstance(dt, _NUMERIC):
        d = c.cast("double")
    elif isinstance(dt, T.BooleanType):
        d = c.cast("int").cast("double")
    elif isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        d = F.expr(f"try_cast(`{name}` AS DOUBLE)")
    else:
        return F.lit(None).cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(None).cast("double")).otherwise(d)


def nan_as_null(df: DataFrame, name: str) -> Column:
    """The column, with NaN as NULL where its type can hold one."""
    c = F.col(f"`{name}`")
    return F.when(~F.isnan(c), c) if isinstance(_dtype(df, name), (T.FloatType, T.DoubleType)) else c


def null_tokens(c: Column, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    """NULL where a string equals one of ``tokens`` (case-insensitive)."""
    toks = [t.lower() for t in tokens]
    return F.when(F.lower(c).isin(toks), F.lit(None).cast("string")).otherwise(c)


def title_case(c: Column) -> Column:
    """Capitalise every run of letters (Python ``str.title`` rule).

    ``initcap`` splits at spaces only, so each run of letters gets a mark and a
    space before it, which are taken out again after ``initcap``.  The mark is
    a private-use character; a text that holds it already is cut into runs.
    """
    mark = "\ue000 "
    marked = F.initcap(F.regexp_replace(F.lower(c), "(\\p{L}+)", mark + "$1"))
    runs = F.regexp_extract_all(F.lower(c), F.lit("(\\p{L}+|\\P{L}+)"), 1)
    return F.when(c.contains(mark[0]), F.array_join(F.transform(runs, lambda x: F.initcap(x)), "")).otherwise(F.replace(marked, F.lit(mark), F.lit("")))


def trim_whitespace(c: Column) -> Column:
    """Strip leading and trailing whitespace (tabs and newlines too)."""
    return F.regexp_replace(c, f"^{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+$", "")


def safe_divide(a: Column, b: Column) -> Column:
    """a / b with NULL for a zero or NULL divisor (never an ANSI error)."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def r_mod(a: Column, b: Column) -> Column:
    """Modulo whose sign follows the divisor (R ``%%``); zero divisor -> NULL."""
    bb = F.nullif(b.cast("double"), F.lit(0.0))
    aa = a.cast("double")
    return aa - F.floor(aa / bb) * bb


def count_below(x: Column, breaks, strict: bool = True) -> Column:
    """Number of sorted literal ``breaks`` below ``x`` (``b < x``; ``b <= x``
    when not strict) as a plain, code-generated expression.

    Short lists are a sum of comparisons; lists up to 128 a balanced CASE
    WHEN binary search (O(log n) comparisons per row).  Longer lists use two
    levels so the generated code stays small: a search over every 64th break
    picks a block, then the at most 64 breaks of that block are counted.
    NULL ``x`` gives NULL.
    """
    bs = [float(b) for b in breaks]

    def below(b) -> Column:
        b = b if isinstance(b, Column) else F.lit(b)
        return x > b if strict else x >= b

    if not bs:
        return F.when(x.isNotNull(), F.lit(0))
    if len(bs) <= 16:
        total = below(bs[0]).cast("int")
        for b in bs[1:]:
            total = total + below(b).cast("int")
        return total

    def tree(vals: list[float], lo: int, hi: int) -> Column:  # answer in [lo, hi]
        if hi - lo <= 8:
            total = F.lit(lo)
            for b in vals[lo:hi]:
                total = total + below(b).cast("int")
            return total
        mid = (lo + hi) // 2
        return F.when(below(vals[mid]), tree(vals, mid + 1, hi)).otherwise(tree(vals, lo, mid))

    if len(bs) <= _TREE_MAX:
        return F.when(x.isNotNull(), tree(bs, 0, len(bs)))
    blocks = [bs[i : i + _BLOCK] for i in range(0, len(bs), _BLOCK)]
    lasts = [blk[-1] for blk in blocks]
    j = tree(lasts, 0, len(lasts))  # blocks lying wholly below x
    table = F.array(*[F.array(*[F.lit(v) for v in blk]) for blk in blocks])
    inside = F.element_at(table, F.least(j, F.lit(len(blocks) - 1)) + 1)
    within = F.size(F.filter(inside, lambda b: below(b)))
    # blocks before j are full (only the last block can be short)
    return F.when(x.isNotNull(), F.when(j >= len(blocks), F.lit(len(bs))).otherwise(j * _BLOCK + within))


_TREE_MAX = 128
_BLOCK = 64
