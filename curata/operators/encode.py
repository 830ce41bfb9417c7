"""Categorical encoding (E1 one-hot, E2 label)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.functions import is_string_type, require_columns
from curata.operators.fitted import Fitted
from curata.session import cut_lineage

# --- fixed values -----------------------------------------------------------------
WIDE_LEVELS = 10_000  # one column a level: more levels are refused (the sparse form takes any number)
# ----------------------------------------------------------------------------------

METHODS = ("onehot", "onehot_sparse", "label")


def _check(df: DataFrame, column: str) -> None:
    require_columns(df, [column])
    if not is_string_type(df, column):
        raise ValueError(f"column {column!r} must be text (categorical)")


def fit_onehot(df: DataFrame, column: str, max_levels: int = WIDE_LEVELS) -> Fitted:
    """The sorted level list (one output column per level, so the list is as
    long as the output is wide).  More levels than ``max_levels`` are an error;
    for columns with very many levels there is ``fit_onehot_sparse``."""
    _check(df, column)
    c = F.col(f"`{column}`")
    found = df.where(c.isNotNull()).select(c).distinct()
    levels = [r[0] for r in found.orderBy(c).limit(max_levels + 1).collect()]
    if len(levels) > max_levels:
        raise ValueError(f"column {column!r} has more than {max_levels} levels; use the sparse form")

    def apply(t: DataFrame) -> DataFrame:
        cc = F.col(f"`{column}`")
        dummies = [F.coalesce((cc == F.lit(v)).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in levels]
        return t.select(*[F.col(f"`{n}`") for n in t.columns if n != column], *dummies)

    return Fitted("onehot", column, {"levels": levels}, apply)


def onehot(df: DataFrame, column: str) -> DataFrame:
    """Replace ``column`` by 0/1 columns ``<column>_<level>`` appended last,
    one per level in sorted order; NULL gives all zeros."""
    return fit_onehot(df, column).transform(df)


def fit_onehot_sparse(df: DataFrame, column: str) -> Fitted:
    """E1 for any number of levels: a (level, index) table, applied by a join.  No
    level list reaches the driver, only the number of levels."""
    _check(df, column)
    c = F.col(f"`{column}`")
    ranked = cut_lineage(_text_ranks(df.where(c.isNotNull()).select(c.alias("_lvl")).distinct()))
    size = ranked.count()

    def apply(t: DataFrame) -> DataFrame:
        out = t.join(ranked, F.col(f"`{column}`") == F.col("_lvl"), "left")
        index = F.col("_code") - 1
        vector = F.struct(
            F.lit(size).cast("int").alias("size"),
            F.when(index.isNull(), F.array().cast("array<int>")).otherwise(F.array(index)).alias("indices"),
            F.when(index.isNull(), F.array().cast("array<double>")).otherwise(F.array(F.lit(1.0))).alias("values"),
        )
        return out.select(*[F.col(f"`{n}`") for n in t.columns if n != column], vector.alias(column))

    return Fitted("onehot_sparse", column, {"levels": ranked, "size": size}, apply)


def onehot_sparse(df: DataFrame, column: str) -> DataFrame:
    """Replace ``column`` by a sparse vector ``(size, indices, values)``: a 1.0 at the
    0-based position of its value among the sorted distinct values.  NULL, and a
    level that the fit has not seen, give the empty vector (all zeros)."""
    return fit_onehot_sparse(df, column).transform(df)


def fit_label(df: DataFrame, column: str) -> Fitted:
    """A (level, code) table -- 1-based positions of the sorted distinct
    values from a global row position (no cap on the number of levels).  It is
    applied by a join (AQE broadcasts it when small; works stream-static)."""
    _check(df, column)
    c = F.col(f"`{column}`")
    levels = df.where(c.isNotNull()).select(c.alias("_lvl")).distinct()
    ranked = cut_lineage(_text_ranks(levels))  # materialised once in the shared checkpoint folder

    def apply(t: DataFrame) -> DataFrame:
        cc = F.col(f"`{column}`")
        out = t.join(ranked, cc.eqNullSafe(F.col("_lvl")), "left").drop("_lvl")
        return out.withColumn(column, F.col("_code")).drop("_code")

    return Fitted("label", column, {"levels": ranked}, apply)


def label(df: DataFrame, column: str) -> DataFrame:
    """Replace ``column`` by the 1-based position of its value among the
    sorted distinct values; NULL stays NULL."""
    return fit_label(df, column).transform(df)


def _text_ranks(levels: DataFrame) -> DataFrame:
    """1-based rank of distinct text values (byte order), computed with a
    range repartition + per-partition counts instead of one global window."""
    from curata.functions.stats import with_position

    pos = with_position(levels, ["_lvl"], "_p")
    return pos.select("_lvl", (F.col("_p") + 1).cast("int").alias("_code"))


def encode(df: DataFrame, column: str, method: str = "onehot") -> DataFrame:
    method = method.lower()
    if method == "onehot":
        return onehot(df, column)
    if method == "onehot_sparse":
        return onehot_sparse(df, column)
    if method == "label":
        return label(df, column)
    raise ValueError(f"unknown encoding method {method!r}; choose one of {METHODS}")

