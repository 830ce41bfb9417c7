"""Grouped aggregation.

``aggregate(df, group_by, agg_func, agg_col)`` returns the group columns plus
``count`` (for ``count``) or ``agg_value``.  NULL keys form their own group;
NULLs in the aggregated column are skipped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions import numeric_column, require_columns
from curata.functions.stats import exact_percentiles, null_safe_join

# --- fixed values -----------------------------------------------------------------
# Scale that makes the median absolute deviation consistent with the sd.
MAD_CONSTANT = 1.4826
# Aggregate names accepted (R function names).
AGG_FUNCS = ("count", "mean", "sum", "min", "max", "median", "sd", "var", "iqr", "prod", "mad", "range")
# -----------------------------------------------------------------------------------


def _plain(func: str, x: Column) -> Column | None:
    if func == "mean":
        return F.avg(x)
    if func == "sum":
        return F.coalesce(F.sum(x), F.lit(0.0))  # sum over no values is 0
    if func == "min":
        return F.min(x)
    if func == "max":
        return F.max(x)
    if func == "sd":
        return F.stddev_samp(x)
    if func == "var":
        return F.var_samp(x)
    if func == "prod":
        return F.coalesce(F.product(x), F.lit(1.0))  # product over no values is 1
    return None


def aggregate(df: DataFrame, group_by: Sequence[str] | str, agg_func: str, agg_col: str | None = None) -> DataFrame:
    """Group ``df`` by ``group_by`` and aggregate ``agg_col`` with ``agg_func``.

    Distributive functions are plain Spark aggregates (partial/final split).
    ``median``/``iqr``/``mad`` use exact distributed percentiles, so a group
    holding a third of the rows is still spread over many tasks.
    """
    if isinstance(group_by, str):
        group_by = [g.strip() for g in group_by.split(",") if g.strip()]
    group_by = list(group_by)
    func = agg_func.lower()
    require_columns(df, group_by)
    keys = [F.col(f"`{g}`") for g in group_by]
    if func == "count":
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    if func not in AGG_FUNCS:
        raise ValueError(f"unsupported aggregate {agg_func!r}; choose one of {AGG_FUNCS}")
    if agg_col is None:
        raise ValueError("agg_col is required for functions other than count")
    require_columns(df, [agg_col])
    x = numeric_column(df, agg_col)
    plain = _plain(func, x)
    if plain is not None:
        return df.groupBy(*keys).agg(plain.alias("agg_value"))
    if func == "range":
        return df.groupBy(*keys).agg(F.min(x).alias("agg_value_min"), F.max(x).alias("agg_value_max"))
    src = df.select(*keys, x.alias("_x"))
    if func == "median":
        return exact_percentiles(src, "_x", [0.5], by=group_by, names=["agg_value"])
    if func == "iqr":
        q = exact_percentiles(src, "_x", [0.25, 0.75], by=group_by, names=["_q1", "_q3"])
        return q.select(*keys, (F.col("_q3") - F.col("_q1")).alias("agg_value"))
    # mad: median absolute deviation from the group median, times 1.4826
    med = exact_percentiles(src, "_x", [0.5], by=group_by, names=["_med"])
    dev = null_safe_join(src, med, group_by, "left").select(*keys, F.abs(F.col("_x") - F.col("_med")).alias("_dev"))
    m = exact_percentiles(dev, "_dev", [0.5], by=group_by, names=["_mad"])
    return m.select(*keys, (F.col("_mad") * MAD_CONSTANT).alias("agg_value"))
