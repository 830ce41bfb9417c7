"""Normalisation (N1-N4): statistics from one aggregate, applied as an expression."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.functions import is_numeric_type, numeric_column, require_columns
from curata.functions.stats import global_percentiles
from curata.operators.fitted import Fitted

METHODS = ("minmax", "zscore", "decimal", "robust")


def fit_scaler(df: DataFrame, column: str, method: str = "minmax") -> Fitted:
    """Learn the statistics of a normalisation (one aggregate, or exact
    quartiles for ``robust``)."""
    require_columns(df, [column])
    if not is_numeric_type(df, column):
        raise ValueError(f"column {column!r} is not numeric")
    method = method.lower()
    x = numeric_column(df, column)
    if method == "minmax":
        r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
        params = {"center": r["lo"], "scale": None if r["lo"] is None else r["hi"] - r["lo"]}
    elif method == "zscore":
        r = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).first()
        params = {"center": r["m"], "scale": r["s"]}
    elif method == "decimal":
        m = df.agg(F.max(F.abs(x))).first()[0]
        params = {"center": 0.0, "scale": None if not m else 10.0 ** math.ceil(math.log10(m))}
    elif method == "robust":
        q1, q2, q3 = global_percentiles(df.select(x.alias("_x")), "_x", [0.25, 0.5, 0.75])
        params = {"center": q2, "scale": None if q2 is None else q3 - q1}
    else:
        raise ValueError(f"invalid method {method!r}; choose one of {METHODS}")
    params["method"] = method

    def apply(target: DataFrame) -> DataFrame:
        xx = numeric_column(target, column)
        if params["center"] is None or params["scale"] is None:
            # no values, or decimal scaling of an all-zero column
            return target.withColumn(column, xx if params["center"] is None else F.lit(None).cast("double"))
        new = F.try_divide(xx - F.lit(float(params["center"])), F.nullif(F.lit(float(params["scale"])), F.lit(0.0)))
        return target.withColumn(column, new)

    return Fitted("normalize", column, params, apply)


def normalize(df: DataFrame, column: str, method: str = "minmax") -> DataFrame:
    """Scale a numeric column in place.

    minmax: (x - min) / (max - min); zscore: (x - mean) / sd_sample;
    decimal: x / 10^ceil(log10(max |x|)); robust: (x - median) / IQR.
    A zero denominator gives NULL.
    """
    return fit_scaler(df, column, method).transform(df)
