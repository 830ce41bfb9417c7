"""Skewness correction.

Power transforms choose lambda from log-likelihoods evaluated for a whole
grid of lambdas inside ONE aggregate pass (one variance per grid point), so a
fit costs a handful of scans; the transform is a column expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions import is_numeric_type, numeric_column, require_columns
from curata.operators.fitted import Fitted

# --- fixed values -------------------------------------------------------------------
BOXCOX_GRID = [round(-2 + 0.1 * i, 10) for i in range(41)]  # -2.0 .. 2.0 step 0.1
BOXCOX_FUDGE = 0.2          # |lambda| < 0.2 -> log; |lambda - 1| < 0.2 -> unchanged
BOXCOX_MIN_UNIQUE = 3       # fewer distinct values -> unchanged
BOXCOX_SERIES_EPS = 1 / 50  # below this |lambda| the log-likelihood uses a series
YJ_BOUNDS = (-5.0, 5.0)
YJ_EPS = 0.001
YJ_GRID_POINTS = 41
YJ_REFINEMENTS = 4
# -------------------------------------------------------------------------------------

METHODS = ("boxcox", "yeojohnson", "auto", "log", "neglog", "log1p", "sqrt", "negsqrt", "inv", "neginv", "square")


def _boxcox_expr(x: Column, lam: float) -> Column:
    return F.log(x) if lam == 0 else (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)


def _grid_variances(df: DataFrame, t_of, grid: list[float], extra: list[Column] | None = None):
    """Population variance of ``t_of(lambda)`` for every lambda of ``grid``.

    The grid is exploded as data (each row meets every lambda inside one
    pipelined stage, then ``groupBy(lambda)``): the generated code is the same
    for every grid, so repeated passes reuse it.  ``extra`` aggregates ride
    along (their value is taken from any lambda's row).
    """
    lam = F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("_lam")
    extra = extra or []
    rows = (
        df.select("*", lam)
        .groupBy("_lam")
        .agg(F.var_pop(t_of(F.col("_lam"))).alias("_vp"), *[e.alias(f"_e{i}") for i, e in enumerate(extra)])
        .collect()
    )
    var = {r["_lam"]: r["_vp"] for r in rows}
    extras = [rows[0][f"_e{i}"] if rows else None for i in range(len(extra))]
    return var, extras


def boxcox_lambda(df: DataFrame, x: Column, lo: float, hi: float, mean_log: float | None = None) -> float | None:
    """Grid maximum of the Box-Cox profile log-likelihood after the fudge
    rules; ``None`` means "leave unchanged".  ``lo``/``hi`` are min and max:
    a value strictly between them proves at least three distinct values (that
    count rides along in the grid pass)."""
    if mean_log is None:
        mean_log = df.agg(F.avg(F.log(x))).first()[0]
    if mean_log is None or lo == hi:
        return None
    gm = math.exp(mean_log)
    base = df.select((x / F.lit(gm)).alias("_y"), x.alias("_x")).where(F.col("_y").isNotNull())  # argmax unchanged by scaling

    def t_of(lam: Column) -> Column:
        y = F.col("_y")
        ly = F.log(y)
        a = lam * ly
        series = ly * (1 + a / 2 * (1 + a / 3 * (1 + a / 4)))
        return F.when(F.abs(lam) > BOXCOX_SERIES_EPS, (F.pow(y, lam) - 1) / lam).otherwise(series)

    mid = F.count_if((F.col("_x") > F.lit(lo)) & (F.col("_x") < F.lit(hi)))
    var, (n_mid,) = _grid_variances(base, t_of, BOXCOX_GRID, [mid])
    if BOXCOX_MIN_UNIQUE >= 3 and not n_mid:
        return None  # fewer than three distinct values: left unchanged
    best, best_ll = None, -math.inf
    for lam in BOXCOX_GRID:
        v = var.get(float(lam))
        if v is None or v <= 0:
            continue
        ll = -math.log(v)
        if ll > best_ll:
            best, best_ll = lam, ll
    if best is None:
        return None
    if abs(best) < BOXCOX_FUDGE:
        return 0.0
    if abs(best - 1) < BOXCOX_FUDGE:
        return None
    return best


def _yj_col(x: Column, lam: Column) -> Column:
    pos = F.when(F.abs(lam) < YJ_EPS, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    neg = F.when(F.abs(lam - 2) < YJ_EPS, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, pos).otherwise(neg)


def _yj_expr(x: Column, lam: float) -> Column:
    return _yj_col(x, F.lit(float(lam)))


def yeojohnson_lambda(df: DataFrame, x: Column) -> float:
    """Maximise -n/2 ln(var_pop) + (lambda - 1) sum(sign(x) ln(|x| + 1)) over
    lambda in (-5, 5): a grid in one aggregate, refined around the best point."""
    base = df.select(x.alias("_x")).where(F.col("_x").isNotNull())
    st = base.agg(F.count(F.lit(1)).alias("n"), F.sum(F.signum("_x") * F.log1p(F.abs("_x"))).alias("c")).first()
    n, const = st["n"], st["c"]
    lo, hi = YJ_BOUNDS
    best = 1.0
    for _ in range(YJ_REFINEMENTS):
        step = (hi - lo) / (YJ_GRID_POINTS - 1)
        grid = [lo + i * step for i in range(YJ_GRID_POINTS)]
        var, _ = _grid_variances(base, lambda lam: _yj_col(F.col("_x"), lam), grid)
        best_ll = -math.inf
        for lam in grid:
            v = var.get(float(lam))
            if v is None or v <= 0 or math.isnan(v):
                continue
            ll = -0.5 * n * math.log(v) + (lam - 1) * const
            if ll > best_ll:
                best, best_ll = lam, ll
        lo, hi = max(YJ_BOUNDS[0], best - step), min(YJ_BOUNDS[1], best + step)
    return best


def fit_skew(df: DataFrame, column: str, method: str = "auto") -> Fitted:
    """Check the domain and learn what the transform needs (lambda, the
    column maximum, the standardisation of Yeo-Johnson)."""
    require_columns(df, [column])
    method = method.lower()
    if method not in METHODS:
        raise ValueError(f"unknown transformation method {method!r}; choose one of {METHODS}")
    if not is_numeric_type(df, column):
        raise ValueError(f"skewness can only be reduced in a numeric column; {column!r} is not one")
    x = numeric_column(df, column)
    chk = df.agg(
        F.min(x).alias("lo"),
        F.max(x).alias("hi"),
        F.count_if(x == 0).alias("zeros"),
        F.avg(F.when(x > 0, F.log(x))).alias("ml"),  # used by Box-Cox when every value is positive
    ).first()
    lo, hi = chk["lo"], chk["hi"]
    params: dict = {"method": method, "max": hi}
    if lo is not None:
        if method == "auto":
            method = "boxcox" if lo > 0 else "yeojohnson"
        if method in ("boxcox", "log") and lo <= 0:
            raise ValueError(f"{method} requires all values > 0")
        if method in ("log1p", "sqrt") and lo < 0:
            raise ValueError(f"{method} requires all values >= 0")
        if method == "inv" and chk["zeros"]:
            raise ValueError("1/x requires no zero values")
        if method == "boxcox":
            params["lambda"] = boxcox_lambda(df, x, lo, hi, chk["ml"])
        elif method == "yeojohnson":
            lam = yeojohnson_lambda(df, x)
            t = _yj_expr(x, lam)
            st = df.agg(F.avg(t).alias("m"), F.stddev_samp(t).alias("s")).first()
            params.update({"lambda": lam, "mean": st["m"], "sd": st["s"]})
    params["applied"] = method

    def apply(target: DataFrame) -> DataFrame:
        xx = numeric_column(target, column)
        if lo is None:
            return target.withColumn(column, xx)
        m = params["applied"]
        shift = F.lit(hi + 1) - xx  # max(x + 1) - x
        if m == "boxcox":
            lam = params["lambda"]
            new = xx if lam is None else _boxcox_expr(xx, lam)
        elif m == "yeojohnson":
            t = _yj_expr(xx, params["lambda"])
            sd = params["sd"]
            new = F.try_divide(t - F.lit(params["mean"]), F.nullif(F.lit(sd).cast("double"), F.lit(0.0)))
        elif m == "log":
            new = F.log10(xx)
        elif m == "neglog":
            new = F.log10(shift)
        elif m == "log1p":
            new = F.log1p(xx)
        elif m == "sqrt":
            new = F.sqrt(xx)
        elif m == "negsqrt":
            new = F.sqrt(shift)
        elif m == "inv":
            new = 1 / xx
        elif m == "neginv":
            new = 1 / shift
        else:  # square
            new = xx * xx
        return target.withColumn(column, new)

    return Fitted("skew", column, params, apply)


def reduce_skew(df: DataFrame, column: str, method: str = "auto") -> DataFrame:
    """Apply a skewness-reducing transform to a numeric column in place.

    Domain checks raise ``ValueError`` (boxcox/log need x > 0, log1p/sqrt
    x >= 0, inv x != 0).  NULLs pass through.  yeojohnson output is
    standardised (mean 0, sample sd 1).
    """
    return fit_skew(df, column, method).transform(df)
