"""Missing-value handling.

``handle_missing(df, column, method, ...)`` with method in
``mean | median | mode | constant | remove_row | remove_col | regression |
decision_tree | tree``.  Fitted values are learned by Spark aggregates and
written back with a column expression; the trees are in ``trees``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.functions import is_numeric_type, is_string_type, nan_as_null, numeric_column, require_columns
from curata.functions.stats import global_percentiles, most_frequent
from curata.operators.fitted import Fitted

METHODS = ("mean", "median", "mode", "constant", "remove_row", "remove_col", "regression", "decision_tree", "tree")


def _numeric_features(df: DataFrame, target: str, features: Sequence[str] | None) -> list[str]:
    if features is not None:
        require_columns(df, features)
        return [f for f in features if f != target]
    return [
        f.name
        for f in df.schema.fields
        if f.name != target and isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType))
    ]


def fit_imputer(df: DataFrame, column: str, method: str, constant=None) -> Fitted:
    """Learn the fill value of ``mean | median | mode | constant`` imputation."""
    require_columns(df, [column])
    method = method.lower()
    numeric = method in ("mean", "median")
    if method == "mean":
        fill = df.agg(F.avg(numeric_column(df, column))).first()[0]
    elif method == "median":
        fill = global_percentiles(df.select(numeric_column(df, column).alias("_x")), "_x", [0.5])[0]
    elif method == "mode":
        row = most_frequent(df.withColumn(column, nan_as_null(df, column)), column).first()
        if row is None or row["mode"] is None:
            raise ValueError(f"could not compute the mode of {column!r}: no values")
        fill = row["mode"]
    elif method == "constant":
        if constant is None:
            raise ValueError("a constant must be given")
        if is_numeric_type(df, column) and not isinstance(constant, (int, float)):
            raise ValueError("numeric column needs a numeric constant")
        if is_string_type(df, column) and not isinstance(constant, str):
            raise ValueError("text column needs a text constant")
        fill = constant
    else:
        raise ValueError(f"not a single-value imputation: {method!r}")
    dtype = df.schema[column].dataType

    def apply(target: DataFrame) -> DataFrame:
        if numeric:
            x = numeric_column(target, column)
            return target.withColumn(column, x if fill is None else F.coalesce(x, F.lit(float(fill))))
        return target.withColumn(column, F.coalesce(nan_as_null(target, column), F.lit(fill).cast(dtype)))

    return Fitted("impute", column, {"method": method, "fill": fill}, apply)


def handle_missing(
    df: DataFrame,
    column: str,
    method: str,
    constant=None,
    features: Sequence[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    require_columns(df, [column])
    method = method.lower()
    if method in ("mean", "median", "mode", "constant"):
        return fit_imputer(df, column, method, constant).transform(df)
    if method == "remove_row":
        return df.where(nan_as_null(df, column).isNotNull())
    if method == "remove_col":
        return df.drop(column)
    if method == "regression":
        return regression_impute(df, column, features)
    if method == "decision_tree":
        return boosted_impute(df, column, features, seed)
    if method == "tree":
        return tree_impute(df, column, features, seed)
    raise ValueError(f"unknown method {method!r}; choose one of {METHODS}")


# --- C7: least squares from one Gram aggregate -------------------------------------------


def fit_least_squares(df: DataFrame, target: str, features: Sequence[str]) -> tuple[float, np.ndarray, int]:
    """OLS with intercept on complete rows, from mean-shifted cross-product
    sums (two aggregate passes, numerically stable); solved on the driver on
    the correlation scale (``solve_normal``).  NaN counts as missing.  Returns
    (intercept, coefficients, rows used)."""
    from curata.functions.stats import comoments, solve_normal

    n, means, cov = comoments(df, [numeric_column(df, f) for f in [target, *features]], complete=True)
    if n < 2:
        raise ValueError("not enough complete rows to fit a regression")
    sxx, sxy = cov[1:, 1:], cov[1:, 0]
    beta, _ = solve_normal(sxx, sxy)
    intercept = means[0] - beta @ means[1:]
    return float(intercept), beta, n


def regression_impute(df: DataFrame, column: str, features: Sequence[str] | None = None) -> DataFrame:
    """Fill NULLs of ``column`` with an OLS prediction from all other numeric
    columns; rows lacking a feature stay NULL."""
    df = df.withColumn(column, numeric_column(df, column))
    feats = _numeric_features(df, column, features)
    if not feats:
        raise ValueError("regression needs a numeric predictor column")
    if df.where(F.col(f"`{column}`").isNotNull()).limit(2).count() < 2:
        raise ValueError(f"regression needs two known values of {column!r}")
    intercept, beta, _ = fit_least_squares(df, column, feats)
    pred: Column = F.lit(intercept)
    complete = F.lit(True)
    for b, f in zip(beta, feats):
        x = numeric_column(df, f)
        pred = pred + F.lit(float(b)) * x
        complete = complete & x.isNotNull()
    return df.withColumn(column, F.coalesce(F.col(f"`{column}`"), F.when(complete, pred)))


# --- C8 / C9: tree models -------------------------------------------------------------------


def _fixed_point(train: DataFrame, value: Column) -> tuple[int, float, int]:
    """(rows, middle, digits): sums of all rows' distance from the middle, as multiples of 2^-digits, stay below 2^61."""
    n, low, high = train.agg(F.count(value), F.min(value), F.max(value)).first()
    if not n:
        return 0, 0.0, 0
    middle = low + (high - low) / 2
    widest = max(high - middle, middle - low, 1e-300)
    return n, middle, min(1000, 60 - math.ceil(math.log2(widest)) - math.ceil(math.log2(n + 1)))


def boosted_impute(
    df: DataFrame,
    column: str,
    features: Sequence[str] | None = None,
    seed: int = 42,
    rounds: int = 100,
    rate: float = 0.1,
    max_depth: int = 5,
    min_leaf: int = 1,
) -> DataFrame:
    """Gradient-boosted trees predict NULLs of a numeric column.  Training
    and predicted rows need at least one non-NULL feature.

    Missing predictors are a bin of their own, which goes to the better side of
    each split.  Nothing is drawn, so ``seed`` has no effect: the trees are the
    same under any partitioning."""
    from curata.operators import trees

    df = df.withColumn(column, numeric_column(df, column))
    feats = _numeric_features(df, column, features)
    if not feats:
        raise ValueError("no numeric features available for tree imputation")
    y, any_feat = F.col(f"`{column}`"), F.lit(False)
    for f in feats:
        any_feat = any_feat | (numeric_column(df, f) if is_numeric_type(df, f) else F.col(f"`{f}`")).isNotNull()
    train = df.where(y.isNotNull() & any_feat)
    n, middle, digits = _fixed_point(train, y)
    if n < 2:
        raise ValueError("boosting needs two rows that have a known value and a predictor")
    whole = F.rint((y - F.lit(middle)) * F.lit(2.0**digits)).cast("long")
    binning = trees.fit_binning(train, feats, whole)
    rows = trees.training_rows(train, binning, whole)
    model = trees.boost(rows, binning.ordered, rounds, rate, max_depth, min_leaf, digits)
    scored = trees.with_prediction(df.withColumn("_any", any_feat), binning, model, middle, "_pred", y.isNull() & F.col("_any"))
    return scored.withColumn(column, F.when(y.isNull() & F.col("_any"), F.col("_pred")).otherwise(y)).select(*df.columns)


def tree_impute(
    df: DataFrame,
    column: str,
    features: Sequence[str] | None = None,
    seed: int = 42,
    max_depth: int = 5,
    min_split: int = 2,
    min_leaf: int = 1,
    complexity: float = 0.0,
) -> DataFrame:
    """One decision tree over all other columns; regression for a numeric
    target, classification for any other.

    Text predictors are split into sets of levels.  A row that lacks a split's
    predictor goes the way of its surrogates (splits of other predictors that
    agree with it most), or with the larger side.  ``complexity``: share of the
    root's risk that a split must save to stay.  ``seed`` has no effect."""
    from curata.operators import trees

    feats = [f for f in (features if features is not None else df.columns) if f != column]
    require_columns(df, feats)
    if not feats:
        raise ValueError("a tree needs at least one other column")
    own = nan_as_null(df, column)
    known = df.where(own.isNotNull())
    if is_numeric_type(df, column):
        y = numeric_column(df, column)
        known = known.where(y.isNotNull())
        n, middle, digits = _fixed_point(known, y)
        if not n:
            raise ValueError(f"a tree needs known values of {column!r}")
        target, kinds, unit = F.rint((y - F.lit(middle)) * F.lit(2.0**digits)).cast("long"), 0, 2.0**digits
        order_by, squares = target, known.agg(F.sum(target.cast("double") ** 2)).first()[0]
    else:
        text = F.col(f"`{column}`").cast("string")
        most = trees.CELLS // (len(feats) * (trees.BINS + 1))
        labels = [tuple(r) for r in known.groupBy(text.alias("_c")).agg(F.count(F.lit(1)).alias("_n")).limit(most + 1).collect()]
        if len(labels) > most:
            raise ValueError(f"{column!r} has more than {most} classes")
        if not labels:
            raise ValueError(f"a tree needs known values of {column!r}")
        names = sorted(c for c, _ in labels)
        common = min(labels, key=lambda r: (-r[1], r[0]))[0]
        at = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(i))])
        target, kinds, unit, middle = at[text].cast("long"), len(names), 1.0, 0.0
        order_by, squares = (text == F.lit(common)).cast("long"), 0.0
    binning = trees.fit_binning(known, feats, order_by)
    rows = trees.training_rows(known, binning, target, classes=kinds > 0)
    tree, _ = trees.grow(rows, binning.ordered, kinds, unit, squares, max_depth, min_split, min_leaf, complexity)
    scored = trees.with_prediction(df, binning, [tree], middle, "_pred", own.isNull())
    dtype = df.schema[column].dataType
    pred = F.col("_pred") if not kinds else F.array(*[F.lit(c) for c in names])[F.col("_pred").cast("int")]
    return scored.withColumn(column, F.coalesce(own, pred.cast(dtype))).select(*df.columns)


# --- C9b ----------------------------------------------------------------------------------


def unimputable_report(df: DataFrame, column: str, predictors: Sequence[str] | None = None) -> DataFrame:
    """Rows whose ``column`` is missing and that lack a predictor, with the
    missing predictor names: (all input columns..., missing_predictors).  NaN
    is missing like NULL, in the column and in the predictors."""
    require_columns(df, [column])
    preds = list(predictors) if predictors is not None else [c for c in df.columns if c != column]
    names = F.array_compact(F.array(*[F.when(nan_as_null(df, p).isNull(), F.lit(p)) for p in preds]))
    return (
        df.where(nan_as_null(df, column).isNull())
        .withColumn("missing_predictors", names)
        .where(F.size("missing_predictors") > 0)
    )
