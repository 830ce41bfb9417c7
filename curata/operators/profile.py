"""Dataset profile (P1-P6): summary, per-column statistics, frequencies,
histograms and the correlation matrix.

Every statistic is a Spark aggregate; many columns share one pass (a wide
``agg`` or an unpivot + ``groupBy``).  Only scalars and small per-column tables
reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.functions import count_below, is_numeric_type, numeric_column
from curata.functions.stats import exact_percentiles, top_k_per_group
from curata.operators.schema import classify_and_count, classify_columns, r_type_name
from curata.session import cut_lineage

# --- fixed values ---------------------------------------------------------------
TOP_LABELS = 10          # categorical frequency table keeps this many labels
HISTOGRAM_BREAKS = 10    # requested number of histogram cells
TUKEY_FACTOR = 1.5       # outlier fences q1 - 1.5 IQR, q3 + 1.5 IQR
# pretty() constants: bias towards larger units, rounding tolerance, fuzz
PRETTY_HIGH_BIAS = 1.5
PRETTY_U5_BIAS = 0.5 + 1.5 * PRETTY_HIGH_BIAS
PRETTY_ROUNDING_EPS = 1e-10
HIST_FUZZ = 1e-7
# ---------------------------------------------------------------------------------


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


# --- P1 ------------------------------------------------------------------------------


def dataset_summary(df: DataFrame, max_unique_cat: int = 10) -> DataFrame:
    """One row: num_rows, num_columns, num_qualitative_columns,
    num_quantitative_columns, num_duplicates (rows repeating an earlier row)."""
    qual, quant, n_rows = classify_and_count(df, max_unique_cat)
    n_distinct = df.distinct().count()
    spark = df.sparkSession
    schema = (
        "num_rows bigint, num_columns bigint, num_qualitative_columns bigint, "
        "num_quantitative_columns bigint, num_duplicates bigint"
    )
    return spark.createDataFrame(
        [(n_rows, len(df.columns), len(qual), len(quant), n_rows - n_distinct)], schema
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row, as a one-row frame (lazy)."""
    per_row = df.groupBy(*[_c(c) for c in df.columns]).count()
    return per_row.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("num_duplicates"))


# --- P2 ------------------------------------------------------------------------------

COLUMN_STATS_SCHEMA = T.StructType(
    [
        T.StructField("column_name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("missing", T.LongType()),
        T.StructField("distinct", T.LongType()),
        T.StructField("zeros", T.LongType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("median", T.DoubleType()),
        T.StructField("sd", T.DoubleType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("iqr", T.DoubleType()),
        T.StructField("skewness", T.DoubleType()),
        T.StructField("outliers", T.LongType()),
        T.StructField("most_frequent", T.StringType()),
        T.StructField("freq_count", T.LongType()),
    ]
)


def _value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(_i, _col, _d, _s, _cnt): count of every distinct value per column, the one frame that all value statistics share.

    ``_i`` is the column's place in ``columns``, ``_d`` the numeric value (NULL for other columns) and ``_s`` its text
    label: whole numbers print without a fraction (``5`` not ``5.0``), other values as Spark casts them.  Ordering by
    (_d, _s) sorts numbers numerically.  Missing values (NULL, NaN) are left out.  What is shuffled is the column's
    number and a DOUBLE; only text, and whole numbers too long for a DOUBLE's digits, travel as text.
    """
    items = []
    for i, c in enumerate(columns):
        dt = df.schema[c].dataType
        if is_numeric_type(df, c):
            d = numeric_column(df, c)
            t = F.when(F.abs(d) >= 1e15, _c(c).cast("string")) if isinstance(dt, T.IntegralType) else F.lit(None).cast("string")
        else:
            d, t = F.lit(None).cast("double"), _c(c).cast("string")
        items.append(F.struct(F.lit(i).alias("_i"), d.alias("_d"), t.alias("_t")))
    long = df.select(F.explode(F.array(*items)).alias("_p")).select("_p.*").where(F.col("_d").isNotNull() | F.col("_t").isNotNull())
    counted = long.groupBy("_i", "_d", "_t").agg(F.count(F.lit(1)).alias("_cnt"))
    d = F.col("_d")
    label = F.when((d == F.floor(d)) & (F.abs(d) < 1e15), F.floor(d).cast("long").cast("string")).otherwise(d.cast("string"))
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("_i") + 1)
    return counted.select("_i", name.alias("_col"), "_d", F.coalesce("_t", label).alias("_s"), "_cnt")


def column_stats(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Per-column statistics, one row per column.

    Two scans of the input: one wide aggregate for counts, moments, min and max, and one that collapses all columns to
    (column, value, count), written once.  Quartiles, outlier counts by Tukey fences, distinct counts and most frequent
    values come from the collapsed frame (``counts``, where the caller has it already).
    """
    cols = df.columns
    numeric = [c for c in cols if is_numeric_type(df, c)]
    num = {c: numeric_column(df, c) for c in numeric}
    aggs: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        aggs.append(F.count(_c(c)).alias(f"nn{i}"))
    for i, c in enumerate(numeric):
        x = num[c]
        aggs += [
            F.count_if(x == 0).alias(f"z{i}"),
            F.avg(x).alias(f"mean{i}"),
            F.stddev_samp(x).alias(f"sd{i}"),
            F.min(x).alias(f"min{i}"),
            F.max(x).alias(f"max{i}"),
            F.skewness(x).alias(f"sk{i}"),
            F.count(x).alias(f"nx{i}"),
        ]
    wide = df.agg(*aggs).first()
    n_rows = wide["_rows"]

    counted = cut_lineage(_value_counts(df, cols)) if counts is None else counts
    quart: dict[int, tuple] = {}
    outliers: dict[int, int] = {}
    if numeric:
        values = counted.where(F.col("_d").isNotNull())
        for r in exact_percentiles(values, "_d", [0.25, 0.5, 0.75], by=["_i"], names=["q1", "q2", "q3"], counted="_cnt").collect():
            quart[r["_i"]] = (r["q1"], r["q2"], r["q3"])
        if quart:  # one row a column, as constants
            low, high = {}, {}
            for i, (q1, _, q3) in quart.items():
                low[i], high[i] = q1 - TUKEY_FACTOR * (q3 - q1), q3 + TUKEY_FACTOR * (q3 - q1)
            fence = lambda side: F.element_at(F.create_map(*[F.lit(x) for i, v in side.items() for x in (i, v)]), F.col("_i"))
            beyond = (F.col("_d") < fence(low)) | (F.col("_d") > fence(high))
            for r in values.groupBy("_i").agg(F.sum(F.when(beyond, F.col("_cnt")).otherwise(0)).alias("n")).collect():
                outliers[r["_i"]] = r["n"]
    best = F.min(F.struct((-F.col("_cnt")).alias("neg"), F.col("_d"), F.col("_s"))).alias("_best")
    per_col = {
        r["_i"]: r
        for r in counted.groupBy("_i")
        .agg(F.count(F.lit(1)).alias("_distinct"), best)
        .select("_i", "_distinct", F.col("_best._s").alias("_mf"), (-F.col("_best.neg")).alias("_mfc"))
        .collect()
    }

    rows = []
    for i, c in enumerate(cols):
        pc = per_col.get(i)
        rec = dict(
            column_name=c,
            type=r_type_name(df.schema[c].dataType),
            missing=n_rows - wide[f"nn{i}"],
            distinct=pc["_distinct"] if pc else 0,
            most_frequent=pc["_mf"] if pc else None,
            freq_count=pc["_mfc"] if pc else None,
        )
        if c in numeric:
            j = numeric.index(c)
            q1, q2, q3 = quart.get(i, (None, None, None))
            rec.update(
                missing=n_rows - wide[f"nx{j}"],
                zeros=wide[f"z{j}"],
                mean=wide[f"mean{j}"],
                median=q2,
                sd=wide[f"sd{j}"],
                min=wide[f"min{j}"],
                max=wide[f"max{j}"],
                iqr=(q3 - q1) if q1 is not None else None,
                skewness=wide[f"sk{j}"],
                outliers=outliers.get(i),
            )
        rows.append(tuple(rec.get(f.name) for f in COLUMN_STATS_SCHEMA.fields))
    return df.sparkSession.createDataFrame(rows, COLUMN_STATS_SCHEMA)


# --- P3 ------------------------------------------------------------------------------


def categorical_frequencies(df: DataFrame, columns: Sequence[str], top: int = TOP_LABELS, counts: DataFrame | None = None) -> DataFrame:
    """Top labels per column with percentages of the top-``top`` total.

    Returns (column_name, rank, label, count, percentage); ties are broken by
    ascending value.  The top-k is salted, so a column with many distinct
    values is ranked by many tasks.  ``counts``: the collapsed frame of
    ``column_stats``, where the caller has it.
    """
    if not columns:
        schema = "column_name string, rank int, label string, count bigint, percentage double"
        return df.sparkSession.createDataFrame([], schema)
    counts = _value_counts(df, columns) if counts is None else counts.where(F.col("_col").isin(*columns))
    order = [F.col("_cnt").desc(), F.col("_d").asc_nulls_last(), F.col("_s").asc()]
    top_rows = top_k_per_group(counts, ["_col"], order, top, salt_on="_s")
    total = F.sum("_cnt").over(Window.partitionBy("_col"))
    return top_rows.select(
        F.col("_col").alias("column_name"),
        F.col("_rank").cast("int").alias("rank"),
        F.col("_s").alias("label"),
        F.col("_cnt").alias("count"),
        F.bround(F.col("_cnt") / total * 100, 2).alias("percentage"),
    )


# --- P4 ------------------------------------------------------------------------------


def pretty_breaks(lo: float, hi: float, n: int = HISTOGRAM_BREAKS, min_n: int = 1) -> list[float]:
    """Round breakpoints covering [lo, hi] with about ``n`` cells (R ``pretty``)."""
    h, h5 = PRETTY_HIGH_BIAS, PRETTY_U5_BIAS
    dx = hi - lo
    if dx == 0 and hi == 0:
        cell, small = 1.0, True
    else:
        cell = max(abs(lo), abs(hi))
        u = 1 + (1 / (1 + h) if h5 >= 1.5 * h + 0.5 else 1.5 / (1 + h5))
        u *= max(1, n) * 2.220446049250313e-16
        small = dx < cell * u * 3
    if small:
        if cell > 10:
            cell = 9 + cell / 10
        cell *= 0.75  # shrink.sml
        if min_n > 1:
            cell /= min_n
    else:
        cell = dx
        if n > 1:
            cell /= n
    base = 10.0 ** math.floor(math.log10(cell))
    unit = base
    if 2 * base - cell < h * (cell - unit):
        unit = 2 * base
        if 5 * base - cell < h5 * (cell - unit):
            unit = 5 * base
            if 10 * base - cell < h * (cell - unit):
                unit = 10 * base
    ns = math.floor(lo / unit + PRETTY_ROUNDING_EPS)
    nu = math.ceil(hi / unit - PRETTY_ROUNDING_EPS)
    while ns * unit > lo + PRETTY_ROUNDING_EPS * unit:
        ns -= 1
    while nu * unit < hi - PRETTY_ROUNDING_EPS * unit:
        nu += 1
    k = int(0.5 + nu - ns)
    if k < min_n:
        k = min_n - k
        if ns >= 0:
            nu += k / 2
            ns -= k / 2 + k % 2
        else:
            ns -= k / 2
            nu += k / 2 + k % 2
        k = min_n
    start, end = ns * unit, nu * unit
    step = (end - start) / k
    out = [start] + [start + i * step for i in range(1, k)] + [end]
    delta = (end - start) / k
    return [0.0 if abs(b) < 1e-14 * delta else b for b in out]


def histogram_bin(x: Column, breaks: Sequence[float]) -> Column:
    """0-based bin of ``x`` for right-closed cells (first cell closed both sides),
    with the relative fuzz that keeps values on a break in the lower cell."""
    diffs = sorted(b - a for a, b in zip(breaks[:-1], breaks[1:]))
    m = len(diffs)
    med = diffs[m // 2] if m % 2 else (diffs[m // 2 - 1] + diffs[m // 2]) / 2
    fuzz = HIST_FUZZ * med
    inner = [float(b + fuzz) for b in breaks[1:-1]]
    if not inner:
        return F.lit(0)
    return count_below(x, inner)


def numeric_histograms(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Histogram per quantitative column.

    Returns (column_name, bin, lower, upper, count, percentage); empty cells are
    kept.  min/max come from one aggregate; the breakpoints are computed on the
    driver from those two numbers; counting is one unpivot + ``groupBy``.
    """
    spark = df.sparkSession
    schema = "column_name string, bin int, lower double, upper double, count bigint, percentage double"
    if not columns:
        return spark.createDataFrame([], schema)
    num = {c: numeric_column(df, c) for c in columns}
    mm = df.agg(*[F.min(num[c]).alias(f"a{i}") for i, c in enumerate(columns)],
                *[F.max(num[c]).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    breaks = {}
    for i, c in enumerate(columns):
        if mm[f"a{i}"] is not None:
            breaks[c] = pretty_breaks(float(mm[f"a{i}"]), float(mm[f"b{i}"]))
    if not breaks:
        return spark.createDataFrame([], schema)
    items = [
        F.struct(F.lit(c).alias("_col"), histogram_bin(num[c], b).alias("_bin"), num[c].alias("_v"))
        for c, b in breaks.items()
    ]
    long = df.select(F.explode(F.array(*items)).alias("_p")).select("_p.*").where(F.col("_v").isNotNull())
    counted = long.groupBy("_col", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    cells = spark.createDataFrame(
        [(c, i, float(b[i]), float(b[i + 1])) for c, b in breaks.items() for i in range(len(b) - 1)],
        "_col string, _bin int, lower double, upper double",
    )
    joined = cells.join(counted, ["_col", "_bin"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)).cast("long"))
    total = F.sum("_n").over(Window.partitionBy("_col"))
    return joined.select(
        F.col("_col").alias("column_name"),
        F.col("_bin").alias("bin"),
        "lower",
        "upper",
        F.col("_n").alias("count"),
        F.bround(F.col("_n") / total * 100, 2).alias("percentage"),
    )


# --- P6 ------------------------------------------------------------------------------


@dataclass
class Profile:
    summary: DataFrame
    columns: DataFrame
    categorical: DataFrame
    numerical: DataFrame
    correlation: DataFrame | None
    qualitative: list[str]
    quantitative: list[str]


def profile(df: DataFrame, max_unique_cat: int = 10) -> Profile:
    """Whole profile (P1-P5).  The input is never cached: all value statistics
    share one collapsed frame (column, value, count), written once; nothing is
    run automatically after other operators (profiling is opt-in)."""
    from curata.operators.correlation import correlation_matrix

    qual, quant = classify_columns(df, max_unique_cat)
    counts = cut_lineage(_value_counts(df, df.columns))
    return Profile(
        summary=dataset_summary(df, max_unique_cat),
        columns=column_stats(df, counts),
        categorical=categorical_frequencies(df, qual, counts=counts),
        numerical=numeric_histograms(df, quant),
        correlation=correlation_matrix(df, quant, "pearson") if len(quant) > 1 else None,
        qualitative=qual,
        quantitative=quant,
    )
