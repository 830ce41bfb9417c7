"""Discretisation (D1-D4): new column ``<column>_discretized`` with codes from 1."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions import count_below, is_numeric_type, numeric_column, require_columns
from curata.functions.stats import global_percentiles, running_sums
from curata.operators.fitted import Fitted
from curata.session import cut_lineage

# --- fixed values -------------------------------------------------------------------
DEFAULT_BINS = 4
KMEANS_MAX_ITER = 50
# Equal-width outer breaks are widened by range / 1000 on each side.
EQUAL_WIDTH_WIDEN = 1000
# An interval of at most so many (value, class) rows is cut to its end in one task.
MDLP_ROWS = 1 << 16
# -------------------------------------------------------------------------------------

METHODS = ("equalwidth", "equalfreq", "kmeans", "entropy")


def code_from_breaks(x: Column, inner: Sequence[float]) -> Column:
    """1-based right-closed interval code: 1 + number of inner breaks below x."""
    if not inner:
        return F.when(x.isNotNull(), F.lit(1))
    return count_below(x, inner) + 1


def equal_width_breaks(lo: float, hi: float, bins: int) -> list[float]:
    """All breaks (outer ones widened) of ``bins`` equal-width intervals."""
    dx = hi - lo
    if dx == 0:
        lo, hi = lo - abs(lo) / 1000, hi + abs(hi) / 1000
        dx = hi - lo
        by = dx / bins
        return [lo + i * by for i in range(bins + 1)]
    by = dx / bins
    br = [lo + i * by for i in range(bins + 1)]
    br[0], br[-1] = lo - dx / EQUAL_WIDTH_WIDEN, hi + dx / EQUAL_WIDTH_WIDEN
    return br


def fit_discretizer(
    df: DataFrame,
    column: str,
    method: str = "equalwidth",
    bins: int = DEFAULT_BINS,
    target: str | None = None,
) -> Fitted:
    """Learn the inner breakpoints; every method ends as right-closed codes
    ``1 + number of inner breaks below x`` in ``<column>_discretized``."""
    require_columns(df, [column])
    if not is_numeric_type(df, column):
        raise ValueError(f"column {column!r} is not numeric")
    method = method.lower()
    x = numeric_column(df, column)
    inner: list[float] | None
    if method == "equalwidth":
        r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
        inner = None if r["lo"] is None else equal_width_breaks(r["lo"], r["hi"], bins)[1:-1]
    elif method == "equalfreq":
        qs = global_percentiles(df.select(x.alias("_x")), "_x", [i / bins for i in range(bins + 1)])
        if qs[0] is None:
            inner = None
        else:
            uniq = sorted(set(qs))
            if len(uniq) < 2:
                raise ValueError("breaks are not unique: the column has a single value")
            inner = uniq[1:-1]
    elif method == "kmeans":
        inner = kmeans_breaks(df, column, bins)
    elif method == "entropy":
        if target is None:
            raise ValueError("a target column is required for entropy discretisation")
        inner = mdlp_cuts(df, column, target)
    else:
        raise ValueError(f"unsupported discretisation method {method!r}; choose one of {METHODS}")
    new = f"{column}_discretized"

    def apply(t: DataFrame) -> DataFrame:
        if inner is None:
            return t.withColumn(new, F.lit(None).cast("int"))
        return t.withColumn(new, code_from_breaks(numeric_column(t, column), inner))

    return Fitted("discretize", column, {"method": method, "inner_breaks": inner}, apply)


def discretize(
    df: DataFrame,
    column: str,
    method: str = "equalwidth",
    bins: int = DEFAULT_BINS,
    target: str | None = None,
) -> DataFrame:
    return fit_discretizer(df, column, method, bins, target).transform(df)


def kmeans_breaks(df: DataFrame, column: str, k: int = DEFAULT_BINS) -> list[float]:
    """D3: 1-D k-means; the boundaries between clusters numbered by ascending
    centre are the midpoints of neighbouring centres (a value on one belongs
    to the lower cluster).

    Lloyd's rounds from the quantiles (2i + 1) / 2k of the distinct values, so
    the result depends on the values alone.  Rows collapse to (value, count),
    written once; a round is one aggregate of them with k rows, until no value
    changes its cluster.  Fewer distinct values than k are a cluster each.
    """
    keyed = df.select(numeric_column(df, column).alias("_kx")).where(F.col("_kx").isNotNull())
    counted = cut_lineage(keyed.groupBy("_kx").agg(F.count(F.lit(1)).alias("_n")))
    distinct = counted.count()
    if not distinct:
        return []
    k = min(k, distinct)
    centres = global_percentiles(counted, "_kx", [(2 * i + 1) / (2 * k) for i in range(k)])
    inner: list[float] = []
    held: dict[int, int] = {}
    for _ in range(KMEANS_MAX_ITER):
        inner = [(a + b) / 2 for a, b in zip(centres[:-1], centres[1:], strict=True)]
        code = code_from_breaks(F.col("_kx"), inner).alias("_k")
        groups = counted.groupBy(code).agg(F.sum("_n").alias("n"), (F.sum(F.col("_kx") * F.col("_n")) / F.sum("_n")).alias("mean")).collect()
        for g in groups:  # an empty cluster keeps its centre
            centres[g["_k"] - 1] = g["mean"]
        if (sizes := {g["_k"]: g["n"] for g in groups}) == held:
            break  # the same intervals again
        held = sizes
    return [(a + b) / 2 for a, b in zip(centres[:-1], centres[1:], strict=True)]


def kmeans_codes(df: DataFrame, column: str, k: int = DEFAULT_BINS) -> DataFrame:
    """D3: codes of the nearest k-means centre, numbered by ascending centre."""
    return fit_discretizer(df, column, "kmeans", k).transform(df)


# --- D4: MDLP (Fayyad & Irani) --------------------------------------------------------------


def _bits(c: Column, scale: int) -> Column:
    """c log2 c as a whole number of 1/scale bits, so that sums do not depend on their order."""
    return F.when(c > 1, F.round(c * F.log2(c.cast("double")) * F.lit(float(scale))).cast("long")).otherwise(F.lit(0).cast("long"))


def _xlog(c: float) -> float:
    return c * math.log2(c) if c > 1 else 0.0


def mdlp_cuts(df: DataFrame, column: str, target: str) -> list[float]:
    """Minimum-description-length cut points of ``column`` for class ``target``.

    Works on ``(value, class, count)`` rows, whatever the number of classes.
    A level of the recursion examines all open intervals together: running
    counts per (interval, class) say by how much each row moves the sum of
    c log2 c over the classes on either side, and running totals of these
    moves per interval give the entropy of every cut.  ``min_by`` picks one cut
    an interval; the driver sees a few numbers an interval for the MDL test and
    the next value beside each accepted cut.  Equal entropies go to the smallest value.
    Intervals of at most ``MDLP_ROWS`` rows are cut to their end in one job, a
    task an interval, so jobs do not grow with the number of cuts.
    """
    require_columns(df, [column, target])
    x = numeric_column(df, column)
    base = df.select(x.alias("_v"), F.col(f"`{target}`").cast("string").alias("_y")).where(
        F.col("_v").isNotNull() & F.col("_y").isNotNull()
    )
    counted = cut_lineage(base.groupBy("_v", "_y").agg(F.count(F.lit(1)).alias("_n")))
    rows = counted.agg(F.sum("_n")).first()[0] or 0
    if rows < 2:
        return []
    scale = 1 << max(0, min(40, 59 - math.ceil(math.log2(rows * math.log2(rows) + 1))))
    cum, n, total = F.col("_cum_n"), F.col("_n"), F.col("_all_n")
    moves = {
        "_l": _bits(cum, scale) - _bits(cum - n, scale),
        "_r": _bits(total - cum, scale) - _bits(total - cum + n, scale),
        "_new": (cum == n).cast("long"),  # the class's first rows
        "_gone": (cum == total).cast("long"),  # ... and its last
    }
    cuts: list[float] = []
    finished: list[float] = []
    open_ivals = [0]

    def small_cuts(rows: DataFrame) -> list[float]:
        return [r["cut"] for r in rows.groupBy("_iv").applyInArrow(_interval_cuts(scale), "cut double").collect()]

    while open_ivals:
        tagged = counted.withColumn("_iv", count_below(F.col("_v"), cuts)).where(F.col("_iv").isin(open_ivals))
        small = [r["_iv"] for r in tagged.groupBy("_iv").agg(F.count(F.lit(1)).alias("_k")).collect() if r["_k"] <= MDLP_ROWS]
        if small:
            finished += small_cuts(tagged.where(F.col("_iv").isin(small)))
            tagged = tagged.where(~F.col("_iv").isin(small))
            if len(small) == len(open_ivals):
                break
        by_class = running_sums(tagged, "_v", ["_n"], by=["_iv", "_y"], totals=True).withColumns(moves)
        moved = by_class.groupBy("_iv", "_v").agg(*[F.sum(c).alias(c) for c in ("_n", *moves)])
        run = running_sums(moved, "_v", ["_n", *moves], by=["_iv"], totals=True)
        right = total - cum
        cost = _bits(cum, scale) - F.col("_cum_l") + _bits(right, scale) - F.col("_all_l") - F.col("_cum_r")
        sums = ["_all_n", "_all_l", "_all_new", "_cum_n", "_cum_l", "_cum_r", "_cum_new", "_cum_gone"]
        best = run.where(right > 0).withColumn("_e", cost).groupBy("_iv").agg(F.min_by(F.struct("_v", "_e", *sums), F.struct("_e", "_v")).alias("b")).collect()
        left_of = sorted(r["b"]["_v"] for r in best if _worth_a_cut(r["b"], scale))
        if not left_of:
            break
        after = counted.groupBy(count_below(F.col("_v"), left_of).alias("_g")).agg(F.min("_v").alias("_v")).where(F.col("_g") > 0).collect()
        following = {r["_g"]: r["_v"] for r in after}
        new_cuts = [(v + following[i + 1]) / 2.0 for i, v in enumerate(left_of)]
        cuts = sorted(cuts + new_cuts)
        # children of split intervals are the ones to examine next level
        open_ivals = sorted({j for c in new_cuts for j in (cuts.index(c), cuts.index(c) + 1)})
    return sorted(cuts + finished)


def _interval_cuts(scale: int):
    """All cuts of one interval's (value, class, count) rows, by the sums and the test of ``mdlp_cuts``."""

    def bits(c):
        import numpy as np

        x = c * (np.log(np.maximum(c, 1)) / np.log(2.0)) * float(scale)
        return np.where(x < 2.0**52, np.floor(x + 0.5), x).astype(np.int64)

    def cuts(rows):
        import numpy as np
        import pyarrow as pa

        value, n = rows["_v"].to_numpy(), rows["_n"].to_numpy()
        kind = np.unique(rows["_y"].to_numpy().astype(str), return_inverse=True)[1].reshape(-1)
        order = np.lexsort((kind, value))
        value, kind, n = value[order], kind[order], n[order]
        found = []
        todo = [(0, len(value), np.lexsort((np.arange(len(value)), kind)))]  # rows from, to, and the same rows by class
        while todo:
            lo, hi, own = todo.pop()
            firsts = lo + np.flatnonzero(np.diff(value[lo:hi], prepend=np.nan))
            if len(firsts) < 2:
                continue
            many = n[own]
            start = np.flatnonzero(np.diff(kind[own], prepend=-1))
            length = np.diff(start, append=len(own))
            total = np.repeat(np.add.reduceat(many, start), length)
            cum = np.cumsum(many)
            cum = cum - np.repeat(cum[start] - many[start], length)
            moves = np.empty((5, hi - lo), np.int64)
            moves[:, own - lo] = (
                many,
                bits(cum) - bits(cum - many),
                bits(total - cum) - bits(total - cum + many),
                cum == many,
                cum == total,
            )
            at, left, right, new, gone = np.cumsum(np.add.reduceat(moves, firsts - lo, axis=1), axis=1)
            rest = at[-1] - at[:-1]
            cost = bits(at[:-1]) - left[:-1] + bits(rest) - left[-1] - right[:-1]
            i = int(np.argmin(cost))
            best = {"_v": value[firsts[i]], "_e": int(cost[i]), "_all_n": int(at[-1]), "_all_l": int(left[-1]), "_all_new": int(new[-1])}
            best |= {"_cum_n": int(at[i]), "_cum_l": int(left[i]), "_cum_r": int(right[i]), "_cum_new": int(new[i]), "_cum_gone": int(gone[i])}
            if not _worth_a_cut(best, scale):
                continue
            cut = (value[firsts[i]] + value[firsts[i + 1]]) / 2.0
            found.append(float(cut))
            middle = lo + int(np.searchsorted(value[lo:hi], cut, side="right"))
            if middle < hi:
                todo += [(lo, middle, own[own < middle]), (middle, hi, own[own >= middle])]
        return pa.table({"cut": pa.array(found, pa.float64())})

    return cuts


def _worth_a_cut(b, scale: int) -> bool:
    """The description-length test: does the best cut's gain pay for the cut?"""
    n, nl = b["_all_n"], b["_cum_n"]
    nr = n - nl
    whole = (_xlog(n) - b["_all_l"] / scale) / n
    left = (_xlog(nl) - b["_cum_l"] / scale) / nl
    right = (_xlog(nr) - (b["_all_l"] + b["_cum_r"]) / scale) / nr
    k, k1, k2 = b["_all_new"], b["_cum_new"], b["_all_new"] - b["_cum_gone"]
    delta = math.log2(3**k - 2) - (k * whole - k1 * left - k2 * right)
    return n > 1 and whole - b["_e"] / scale / n > (math.log2(n - 1) + delta) / n
