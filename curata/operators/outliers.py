"""Outlier detection and handling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions import is_numeric_type, is_string_type, numeric_column, require_columns
from curata.functions.stats import global_percentiles, most_frequent
from curata.operators.fitted import Fitted
from curata.operators.schema import drop_flagged
from curata.session import cut_lineage

# --- fixed values ----------------------------------------------------------------
ZSCORE_LIMIT = 3.0            # detect/handle: |z| > 3 with the population sd
IQR_FACTOR = 1.5              # Tukey fences
PERCENTILE_BOUNDS = (0.01, 0.99)
LIB_ZSCORE_THRESHOLD = 2.5    # library z-score rule (sample sd)
DBSCAN_EPS = 0.5
DBSCAN_MIN_PTS = 5
DBSCAN_KEY_DIMS = 3             # the widest dimensions that the first cells are cut in
DBSCAN_HALVED_DIMS = 6          # a crowded cell is halved in this many of its widest dimensions at once
DBSCAN_MAX_KEY_POINTS = 128     # a cell with more points than this is crowded
RARE_THRESHOLD = 0.1
# ----------------------------------------------------------------------------------

DETECTORS = ("zscore", "iqr", "percentile")
REPLACEMENTS = ("mean", "median", "mode", "remove_row")


def fit_outlier_bounds(df: DataFrame, column: str, method: str) -> dict:
    """Bounds of the detectors: ``zscore`` (mean, population sd), ``iqr``
    (Tukey fences from exact quartiles), ``percentile`` (exact 1 % / 99 %)."""
    require_columns(df, [column])
    x = numeric_column(df, column)
    method = method.lower()
    if method == "zscore":
        row = df.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).first()
        return {"method": method, "mean": row["m"], "sd": row["s"]}
    if method == "iqr":
        q1, q3 = global_percentiles(df.select(x.alias("_x")), "_x", [0.25, 0.75])
        if q1 is None:
            return {"method": method, "lo": None, "hi": None}
        return {"method": method, "lo": q1 - IQR_FACTOR * (q3 - q1), "hi": q3 + IQR_FACTOR * (q3 - q1)}
    if method == "percentile":
        lo, hi = global_percentiles(df.select(x.alias("_x")), "_x", list(PERCENTILE_BOUNDS))
        return {"method": method, "lo": lo, "hi": hi}
    raise ValueError(f"unknown outlier method {method!r}; choose one of {DETECTORS}")


def mask_from_bounds(x: Column, b: dict) -> Column:
    """Outlier flag from fitted bounds; NULL values give a NULL flag."""
    if b["method"] == "zscore":
        if b["mean"] is None or not b["sd"]:
            return F.when(x.isNotNull(), F.lit(False))
        return F.abs((x - F.lit(b["mean"])) / F.lit(b["sd"])) > ZSCORE_LIMIT
    if b["lo"] is None:
        return F.lit(None).cast("boolean")
    return (x < F.lit(b["lo"])) | (x > F.lit(b["hi"]))


def outlier_mask(df: DataFrame, column: str, method: str) -> Column:
    """Boolean column: is the value an outlier under ``method``.  NULL values
    give a NULL mask (never flagged)."""
    return mask_from_bounds(numeric_column(df, column), fit_outlier_bounds(df, column, method))


def detect_outliers(df: DataFrame, column: str, method: str) -> DataFrame:
    """One row with ``outlier_count``."""
    mask = outlier_mask(df, column, method)
    return df.agg(F.count_if(F.coalesce(mask, F.lit(False))).cast("long").alias("outlier_count"))


def fit_outlier_handler(df: DataFrame, column: str, method: str, replace: str) -> Fitted:
    """Learn the detector bounds and the replacement value (computed on all
    values, outliers included; mode falls back to the median)."""
    require_columns(df, [column])
    bounds = fit_outlier_bounds(df, column, method)
    replace = replace.lower()
    x = numeric_column(df, column)
    if replace == "remove_row":
        value = None
    elif replace == "mean":
        value = df.agg(F.avg(x)).first()[0]
    elif replace == "median":
        value = global_percentiles(df.select(x.alias("_x")), "_x", [0.5])[0]
    elif replace == "mode":
        row = most_frequent(df.select(x.alias("_x")), "_x").first()
        if row is not None and row["mode"] is not None:
            value = row["mode"]
        else:
            value = global_percentiles(df.select(x.alias("_x")), "_x", [0.5])[0]
    else:
        raise ValueError(f"unknown replacement {replace!r}; choose one of {REPLACEMENTS}")

    def apply(target: DataFrame) -> DataFrame:
        target = target.withColumn(column, numeric_column(target, column))
        mask = mask_from_bounds(F.col(f"`{column}`"), bounds)
        if replace == "remove_row":
            return drop_flagged(target, mask)
        if value is None:
            return target
        flagged = F.coalesce(mask, F.lit(False))
        return target.withColumn(column, F.when(flagged, F.lit(float(value))).otherwise(F.col(f"`{column}`")))

    return Fitted("outliers", column, {**bounds, "replace": replace, "value": value}, apply)


def handle_outliers(df: DataFrame, column: str, method: str, replace: str) -> DataFrame:
    """C17: replace outliers by the mean / median / mode of all values
    (outliers included), or remove their rows.  The column becomes DOUBLE."""
    return fit_outlier_handler(df, column, method, replace).transform(df)


def _replace_with_inlier_mean(df: DataFrame, column: str, mask: Column) -> DataFrame:
    """Replace flagged values by the mean of the other non-NULL values, rounded
    half-to-even when all of those are whole numbers."""
    x = F.col(f"`{column}`").cast("double")
    flagged = F.coalesce(mask, F.lit(False))
    keep = x.isNotNull() & ~flagged
    row = df.agg(
        F.avg(F.when(keep, x)).alias("m"),
        F.bool_and(F.when(keep, x == F.floor(x))).alias("whole"),
        F.count_if(flagged).alias("k"),
    ).first()
    if not row["k"] or row["m"] is None:
        return df
    value = row["m"]
    value_col = F.bround(F.lit(value), 0) if row["whole"] else F.lit(value)
    return df.withColumn(column, F.when(flagged, value_col.cast(df.schema[column].dataType)).otherwise(F.col(f"`{column}`")))


def _require_numeric(df: DataFrame, column: str) -> None:
    require_columns(df, [column])
    if not is_numeric_type(df, column):
        raise ValueError(f"{column!r} has to be numeric for outlier detection")


def zscore_outliers(df: DataFrame, column: str, threshold: float = LIB_ZSCORE_THRESHOLD, action: str = "remove") -> DataFrame:
    """|x - mean| / sd_sample > threshold; remove rows or replace."""
    _require_numeric(df, column)
    x = numeric_column(df, column)
    row = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).first()
    if row["m"] is None or not row["s"]:
        return df
    mask = F.abs((x - F.lit(row["m"])) / F.lit(row["s"])) > threshold
    return drop_flagged(df, mask) if action == "remove" else _replace_with_inlier_mean(df, column, mask)


def iqr_outliers(df: DataFrame, column: str, factor: float = IQR_FACTOR, action: str = "remove") -> DataFrame:
    """Outside [q1 - factor IQR, q3 + factor IQR]; remove rows or replace."""
    _require_numeric(df, column)
    x = numeric_column(df, column)
    q1, q3 = global_percentiles(df.select(x.alias("_x")), "_x", [0.25, 0.75])
    if q1 is None:
        return df
    iqr = q3 - q1
    mask = (x < F.lit(q1 - factor * iqr)) | (x > F.lit(q3 + factor * iqr))
    return drop_flagged(df, mask) if action == "remove" else _replace_with_inlier_mean(df, column, mask)


# --- C21 ----------------------------------------------------------------------------------


def rare_categories(
    df: DataFrame, column: str, threshold: float = RARE_THRESHOLD, kind: str = "proportion", action: str = "remove"
) -> DataFrame:
    """Categories whose share (or count) of the non-NULL rows is below
    ``threshold``: remove their rows, or replace them by the most frequent
    remaining category (ties -> smallest label).  NULL rows are kept.

    Category counts are one ``groupBy``; the rare set is joined back (AQE
    broadcasts it when small)."""
    require_columns(df, [column])
    if not is_string_type(df, column):
        raise ValueError(f"column {column!r} must be categorical (text)")
    c = F.col(f"`{column}`")
    counts = df.where(c.isNotNull()).groupBy(c.alias("_cat")).agg(F.count(F.lit(1)).alias("_n"))
    if kind == "proportion":
        total = counts.agg(F.sum("_n")).first()[0] or 0
        rare = counts.where(F.col("_n") / F.lit(float(total)) < threshold)
    elif kind == "count":
        rare = counts.where(F.col("_n") < threshold)
    else:
        raise ValueError("kind must be 'proportion' or 'count'")
    rare_keys = rare.select("_cat", F.lit(True).alias("_rare"))
    tagged = df.join(rare_keys, c.eqNullSafe(F.col("_cat")), "left").drop("_cat")
    is_rare = F.coalesce(F.col("_rare"), F.lit(False))
    if action == "remove":
        return tagged.where(~is_rare).drop("_rare")
    common = counts.join(rare_keys, "_cat", "left_anti")
    best = common.agg(F.min(F.struct((-F.col("_n")).alias("neg"), F.col("_cat").alias("cat"))).alias("b")).first()["b"]
    if best is None:
        raise ValueError("no common category remains to replace rare ones with")
    return tagged.withColumn(column, F.when(is_rare, F.lit(best["cat"])).otherwise(c)).drop("_rare")


# --- C20 DBSCAN noise ------------------------------------------------------------------------


def _near2(d: int, q: str = "q") -> Column:
    """Squared distance from the query to the nearest place of the box (lo*, hi*)."""
    return sum(
        F.greatest(F.col(f"lo{i}") - F.col(f"{q}{i}"), F.col(f"{q}{i}") - F.col(f"hi{i}"), F.lit(0.0)) ** 2 for i in range(d)
    )


def _far2(d: int, q: str = "q") -> Column:
    """Squared distance from the query to the farthest corner of the box."""
    return sum(F.greatest(F.abs(F.col(f"{q}{i}") - F.col(f"lo{i}")), F.abs(F.col(f"{q}{i}") - F.col(f"hi{i}"))) ** 2 for i in range(d))


def _halved(points: DataFrame, crowded: DataFrame, d: int) -> DataFrame:
    """The points of the crowded cells (``_node``, lo*, hi*), each in its half-size cell:
    the box is halved in its DBSCAN_HALVED_DIMS widest dimensions.  Whatever the box, at
    least two of its cells hold points, unless all of its points are equal."""
    spans = F.array(*[F.col(f"hi{i}") - F.col(f"lo{i}") for i in range(d)])
    wide = F.lit(0.0) if d <= DBSCAN_HALVED_DIMS else F.sort_array(spans, asc=False)[DBSCAN_HALVED_DIMS - 1]
    cuts = []
    for i in range(d):
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        middle = lo + (hi - lo) / 2
        cuts.append(F.when((hi > lo) & (hi - lo >= wide), F.when(middle < hi, middle).otherwise(lo)).alias(f"cut{i}"))
    nodes = crowded.select("_node", *cuts)
    side = [F.when(F.col(f"z{i}") > F.col(f"cut{i}"), F.lit("1")).otherwise(F.lit("0")) for i in range(d)]
    return points.join(nodes, "_node").select(
        F.col("_node").alias("_up"), F.concat("_node", F.lit("/"), *side).alias("_node"), *[f"z{i}" for i in range(d)]
    )


def _neighbours_up_to(queries: DataFrame, points: DataFrame, dims: Sequence[int], d: int, eps: float, need: int) -> DataFrame:
    """(_id, _n): how many of ``points`` lie within ``eps`` of each query, exact below
    ``need`` and ``need`` from there on; queries without any are absent.

    Queries go down a tree of cells whose boxes (count, lower and upper corner) are
    aggregates.  A box wholly within eps adds its count, one wholly outside adds
    nothing, one cut by the ball's surface is gone into: a crowded cell is halved and
    its halves are tested in the next round, the few points of another are compared
    one by one.  A query that has found ``need`` goes no further.  Only crowded
    cells that a query still asks about are ever halved.
    """
    eps2 = eps * eps
    cell = F.transform(F.array(*[F.floor(F.col(f"z{i}") / eps).cast("long") for i in dims]), lambda k: k)
    points = points.select(F.array_join(cell.cast("array<string>"), ",").alias("_node"), *[f"z{i}" for i in range(d)])
    points = points.withColumn("_up", F.col("_node"))
    offsets: list[list[int]] = [[]]
    for _ in dims:
        offsets = [[*o, k] for o in offsets for k in (-1, 0, 1)]
    shifts = F.array(*[F.array(*[F.lit(k).cast("long") for k in o]) for o in offsets])
    around = F.transform(shifts, lambda sh: F.array_join(F.zip_with(cell, sh, lambda a, b: a + b).cast("array<string>"), ","))
    qs = [f"q{i}" for i in range(d)]
    corners = [f"{side}{i}" for i in range(d) for side in ("lo", "hi")]
    asked = queries.select("_id", *[F.col(f"z{i}").alias(f"q{i}") for i in range(d)], F.lit(0).cast("long").alias("_have"), F.explode(around).alias("_up"))
    dist2 = sum((F.col(f"q{i}") - F.col(f"z{i}")) ** 2 for i in range(d))
    gains = []
    while True:
        boxes = points.groupBy("_up", "_node").agg(
            F.count(F.lit(1)).alias("_m"),
            *[f(f"z{i}").alias(f"{side}{i}") for i in range(d) for side, f in (("lo", F.min), ("hi", F.max))],
        )
        met = asked.join(boxes, "_up").where(_near2(d) <= eps2)
        met = cut_lineage(met.select("_id", *qs, "_have", "_node", "_m", *corners, (_far2(d) <= eps2).alias("_inside")))
        whole = met.where("_inside").groupBy("_id").agg(F.sum("_m").alias("_n"))
        gains.append(whole)
        open_ = met.where(~F.col("_inside")).join(whole, "_id", "left").withColumn("_have", F.col("_have") + F.coalesce("_n", F.lit(0)))
        open_ = open_.where(F.col("_have") < need)
        few = open_.where(F.col("_m") <= DBSCAN_MAX_KEY_POINTS).select("_id", "_node", *qs)
        gains.append(few.join(points.select("_node", *[f"z{i}" for i in range(d)]), "_node").where(dist2 <= eps2).groupBy("_id").agg(F.count(F.lit(1)).alias("_n")))
        crowd = F.col("_m") > DBSCAN_MAX_KEY_POINTS
        if met.where(~F.col("_inside") & crowd).isEmpty():
            break
        crowded = open_.where(crowd)
        nodes = cut_lineage(crowded.groupBy("_node").agg(*[F.first(c).alias(c) for c in corners]))
        if nodes.isEmpty():
            break
        asked = crowded.select("_id", *qs, "_have", F.col("_node").alias("_up"))
        points = cut_lineage(_halved(points, nodes, d))
    found = gains[0]
    for g in gains[1:]:
        found = found.unionByName(g)
    return found.groupBy("_id").agg(F.least(F.sum("_n"), F.lit(need)).alias("_n"))


def dbscan_noise_flags(
    df: DataFrame, columns: Sequence[str] | None = None, eps: float = DBSCAN_EPS, min_pts: int = DBSCAN_MIN_PTS, id_col: str = "_rid"
) -> DataFrame:
    """Flag DBSCAN noise points on z-scaled numeric columns (C20), exactly.

    No cluster labels are needed, only noise, so no list of neighbours is built:

    * points are z-scaled (sample sd); a fine cell of side eps/sqrt(d) has
      diameter <= eps, so every point of a fine cell holding >= min_pts
      points is core, with no distance computed;
    * the points of sparse fine cells count their neighbours (self included)
      among all points, up to min_pts; those that reach it are core too;
    * what is left is noise unless one core point lies within eps: the same
      count among the core points, up to 1.

    Both counts go down halved cells (``_neighbours_up_to``): a hot spot of
    equal points is one box, a crowded cell is entered only along the surface
    of an undecided point's ball.

    Input must have a unique ``id_col``; returns (id_col, noise boolean).
    """
    cols = list(columns) if columns is not None else [c for c in df.columns if c != id_col]
    d = len(cols)
    if d == 0:
        raise ValueError("DBSCAN needs a numeric column")
    nulls = df.agg(*[F.count_if(numeric_column(df, c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    if any(nulls[f"n{i}"] for i in range(d)):
        raise ValueError("every point needs all its coordinates: fill or drop NULL and NaN before DBSCAN")
    st = df.agg(*[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(cols)],
                *[F.stddev_samp(f"`{c}`").alias(f"s{i}") for i, c in enumerate(cols)],
                *[F.min(f"`{c}`").alias(f"lo{i}") for i, c in enumerate(cols)],
                *[F.max(f"`{c}`").alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    scaled, spans = [], []
    for i, c in enumerate(cols):
        m, sd = st[f"m{i}"] or 0.0, st[f"s{i}"] or 1.0
        scaled.append(((F.col(f"`{c}`").cast("double") - F.lit(float(m))) / F.lit(float(sd))).alias(f"z{i}"))
        spans.append((float((st[f"hi{i}"] or 0) - (st[f"lo{i}"] or 0)) / float(sd), i))
    zs = [f"z{i}" for i in range(d)]
    fine_side = eps / math.sqrt(d)
    pts = df.select(F.col(f"`{id_col}`").alias("_id"), *scaled).withColumn(
        "_fine", F.array(*[F.floor(F.col(z) / fine_side) for z in zs])
    )
    cell_n = pts.groupBy("_fine").agg(F.count(F.lit(1)).alias("_fine_n"))
    # every branch below reads the scored points: write them once to the
    # shared checkpoint folder instead of re-scanning and re-joining per branch
    pts = cut_lineage(pts.join(cell_n, "_fine").select("_id", *zs, (F.col("_fine_n") >= min_pts).alias("_dense")))
    dims = [i for _, i in sorted(spans, reverse=True)][:DBSCAN_KEY_DIMS]
    sparse = pts.where(~F.col("_dense"))
    counts = _neighbours_up_to(sparse, pts, dims, d, eps, min_pts)
    scored = cut_lineage(
        pts.join(counts, "_id", "left").select("_id", *zs, (F.col("_dense") | (F.coalesce("_n", F.lit(0)) >= min_pts)).alias("_core"))
    )
    near = _neighbours_up_to(scored.where(~F.col("_core")), scored.where("_core"), dims, d, eps, 1)
    return scored.join(near, "_id", "left").select(F.col("_id").alias(id_col), (~F.col("_core") & F.col("_n").isNull()).alias("noise"))


def dbscan_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    eps: float = DBSCAN_EPS,
    min_pts: int = DBSCAN_MIN_PTS,
    action: str = "remove",
    id_col: str | None = None,
) -> DataFrame:
    """C20: remove DBSCAN noise rows, or replace their values that exceed the
    rounded mean of the non-noise rows (per numeric column)."""
    from curata.functions import is_numeric_type

    cols = list(columns) if columns is not None else [c for c in df.columns if is_numeric_type(df, c) and c != id_col]
    if id_col is None:
        df = cut_lineage(df.withColumn("_rid", F.monotonically_increasing_id()))
        id_col = "_rid"
    flags = dbscan_noise_flags(df, cols, eps, min_pts, id_col)
    tagged = df.join(flags, id_col, "left")
    if action == "remove":
        out = tagged.where(~F.col("noise"))
    else:
        means = tagged.where(~F.col("noise")).agg(*[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(cols)]).first()
        out = tagged
        for i, c in enumerate(cols):
            m = means[f"m{i}"]
            if m is None:
                continue
            r = float(round(m))  # half-to-even, as R's round
            x = F.col(f"`{c}`")
            out = out.withColumn(c, F.when(F.col("noise") & (x > F.lit(r)), F.lit(r).cast(df.schema[c].dataType)).otherwise(x))
    out = out.drop("noise")
    return out.drop("_rid") if id_col == "_rid" else out
