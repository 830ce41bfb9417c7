"""Smoothing along row order.

Row order must be explicit (``order_by``, unique).  Positions come from
``with_position`` (range partitioning + per-partition offsets), never from a
single-partition window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.functions import count_below, numeric_column, require_columns
from curata.functions.stats import exact_percentiles, running_sums, with_position
from curata.session import cut_lineage

# --- fixed values -------------------------------------------------------------------
DEFAULT_BIN_SIZE = 5
LOWESS_FRAC = 0.3
LOWESS_ITERATIONS = 3
LOESS_SPAN = 0.75
# Cleveland's cut-offs: distances within 0.1% of the radius weigh 1, beyond
# 99.9% weigh 0 (same for the robustness weights relative to 6 * MAD).
NEAR, FAR = 0.001, 0.999
# ---------------------------------------------------------------------------------------

METHODS = ("binning", "regression")


def smooth(
    df: DataFrame,
    column: str,
    method: str,
    order_by: Sequence[str],
    bin_size: int = DEFAULT_BIN_SIZE,
    regression_type: str = "loess",
    anchor_every: int | None = None,
) -> DataFrame:
    require_columns(df, [column, *order_by])
    if method == "binning":
        return bin_means(df, column, order_by, bin_size)
    if method == "regression":
        if regression_type == "linear":
            return linear_trend(df, column, order_by)
        if regression_type == "loess":
            return lowess(df, column, order_by, frac=LOWESS_FRAC, iterations=LOWESS_ITERATIONS, anchor_every=anchor_every)
        if regression_type == "loess2":
            return lowess(df, column, order_by, frac=LOESS_SPAN, iterations=0, degree=2, anchor_every=anchor_every)
        raise ValueError("unsupported regression type; choose loess or linear")
    raise ValueError(f"unsupported smoothing method {method!r}; choose one of {METHODS}")


def bin_means(df: DataFrame, column: str, order_by: Sequence[str], bin_size: int = DEFAULT_BIN_SIZE) -> DataFrame:
    """Consecutive bins of ``bin_size`` rows; every row (NULLs too) gets
    the mean of the bin's non-NULL values.  Each window group holds at most
    ``bin_size`` rows."""
    pos = with_position(df.withColumn(column, numeric_column(df, column)), order_by, "_pos")
    b = F.floor(F.col("_pos") / F.lit(bin_size))
    out = pos.withColumn(column, F.avg(F.col(f"`{column}`")).over(Window.partitionBy(b)))
    return out.drop("_pos")


def linear_trend(df: DataFrame, column: str, order_by: Sequence[str]) -> DataFrame:
    """C11: least-squares line of the value on its 0-based position (NULL
    values skipped in the fit); every row gets the fitted value."""
    pos = with_position(df.withColumn(column, numeric_column(df, column)), order_by, "_pos")
    y, x = F.col(f"`{column}`"), F.col("_pos").cast("double")
    r = pos.agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a")).first()
    if r["b"] is None:
        return pos.drop("_pos")
    return pos.withColumn(column, F.lit(r["a"]) + F.lit(r["b"]) * x).drop("_pos")


# --- C12 / C13: local regression -------------------------------------------------------------


def _tricube(d: Column) -> Column:
    return F.when(d <= NEAR, F.lit(1.0)).when(d > FAR, F.lit(0.0)).otherwise(F.pow(1 - F.pow(d, 3), 3))


# Positions are cut into leaves, FANOUT leaves make a node of the next level, and so on.
LEAF, FANOUT = 128, 4
CHUNK = 2048  # positions whose points are fitted together
SPREAD = 1.5  # points of a chunk share sums as long as moving them enlarges no number more than that
NEIGHBOURS = ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2")


def lowess(
    df: DataFrame,
    column: str,
    order_by: Sequence[str],
    frac: float = LOWESS_FRAC,
    iterations: int = LOWESS_ITERATIONS,
    degree: int = 1,
    anchor_every: int | None = None,
) -> DataFrame:
    """Locally weighted regression of the value on its row position.

    Only non-NULL rows are fitted (NULL rows stay NULL); x is the position in
    the whole table, so NULL rows widen distances.  The neighbourhood of a
    point is the ``floor(frac * m)`` nearest fitted rows (the window slides
    while the point is nearer the next row out than the first row in), with
    tricube weights and a weighted line (``degree=1``) or parabola
    (``degree=2``), then ``iterations`` rounds of bisquare robustness weights
    from 6 x the median absolute residual.

    Every row is fitted, at any size, in m log(m) work a round (see
    ``_lowess_exact``).  Only on request, ``anchor_every=s`` fits every s-th row
    (and the last) and interpolates linearly in x in between -- the
    interpolation surface that lowess/loess implementations use for speed, an
    approximation.
    """
    src = with_position(df.withColumn(column, numeric_column(df, column)), order_by, "_x")
    y = F.col(f"`{column}`")
    fitted = src.where(y.isNotNull()).select("_x", y.alias("_y"))
    ranked = with_position(fitted, ["_x"], "_r")  # rank among fitted rows
    ranked = ranked.select("_r", F.col("_x").cast("double").alias("_xd"), "_y")
    m, first, last = ranked.agg(F.count(F.lit(1)), F.min("_xd"), F.max("_xd")).first()
    if m == 0:
        return src.drop("_x")
    k = max(2, min(m, int(math.floor(frac * m + 1e-10))))
    rng = last - first
    if anchor_every is None or anchor_every <= 1:
        out_fit = _lowess_exact(ranked, m, k, iterations, degree, rng, int(last) + 1)
    else:
        out_fit = _lowess_anchored(ranked, m, k, iterations, degree, rng, anchor_every)
    out = src.join(out_fit, "_x", "left").withColumn(column, F.when(y.isNotNull(), F.col("_smooth")))
    return out.drop("_x", "_smooth")


def _robust_weight(errors: DataFrame, error: Column) -> Column | None:
    """Bisquare weight of an error from 6 x the median of the column ``_e`` (None: all 1)."""
    med = exact_percentiles(errors, "_e", [0.5]).first()[0] or 0.0
    cmad = 6.0 * med
    if cmad == 0:
        return None
    q = error / F.lit(cmad)
    return F.when(q <= NEAR, F.lit(1.0)).when(q > FAR, F.lit(0.0)).otherwise(F.pow(1 - q * q, 2))


def _moment_sums(frame: DataFrame, key: str, w: Column, u: Column) -> DataFrame:
    return frame.groupBy(key).agg(
        F.sum(w).alias("s0"),
        F.sum(w * u).alias("s1"),
        F.sum(w * u * u).alias("s2"),
        F.sum(w * u * u * u).alias("s3"),
        F.sum(w * u * u * u * u).alias("s4"),
        F.sum(w * F.col("_y")).alias("t0"),
        F.sum(w * u * F.col("_y")).alias("t1"),
        F.sum(w * u * u * F.col("_y")).alias("t2"),
    )


def _windows(ranked: DataFrame, m: int, k: int) -> DataFrame:
    """Per row: _r, _xd, window start _L and radius _h.

    g(L) = (x_L + x_{L+k}) / 2 does not fall with L, so a row's start is the
    number of L with g(L) < x (at most m - k): running counts over the values
    of g and x together.
    """
    right = ranked.select((F.col("_r") - k).alias("_r"), F.col("_xd").alias("_xR"))
    g = ranked.join(right, "_r").select(((F.col("_xd") + F.col("_xR")) / 2).alias("_v"), F.lit(1).alias("_below"))
    both = g.unionByName(ranked.select(F.col("_xd").alias("_v"), F.lit(0).alias("_below")))
    below = running_sums(both.groupBy("_v").agg(F.sum("_below").alias("_below")), "_v", ["_below"])
    start = below.select(F.col("_v").alias("_xd"), F.least(F.col("_cum_below") - F.col("_below"), F.lit(m - k)).alias("_L"))
    placed = ranked.join(start, "_xd").select("_r", "_xd", "_L")
    left = ranked.select(F.col("_r").alias("_L"), F.col("_xd").alias("_xL"))
    end = ranked.select((F.col("_r") - k + 1).alias("_L"), F.col("_xd").alias("_xE"))
    radius = F.greatest(F.col("_xd") - F.col("_xL"), F.col("_xE") - F.col("_xd"))
    return placed.join(left, "_L").join(end, "_L").select("_r", "_xd", "_L", radius.alias("_h"))


def _node_width(level: int) -> int:
    return LEAF * FANOUT**level


def _canonical(a: int, b: int, top: int) -> list[tuple[int, int]]:
    """The largest nodes (level, number) that together are the leaves a to b - 1."""
    out, level = [], 0
    while a < b:
        if level == top:
            out += [(level, n) for n in range(a, b)]
            break
        while a < b and a % FANOUT:
            out.append((level, a))
            a += 1
        while a < b and b % FANOUT:
            b -= 1
            out.append((level, b))
        a, b, level = a // FANOUT, b // FANOUT, level + 1
    return out


def _limits(x, h):
    """Leaves in which the weight changes its form, one column each: far left, near left, near right, far right."""
    import numpy as np

    at = np.stack([x - FAR * h, x - NEAR * h, x + NEAR * h, x + FAR * h], axis=1)
    return np.floor(at / LEAF).astype(np.int64)


def _asked(top: int):
    """(_c, level, node) of all that the points of one chunk meet; level -1: the points of a leaf themselves."""

    def asked(rows):
        import numpy as np
        import pyarrow as pa

        limits = _limits(rows["_xd"].to_numpy(), rows["_h"].to_numpy())
        found = {(-1, int(leaf)) for leaf in np.unique(limits) if leaf >= 0}
        for i in range(3):
            for a, b in np.unique(limits[:, i : i + 2], axis=0):
                found.update(_canonical(max(int(a) + 1, 0), min(int(b), FANOUT**top), top))
        level, node = (np.array(v, dtype=np.int64) for v in zip(*sorted(found), strict=True))
        chunk = np.full(len(level), int(rows["_xd"][0].as_py()) // CHUNK)
        return pa.table({"_c": chunk, "_level": level, "_node": node})

    return asked


def _centre(level: int, node):
    """Middle of a node and half of its width."""
    width = _node_width(level)
    return node * width + (width - 1) / 2, (width - 1) / 2


def _shifts(alpha, beta, size: int):
    """Matrices that make the sums of (alpha t + beta)^q out of those of t^i, for q, i < ``size``; one each of alpha, beta."""
    import numpy as np

    q, i = np.indices((size, size))
    choose = np.array([[math.comb(int(n), int(k)) for k in range(size)] for n in range(size)], dtype=float)
    powers = np.arange(size)
    return choose * (alpha[:, None] ** powers)[:, i] * (beta[:, None] ** powers)[:, np.maximum(q - i, 0)]


def _node_moments(top: int, degree: int):
    """Sums of rw t^j and rw t^j y by node, t the place in the node from -1 to 1: of each batch, to be added up.

    Leaves are summed from the points, the nodes above from their children, moved to the middle of the node.
    """
    size = 10 + 2 * degree

    def moments(batches):
        import numpy as np
        import pyarrow as pa

        up = []
        for level in range(top):
            (middle, half), (centre, part) = _centre(level + 1, 0), _centre(level, np.arange(FANOUT))
            up.append(_shifts(np.full(FANOUT, part / half), (centre - middle) / half, size))
        names = ["_level", "_node", *(f"m{j}" for j in range(2 * size - degree))]
        for batch in batches:
            x, y, rw = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            order = np.argsort(x, kind="stable")
            x, y, rw = x[order], y[order], rw[order]
            if not len(x):
                continue
            node, start = np.unique((x // LEAF).astype(np.int64), return_index=True)
            centre, half = _centre(0, x // LEAF)
            place, power = (x - centre) / half, rw
            sums = np.zeros((len(node), size, 2))
            for j in range(size):
                sums[:, j, 0], sums[:, j, 1] = np.add.reduceat(power, start), np.add.reduceat(power * y, start)
                power = power * place
            for level in range(top + 1):
                held = np.concatenate([sums[:, :, 0], sums[:, : size - degree, 1]], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), level)), pa.array(node), *[pa.array(c) for c in held.T]], names)
                if level < top:
                    moved = up[level][node % FANOUT] @ sums
                    node, start = np.unique(node // FANOUT, return_index=True)
                    sums = np.add.reduceat(moved, start, axis=0)

    return moments


def _leaf_points(batches):
    """(-1, leaf, x of its points, then y, then rw): a record a leaf and batch, so a leaf may come in parts."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        held = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        held = held[:, np.argsort(held[0], kind="stable")]
        node, start = np.unique((held[0] // LEAF).astype(np.int64), return_index=True)
        ends = np.append(start, held.shape[1])
        values = np.concatenate([np.zeros(0), *(held[:, a:b].reshape(-1) for a, b in zip(ends[:-1], ends[1:], strict=True))])
        lists = pa.ListArray.from_arrays(pa.array(3 * ends, pa.int32()), pa.array(values))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), -1)), pa.array(node), lists], ["_level", "_node", "_v"])


def _alike(x, h):
    """Runs (start, end) of points, in order of x, whose sums can be moved from the middle of the run to each of them."""
    runs = [(0, len(x))]
    while runs:
        a, b = runs.pop()
        if b - a > 1 and h[a:b].max() + x[b - 1] - x[a] > SPREAD * h[a:b].min():
            runs += [((a + b) // 2, b), (a, (a + b) // 2)]
        else:
            yield a, b


def _fit_sums(top: int, degree: int):
    """The sums of ``_local_fit`` for the points of one chunk, from the nodes and leaves that they ask for.

    Beside a point the tricube weight is 1 - 3 d^3 + 3 d^6 - d^9 with d = |x - x_a| / h, so over nodes that lie on
    one side its sums are combinations of the nodes' moments, moved to the point: first to the middle of a run of points
    with windows of about the same size, where those of all nodes between two limits are added up, then to each point.
    All numbers stay within 1 in size (in units of h; ``SPREAD`` in a run), so nothing cancels.  Leaves in which the
    weight changes its form are summed point by point.
    """
    size = 10 + 2 * degree

    def sums(key, rows, material):
        import numpy as np
        import pyarrow as pa

        rows = rows.sort_by("_xd")
        x, y, h = (rows[c].to_numpy() for c in ("_xd", "_y", "_h"))
        limits = _limits(x, h)
        n_s, n_t = 2 * degree + 1, degree + 1
        s, t = np.zeros((len(x), 5)), np.zeros((len(x), 3))
        level, node = (material[c].to_numpy() for c in ("_level", "_node"))
        lists = [chunk for chunk in material["_v"].chunks if len(chunk)]
        ends = [chunk.offsets.to_numpy() for chunk in lists]
        held = [v[a:b] for v, at in ((c.values.to_numpy(zero_copy_only=False), e) for c, e in zip(lists, ends, strict=True)) for a, b in zip(at[:-1], at[1:], strict=True)]
        for i in np.flatnonzero(level < 0):
            own = np.flatnonzero((limits == node[i]).any(axis=1))
            px, py, prw = held[i].reshape(3, -1)
            u = px[None, :] - x[own][:, None]
            d = np.abs(u) / h[own][:, None]
            rest = 1 - d * d * d
            power = np.where(d <= NEAR, 1.0, np.where(d > FAR, 0.0, rest * rest * rest)) * prw[None, :]
            for j in range(n_s):
                s[own, j] += power.sum(axis=1)
                if j < n_t:
                    t[own, j] += power @ py
                power = power * u
        inner = np.flatnonzero(level >= 0)
        if len(inner):
            level, node, flat = level[inner], node[inner], np.stack([held[i] for i in inner])
            count = FANOUT**level
            centre, half = node * count * LEAF + (count * LEAF - 1) / 2, (count * LEAF - 1) / 2
            first, end, parent = node * count, (node + 1) * count, node // FANOUT * FANOUT * count
            moments = np.zeros((len(node), size, 2))
            moments[:, :, 0], moments[:, : size - degree, 1] = flat[:, :size], flat[:, size:]
            for lo, hi in _alike(x, h):
                kinds, kind = np.unique(limits[lo:hi], axis=0, return_inverse=True)
                within = []
                for i in range(3):
                    a, b = kinds[:, i, None] + 1, kinds[:, i + 1, None]
                    whole = (parent >= a) & (parent + FANOUT * count <= b) & (level < top)
                    within.append((first >= a) & (end <= b) & ~whole)
                used = np.flatnonzero(np.any(within, axis=(0, 1)))
                if not len(used):
                    continue
                middle, widest = (x[lo] + x[hi - 1]) / 2, h[lo:hi].max() + (x[hi - 1] - x[lo]) / 2
                moved = (_shifts(half[used] / widest, (centre[used] - middle) / widest, size) @ moments[used]).reshape(len(used), -1)
                added = [(w[:, used].astype(float) @ moved).reshape(-1, size, 2)[kind.reshape(-1)] for w in within]
                near = h[lo:hi]
                each = _shifts(widest / near, (middle - x[lo:hi]) / near, size) @ np.concatenate(added, axis=2)
                for i, signs in enumerate(((1, 3, 3, 1), (1, 0, 0, 0), (1, -3, 3, -1))):
                    for out, n, at in ((s, n_s, 2 * i), (t, n_t, 2 * i + 1)):
                        for j in range(n):
                            out[lo:hi, j] += near**j * sum(c * each[:, j + 3 * e, at] for e, c in enumerate(signs) if c)
        return pa.table({"_xd": x, "_y": y, "_h": h, **dict(zip(NEIGHBOURS, [*s.T, *t.T], strict=True))})

    return sums


def _lowess_exact(ranked: DataFrame, m: int, k: int, iterations: int, degree: int, rng: float, size: int) -> DataFrame:
    """Every row is fitted, in m log(m) work a round, from a tree of moments over the positions.

    A window is the positions within 0.999 h of its point (rows beyond the k nearest are at h or farther).  Positions
    are cut into leaves, and each node of the tree over them holds the moments of its points around its middle.  A chunk
    of consecutive points asks for the few leaves in which a window of its begins or ends and for the O(log m) nodes
    between them; both are joined by number, so a task holds one chunk and what it asks for, whatever the window.
    """
    top = max(0, math.ceil(math.log(max(size / LEAF, 1), FANOUT)))
    spread = _windows(ranked, m, k).select("_r", "_h")
    chunk = F.floor(F.col("_xd") / CHUNK).alias("_c")
    rows = ranked.join(spread, "_r").select("_xd", "_y", "_h", F.lit(1.0).alias("_rw"))
    rows = cut_lineage(rows.repartition(chunk).sortWithinPartitions("_xd"))  # neighbours together: a batch has few nodes
    asked = cut_lineage(rows.select("_xd", "_h", chunk).groupBy("_c").applyInArrow(_asked(top), "_c long, _level long, _node long"))
    names = [f"m{j}" for j in range(20 + 3 * degree)]
    for it in range(iterations + 1):
        partial = rows.select("_xd", "_y", "_rw").mapInArrow(_node_moments(top, degree), ", ".join(["_level long, _node long", *(f"{n} double" for n in names)]))
        nodes = partial.groupBy("_level", "_node").agg(*[F.sum(n).alias(n) for n in names]).select("_level", "_node", F.array(*names).alias("_v"))
        leaves = rows.select("_xd", "_y", "_rw").mapInArrow(_leaf_points, "_level long, _node long, _v array<double>")
        material = asked.join(nodes.unionByName(leaves), ["_level", "_node"]).select("_c", "_level", "_node", "_v")
        met = rows.select("_xd", "_y", "_h", chunk).groupBy("_c").cogroup(material.groupBy("_c"))
        fitted = met.applyInArrow(_fit_sums(top, degree), ", ".join(["_xd double, _y double, _h double", *(f"{n} double" for n in NEIGHBOURS)]))
        fits = cut_lineage(fitted.select("_xd", "_y", "_h", _local_fit(degree, rng).alias("_f")))
        if it == iterations:
            break
        residual = F.abs(F.col("_y") - F.col("_f"))
        weight = _robust_weight(fits.select(residual.alias("_e")), residual)
        if weight is None:
            break
        rows = fits.select("_xd", "_y", "_h", weight.alias("_rw"))
    return fits.select(F.col("_xd").cast("long").alias("_x"), F.col("_f").alias("_smooth"))


def _lowess_anchored(ranked: DataFrame, m: int, k: int, iterations: int, degree: int, rng: float, s: int) -> DataFrame:
    """Fits at every s-th rank (and the last), linear interpolation between.

    * window starts: g(L) = (x_L + x_{L+k}) / 2 is non-decreasing in L, so the
      start of anchor a is the number of L with g(L) < x_a -- one pass tags
      every L with how many anchors lie at or below g(L) and a histogram of
      those tags (at most G + 1 rows) gives all starts;
    * every row is exploded only to the anchors whose window contains it (a
      contiguous anchor range, found in the sorted start/end arrays), so the
      work is about G * k rows spread evenly over all tasks;
    * anchor parameters (x, radius) and fits travel as literal arrays.
    """
    anchor_ranks = list(range(0, m, s))
    if anchor_ranks[-1] != m - 1:
        anchor_ranks.append(m - 1)
    g_n = len(anchor_ranks)
    ax = {r["_r"]: r["_xd"] for r in ranked.where(F.col("_r").isin(anchor_ranks)).collect()}
    ax_list = [float(ax[r]) for r in anchor_ranks]
    xs_arr = F.array(*[F.lit(v) for v in ax_list])
    # window starts
    gtab = ranked.select(F.col("_r").alias("_L"), F.col("_xd").alias("_xL")).join(
        ranked.select((F.col("_r") - k).alias("_L"), F.col("_xd").alias("_xR")), "_L", "left"
    )
    g = (F.col("_xL") + F.col("_xR")) / 2
    tag = F.when(F.col("_xR").isNull(), F.lit(g_n)).otherwise(count_below(g, ax_list, strict=False))
    hist = dict(gtab.where(F.col("_L") <= m - 1).select(tag.alias("_A")).groupBy("_A").count().collect())
    starts, run = [], 0
    for a in range(g_n):
        run += hist.get(a, 0)
        starts.append(min(run, m - k))
    ends = [st + k - 1 for st in starts]
    edge = {r["_r"]: r["_xd"] for r in ranked.where(F.col("_r").isin(sorted(set(starts + ends)))).collect()}
    radius = [max(ax_list[a] - edge[starts[a]], edge[ends[a]] - ax_list[a]) for a in range(g_n)]
    h_arr = F.array(*[F.lit(float(v)) for v in radius])
    r = F.col("_r")
    a_hi = (count_below(r, starts, strict=False) - 1).cast("int")
    a_lo = count_below(r, ends).cast("int")
    span = F.when(a_lo <= a_hi, F.sequence(a_lo, a_hi)).otherwise(F.array().cast("array<int>"))
    x_a = F.element_at(xs_arr, F.col("_a") + 1)
    h_a = F.element_at(h_arr, F.col("_a") + 1)

    def members(rows: DataFrame) -> DataFrame:
        # each row meets only the anchors whose window holds it; robustness
        # weights are joined on the m rows before this explode, never after
        out = rows.select("*", F.explode(span).alias("_a"))
        return out.withColumn("_u", F.col("_xd") - x_a).withColumn("_tw", _tricube(F.abs(F.col("_u")) / h_a))

    seg = F.least((r / F.lit(s)).cast("int"), F.lit(g_n - 1))
    robust = None
    for it in range(iterations + 1):
        p = members(ranked if robust is None else ranked.join(robust, "_r"))
        w = F.col("_tw") if robust is None else F.col("_tw") * F.col("_rw")
        fits = {row["_a"]: row["_fit"] for row in _moment_sums(p, "_a", w, F.col("_u")).select("_a", _local_fit(degree, rng).alias("_fit")).collect()}
        fit_arr = F.array(*[F.lit(float(fits[a]) if fits.get(a) is not None else None).cast("double") for a in range(g_n)])
        a0 = seg
        a1 = F.least(seg + 1, F.lit(g_n - 1))
        x0, x1 = F.element_at(xs_arr, a0 + 1), F.element_at(xs_arr, a1 + 1)
        f0, f1 = F.element_at(fit_arr, a0 + 1), F.element_at(fit_arr, a1 + 1)
        t = F.try_divide(F.col("_xd") - x0, x1 - x0)
        interp = F.when(a0 == a1, f0).otherwise(f0 + t * (f1 - f0))
        row_fit = ranked.withColumn("_f", interp)
        if it == iterations:
            break
        residual = F.abs(F.col("_y") - F.col("_f"))
        weight = _robust_weight(row_fit.select(residual.alias("_e")), residual)
        if weight is None:
            break
        robust = cut_lineage(row_fit.select("_r", weight.alias("_rw")))
    return cut_lineage(row_fit.select(F.col("_xd").cast("long").alias("_x"), F.col("_f").alias("_smooth")))


def _local_fit(degree: int, x_range: float) -> Column:
    """Value at the anchor (u = 0) of the weighted polynomial fit."""
    s0, s1, s2, s3, s4 = (F.col(f"s{i}") for i in range(5))
    t0, t1, t2 = F.col("t0"), F.col("t1"), F.col("t2")
    mean = t0 / s0
    if degree == 1:
        # weighted line in u = x - x_anchor, evaluated at u = 0
        xbar = s1 / s0
        c = s2 / s0 - xbar * xbar  # weighted variance of u
        slope = (t1 / s0 - xbar * mean) / c
        fitv = mean - slope * xbar
        return F.when(F.sqrt(F.greatest(c, F.lit(0.0))) > F.lit(0.001 * x_range), fitv).otherwise(mean)
    # degree 2: solve the 3x3 normal equations by Cramer's rule
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)
    a0 = t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)
    return F.when(F.abs(det) > F.lit(1e-12), a0 / det).otherwise(mean)
