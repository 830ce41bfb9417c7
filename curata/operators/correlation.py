"""Correlation matrices (P5 Pearson, P7 Spearman, P8 Kendall tau-b).

All are pairwise-complete: each pair uses the rows where both values are
present.  Results are long form ``(col_a, col_b, r)`` with every ordered pair,
diagonal included.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions import numeric_column
from curata.functions.stats import pairwise_sums, running_sums, value_ranks

# Aggregate expressions per Spark job when many pairs are computed at once.
_AGGS_PER_JOB = 600


def _pearson_pairs(df: DataFrame, pairs: list[tuple[Column, Column]]) -> list[float | None]:
    """Pearson r for each (x, y) pair on the rows where both are present.

    Pass 1: per pair, the count and means over complete rows.  Pass 2: sums of
    products of mean-shifted values (plain ``sum`` buffers, stable thanks to
    the shift).  Many pairs share each pass.
    """
    out: list[float | None] = []
    per_job = max(1, _AGGS_PER_JOB // 6)
    for start in range(0, len(pairs), per_job):
        chunk = pairs[start : start + per_job]
        masks = [(x.isNotNull() & y.isNotNull(), x.cast("double"), y.cast("double")) for x, y in chunk]
        first = df.agg(
            *[
                e
                for i, (m, x, y) in enumerate(masks)
                for e in (F.count_if(m).alias(f"n{i}"), F.avg(F.when(m, x)).alias(f"mx{i}"), F.avg(F.when(m, y)).alias(f"my{i}"))
            ]
        ).first()
        exprs = []
        for i, (m, x, y) in enumerate(masks):
            mx, my = first[f"mx{i}"], first[f"my{i}"]
            if mx is None:
                continue
            dx = F.when(m, x - F.lit(float(mx)))
            dy = F.when(m, y - F.lit(float(my)))
            exprs += [
                F.sum(dx).alias(f"sx{i}"), F.sum(dy).alias(f"sy{i}"),
                F.sum(dx * dx).alias(f"xx{i}"), F.sum(dy * dy).alias(f"yy{i}"), F.sum(dx * dy).alias(f"xy{i}"),
            ]
        row = df.agg(*exprs).first() if exprs else None
        for i in range(len(chunk)):
            n = first[f"n{i}"]
            if not n or n < 2 or first[f"mx{i}"] is None:
                out.append(None)
                continue
            sx, sy = row[f"sx{i}"], row[f"sy{i}"]
            cxx = row[f"xx{i}"] - sx * sx / n
            cyy = row[f"yy{i}"] - sy * sy / n
            cxy = row[f"xy{i}"] - sx * sy / n
            if cxx <= 0 or cyy <= 0:
                out.append(None)
            else:
                out.append(max(-1.0, min(1.0, cxy / math.sqrt(cxx * cyy))))
    return out


def _long(spark, columns: Sequence[str], values: dict[tuple[str, str], float | None]) -> DataFrame:
    def val(a, b):
        v = values.get((a, b), values.get((b, a)))
        return None if v is None else float(v)

    rows = [(a, b, val(a, b)) for a in columns for b in columns]
    return spark.createDataFrame(rows, "col_a string, col_b string, r double")


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson matrix (P5) in two scans, whatever the number
    of columns; a column that is constant on a pair's rows gives NULL."""
    import numpy as np

    base = df.select(*[numeric_column(df, c).alias(f"_c{i}") for i, c in enumerate(columns)])
    means = base.agg(*[F.avg(f"_c{i}").alias(f"a{i}") for i in range(len(columns))]).first()
    n, x, xx, xy = pairwise_sums(base, list(means))
    values: dict[tuple[str, str], float | None] = {}
    for i, j in combinations_with_replacement(range(len(columns)), 2):
        k = n[i, j]
        cxx, cyy = (xx[i, j] - x[i, j] ** 2 / k, xx[j, i] - x[j, i] ** 2 / k) if k >= 2 else (0.0, 0.0)
        r = None
        if cxx > 1e-14 * xx[i, j] and cyy > 1e-14 * xx[j, i]:
            r = float(np.clip((xy[i, j] - x[i, j] * x[j, i] / k) / math.sqrt(cxx * cyy), -1.0, 1.0))
        values[(columns[i], columns[j])] = r
    return _long(df.sparkSession, columns, values)


def with_average_ranks(df: DataFrame, column: str, rank_col: str) -> DataFrame:
    """Add the average (tie-mean) rank of ``column`` among its non-NULL values."""
    ranks = value_ranks(df.select(F.col(f"`{column}`").cast("double").alias("_x")), "_x").select(
        F.col("_x").alias("_rx"), (F.col("_before") + (F.col("_cnt") + 1) / 2.0).alias(rank_col)
    )
    keyed = df.withColumn("_rx", F.col(f"`{column}`").cast("double"))
    return keyed.join(ranks, "_rx", "left").drop("_rx")


def spearman_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete Spearman matrix (P7): Pearson on average ranks.

    Every column is ranked once, whatever the number of pairs: one frame
    (column, value) holds how many rows a value has, and how many of them lack
    each column that has NULLs at all.  Running sums of these counts give the
    rank of a value among all rows and, less the rows that lack column b, its
    rank beside b.  The ranks go back to the rows by one join on (column,
    value), and the sums of all pairs come from one pass.
    """
    names = [f"_c{i}" for i in range(len(columns))]
    base = df.select(*[numeric_column(df, c).alias(n) for c, n in zip(columns, names, strict=True)])
    seen = base.agg(F.count(F.lit(1)).alias("n"), *[F.count(n).alias(n) for n in names]).first()
    gaps = [i for i, n in enumerate(names) if seen[n] < seen["n"]]  # columns that some row lacks
    lacks = [F.col(names[g]).isNull().cast("int").alias(f"_lack{g}") for g in gaps]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("_col"), F.col(n).alias("_v")) for i, n in enumerate(names)])).alias("_p")
    long = base.withColumn("_row", F.monotonically_increasing_id()).select("_row", *lacks, cells).select("_row", *[f"_lack{g}" for g in gaps], "_p.*")
    long = long.where(F.col("_v").isNotNull())
    sums = ["_n", *[f"_lack{g}" for g in gaps]]
    counted = long.groupBy("_col", "_v").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_lack{g}").alias(f"_lack{g}") for g in gaps])
    run = running_sums(counted, "_v", sums, by=["_col"])
    # average rank among all rows, then among those that have each column with gaps
    mean = lambda cum, n: cum - (n - 1) / 2.0
    among = [mean(F.col("_cum_n"), F.col("_n")), *[mean(F.col("_cum_n") - F.col(f"_cum_lack{g}"), F.col("_n") - F.col(f"_lack{g}")) for g in gaps]]
    ranks = run.select("_col", "_v", F.array(*among).alias("_r"))
    rows = long.select("_row", "_col", "_v").join(ranks, ["_col", "_v"]).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_col", "_r"))).alias("_m"))
    wide = rows.select(*[F.get(F.col("_m")[i], g).alias(f"r{i}_{g}") for i in range(len(columns)) for g in range(len(gaps) + 1)])
    place = {g: k + 1 for k, g in enumerate(gaps)}
    values: dict[tuple[str, str], float | None] = {}
    found = _rank_sums(wide, len(columns), place, float(seen["n"] or 0))
    for i, j in combinations_with_replacement(range(len(columns)), 2):
        n, si, sj, ii, jj, ij = found[i, j]
        cii, cjj = (ii - si * si / n, jj - sj * sj / n) if n >= 2 else (0.0, 0.0)
        if i == j:
            values[columns[i], columns[i]] = 1.0 if cii > 0 else None
        else:
            values[columns[i], columns[j]] = float(np.clip((ij - si * sj / n) / math.sqrt(cii * cjj), -1.0, 1.0)) if cii > 0 and cjj > 0 else None
    return _long(df.sparkSession, columns, values)


def _rank_sums(wide: DataFrame, p: int, place: dict[int, int], n: float) -> dict[tuple[int, int], tuple]:
    """For i <= j: rows, sums of the ranks of i beside j and of j beside i, of their squares and of their product.

    Ranks are halves, so around a whole middle all sums are exact up to 2^53 quarters.  One row a task and pair.
    """
    shift, width = float(int(n / 2)), len(place) + 1
    pairs = list(combinations_with_replacement(range(p), 2))

    def partial(batches):
        import pyarrow as pa

        total = np.zeros((len(pairs), 6))
        for batch in batches:
            r = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]).reshape(p, width, -1) - shift
            there = ~np.isnan(r[:, 0])
            for k, (i, j) in enumerate(pairs):
                on = there[i] & there[j]
                a, b = r[i, place.get(j, 0)][on], r[j, place.get(i, 0)][on]
                total[k] += len(a), a.sum(), b.sum(), a @ a, b @ b, a @ b
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs))), *[pa.array(c) for c in total.T]], ["k", *"nabcde"])

    rows = wide.mapInArrow(partial, "k long, n double, a double, b double, c double, d double, e double")
    out = dict.fromkeys(pairs, (0.0,) * 6)
    for r in rows.groupBy("k").agg(*[F.sum(c).alias(c) for c in "nabcde"]).collect():
        out[pairs[r["k"]]] = tuple(r[c] for c in "nabcde")
    return out


# --- Kendall tau-b --------------------------------------------------------------------

def weighted_inversions(rank: np.ndarray, w: np.ndarray) -> float:
    """Sum of w_i * w_j over pairs i < j with rank_i > rank_j.

    Bottom-up merge counting, vectorised per level: at width s every element
    of a right half looks up (binary search on keys pair * M + rank) the
    weight of larger ranks in its left half.  O(n log^2 n), no row loop.
    """
    n = len(rank)
    if n < 2:
        return 0.0
    rank = rank.astype(np.int64)
    m = int(rank.max()) + 1
    idx = np.arange(n, dtype=np.int64)
    total = 0.0
    s = 1
    while s < n:
        pair = idx // (2 * s)
        left = (idx // s) % 2 == 0
        lk = pair[left] * m + rank[left]
        order = np.argsort(lk, kind="stable")
        keys = lk[order]
        csum = np.concatenate([[0.0], np.cumsum(w[left][order])])
        rp, rr, rw = pair[~left], rank[~left], w[~left]
        start = np.searchsorted(keys, rp * m, side="left")
        end = np.searchsorted(keys, (rp + 1) * m, side="left")
        upto = np.searchsorted(keys, rp * m + rr, side="right")
        total += float(np.dot(rw, csum[end] - csum[upto]))
        s *= 2
    return total


def _discordant(pdf: pd.DataFrame) -> pd.DataFrame:
    """Weighted discordant pairs inside one block of (x, y, w) rows."""
    if len(pdf) < 2:
        return pd.DataFrame({"d": [0.0]})
    pdf = pdf.sort_values(["x", "y"], kind="mergesort")
    y = pdf["y"].to_numpy()
    ranks = np.searchsorted(np.unique(y), y)  # dense rank of y
    return pd.DataFrame({"d": [weighted_inversions(ranks, pdf["w"].to_numpy(dtype=np.float64))]})


_KENDALL_GROUP_ROWS = 200_000  # distinct (x, y) rows one task counts directly
_KENDALL_SUB_BLOCKS = 64


def _grouped_discordant(df: DataFrame, keys: list[str], limit: int = _KENDALL_GROUP_ROWS, blocks: int = _KENDALL_SUB_BLOCKS, depth: int = 0) -> DataFrame:
    """Weighted discordant pairs per group of ``keys`` over rows (keys, x, y, w).

    Groups up to ``limit`` rows are counted inside one ``applyInPandas`` task
    each; groups with a single x or a single y value have none.  Larger groups
    are split by their own value blocks of x and y (quantile-sketch cuts, a
    cut value keeping a block of its own): pairs in different x- and y-blocks
    come from the group's block-count matrix, pairs sharing a block from this
    same function applied to the block groups -- so no task ever holds more
    than ``limit`` rows or one group's block matrix.
    """
    kc = [F.col(k) for k in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys) + ", d double"

    def count_group(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _discordant(pdf[["x", "y", "w"]])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "d"]]

    largest = df.groupBy(*kc).count().agg(F.max("count")).first()[0] or 0
    if largest <= limit:  # every group fits one task
        return df.groupBy(*kc).applyInPandas(count_group, schema)
    sizes = df.groupBy(*kc).agg(
        F.count(F.lit(1)).alias("_n"),
        (F.min("x") == F.max("x")).alias("_one_x"),
        (F.min("y") == F.max("y")).alias("_one_y"),
    )
    small_keys = sizes.where(F.col("_n") <= limit).select(*kc)
    flat = sizes.where((F.col("_n") > limit) & (F.col("_one_x") | F.col("_one_y"))).select(*kc, F.lit(0.0).alias("d"))
    big_keys = sizes.where((F.col("_n") > limit) & ~F.col("_one_x") & ~F.col("_one_y")).select(*kc)
    small = df.join(small_keys, keys, "left_semi").groupBy(*kc).applyInPandas(count_group, schema)
    result = small.unionByName(flat)
    # split every large group by its own value blocks
    from curata.functions.stats import _stable

    probs = [i / blocks for i in range(1, blocks)]
    big = df.join(big_keys, keys, "left_semi")
    cuts = _stable(big.groupBy(*kc).agg(
        F.array_sort(F.array_distinct(F.percentile_approx("x", probs, 10_000))).alias("_qx"),
        F.array_sort(F.array_distinct(F.percentile_approx("y", probs, 10_000))).alias("_qy"),
    ))

    def block(v: str, q: str) -> Column:
        return F.size(F.filter(q, lambda c: c < F.col(v))) * 2 + F.array_contains(F.col(q), F.col(v)).cast("int")

    kind, k1, k2 = f"_kind{depth}", f"_k1_{depth}", f"_k2_{depth}"
    tagged = big.join(cuts, keys).withColumn("_xb", block("x", "_qx")).withColumn("_yb", block("y", "_qy")).drop("_qx", "_qy")

    def cross_group(pdf: pd.DataFrame) -> pd.DataFrame:
        nx, ny = int(pdf["_xb"].max()) + 1, int(pdf["_yb"].max()) + 1
        mat = np.zeros((nx, ny))
        np.add.at(mat, (pdf["_xb"].to_numpy(), pdf["_yb"].to_numpy()), pdf["w"].to_numpy())
        below = np.cumsum(np.cumsum(mat[::-1, :], axis=0)[::-1, :], axis=1)
        out = pd.DataFrame({"d": [float((mat[:-1, 1:] * below[1:, :-1]).sum())]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "d"]]

    cells = tagged.groupBy(*kc, "_xb", "_yb").agg(F.sum("w").alias("w"))
    cross = cells.groupBy(*kc).applyInPandas(cross_group, schema)
    kinds = F.array(
        F.struct(F.lit(0).alias(kind), F.col("_xb").alias(k1), F.lit(0).alias(k2)),
        F.struct(F.lit(1).alias(kind), F.col("_yb").alias(k1), F.lit(0).alias(k2)),
        F.struct(F.lit(2).alias(kind), F.col("_xb").alias(k1), F.col("_yb").alias(k2)),
    )
    split = tagged.select(*kc, "x", "y", "w", F.explode(kinds).alias("_g")).select(*kc, "x", "y", "w", "_g.*")
    inner = _grouped_discordant(split, [*keys, kind, k1, k2], limit, blocks, depth + 1)
    signed = F.when(F.col(kind) == 2, -F.col("d")).otherwise(F.col("d"))
    within = inner.groupBy(*kc).agg(F.sum(signed).alias("_w"))
    big_d = cross.join(within, keys, "left").select(*kc, (F.col("d") + F.coalesce("_w", F.lit(0.0))).alias("d"))
    return result.unionByName(big_d)


def _kendall_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], group_rows: int, blocks: int | None = None) -> dict[tuple[str, str], float | None]:
    """tau-b of every pair on its complete rows, all pairs in one frame keyed by pair.

    Rows collapse to distinct (pair, x, y, w), written once.  Two tied rows
    share an x or a y, so pairs of rows that are neither come from group sums
    and the discordant ones from ``_grouped_discordant``: the number of jobs
    does not depend on the number of pairs.
    """
    from curata.session import cut_lineage

    if not pairs:
        return {}
    base = df.select(*[numeric_column(df, c).alias(c) for c in dict.fromkeys(c for p in pairs for c in p)])
    items = [F.struct(F.lit(k).alias("pid"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")) for k, (a, b) in enumerate(pairs)]
    long = base.select(F.explode(F.array(*items)).alias("_p")).select("_p.*").where(F.col("x").isNotNull() & F.col("y").isNotNull())
    xy = cut_lineage(long.groupBy("pid", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")))
    pairs_of = lambda w: F.sum(F.col(w) * (F.col(w) - 1) / 2)
    # rows alike in x, in y and in both, in one pass each over the distinct rows
    whole = xy.groupBy("pid").agg(F.sum("w").alias("n"), pairs_of("w").alias("n3"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("key")), F.struct(F.lit(1).alias("side"), F.col("y").alias("key")))).alias("t")
    alike = xy.select("pid", "w", sides).groupBy("pid", "t.side", "t.key").agg(F.sum("w").alias("t"))
    ties = alike.groupBy("pid").agg(*[F.sum(F.when(F.col("side") == s, F.col("t") * (F.col("t") - 1) / 2)).alias(f"n{s + 1}") for s in (0, 1)])
    apart = _grouped_discordant(xy, ["pid"], group_rows, max(2, blocks or _KENDALL_SUB_BLOCKS)).groupBy("pid").agg(F.sum("d").alias("d"))
    out: dict[tuple[str, str], float | None] = dict.fromkeys(pairs)
    for r in whole.join(ties, "pid").join(apart, "pid", "left").collect():
        n0 = r["n"] * (r["n"] - 1) / 2
        spread = (n0 - r["n1"]) * (n0 - r["n2"])
        if r["n"] >= 2 and spread > 0:
            out[pairs[r["pid"]]] = (n0 - r["n1"] - r["n2"] + r["n3"] - 2 * (r["d"] or 0.0)) / math.sqrt(spread)
    return out


def kendall_tau(df: DataFrame, a: str, b: str, blocks: int | None = None, group_rows: int = _KENDALL_GROUP_ROWS) -> float | None:
    """Kendall tau-b of two columns on their complete rows (P8), exact; ``blocks`` value blocks split a pair of more than ``group_rows`` rows."""
    return _kendall_pairs(df, [(a, b)], group_rows, blocks)[a, b]


def kendall_matrix(df: DataFrame, columns: Sequence[str], group_rows: int = _KENDALL_GROUP_ROWS) -> DataFrame:
    """Pairwise-complete Kendall tau-b matrix (P8): all pairs at once, no cross join, no task above ``group_rows`` rows."""
    values = _kendall_pairs(df, list(combinations(columns, 2)), group_rows)
    return _long(df.sparkSession, columns, values | {(c, c): 1.0 for c in columns})


def correlation_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    method = method.lower()
    if method == "pearson":
        return pearson_matrix(df, columns)
    if method == "spearman":
        return spearman_matrix(df, columns)
    if method == "kendall":
        return kendall_matrix(df, columns)
    raise ValueError(f"unsupported correlation method {method!r}")
