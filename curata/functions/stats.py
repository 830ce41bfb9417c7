"""Distributed building blocks for statistics that Spark's built-ins would run
in a single task: exact quantiles, most-frequent values, per-group top-k,
global row positions and running totals.

None of these hold a whole group (or a whole column) in one task or on the
driver.  A group may be as large as a third of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def _stable(df: DataFrame) -> DataFrame:
    """Write a small derived table once to the shared checkpoint folder."""
    from curata.session import cut_lineage

    return cut_lineage(df)


def unpivot_values(df: DataFrame, columns: Sequence[str], value: Column | None = None) -> DataFrame:
    """Long form ``(_col, _v)`` of ``columns`` cast to DOUBLE (one row per cell)."""
    pairs = [F.struct(F.lit(c).alias("_col"), F.col(f"`{c}`").cast("double").alias("_v")) for c in columns]
    return df.select(F.explode(F.array(*pairs)).alias("_p")).select("_p._col", "_p._v")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the key columns come from ``left``."""
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    renamed = right.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in right.columns])
    cond = F.lit(True)
    for k, n in names.items():
        cond = cond & left[f"`{k}`"].eqNullSafe(renamed[n])
    return left.join(renamed, cond, how).drop(*names.values())


def _running(rows: DataFrame, by: Sequence[str], value: str, sums: Sequence[str], parts: int | None) -> DataFrame:
    """Adds ``_before<name>`` (total of ``name`` over the group's smaller values) and
    ``_all<name>`` (over the group) for each of ``sums``; one row per (group, value).

    Rows are range-partitioned by (group, value) and written once, so a group
    may span any number of partitions; a window runs inside each (partition,
    group) only, and one total per (partition, group) gives the offsets.
    """
    keys = _cols(by)
    order = [*keys, F.col(f"`{value}`")]
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    ranged = _stable(ranged.withColumn("_pid", F.spark_partition_id()))
    inside = Window.partitionBy("_pid", *keys).orderBy(F.col(f"`{value}`").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(f"`{n}`").over(inside), F.lit(0)).alias(f"_in{i}") for i, n in enumerate(sums)])
    totals = ranged.groupBy("_pid", *keys).agg(*[F.sum(f"`{n}`").alias(f"_t{i}") for i, n in enumerate(sums)])
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_pid",
        *keys,
        *[F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_off{i}") for i in range(len(sums))],
        *[F.sum(f"_t{i}").over(group).alias(f"_all{n}") for i, n in enumerate(sums)],
    )
    out = null_safe_join(local, offsets, ["_pid", *by])
    for i, n in enumerate(sums):
        out = out.withColumn(f"_before{n}", F.col(f"_off{i}") + F.col(f"_in{i}")).drop(f"_off{i}", f"_in{i}")
    return out.drop("_pid")


def exact_percentiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    names: Sequence[str] | None = None,
    buckets: int | None = None,
    counted: str | None = None,
) -> DataFrame:
    """Exact type-7 (linear interpolation) percentiles of ``value`` per group.

    Returns one row per group of ``by`` (NULL keys are a group) with one DOUBLE
    column per probability (``names`` or ``p0, p1, ...``).  NULLs and NaN are
    ignored; a group without values gets NULLs.  Rows collapse to distinct
    ``(group, value, count)`` first (map-side combine); ``_running`` gives each
    value its ranks, and the wanted ranks are picked by an aggregate per group.
    ``buckets``: number of range partitions (default: the session's).
    ``counted``: column with the rows of each (group, value), where the frame
    already holds each of them once.
    """
    by = list(by)
    names = list(names) if names is not None else [f"p{i}" for i in range(len(probs))]
    whole = not by
    if whole:  # one group: a constant key keeps a single code path
        df = df.withColumn("_g", F.lit(0))
        by = ["_g"]
    v = F.col(f"`{value}`").cast("double")
    # rows without a value stay in with no weight, so that their group comes out
    there = F.when(~F.isnan(v), v).alias("_v")
    if counted is None:
        values = df.select(*_cols(by), there).groupBy(*_cols(by), "_v").agg(F.count("_v").alias("_n"))
    else:
        values = df.select(*_cols(by), there, F.when(v.isNotNull(), F.col(f"`{counted}`")).otherwise(0).alias("_n"))
    ranked = _running(values, by, "_v", ["_n"], buckets)
    present, start, stop = F.col("_v").isNotNull(), F.col("_before_n"), F.col("_before_n") + F.col("_n")
    aggs = []
    for p, name in zip(probs, names, strict=True):
        h = (F.col("_all_n") - 1).cast("double") * F.lit(float(p))
        at = lambda r: F.max(F.when(present & (start <= r) & (r < stop), F.col("_v")))
        lo, hi, hh = at(F.floor(h)), at(F.ceil(h)), F.max(h)
        frac = hh - F.floor(hh)
        aggs.append(F.when(frac == 0, lo).otherwise((1 - frac) * lo + frac * hi).alias(name))
    out = ranked.groupBy(*_cols(by)).agg(*aggs)
    if whole:
        return df.sparkSession.range(1).select(F.lit(0).alias("_g")).join(out, by, "left").drop("_g")
    return out


def global_percentiles(df: DataFrame, value: str, probs: Sequence[float]) -> list[float | None]:
    """Exact percentiles of a whole column as Python floats (a few scalars)."""
    row = exact_percentiles(df, value, probs).first()
    return [None if row is None else row[i] for i in range(len(probs))]


def top_k_per_group(
    counts: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    k: int,
    salt_on: str,
    salts: int = 64,
) -> DataFrame:
    """Exact top-``k`` rows per group of an already aggregated frame.

    A first ``row_number`` runs inside ``(group, hash(salt_on) % salts)`` so a
    group with many rows is split over ``salts`` tasks; the global top-k of the
    group is always inside the union of the per-salt top-k, which is at most
    ``k * salts`` rows per group for the second ``row_number``.
    """
    by_cols = _cols(by)
    salted = counts.withColumn("_salt", F.pmod(F.xxhash64(F.col(f"`{salt_on}`")), F.lit(salts)))
    w1 = Window.partitionBy(*by_cols, F.col("_salt")).orderBy(*order)
    first = salted.withColumn("_rk", F.row_number().over(w1)).where(F.col("_rk") <= k).drop("_rk", "_salt")
    w2 = Window.partitionBy(*by_cols).orderBy(*order)
    return first.withColumn("_rank", F.row_number().over(w2)).where(F.col("_rank") <= k)


def most_frequent(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent non-NULL value per group; ties go to the smallest value.

    ``groupBy(value).count()`` then a ``min(struct(-count, value))`` aggregate:
    both steps combine map-side, so a hot group never sits in one task.
    Returns ``by..., mode, mode_count``.
    """
    by_cols = _cols(by)
    counted = (
        df.where(F.col(f"`{value}`").isNotNull())
        .groupBy(*by_cols, F.col(f"`{value}`").alias("_val"))
        .agg(F.count(F.lit(1)).alias("_cnt"))
    )
    best = F.min(F.struct((-F.col("_cnt")).alias("neg"), F.col("_val").alias("val"))).alias("_best")
    res = counted.groupBy(*by_cols).agg(best) if by else counted.agg(best)
    return res.select(*by_cols, F.col("_best.val").alias("mode"), (-F.col("_best.neg")).alias("mode_count"))


def with_position(df: DataFrame, order_by: Sequence[str], name: str = "_pos") -> DataFrame:
    """Attach a global 0-based row position following ``order_by``; ties follow
    the other (orderable) columns, so the partitioning never matters.

    The frame is range-partitioned and sorted by the order keys and written to
    the shared checkpoint folder, so every later job sees the same partitions
    (also after an executor loss).  Rows per partition (one row a partition,
    at most the session's shuffle partitions) become offsets; the in-partition
    index is the lower part of ``monotonically_increasing_id``.
    """
    from curata.session import cut_lineage

    keys = _cols(order_by)
    ties = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name not in order_by and f.dataType.typeName() not in ("map", "variant")]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys, *ties)
    placed = cut_lineage(
        ranged.withColumns({"_pid": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    )
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    # one row a partition: small enough for every task by construction
    return placed.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_off") + F.col("_row")).drop("_pid", "_row", "_off")


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Running counts over value order: one row per distinct non-NULL value with
    ``_cnt`` (its rows) and ``_before`` (rows of the group with a smaller value).

    Average 1-based rank of the value = ``_before + (_cnt + 1) / 2``.  NULL keys
    are a group.  Same plan as ``exact_percentiles``.
    """
    by = list(by)
    v = F.col(f"`{value}`").cast("double")
    keys = by or ["_g"]
    counted = (
        df.select(*(_cols(by) or [F.lit(0).alias("_g")]), v.alias(value))
        .where(F.col(f"`{value}`").isNotNull() & ~F.isnan(f"`{value}`"))
        .groupBy(*_cols(keys), f"`{value}`")
        .agg(F.count(F.lit(1)).alias("_cnt"))
    )
    out = _running(counted, keys, value, ["_cnt"], buckets)
    return out.select(*_cols(by), F.col(f"`{value}`"), "_cnt", F.col("_before_cnt").alias("_before"))


def running_sums(
    df: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (), buckets: int | None = None, totals: bool = False
) -> DataFrame:
    """Inclusive running totals of ``sums`` over ``value`` order per group.

    ``df`` must hold one row per (group, value).  Adds ``_cum<name>`` for each
    name in ``sums`` and, with ``totals``, the group's ``_all<name>``.  NULL keys are a group.  Same plan as ``exact_percentiles``.
    """
    keys = list(by) or ["_g"]
    rows = df if by else df.withColumn("_g", F.lit(0))
    out = _running(rows, keys, value, list(sums), buckets)
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"`_before{s}`") + F.col(f"`{s}`")).alias(f"_cum{s}") for s in sums],
        *[F.col(f"`_all{s}`") for s in sums if totals],
    )


def solve_normal(sxx, sxy):
    """Least-squares coefficients and rank from centred (co)variance sums.

    Solved on the correlation scale, so features of any width count alike;
    constant features get 0 and exact collinearity the minimum-norm solution
    on that scale (predictions do not depend on it).
    """
    import numpy as np

    scale = np.sqrt(np.clip(np.diag(sxx), 0.0, None))
    on = np.flatnonzero(scale > 0)
    beta = np.zeros(len(scale))
    if not len(on):
        return beta, 0
    corr = sxx[np.ix_(on, on)] / np.outer(scale[on], scale[on])
    beta[on] = np.linalg.pinv(corr, rcond=1e-10, hermitian=True) @ (sxy[on] / scale[on]) / scale[on]
    return beta, int(np.linalg.matrix_rank(corr, tol=1e-10 * len(on), hermitian=True))


def comoments(df: DataFrame, exprs: Sequence[Column], complete: bool = True, non_null: list | None = None):
    """(n, means, sample covariance matrix) of column expressions, in two
    passes: means (and the row count), then the products of the mean-shifted
    values (``pairwise_sums``), numerically stable because of the shift.

    With ``complete`` only rows where every expression is non-NULL are used.
    ``non_null``, when given, receives each expression's non-NULL count from
    the first pass.
    """
    import numpy as np

    p = len(exprs)
    cols = [e.cast("double").alias(f"_m{i}") for i, e in enumerate(exprs)]
    sub = df.select(*cols)
    if complete:
        cond = F.lit(True)
        for i in range(p):
            cond = cond & F.col(f"_m{i}").isNotNull()
        sub = sub.where(cond)
    first = sub.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f"_m{i}").alias(f"a{i}") for i in range(p)],
        *[F.count(f"_m{i}").alias(f"c{i}") for i in range(p)],
    ).first()
    n = first["n"]
    if non_null is not None:
        non_null.extend(first[f"c{i}"] for i in range(p))
    means = np.array([np.nan if first[f"a{i}"] is None else first[f"a{i}"] for i in range(p)])
    if n == 0:
        return 0, means, np.full((p, p), np.nan)
    _, x, _, xy = pairwise_sums(sub, means)
    s = np.diag(x)
    cov = (xy - np.outer(s, s) / n) / (n - 1) if n > 1 else np.full((p, p), np.nan)
    return n, means + s / n, cov


def pairwise_sums(df: DataFrame, means: Sequence[float]):
    """For DOUBLE columns, four p x p arrays over the rows where columns i and j
    are both present, values less ``means``: their number, the sum of i, the sum
    of i squared and the sum of i times j.

    One scan whatever the number of columns: every task multiplies its batches
    as matrices and returns p * p partial sums.
    """
    import numpy as np

    p = len(df.columns)
    shift = np.array([0.0 if m is None or np.isnan(m) else float(m) for m in means])

    def partial(batches):
        import pyarrow as pa

        total = np.zeros((4, p, p))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            there = ~np.isnan(x)
            z = np.where(there, x - shift, 0.0)
            m = there.astype(float)
            total += np.stack([m.T @ m, z.T @ m, (z * z).T @ m, z.T @ z])
        i, j = np.indices((p, p)).reshape(2, -1)
        names = ["i", "j", "n", "x", "xx", "xy"]
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *[pa.array(t.reshape(-1)) for t in total]], names)

    rows = df.mapInArrow(partial, "i long, j long, n double, x double, xx double, xy double")
    out = np.zeros((4, p, p))
    for r in rows.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "xx", "xy")]).collect():
        out[:, r["i"], r["j"]] = r["n"], r["x"], r["xx"], r["xy"]
    return out
