import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curata.operators import reduce as red
from curata.operators import smoothing
from tests.conftest import rows


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(21)
    n = 300
    x1 = rng.normal(size=n)
    x2 = 2 * x1 + rng.normal(scale=0.01, size=n)
    x3 = rng.normal(size=n)
    x4 = rng.normal(size=n)
    y = 3 * x1 - 2 * x3 + rng.normal(scale=0.5, size=n)
    pdf = pd.DataFrame({"y": y, "x1": x1, "x2": x2, "x3": x3, "x4": x4, "c": rng.choice(["u", "v"], n)})
    return spark.createDataFrame(pdf), pdf


def test_pca_matches_numpy(wide):
    df, pdf = wide
    num = pdf[["y", "x1", "x2", "x3", "x4"]].to_numpy()
    z = (num - num.mean(0)) / num.std(0, ddof=1)
    vals, vecs = np.linalg.eigh(np.corrcoef(num, rowvar=False))
    order = np.argsort(vals)[::-1]
    vals, vecs = vals[order], vecs[:, order]
    k = int(np.argmax(np.cumsum(vals) / vals.sum() >= 0.9)) + 1
    out = red.pca_reduce(df, 0.9)
    assert out.columns == [f"PC{i + 1}" for i in range(k)] + ["c"]
    got = np.array([[r[f"PC{i + 1}"] for i in range(k)] for r in out.collect()])
    exp = z @ vecs[:, :k]
    assert np.allclose(np.abs(got), np.abs(exp), atol=1e-8)


def aic(pdf, target, cols):
    X = np.column_stack([np.ones(len(pdf))] + [pdf[c] for c in cols])
    beta, *_ = np.linalg.lstsq(X, pdf[target], rcond=None)
    rss = float(((pdf[target] - X @ beta) ** 2).sum())
    return len(pdf) * math.log(rss / len(pdf)) + 2 * np.linalg.matrix_rank(X)


def step_ref(pdf, target, feats, direction):
    cur = [] if direction == "forward" else list(feats)
    cur_aic = aic(pdf, target, cur)
    while True:
        cands = []
        if direction in ("backward", "both"):
            cands += [[c for c in cur if c != d] for d in cur]
        if direction in ("forward", "both"):
            cands += [cur + [a] for a in feats if a not in cur]
        if not cands:
            return cur
        best = min(cands, key=lambda c: aic(pdf, target, c))
        if not aic(pdf, target, best) < cur_aic - 1e-7:
            return cur
        cur, cur_aic = best, aic(pdf, target, best)


@pytest.mark.parametrize("direction", ["forward", "backward", "both"])
def test_stepwise_matches_reference(wide, direction):
    df, pdf = wide
    feats = ["x1", "x2", "x3", "x4"]
    out = red.stepwise(df.drop("c"), "y", direction)
    assert out.columns == ["y"] + step_ref(pdf, "y", feats, direction)


def test_rank_select_and_collinear(wide):
    df, pdf = wide
    sc = red.feature_scores(df, "y")
    assert [f for f, _ in sc][:2] == ["x1", "x2"] or [f for f, _ in sc][:2] == ["x2", "x1"]
    assert red.rank_select(df, "y", 2, "forward").columns == [f for f, _ in sc][:2]
    assert len(red.rank_select(df, "y", 10, "backward").columns) == 1
    assert red.collinear_columns(df, 0.95, "pearson", "first") == ["x1"]
    assert red.collinear_columns(df, 0.95, "pearson", "last") == ["x2"]
    assert "x2" not in red.drop_collinear(df, 0.95, "spearman", "last").columns
    assert red.collinear_columns(df, 0.95, "kendall", "first") == ["x1"]


@pytest.fixture(scope="module")
def series(spark):
    y = [float(v) for v in np.sin(np.arange(23) / 3.0).round(3)]
    for i in (3, 10, 11, 12, 13, 14):
        y[i] = None
    return spark.createDataFrame([(i, y[i]) for i in range(23)], "pos bigint, y double"), y


def test_bin_means(series):
    df, y = series
    got = dict(rows(smoothing.bin_means(df, "y", ["pos"], 5), "pos", "y"))
    for start in range(0, 23, 5):
        vals = [v for v in y[start : start + 5] if v is not None]
        for p in range(start, min(start + 5, 23)):
            if vals:
                assert got[p] == pytest.approx(np.mean(vals))
            else:
                assert got[p] is None
    assert got[10] is None  # the all-NULL bin


def test_linear_trend_fills_all(series):
    df, y = series
    xs = np.array([i for i, v in enumerate(y) if v is not None], float)
    ys = np.array([v for v in y if v is not None])
    b, a = np.polyfit(xs, ys, 1)
    got = dict(rows(smoothing.linear_trend(df, "y", ["pos"]), "pos", "y"))
    assert got[3] == pytest.approx(a + b * 3) and got[22] == pytest.approx(a + b * 22)


def lowess_ref(x, y, frac, iters, degree=1):
    n = len(x)
    k = max(2, min(n, int(math.floor(frac * n + 1e-10))))
    rw = np.ones(n)
    fit = np.zeros(n)
    rng = x[-1] - x[0]
    for it in range(iters + 1):
        left = 0
        for i in range(n):
            while left + k < n and x[i] > (x[left] + x[left + k]) / 2:
                left += 1
            xs, ys = x[left : left + k], y[left : left + k]
            h = max(x[i] - x[left], x[left + k - 1] - x[i])
            d = np.abs(xs - x[i]) / h
            w = np.where(d <= 0.001, 1.0, np.where(d > 0.999, 0.0, (1 - d**3) ** 3)) * rw[left : left + k]
            u = xs - x[i]
            if degree == 1:
                sw = w.sum()
                xm, ym = (w * u).sum() / sw, (w * ys).sum() / sw
                c = (w * u * u).sum() / sw - xm * xm
                fit[i] = ym - ((w * u * ys).sum() / sw - xm * ym) / c * xm if math.sqrt(max(c, 0)) > 0.001 * rng else ym
            else:
                A = np.column_stack([np.ones(k), u, u * u])
                W = np.diag(w)
                fit[i] = np.linalg.solve(A.T @ W @ A, A.T @ W @ ys)[0]
        if it == iters:
            break
        e = np.abs(y - fit)
        cmad = 6 * np.median(e)
        q = e / cmad
        rw = np.where(q <= 0.001, 1.0, np.where(q > 0.999, 0.0, (1 - q * q) ** 2))
    return fit


def test_lowess_exact_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    n = 80
    y = np.sin(np.arange(n) / 8.0) + rng.normal(scale=0.3, size=n)
    y[[5, 6, 40]] = np.nan
    y[20] = 6.0  # an outlier for the robustness rounds
    df = spark.createDataFrame(pd.DataFrame({"pos": np.arange(n), "y": y}))
    got = dict(rows(smoothing.lowess(df, "y", ["pos"]), "pos", "y"))
    mask = ~np.isnan(y)
    exp = lowess_ref(np.arange(n)[mask].astype(float), y[mask], 0.3, 3)
    assert [got[i] for i in (5, 6, 40)] == [None, None, None]
    assert np.allclose([got[i] for i in np.arange(n)[mask]], exp, atol=1e-9)
    got2 = dict(rows(smoothing.lowess(df, "y", ["pos"], frac=0.75, iterations=0, degree=2), "pos", "y"))
    exp2 = lowess_ref(np.arange(n)[mask].astype(float), y[mask], 0.75, 0, degree=2)
    assert np.allclose([got2[i] for i in np.arange(n)[mask]], exp2, atol=1e-8)


@pytest.mark.parametrize(("frac", "iters", "degree"), [(0.3, 1, 1), (0.02, 0, 1), (0.6, 0, 2)])
def test_lowess_over_many_leaves_and_gaps(spark, frac, iters, degree):
    """Several chunks, long gaps between fitted rows, windows of many nodes and of less than a leaf."""
    rng = np.random.default_rng(3)
    n = 5200
    y = np.sin(np.arange(n) / 300.0) + rng.normal(scale=0.2, size=n)
    y[1100:2900] = np.nan
    y[rng.random(n) < 0.2] = np.nan
    y[4000:4003] = 40.0
    df = spark.createDataFrame(pd.DataFrame({"pos": np.arange(n), "y": y})).repartition(5)
    mask = ~np.isnan(y)
    got = dict(rows(smoothing.lowess(df, "y", ["pos"], frac=frac, iterations=iters, degree=degree), "pos", "y"))
    exp = lowess_ref(np.arange(n)[mask].astype(float), y[mask], frac, iters, degree)
    assert np.allclose([got[i] for i in np.arange(n)[mask]], exp, atol=1e-7)


def test_canonical_nodes_cover_each_leaf_once():
    for a in range(0, 40):
        for b in range(a, 90):
            found = smoothing._canonical(a, b, 3)
            leaves = [i for level, n in found for i in range(n * 4**level, (n + 1) * 4**level)]
            assert sorted(leaves) == list(range(a, b))


def test_lowess_anchored_interpolates(spark):
    rng = np.random.default_rng(6)
    n = 300
    y = np.cos(np.arange(n) / 20.0) + rng.normal(scale=0.05, size=n)
    y[[10, 11, 150]] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"pos": np.arange(n), "y": y}))
    mask = ~np.isnan(y)
    exact = lowess_ref(np.arange(n)[mask].astype(float), y[mask], 0.3, 3)
    approx = dict(rows(smoothing.lowess(df, "y", ["pos"], anchor_every=7), "pos", "y"))
    got = np.array([approx[i] for i in np.arange(n)[mask]])
    assert np.max(np.abs(got - exact)) < 0.02
    # anchor rows themselves are fitted exactly when there are no robustness rounds
    exact0 = lowess_ref(np.arange(n)[mask].astype(float), y[mask], 0.3, 0)
    a0 = dict(rows(smoothing.lowess(df, "y", ["pos"], iterations=0, anchor_every=7), "pos", "y"))
    xs = np.arange(n)[mask]
    for rank in range(0, len(xs), 7):
        assert a0[xs[rank]] == pytest.approx(exact0[rank], abs=1e-9)


def test_pca_rejects_nulls_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (2.0, 5.0)], "a double, b double")
    with pytest.raises(ValueError):
        red.pca_reduce(df)
    const = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "a double, b double")
    with pytest.raises(ValueError):
        red.pca_reduce(const)


def _design(pdf, cols):
    mats = [np.ones((len(pdf), 1))]
    for c in cols:
        if pdf[c].dtype == object:
            levels = sorted(pdf[c].unique())
            mats.append(np.column_stack([(pdf[c] == lv).astype(float) for lv in levels[1:]]))
        else:
            mats.append(pdf[[c]].to_numpy(float))
    return np.hstack(mats)


def _aic_groups(pdf, target, cols):
    X = _design(pdf, cols)
    beta, *_ = np.linalg.lstsq(X, pdf[target], rcond=None)
    rss = float(((pdf[target] - X @ beta) ** 2).sum())
    return len(pdf) * math.log(rss / len(pdf)) + 2 * np.linalg.matrix_rank(X)


@pytest.mark.parametrize("direction", ["forward", "backward", "both"])
def test_stepwise_with_text_predictor(spark, direction):
    rng = np.random.default_rng(31)
    n = 240
    grp = rng.choice(["a", "b", "c"], n)
    x1 = rng.normal(size=n)
    noise = rng.normal(size=n)
    y = 2 * x1 + np.select([grp == "a", grp == "b"], [0.0, 3.0], -2.0) + rng.normal(scale=0.5, size=n)
    pdf = pd.DataFrame({"y": y, "x1": x1, "noise": noise, "grp": grp})
    feats = ["x1", "noise", "grp"]
    cur = [] if direction == "forward" else list(feats)
    cur_aic = _aic_groups(pdf, "y", cur)
    while True:
        cands = []
        if direction in ("backward", "both"):
            cands += [[c for c in cur if c != d] for d in cur]
        if direction in ("forward", "both"):
            cands += [cur + [a] for a in feats if a not in cur]
        if not cands:
            break
        best = min(cands, key=lambda c: _aic_groups(pdf, "y", c))
        if not _aic_groups(pdf, "y", best) < cur_aic - 1e-7:
            break
        cur, cur_aic = best, _aic_groups(pdf, "y", best)
    out = red.stepwise(spark.createDataFrame(pdf), "y", direction)
    assert out.columns == ["y"] + cur
    assert "grp" in out.columns


@pytest.mark.parametrize("direction", ["forward", "backward", "both"])
def test_stepwise_takes_nan_as_missing(spark, direction):
    rng = np.random.default_rng(17)
    n = 200
    x1, x2, x3 = rng.normal(size=(3, n))
    y = x1 + 2 * x2 + rng.normal(scale=0.1, size=n)
    gap = rng.random(n) < 0.2
    with_null = [(float(a), None if g else float(b), float(c), float(d)) for a, b, c, d, g in zip(x1, x2, x3, y, gap, strict=True)]
    with_nan = [(a, float("nan") if b is None else b, c, d) for a, b, c, d in with_null]
    schema = "x1 double, x2 double, x3 double, y double"
    grams = [red._Gram(df, df["y"], red._predictor_groups(df, ["x1", "x2", "x3"])[0]) for df in (spark.createDataFrame(r, schema) for r in (with_null, with_nan))]
    assert grams[0].n == grams[1].n == n - gap.sum()
    assert np.allclose(grams[0].s, grams[1].s)
    assert red.stepwise(spark.createDataFrame(with_nan, schema), "y", direction).columns == red.stepwise(spark.createDataFrame(with_null, schema), "y", direction).columns


def test_points_of_a_chunk_share_the_moves_of_nodes():
    """Points with windows of one size are one run, so that nodes are moved once a run and not once a point."""
    x = np.arange(2048.0)
    assert list(smoothing._alike(x, np.full(2048, 1e6))) == [(0, 2048)]
    h = np.where(x < 700, 40.0, 9000.0)
    runs = list(smoothing._alike(x, h))
    assert [a for a, _ in runs] == [0, *[b for _, b in runs[:-1]]] and runs[-1][1] == 2048
    assert all(b - a == 1 or h[a:b].max() + x[b - 1] - x[a] <= smoothing.SPREAD * h[a:b].min() for a, b in runs)
    t = np.linspace(-1, 1, 9)
    sums = np.array([(t**j).sum() for j in range(12)])
    for m, a, b in zip(smoothing._shifts(np.array([0.3, 1.1]), np.array([-0.6, 0.2]), 12), (0.3, 1.1), (-0.6, 0.2), strict=True):
        assert np.allclose(m @ sums, [((a * t + b) ** j).sum() for j in range(12)], rtol=1e-12)


@pytest.mark.parametrize("degree", [1, 2])
def test_node_moments_from_children(degree):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    x = np.sort(rng.choice(9000, 3000, replace=False)).astype(float)
    y, rw = rng.normal(size=3000), rng.random(3000)
    found = {}
    for batch in smoothing._node_moments(3, degree)([pa.RecordBatch.from_arrays([pa.array(v) for v in (x, y, rw)], ["x", "y", "rw"])]):
        level, node, *sums = (c.to_numpy() for c in batch.columns)
        found |= {(int(a), int(b)): row for a, b, row in zip(level, node, np.stack(sums, axis=1), strict=True)}
    for (level, node), held in found.items():
        own = x // smoothing._node_width(level) == node
        centre, half = smoothing._centre(level, node)
        t = (x[own] - centre) / half
        direct = [(rw[own] * t**j).sum() for j in range(10 + 2 * degree)] + [(rw[own] * y[own] * t**j).sum() for j in range(10 + degree)]
        assert np.allclose(held, direct, atol=1e-11)
    assert len(found) == sum(len(np.unique(x // smoothing._node_width(level))) for level in range(4))


def test_leaf_points_come_whole_whatever_the_batches():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    x = np.arange(0, 1000, 3).astype(float)
    y, rw = rng.normal(size=len(x)), rng.random(len(x))
    batches = [pa.RecordBatch.from_arrays([pa.array(v[a : a + 50][::-1]) for v in (x, y, rw)], ["x", "y", "rw"]) for a in range(0, len(x), 50)]
    seen = []
    for batch in smoothing._leaf_points(batches):
        for level, leaf, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            points = np.array(v).reshape(3, -1)
            assert level == -1 and (points[0] // smoothing.LEAF == leaf).all()
            seen += points.T.tolist()
    assert seen == np.stack([x, y, rw], axis=1).tolist()
