import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curata.operators import derive, discretize, encode, scale, skew
from tests.conftest import rows


@pytest.fixture(scope="module")
def scales(spark):
    return spark.createDataFrame([(1, -50.0), (2, 0.0), (3, 100.0), (4, 25.0), (5, None)], "id int, v double")


def test_normalize(scales):
    x = np.array([-50.0, 0.0, 100.0, 25.0])
    mm = dict(rows(scale.normalize(scales, "v", "minmax"), "id", "v"))
    assert mm[1] == 0.0 and mm[3] == 1.0 and mm[5] is None
    z = dict(rows(scale.normalize(scales, "v", "ZScore"), "id", "v"))
    assert z[3] == pytest.approx((100 - x.mean()) / x.std(ddof=1))
    dec = dict(rows(scale.normalize(scales, "v", "decimal"), "id", "v"))
    assert dec[3] == 1.0 and dec[1] == -0.5
    rb = dict(rows(scale.normalize(scales, "v", "robust"), "id", "v"))
    q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
    assert rb[4] == pytest.approx((25 - q2) / (q3 - q1))


def test_constant_column_gives_null(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 3.0)], "id int, v double")
    assert all(r.v is None for r in scale.normalize(df, "v", "minmax").collect())
    assert all(r.v is None for r in scale.normalize(df, "v", "zscore").collect())


def test_derive_mod_follows_divisor(spark):
    df = spark.createDataFrame([(1, 7.0, -3.0), (2, -7.0, 3.0), (3, 5.0, 0.0), (4, None, 1.0)], "id int, a double, b double")
    m = dict(rows(derive.derive(df, "a", "b", "mod", "m"), "id", "m"))
    assert m == {1: -2.0, 2: 2.0, 3: None, 4: None}
    d = dict(rows(derive.derive(df, "a", "b", "divide", "q"), "id", "q"))
    assert d[3] is None and d[1] == pytest.approx(-7 / 3)
    with pytest.raises(ValueError):
        derive.derive(df.withColumn("s", F.lit("x")), "a", "s", "add", "z")


def test_encoders(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c"), (5, "a")], "id int, c string")
    oh = encode.onehot(df, "c")
    assert oh.columns == ["id", "c_a", "c_b", "c_c"]
    assert dict(rows(oh, "id", "c_a")) == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1}
    assert all(sum(r[1:]) <= 1 for r in oh.collect())
    lab = dict(rows(encode.label(df, "c"), "id", "c"))
    assert lab == {1: 2, 2: 1, 3: None, 4: 3, 5: 1}


def test_skew_domains_and_simple(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 4.0), (3, 9.0), (4, None)], "id int, v double")
    assert dict(rows(skew.reduce_skew(df, "v", "sqrt"), "id", "v")) == {1: 1.0, 2: 2.0, 3: 3.0, 4: None}
    assert dict(rows(skew.reduce_skew(df, "v", "neginv"), "id", "v"))[3] == pytest.approx(1.0)
    neg = spark.createDataFrame([(1, -1.0), (2, 0.0)], "id int, v double")
    for m in ("boxcox", "log", "log1p", "sqrt", "inv"):
        with pytest.raises(ValueError):
            skew.reduce_skew(neg, "v", m)


def boxcox_ref(x):
    gm = np.exp(np.log(x).mean())
    y = x / gm
    best, bll = None, -np.inf
    for lam in [round(-2 + 0.1 * i, 10) for i in range(41)]:
        t = np.log(y) if abs(lam) <= 0.02 else (y**lam - 1) / lam
        ll = -np.log(t.var())
        if ll > bll:
            best, bll = lam, ll
    return best


def test_boxcox_matches_grid(spark):
    rng = np.random.default_rng(2)
    x = rng.lognormal(1.0, 0.8, 400)
    df = spark.createDataFrame(pd.DataFrame({"v": x}))
    lam = boxcox_ref(x)
    lam = 0.0 if abs(lam) < 0.2 else lam
    out = np.sort([r.v for r in skew.reduce_skew(df, "v", "boxcox").collect()])
    exp = np.sort(np.log(x) if lam == 0 else (x**lam - 1) / lam)
    assert np.allclose(out, exp)


def test_yeojohnson_lambda_and_standardised(spark):
    rng = np.random.default_rng(3)
    x = rng.gamma(2.0, 2.0, 500) - 2.0
    df = spark.createDataFrame(pd.DataFrame({"v": x}))

    @np.errstate(invalid="ignore")
    def yj(v, lam):
        pos = np.log1p(v) if abs(lam) < 1e-3 else ((v + 1) ** lam - 1) / lam
        neg = -np.log1p(-v) if abs(lam - 2) < 1e-3 else -((1 - v) ** (2 - lam) - 1) / (2 - lam)
        return np.where(v >= 0, pos, neg)

    grid = np.linspace(-5, 5, 200001)
    c = np.sum(np.sign(x) * np.log1p(np.abs(x)))
    ll = [-0.5 * len(x) * np.log(yj(x, g).var()) + (g - 1) * c for g in grid[::50]]
    lam_ref = grid[::50][int(np.argmax(ll))]
    lam = skew.yeojohnson_lambda(df, F.col("v"))
    assert lam == pytest.approx(lam_ref, abs=3e-3)
    out = np.array([r.v for r in skew.reduce_skew(df, "v", "yeojohnson").collect()])
    assert out.mean() == pytest.approx(0, abs=1e-9) and out.std(ddof=1) == pytest.approx(1)


def test_equal_width_right_closed(spark):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate([0, 2.5, 2.6, 5, 7.5, 10, None])], "id int, v double")
    codes = dict(rows(discretize.discretize(df, "v", "equalwidth"), "id", "v_discretized"))
    assert codes == {0: 1, 1: 1, 2: 2, 3: 2, 4: 3, 5: 4, 6: None}


def test_equal_frequency_dedupes(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1, 1, 1, 1, 2, 3, 4])], "id int, v double")
    codes = dict(rows(discretize.discretize(df, "v", "equalfreq"), "id", "v_discretized"))
    # quantiles 1,1,1,2.25,4 -> breaks 1, 2.25, 4 -> two bins
    assert set(codes.values()) == {1, 2} and codes[5] == 1 and codes[6] == 2


def lloyd(values, k):
    """Plain Lloyd rounds on sorted values from the quantiles of the distinct ones."""
    distinct = np.unique(values)
    centres = [float(np.quantile(distinct, (2 * i + 1) / (2 * k))) for i in range(k)]
    held = None
    while True:
        cuts = [(a + b) / 2 for a, b in zip(centres[:-1], centres[1:], strict=True)]
        codes = np.searchsorted(cuts, values, side="left")
        if held is not None and (codes == held).all():
            return codes + 1
        held = codes
        centres = [float(values[codes == i].mean()) if (codes == i).any() else c for i, c in enumerate(centres)]


def test_kmeans_is_lloyd_under_any_partitioning(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(0, 1, 300), rng.normal(9, 2, 80), np.full(200, 4.0), rng.normal(30, 1, 20)])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(v)), "v": v}))
    for k, parts in ((4, 1), (4, 9), (3, 4), (7, 2)):
        got = dict(rows(discretize.discretize(df.repartition(parts), "v", "kmeans", bins=k), "id", "v_discretized"))
        assert [got[i] for i in range(len(v))] == list(lloyd(v, k))


def test_kmeans_few_values_and_none(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 8.0), (4, None), (5, float("nan"))], "id int, v double")
    assert dict(rows(discretize.discretize(df, "v", "kmeans", bins=4), "id", "v_discretized")) == {1: 1, 2: 1, 3: 2, 4: None, 5: None}
    assert discretize.discretize(df.limit(0), "v", "kmeans").count() == 0


def test_kmeans_codes_ordered(spark):
    vals = [1.0, 1.1, 0.9, 10.0, 10.2, 20.0, 20.5, 40.0, 41.0]
    df = spark.createDataFrame(list(enumerate(vals)), "id int, v double")
    codes = [c for _, c in rows(discretize.discretize(df, "v", "kmeans"), "id", "v_discretized")]
    assert codes == sorted(codes) and codes[0] == 1 and codes[-1] == 4


def mdlp_ref(v, y):
    order = np.argsort(v, kind="mergesort")
    v, y = v[order], y[order]
    classes = sorted(set(y))
    cuts = []

    def ent(lab):
        if len(lab) == 0:
            return 0.0
        p = np.array([np.mean(lab == c) for c in classes])
        p = p[p > 0]
        return float(-(p * np.log2(p)).sum())

    def rec(lo, hi):
        n = hi - lo
        best = None
        for j in range(lo, hi - 1):
            if v[j] == v[j + 1]:
                continue
            left, right = y[lo : j + 1], y[j + 1 : hi]
            e = len(left) / n * ent(left) + len(right) / n * ent(right)
            if best is None or e < best[0] - 1e-12:
                best = (e, j)
        if best is None:
            return
        e, j = best
        s, l, r = y[lo:hi], y[lo : j + 1], y[j + 1 : hi]
        k, k1, k2 = len(set(s)), len(set(l)), len(set(r))
        delta = math.log2(3**k - 2) - (k * ent(s) - k1 * ent(l) - k2 * ent(r))
        if ent(s) - e > (math.log2(n - 1) + delta) / n:
            cuts.append((v[j] + v[j + 1]) / 2)
            rec(lo, j + 1)
            rec(j + 1, hi)

    rec(0, len(v))
    return sorted(cuts)


def test_mdlp_matches_reference(spark):
    rng = np.random.default_rng(9)
    v = rng.uniform(0, 100, 300).round(1)
    y = np.where(v < 30, "a", np.where(v < 70, "b", "a"))
    flip = rng.random(300) < 0.08
    y = np.where(flip, "b", y)
    df = spark.createDataFrame(pd.DataFrame({"v": v, "y": y}))
    cuts = discretize.mdlp_cuts(df, "v", "y")
    assert cuts == pytest.approx(mdlp_ref(v, y))
    assert len(cuts) >= 2
    codes = discretize.discretize(df, "v", "entropy", target="y")
    assert codes.agg(F.max("v_discretized")).first()[0] == len(cuts) + 1


def test_mdlp_many_classes_and_edges(spark):
    rng = np.random.default_rng(10)
    v = np.repeat(np.arange(120.0), 25)  # ties throughout, four bands of 30 classes each
    y = np.array([f"c{int(x // 30) * 30 + rng.integers(0, 30)}" for x in v])
    order = rng.permutation(len(v))
    v, y = v[order], y[order]
    df = spark.createDataFrame(pd.DataFrame({"v": v, "y": y}))
    cuts = discretize.mdlp_cuts(df, "v", "y")
    assert cuts == pytest.approx(mdlp_ref(v, y)) and cuts == discretize.mdlp_cuts(df.repartition(13, "y"), "v", "y")
    assert {29.5, 59.5, 89.5} <= set(cuts)
    edge = spark.createDataFrame([(None, "a"), (1.0, None), (2.0, "a"), (2.0, "b")], "v double, y string")
    assert discretize.mdlp_cuts(edge, "v", "y") == []
    assert discretize.mdlp_cuts(edge.limit(0), "v", "y") == [] and discretize.mdlp_cuts(edge.where("y = 'a'"), "v", "y") == []


def test_boxcox_two_distinct_values_unchanged(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 5.0), (3, 2.0), (4, None)], "id int, v double")
    assert dict(rows(skew.reduce_skew(df, "v", "boxcox"), "id", "v")) == {1: 2.0, 2: 5.0, 3: 2.0, 4: None}


def test_onehot_sparse_many_levels(spark, monkeypatch):
    """10^5 levels: vectors from a joined table; the wide form refuses them without collecting them."""
    n = 100_000
    df = spark.range(2 * n).selectExpr("id", f"concat('k', lpad(CAST(id % {n} AS STRING), 6, '0')) AS c")
    fitted = encode.fit_onehot_sparse(df, "c")
    assert fitted.transform(df).where(f"c.size <> {n} OR c.indices <> array(CAST(id % {n} AS INT)) OR c.values <> array(1.0D)").count() == 0
    new = spark.createDataFrame([(1, None), (2, "unseen"), (3, "k000007")], "id int, c string")
    got = {r.id: (r.c.size, r.c.indices, r.c["values"]) for r in fitted.transform(new).collect()}
    assert got == {1: (n, [], []), 2: (n, [], []), 3: (n, [7], [1.0])}
    with pytest.raises(ValueError, match="sparse"):
        encode.fit_onehot(df, "c")
    empty = encode.encode(new.limit(0), "c", "onehot_sparse")
    assert empty.collect() == [] and empty.columns == ["id", "c"]


@pytest.mark.parametrize("most", [0, 40, 1 << 16])
def test_mdlp_jobs_do_not_grow_with_the_cuts(spark, monkeypatch, most):
    """Copies of a noisy class make hundreds of cuts, one below another: the same by levels, by tasks and by both."""
    rng = np.random.default_rng(12)
    v = np.arange(60.0)
    y = np.where(rng.random(60) < 0.5, "a", "b")
    df = spark.createDataFrame(pd.DataFrame({"v": np.repeat(v, 400), "y": np.repeat(y, 400)}))
    levels = []
    real = discretize.running_sums

    def counted(*args, **kw):
        levels.append(1)
        return real(*args, **kw)

    monkeypatch.setattr(discretize, "running_sums", counted)
    monkeypatch.setattr(discretize, "MDLP_ROWS", most)
    cuts = discretize.mdlp_cuts(df, "v", "y")
    assert cuts == [i + 0.5 for i in range(59) if y[i] != y[i + 1]]
    assert (len(levels) == 0) == (most > 60)
