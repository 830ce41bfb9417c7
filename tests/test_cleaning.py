import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curata.operators import consistency, missing, outliers
from tests.conftest import rows


@pytest.fixture(scope="module")
def gaps(spark):
    data = [
        (1, 10.0, 1.0, 2.0, "a"),
        (2, None, 2.0, 1.0, "b"),
        (3, 14.0, None, 4.0, "b"),
        (4, 20.0, 4.0, 3.0, "a"),
        (5, None, None, 5.0, None),
        (6, 26.0, 6.0, 7.0, "c"),
        (7, 31.0, 7.0, 6.0, "c"),
    ]
    return spark.createDataFrame(data, "id bigint, y double, x1 double, x2 double, c string")


def test_mean_median_mode_constant(gaps):
    ys = [10.0, 14.0, 20.0, 26.0, 31.0]
    m = dict(rows(missing.handle_missing(gaps, "y", "mean"), "id", "y"))
    assert m[2] == pytest.approx(np.mean(ys)) and m[1] == 10.0
    md = dict(rows(missing.handle_missing(gaps, "y", "median"), "id", "y"))
    assert md[5] == 20.0
    mo = dict(rows(missing.handle_missing(gaps, "c", "mode"), "id", "c"))
    assert mo[5] == "a"  # a, b, c tie with 2 each -> smallest
    k = dict(rows(missing.handle_missing(gaps, "y", "constant", constant=-1.0), "id", "y"))
    assert k[2] == -1.0
    with pytest.raises(ValueError):
        missing.handle_missing(gaps, "y", "constant", constant="x")
    assert missing.handle_missing(gaps, "y", "remove_row").count() == 5
    assert "y" not in missing.handle_missing(gaps, "y", "remove_col").columns


def test_regression_matches_numpy(gaps):
    pdf = gaps.toPandas()
    train = pdf.dropna(subset=["y", "x1", "x2"])
    X = np.column_stack([np.ones(len(train)), train.x1, train.x2])
    beta = np.linalg.lstsq(X, train.y, rcond=None)[0]
    out = dict(rows(missing.handle_missing(gaps, "y", "regression"), "id", "y"))
    assert out[2] == pytest.approx(beta[0] + beta[1] * 2.0 + beta[2] * 1.0)
    assert out[5] is None  # x1 missing -> cannot predict


def test_tree_imputers_fill(gaps):
    out = missing.handle_missing(gaps, "y", "tree", features=["x2"])
    assert out.where(F.col("y").isNull()).count() == 0
    out2 = missing.handle_missing(gaps, "y", "decision_tree", features=["x1", "x2"])
    assert out2.where(F.col("y").isNull()).count() == 0
    txt = missing.handle_missing(gaps, "c", "tree", features=["x2"])
    assert txt.where(F.col("c").isNull()).count() == 0


def test_unimputable_report(gaps):
    rep = missing.unimputable_report(gaps, "y", ["x1", "x2"]).collect()
    assert [(r.id, r.missing_predictors) for r in rep] == [(5, ["x1"])]


@pytest.fixture(scope="module")
def spikes(spark):
    v = [10.0 + 0.1 * i for i in range(50)] + [100.0, -80.0, None]
    return spark.createDataFrame(list(enumerate(v)), "id bigint, v double"), np.array([x for x in v if x is not None])


def test_detectors_match_numpy(spikes):
    df, v = spikes
    z = np.abs((v - v.mean()) / v.std())
    assert outliers.detect_outliers(df, "v", "zscore").first()[0] == int((z > 3).sum())
    q1, q3 = np.quantile(v, [0.25, 0.75])
    iqr_n = int(((v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))).sum())
    assert outliers.detect_outliers(df, "v", "iqr").first()[0] == iqr_n == 2
    lo, hi = np.quantile(v, [0.01, 0.99])
    assert outliers.detect_outliers(df, "v", "percentile").first()[0] == int(((v < lo) | (v > hi)).sum())


def test_handle_outliers(spikes):
    df, v = spikes
    out = dict(rows(outliers.handle_outliers(df, "v", "iqr", "mean"), "id", "v"))
    assert out[50] == pytest.approx(v.mean()) and out[52] is None
    kept = outliers.handle_outliers(df, "v", "iqr", "remove_row")
    assert kept.count() == 51  # NULL row kept
    assert dict(rows(outliers.handle_outliers(df, "v", "iqr", "median"), "id", "v"))[51] == pytest.approx(np.median(v))


def test_library_rules_round_whole_means(spark):
    vals = [10.0, 11.0, 12.0, 13.0, 11.0, 12.0, 10.0, 13.0, 12.0, 11.0, 200.0]
    df = spark.createDataFrame(list(enumerate(vals)), "id bigint, v double")
    out = dict(rows(outliers.zscore_outliers(df, "v", threshold=2.5, action="replace"), "id", "v"))
    assert out[10] == 12.0  # mean 11.5 of the rest -> half-to-even 12
    rm = outliers.iqr_outliers(df, "v", action="remove")
    assert rm.count() == 10


def dbscan_noise_brute(x, eps, min_pts):
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    d = np.sqrt(((z[:, None, :] - z[None, :, :]) ** 2).sum(-1))
    nb = d <= eps
    core = nb.sum(1) >= min_pts
    return ~core & ~(nb & core[None, :]).any(1)


def test_dbscan_noise_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    a = np.vstack([rng.normal([0, 0], 0.2, (60, 2)), rng.normal([4, 4], 0.3, (60, 2)), [[2, 2], [-3, 5], [6, -2]]])
    pdf = pd.DataFrame({"rid": np.arange(len(a)), "a": a[:, 0], "b": a[:, 1]})
    flags = outliers.dbscan_noise_flags(spark.createDataFrame(pdf), ["a", "b"], eps=0.5, min_pts=5, id_col="rid")
    got = dict(rows(flags, "rid", "noise"))
    exp = dbscan_noise_brute(a, 0.5, 5)
    assert [got[i] for i in range(len(a))] == list(exp)
    assert exp.sum() >= 3
    removed = outliers.dbscan_outliers(spark.createDataFrame(pdf[["a", "b"]]), ["a", "b"])
    assert removed.count() == len(a) - exp.sum()


def test_dbscan_rejects_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "rid bigint, a double")
    with pytest.raises(ValueError):
        outliers.dbscan_noise_flags(df, ["a"], id_col="rid")


def test_rare_categories(spark):
    data = [("a",)] * 10 + [("b",)] * 5 + [("c",)] * 2 + [("d",)] * 3 + [(None,)]
    df = spark.createDataFrame(data, "c string")
    kept = sorted(r.c or "" for r in outliers.rare_categories(df, "c", 0.15).collect())
    assert kept == [""] + ["a"] * 10 + ["b"] * 5 + ["d"] * 3  # c = 10 % is rare; d = 15 % is not < 15 %
    rep = sorted(r.c or "" for r in outliers.rare_categories(df, "c", 0.15, action="replace").collect())
    assert rep.count("a") == 12 and rep.count("c") == 0
    cnt = outliers.rare_categories(df, "c", 3, kind="count")
    assert cnt.where(F.col("c") == "c").count() == 0 and cnt.where(F.col("c") == "d").count() == 3


def test_duplicates_and_text(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 1.0), ("y", None), ("y", None)], "a string, b double")
    assert consistency.remove_duplicates(df).count() == 2
    t = spark.createDataFrame([(1, "it's a big-foo"), (2, "\t Padded  "), (3, "ÉCOLE été"), (4, None)], "id int, s string")
    title = dict(rows(consistency.text_case(t, ["s"], "title"), "id", "s"))
    assert title[1] == "It'S A Big-Foo" and title[3] == "École Été" and title[4] is None
    assert dict(rows(consistency.trim(t, ["s"]), "id", "s"))[2] == "Padded"
    assert dict(rows(consistency.text_case(t, ["s"], "upper"), "id", "s"))[1] == "IT'S A BIG-FOO"


def test_dates(spark):
    d = spark.createDataFrame(
        [(1, "2020-12-31"), (2, "31/12/2020"), (3, "12/31/2020"), (4, "01/02/2020"), (5, "x"), (6, None), (7, "31.12.95")],
        "id int, s string",
    )
    std = dict(rows(consistency.standardize_dates(d, "s", "%Y-%m-%d"), "id", "s"))
    assert std == {1: "2020-12-31", 2: "2020-12-31", 3: "2020-12-31", 4: "2020-02-01", 5: None, 6: None, 7: "1995-12-31"}
    assert consistency.unparsed_dates(d, "s") == 1
    ch = dict(rows(consistency.change_date_format(d, "s", "%d %b %Y"), "id", "s"))
    assert ch[1] == "31 Dec 2020" and ch[3] == "31 Dec 2020" and ch[5] is None


def test_dbscan_hot_spot_matches_brute_force(spark):
    rng = np.random.default_rng(12)
    hot = np.zeros((400, 3))
    ring = rng.normal(0, 0.6, (60, 3))
    far = rng.uniform(-4, 4, (15, 3))
    a = np.vstack([hot, ring, far])
    pdf = pd.DataFrame({"rid": np.arange(len(a)), "a": a[:, 0], "b": a[:, 1], "c": a[:, 2]})
    flags = outliers.dbscan_noise_flags(spark.createDataFrame(pdf), ["a", "b", "c"], eps=0.4, min_pts=6, id_col="rid")
    got = dict(rows(flags, "rid", "noise"))
    exp = dbscan_noise_brute(a, 0.4, 6)
    assert len(got) == len(a)
    assert [got[i] for i in range(len(a))] == list(exp)


def test_dbscan_high_dimension_key_growth_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(outliers, "DBSCAN_MAX_KEY_POINTS", 5)
    rng = np.random.default_rng(13)
    a = np.vstack([rng.normal(0, 0.15, (40, 5)), rng.uniform(-3, 3, (40, 5))])
    cols = [f"c{i}" for i in range(5)]
    pdf = pd.DataFrame(a, columns=cols)
    pdf.insert(0, "rid", np.arange(len(a)))
    flags = outliers.dbscan_noise_flags(spark.createDataFrame(pdf), cols, eps=0.9, min_pts=4, id_col="rid")
    got = dict(rows(flags, "rid", "noise"))
    exp = dbscan_noise_brute(a, 0.9, 4)
    assert [got[i] for i in range(len(a))] == list(exp)


def test_dbscan_crowded_cell_beside_a_shell(spark):
    """10^5 equal points and 10^4 crowded ones; a sparse shell around decides box by box."""
    rng = np.random.default_rng(21)
    equal = spark.range(100_000).selectExpr("id AS rid", "0.0D AS a", "0.0D AS b")
    disc = rng.uniform(-1, 1, (10_000, 2)) * 0.02 + 3
    turn = rng.uniform(0, 2 * np.pi, 80)
    inner = np.where(turn < np.pi, rng.uniform(0.9, 1.1, 80), rng.uniform(1.04, 1.1, 80))  # below: out of reach of the crowd
    shell = np.c_[np.cos(turn), np.sin(turn)] * inner[:, None]
    rim = np.c_[np.cos(turn), np.sin(turn)] * np.where(turn < np.pi, 1.0, 1.05)[:, None] + 3
    others = np.vstack([disc, shell, rim])
    pdf = pd.DataFrame({"rid": np.arange(len(others)) + 100_000, "a": others[:, 0], "b": others[:, 1]})
    df = equal.unionByName(spark.createDataFrame(pdf))
    x = np.vstack([np.zeros((100_000, 2)), others])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    eps = float(1.0 / x.std(0, ddof=1).mean())  # a ball's surface runs through the shell and the disc
    got = dict(rows(outliers.dbscan_noise_flags(df, ["a", "b"], eps=eps, min_pts=500, id_col="rid"), "rid", "noise"))
    near = np.array([(((z - p) ** 2).sum(1) <= eps * eps).sum() for p in z[110_000:]])
    zero = (((z - z[0]) ** 2).sum(1) <= eps * eps).sum()
    assert zero >= 500
    core = np.r_[np.ones(110_000, bool), near >= 500]
    want = [not core[i] and not (core & (((z - z[i]) ** 2).sum(1) <= eps * eps)).any() for i in range(110_000, len(z))]
    assert len(got) == len(z) and not any(got[i] for i in range(110_000))
    assert [got[i] for i in range(110_000, len(z))] == want
    assert 10 < sum(want) < 100


def test_dbscan_counts_stop_at_need_and_cells_always_part(spark, monkeypatch):
    monkeypatch.setattr(outliers, "DBSCAN_MAX_KEY_POINTS", 1)
    monkeypatch.setattr(outliers, "DBSCAN_HALVED_DIMS", 2)
    rng = np.random.default_rng(22)
    a = np.vstack([rng.normal(0, 0.3, (50, 4)), np.repeat(rng.normal(0, 1, (5, 4)), 4, axis=0)])
    a[:10, 0] = np.nextafter(a[0, 0], 9)  # neighbouring doubles have no middle between them
    a[10:20, 0] = a[0, 0]
    pts = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], "_id long, z0 double, z1 double, z2 double, z3 double")
    d2 = ((a[:, None, :] - a[None, :, :]) ** 2).sum(-1)
    for need in (1, 3, 100):
        got = dict(rows(outliers._neighbours_up_to(pts, pts, [0, 1, 2], 4, 0.5, need), "_id", "_n"))
        assert got == {i: min(int(n), need) for i, n in enumerate((d2 <= 0.25).sum(1))}


def test_dbscan_empty_and_single(spark):
    none = spark.createDataFrame([], "rid long, a double")
    assert outliers.dbscan_noise_flags(none, ["a"], id_col="rid").count() == 0
    one = spark.createDataFrame([(7, 2.0)], "rid long, a double")
    assert rows(outliers.dbscan_noise_flags(one, ["a"], id_col="rid"), "rid", "noise") == [(7, True)]
