import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curata.functions.stats import (
    exact_percentiles,
    global_percentiles,
    most_frequent,
    running_sums,
    top_k_per_group,
    value_ranks,
    with_position,
)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=1500).round(2), np.full(1000, 0.5)])  # one hot value
    g = rng.integers(0, 3, size=len(vals))
    pdf = pd.DataFrame({"g": g.astype("int32"), "v": vals})
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("buckets", [None, 16])
def test_percentiles_match_numpy(skewed, buckets):
    df, pdf = skewed
    probs = [0, 0.01, 0.25, 0.5, 0.75, 0.99, 1]
    got = exact_percentiles(df, "v", probs, buckets=buckets).first()
    assert np.allclose(list(got), np.quantile(pdf.v, probs))
    per = exact_percentiles(df, "v", [0.1, 0.5, 0.9], by=["g"], buckets=buckets).collect()
    for r in per:
        assert np.allclose([r.p0, r.p1, r.p2], np.quantile(pdf.v[pdf.g == r.g], [0.1, 0.5, 0.9]))


def test_percentiles_ignore_nulls_and_empty_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", None)], "g string, v double")
    res = {r.g: r.p0 for r in exact_percentiles(df, "v", [0.5], by=["g"]).collect()}
    assert res == {"a": 2.0, "b": None}
    assert global_percentiles(df, "v", [0.25]) == [1.5]


@pytest.mark.parametrize("buckets", [None, 8])
def test_value_ranks_are_average_ranks(skewed, buckets):
    df, pdf = skewed
    vr = value_ranks(df, "v", ["g"], buckets=buckets).toPandas()
    vr["rank"] = vr["_before"] + (vr["_cnt"] + 1) / 2
    exp = pdf.assign(rank=pdf.groupby("g")["v"].rank()).drop_duplicates(["g", "v"])
    m = exp.merge(vr, on=["g", "v"], suffixes=("_e", "_a"))
    assert len(m) == len(vr) == len(exp)
    assert np.allclose(m.rank_e, m.rank_a)


@pytest.mark.parametrize("buckets", [None, 4])
def test_running_sums(spark, buckets):
    pdf = pd.DataFrame({"k": [1] * 50, "v": np.arange(50.0)[::-1], "a": np.arange(50), "b": np.ones(50, dtype=int)})
    out = running_sums(spark.createDataFrame(pdf), "v", ["a", "b"], by=["k"], buckets=buckets).toPandas().sort_values("v")
    srt = pdf.sort_values("v")
    assert list(out["_cuma"]) == list(srt["a"].cumsum())
    assert list(out["_cumb"]) == list(range(1, 51))


def test_most_frequent_ties_smallest(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, "a"), (2, None), (2, "z")], "g int, c string")
    res = {r.g: (r.mode, r.mode_count) for r in most_frequent(df, "c", ["g"]).collect()}
    assert res == {1: ("a", 2), 2: ("z", 1)}


def test_with_position_is_global_order(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    pos = with_position(df, ["k"], "p").collect()
    assert sorted((r.p, r.k) for r in pos) == [(i, i) for i in range(1000)]


def test_top_k_per_group_exact(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 400), "s": [f"v{i}" for i in range(400)], "n": rng.integers(0, 20, 400)})
    df = spark.createDataFrame(pdf)
    got = top_k_per_group(df, ["g"], [F.col("n").desc(), F.col("s")], 5, salt_on="s", salts=8).toPandas()
    for g, part in pdf.groupby("g"):
        exp = part.sort_values(["n", "s"], ascending=[False, True]).head(5)
        assert list(got[got.g == g].sort_values("_rank").s) == list(exp.s)


@pytest.mark.parametrize("n", [0, 3, 16, 17, 128, 129, 2000])
def test_count_below_matches_numpy(spark, n):
    from curata.functions import count_below

    rng = np.random.default_rng(n)
    br = np.sort(rng.integers(0, 500, n)).astype(float)
    xs = [float(v) for v in rng.integers(-2, 505, 200)] + [None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    out = df.select("x", count_below(F.col("x"), br).alias("a"), count_below(F.col("x"), br, strict=False).alias("b"))
    for r in out.collect():
        if r.x is None:
            assert r.a is None and r.b is None
        else:
            assert (r.a, r.b) == (int((br < r.x).sum()), int((br <= r.x).sum()))
