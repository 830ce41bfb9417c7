import itertools

import numpy as np
import pandas as pd
import pytest

from curata.operators import correlation


def kendall_brute(x, y):
    n0 = n1 = n2 = c = d = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        n0 += 1
        dx, dy = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        n1 += dx == 0
        n2 += dy == 0
        c += dx * dy > 0
        d += dx * dy < 0
    return (c - d) / np.sqrt((n0 - n1) * (n0 - n2))


@pytest.fixture(scope="module")
def tied(spark):
    rng = np.random.default_rng(11)
    x = rng.integers(0, 12, 300).astype(float)
    y = (x + rng.integers(-4, 5, 300)).astype(float)
    y[:60] = 3.0  # a hot value
    z = rng.normal(size=300)
    pdf = pd.DataFrame({"x": x, "y": y, "z": z})
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("blocks", [None, 3, 7])
def test_kendall_exact_against_brute_force(tied, blocks):
    df, pdf = tied
    got = correlation.kendall_tau(df, "x", "y", blocks=blocks)
    assert got == pytest.approx(kendall_brute(pdf.x.values, pdf.y.values), abs=1e-12)
    got2 = correlation.kendall_tau(df, "x", "z", blocks=blocks)
    assert got2 == pytest.approx(kendall_brute(pdf.x.values, pdf.z.values), abs=1e-12)


def test_spearman_pairwise_complete(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.integers(0, 20, 200).astype(float), "b": rng.normal(size=200), "c": rng.normal(size=200)})
    pdf.loc[::7, "b"] = np.nan
    m = {(r.col_a, r.col_b): r.r for r in correlation.spearman_matrix(spark.createDataFrame(pdf), ["a", "b", "c"]).collect()}
    exp = pdf.corr(method="spearman")
    for a in "abc":
        for b in "abc":
            assert m[(a, b)] == pytest.approx(exp.loc[a, b], abs=1e-12)


def test_pearson_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, None), (3.0, 5.0, 7.0), (4.0, 5.0, 1.0)], "a double, k double, b double")
    m = {(r.col_a, r.col_b): r.r for r in correlation.pearson_matrix(df, ["a", "k", "b"]).collect()}
    assert m[("a", "k")] is None and m[("k", "k")] is None
    exp = np.corrcoef([1.0, 3.0, 4.0], [2.0, 7.0, 1.0])[0, 1]
    assert m[("a", "b")] == pytest.approx(exp) and m[("a", "a")] == pytest.approx(1.0)


@pytest.mark.parametrize("group_rows", [20, 60])
def test_kendall_recursive_blocks_match_brute_force(tied, group_rows):
    df, pdf = tied
    got = correlation.kendall_tau(df, "x", "y", blocks=3, group_rows=group_rows)
    assert got == pytest.approx(kendall_brute(pdf.x.values, pdf.y.values), abs=1e-12)
    got2 = correlation.kendall_tau(df, "x", "z", blocks=3, group_rows=group_rows)
    assert got2 == pytest.approx(kendall_brute(pdf.x.values, pdf.z.values), abs=1e-12)


@pytest.mark.parametrize("group_rows", [40, 200_000])
def test_matrices_with_nulls_ties_and_a_constant(spark, group_rows):
    rng = np.random.default_rng(12)
    n = 150
    pdf = pd.DataFrame({f"c{i}": rng.integers(0, 12, n).astype(float) + (0 if i % 2 else rng.normal(size=n)) for i in range(5)})
    pdf["c4"] = pdf["c0"] - pdf["c1"]
    for i, share in ((1, 0.3), (2, 0.1), (4, 0.5)):
        pdf.loc[rng.random(n) < share, f"c{i}"] = np.nan
    pdf["flat"] = 2.0
    cols = list(pdf.columns)
    df = spark.createDataFrame(pdf).repartition(4)
    rho = {(r.col_a, r.col_b): r.r for r in correlation.spearman_matrix(df, cols).collect()}
    tau = {(r.col_a, r.col_b): r.r for r in correlation.kendall_matrix(df, cols, group_rows).collect()}
    for a in cols:
        for b in cols:
            both = pdf[[a, b]].dropna() if a != b else pdf[[a]].dropna()
            if a == b:
                assert rho[a, a] == (None if a == "flat" else 1.0) and tau[a, a] == 1.0
            elif "flat" in (a, b):
                assert rho[a, b] is None and tau[a, b] is None
            else:
                assert rho[a, b] == pytest.approx(both[a].rank().corr(both[b].rank()), abs=1e-12)
                assert tau[a, b] == pytest.approx(kendall_brute(both[a].values, both[b].values), abs=1e-12)


def test_matrices_of_an_empty_table_and_of_one_column(spark):
    df = spark.createDataFrame([], "a double, b double")
    for matrix in (correlation.spearman_matrix, correlation.kendall_matrix):
        assert {(r.col_a, r.col_b): r.r for r in matrix(df, ["a", "b"]).collect()}["a", "b"] is None
        assert matrix(spark.createDataFrame([(1.0,), (2.0,)], "a double"), ["a"]).first().r == 1.0


def test_number_of_jobs_does_not_follow_the_number_of_pairs(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame({f"c{i}": rng.normal(size=60) for i in range(8)})).repartition(2)
    counts = []
    for p in (2, 8):
        spark.sparkContext.setJobGroup(f"kendall-{p}", "jobs")
        correlation.kendall_matrix(df, [f"c{i}" for i in range(p)])
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"kendall-{p}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] <= counts[0] + 2
