"""Histogram trees: bins of text levels, missing directions, surrogates, subsets, pruning, any partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.operators import missing, trees


def test_levels_are_numbered_by_their_mean_target(spark):
    data = [("b", 9)] * 3 + [("a", 1)] * 3 + [("z", 5)] * 5 + [("m", 1)] + [(None, 100)]
    binning = trees.fit_binning(spark.createDataFrame(data, "t string, y long"), ["t"], F.col("y"))
    assert {r._level: r._bin for r in binning.levels["t"].collect()} == {"a": 1, "m": 2, "z": 3, "b": 4}


def test_a_column_of_unique_texts_spreads_over_the_bins(spark):
    df = spark.range(20_000).selectExpr("CAST(id AS STRING) AS t", "id AS y")
    bins = trees.fit_binning(df, ["t"], F.col("y")).levels["t"].collect()
    assert {int(r._level): r._bin for r in bins} == {i: 1 + i * 255 // 20_000 for i in range(20_000)}


def test_numeric_bins(spark):
    df = spark.range(1000).selectExpr("CAST(id % 3 AS DOUBLE) AS few", "CAST(id AS DOUBLE) AS many", "CAST(NULL AS DOUBLE) AS none", "id AS y")
    binning = trees.fit_binning(df, ["few", "many", "none"], F.col("y"))
    assert list(binning.edges["few"]) == [0.5, 1.5] and len(binning.edges["many"]) == 254 and not len(binning.edges["none"])
    codes = binning.coder()([np.array([0.0, 2.0, np.nan]), np.array([-1.0, 2000.0, 5.0]), np.array([np.nan, np.nan, 1.0])])
    assert codes[:, 0].tolist() == [1, 3, 0] and codes[:, 1].tolist()[:2] == [1, 255] and codes[2, 2] == 1


def best_stump(x, y):
    """Least squared error over all cuts of one predictor, with the missing rows on either side."""
    known = sorted({v for v in x if v is not None})
    found = []
    for cut in known:
        for side in (False, True):
            left = np.array([side if v is None else v <= cut for v in x])
            if left.any() and not left.all():
                found.append((sum(((y[m] - y[m].mean()) ** 2).sum() for m in (left, ~left)), left))
    return min(found, key=lambda s: s[0])


def test_missing_predictors_go_to_the_better_side(spark):
    rng = np.random.default_rng(7)
    x = [None if rng.random() < 0.3 else float(rng.integers(0, 40)) for _ in range(300)]
    y = np.array([8.0 if v is None else (0.0 if v < 25 else 7.0) + rng.normal() for v in x])
    error, left = best_stump(x, y)
    rows = [(i, v, 1.0, float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))] + [(1000 + i, v, 1.0, None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, x double, one double, y double")
    got = {r.id: r.y for r in missing.boosted_impute(df, "y", ["x", "one"], rounds=1, max_depth=1).collect()}
    want = np.where(left, y[left].mean(), y[~left].mean())
    assert np.allclose([got[1000 + i] for i in range(300)], want)


def test_boosting_is_the_same_under_any_partitioning_and_fits(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=800), rng.normal(size=800)
    y = np.sin(2 * a) + a * b
    data = [(i, float(a[i]) if i % 5 else None, float(b[i]), float(y[i]) if i % 4 else None) for i in range(800)]
    df = spark.createDataFrame(data, "id long, a double, b double, y double")
    fills = []
    for parts in (1, 7):
        out = missing.boosted_impute(df.repartition(parts), "y", ["a", "b"], rounds=15, rate=0.3, min_leaf=5)
        fills.append({r.id: r.y for r in out.collect()})
    assert fills[0] == fills[1]
    held = [i for i in range(0, 800, 4) if i % 5]
    assert np.mean([(fills[0][i] - y[i]) ** 2 for i in held]) < 0.3 * np.var(y[held])


def test_a_surrogate_stands_in_for_a_missing_predictor(spark):
    """s follows the primary predictor but for a few rows: rows that lack p go by s, rows that lack both with the larger side."""
    data = [(i, float(i % 10), "lo" if i % 10 < 4 or i == 9 else "hi", 0.0 if i % 10 < 4 else 50.0) for i in range(200)]
    data += [(500, None, "lo", None), (501, None, "hi", None), (502, None, None, None), (503, 2.0, "hi", None), (504, None, "new", None)]
    df = spark.createDataFrame(data, "id long, p double, s string, y double")
    got = {r.id: r.y for r in missing.tree_impute(df, "y", ["p", "s"], max_depth=1).collect()}
    assert [got[i] for i in (500, 501, 502, 503, 504)] == [0.0, 50.0, 50.0, 0.0, 50.0]


def test_text_levels_are_split_as_sets(spark):
    """One split parts levels that neither name nor frequency puts side by side, in each node by its own means."""
    mean = {"a": 9.0, "b": 1.0, "c": 9.0, "d": 1.0}
    data = [(i, "abcd"[i % 4], mean["abcd"[i % 4]]) for i in range(100)] + [(200, "c", None), (201, "d", None)]
    got = {r.id: r.y for r in missing.tree_impute(spark.createDataFrame(data, "id long, k string, y double"), "y", ["k"], max_depth=1).collect()}
    assert (got[200], got[201]) == (9.0, 1.0)


@pytest.mark.parametrize(("complexity", "want"), [(0.0, {1: 0.0, 2: 1.0, 3: 20.0, 4: 21.0}), (0.05, {1: 0.5, 2: 0.5, 3: 20.5, 4: 20.5}), (1.0, {1: 10.5, 2: 10.5, 3: 10.5, 4: 10.5})])
def test_pruning_by_complexity(spark, complexity, want):
    value = {1: 0.0, 2: 1.0, 3: 20.0, 4: 21.0}
    data = [(i, float(1 + i % 4), value[1 + i % 4]) for i in range(80)] + [(100 + k, float(k), None) for k in value]
    df = spark.createDataFrame(data, "id long, x double, y double")
    got = {r.id: r.y for r in missing.tree_impute(df, "y", ["x"], complexity=complexity).collect()}
    assert {k: got[100 + k] for k in value} == pytest.approx(want)


def test_classes_and_edge_rows(spark):
    data = [(i, float(i % 6), ["x", "y", "z"][(i % 6) // 2]) for i in range(60)] + [(100 + i, float(i), None) for i in range(6)] + [(200, None, None), (201, float("nan"), None)]
    df = spark.createDataFrame(data, "id long, v double, c string")
    got = {r.id: r.c for r in missing.tree_impute(df, "c", ["v"]).collect()}
    assert [got[100 + i] for i in range(6)] == list("xxyyzz") and got[200] == got[201] and got[200] is not None
    assert missing.boosted_impute(df.withColumn("y", F.when(F.col("id") < 50, F.col("id"))), "y", ["v"], rounds=2).where("id = 200 AND y IS NULL").count() == 1
    with pytest.raises(ValueError):
        missing.tree_impute(df.where("c IS NULL"), "c", ["v"])
    with pytest.raises(ValueError):
        missing.boosted_impute(df.withColumn("y", F.lit(None).cast("double")), "y", ["v"])


def test_tree_passes_read_packed_rows_without_a_shuffle(spark, monkeypatch):
    """Training rows are a few records of many rows; a pass adds up the tasks' sums itself, the same as by a shuffle."""
    data = [(i % 40, i % 7 if i % 5 else None, (i * 37) % 1001 - 500) for i in range(3000)]
    df = spark.createDataFrame(data, "a long, b long, y long")
    binning = trees.fit_binning(df, ["a", "b"], F.col("y"))
    rows = trees.training_rows(df, binning, F.col("y"))
    distinct = df.select("a", "b").distinct().count()
    assert rows.parts == 1 and rows.blocks.count() == 1 and len(rows.blocks.first()["codes"]) == 2 * distinct

    def place(codes, target, many, score):
        return (codes[:, 0] > 20).astype(np.int64) + 1, np.zeros(len(codes), np.int64), target

    direct = trees._sums(rows, [1, 2], 1, place)
    monkeypatch.setattr(trees, "GATHERED", 0)
    shuffled = trees._sums(rows, [1, 2], 1, place)
    monkeypatch.setattr(trees, "BLOCK", 16)
    monkeypatch.setattr(trees, "PART_ROWS", (8, 64))
    small = trees.training_rows(df, binning, F.col("y"))
    assert small.parts > 1 and small.blocks.count() >= distinct / 16
    cut = trees._sums(small, [1, 2], 1, place)
    for n, g in (direct, shuffled, cut):
        assert n[:, 0].sum() == len(data) and g[:, 1].sum() == sum(r[2] for r in data)
        assert (n == direct[0]).all() and (g == direct[1]).all()


def test_rows_end_in_the_same_leaf_by_tables():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 256, (500, 3)).astype(np.uint8)
    splits = {n: trees.Split(int(rng.integers(3)), rng.random(256) < 0.5) for n in (0, 1, 2, 4, 9, 20)}
    leaves = trees._leaves(trees.Tree(splits, {}))
    tree = trees.Tree(splits, {n: float(n) for n in leaves})
    expected = []
    for row in codes:
        n = 0
        while n in splits:
            n = 2 * n + (1 if splits[n].left[row[splits[n].feature]] else 2)
        expected.append(n)
    assert tree.route(codes).tolist() == expected and tree.values(codes).tolist() == [float(n) for n in expected]
