"""Hard-negative mining against a brute-force version, and its edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score int, v string"


def brute(rows, anchors, n_pos=5, n_neg=3, low=50, high=95):
    """rows: (id, integer vector, label); the same lists by plain loops."""
    out = []
    for a in sorted({(i, tuple(v), y) for i, v, y in rows if i in anchors}):
        scored = [(sum(p * q for p, q in zip(a[1], v, strict=True)), i, y) for i, v, y in rows if i != a[0] and len(v) == len(a[1])]
        for ps, pid, _ in sorted(((s, i, y) for s, i, y in scored if y == a[2]), key=lambda r: (-r[0], r[1]))[:n_pos]:
            fit = sorted(((-s, i) for s, i, y in scored if y != a[2] and low * ps <= 100 * s <= high * ps))[:n_neg]
            out += [(a[0], pid, k + 1, i, ps, -s) for k, (s, i) in enumerate(fit)]
    return sorted(out)


def frame(spark, rows, parts=3):
    data = [(i, None if v is None else [float(x) / 256 for x in v], y, "r", 1, "v") for i, v, y in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def mined(spark, rows, **kw):
    return sorted(tuple(r) for r in negatives.mine_hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0, **kw).collect())


def made(n, d, labels, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 60, d)
    return [(i, [int(x) for x in middle + rng.normal(0, 50, d)], int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("d", [1, 7, 20, 64])
def test_against_brute_force(spark, d):
    rows = made(160, d, 4, d)
    assert mined(spark, rows) == brute(rows, set(range(0, 160, 5)))


def test_blocks_give_the_same_rows(spark):
    rows = made(120, 20, 3)
    assert mined(spark, rows, block=7) == mined(spark, rows) == brute(rows, set(range(0, 120, 5)))


def test_ties_repeated_rows_and_one_hot_label(spark):
    same = [(i, [40, 40, 40, 40], 0) for i in range(60)]
    other = [(100 + i, [30, 30, 30, 30], 1) for i in range(40)] + [(200, [20, 20, 20, 21], 2)] * 3
    rows = same + other
    assert mined(spark, rows) == brute(rows, set(range(0, 201, 5)))


def test_values_beyond_doubles_are_exact(spark):
    big = 1 << 22
    rows = [(0, [big * 256, 1], 0), (1, [big * 256, 3], 0), (2, [big * 200, 7], 1), (3, [big * 200, 1], 1), (4, [big * 10, 5], 1)]
    assert mined(spark, rows) == brute(rows, {0})


def test_edge_rows(spark):
    rows = made(30, 4, 2) + [(35, None, 0), (None, [1, 2, 3, 4], 0), (40, [1, 2], 1), (45, [], 1), (50, [0, 0, 0, 0], 0), (55, [1, 2, 3, 4], None)]
    usable = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None]
    nan = spark.createDataFrame([(60, [float("nan")] * 4, 0, "r", 1, "v"), (65, [None, 1.0, 1.0, 1.0], 0, "r", 1, "v")], SCHEMA)
    out = negatives.mine_hard_negatives(frame(spark, rows).unionByName(nan), F.col("vec_id") % 5 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in out.collect()) == brute(usable, {r[0] for r in usable if r[0] % 5 == 0})


def test_empty_table(spark):
    assert mined(spark, []) == []
