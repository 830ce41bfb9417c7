import math

import numpy as np
import pytest
from pyspark.core.broadcast import Broadcast
from pyspark.sql import functions as F

from curata.llm import topk


def brute(rows, k):
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in ok if i % 5 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(b) == len(a))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block", [2, 4096])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk, "CHUNK", 7)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 21))
    rows = [(i, [float(x) for x in base[i % 40] + (0 if i % 3 else 0.01 * rng.normal(size=21))]) for i in range(160)]
    rows += [(200, None), (205, [None] + [1.0] * 20), (210, [float("nan")] * 21), (215, [float("inf")] * 21), (None, [1.0] * 21), (220, [0.5, 0.25]), (221, [-0.5, 1.0]), (225, []), (226, []), (160, rows[3][1]), (161, rows[3][1]), (161, rows[3][1])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, score int, rank int")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 5 == 0, 10).collect()))
    assert got == brute(rows, 10)


def test_large_components_and_empty(spark):
    rows = [(0, [1e12, 3.0]), (1, [1e11, -7.0]), (2, [5.0, 1.0]), (3, [1e15, 1e15])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") == 0, 10).collect()
    assert [r.vec_id for r in got] == [1, 3, 2] and got[0].score == 2**63 - 1
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(4)
    q, x = rng.normal(size=(50, 37)) * 900, rng.normal(size=(60, 37)) * 900
    for width in (*topk.LEVELS, 37, 1):
        assert (topk.features(q, width) @ topk.features(x, width).T >= q @ x.T - 1e-6).all()


def test_blocks_are_held_one_at_a_time(spark, monkeypatch):
    """At most one block of queries is on the driver and with the tasks; its rows are written before the next is read."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    held, most, blocks = 0, 0, 0
    sending, going = spark.sparkContext.broadcast, Broadcast.destroy

    def broadcast(value):
        nonlocal held, most, blocks
        held, blocks = held + 1, blocks + 1
        most = max(most, held)
        return sending(value)

    def destroy(self, *args):
        nonlocal held
        held -= 1
        return going(self, *args)

    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    monkeypatch.setattr(Broadcast, "destroy", destroy)
    rows = [(i, [float(i % 7), float(i % 11) - 5.0, 1.0]) for i in range(120)]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0, 10).collect()))
    assert got == brute(rows, 10) and blocks == 3 and most == 1 and held == 0
