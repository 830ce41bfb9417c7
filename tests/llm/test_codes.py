"""Vector codes against a brute-force version, and their edge rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error int, v string"


def brute(rows, parts=4, entries=256, rounds=4):
    """rows: (id, integer vector, label) of one length, in order of id; plain loops over Python integers."""
    d = len(rows[0][1])
    at = codes.part_edges(d, parts)
    cut = lambda v, p: v[at[p] : at[p + 1]]
    books = [[list(cut(v, p)) for _, v, _ in rows[:entries]] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, v, _ in rows:
                held.setdefault(best(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, own in held.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out, by_label = [], {}
    for i, v, y in rows:
        found = [best(cut(v, p), books[p]) for p in range(parts)]
        error = sum(e for e, _ in found)
        by_label[y] = by_label.get(y, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, y))
    flat = ",".join(str(x) for b in books for e in b for x in e)
    return sorted((i, c, e, by_label[y]) for i, c, e, y in out), hashlib.sha256(flat.encode()).hexdigest()


def frame(spark, rows, parts=3):
    data = [(i, None if v is None else [float(x) / 1024 for x in v], y, "c", 1, "v") for i, v, y in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def coded(df, **kw):
    out, books = codes.compress(df, **kw)
    sha = out.sparkSession.range(1).select(codes.codebooks_digest(books).alias("s")).first()["s"]
    return sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out.collect()), sha


def made(n, d, seed=0, spread=60):
    rng = np.random.default_rng(seed)
    return [(i, [int(x) for x in rng.normal(0, spread, d)], None if i % 7 == 0 else int(rng.integers(3))) for i in range(n)]


@pytest.mark.parametrize(("n", "d", "entries"), [(90, 8, 16), (60, 12, 256), (40, 4, 3), (50, 6, 8)])
def test_against_brute_force(spark, n, d, entries):
    rows = made(n, d, d)
    assert coded(frame(spark, rows), entries=entries) == brute(rows, entries=entries)


def test_partitioning_does_not_matter(spark):
    rows = made(80, 8)
    assert coded(frame(spark, rows, 1), entries=8) == coded(frame(spark, rows, 7), entries=8)


def test_ties_and_repeated_vectors(spark):
    rows = [(i, [1, 2, 3, 4], 0) for i in range(30)] + [(i, [5, 2, 3, 9], 1) for i in range(30, 40)]
    assert coded(frame(spark, rows), entries=4) == brute(rows, entries=4)


@pytest.mark.parametrize("spread", [1 << 12, 1 << 20, 1 << 31])
def test_wide_numbers_are_exact(spark, spread):
    rows = made(40, 4, 3, spread)
    found, sha = coded(frame(spark, rows), entries=5)
    asked, brute_sha = brute(rows, entries=5)
    assert sha == brute_sha
    assert found == [(i, c, min(e, codes.LONG_MAX), min(t, codes.LONG_MAX)) for i, c, e, t in asked]


def test_edge_rows(spark):
    rows = made(30, 8)
    bad = [(40, None, 1), (41, [1, 2], 1), (42, [], 1)]
    nan = spark.createDataFrame([(43, [float("inf")] * 8, 1, "c", 1, "v"), (44, [None] + [1.0] * 7, 1, "c", 1, "v")], SCHEMA)
    df = frame(spark, rows + bad).unionByName(nan)
    assert coded(df, entries=6) == brute(rows, entries=6)
    with_null_id = frame(spark, [*rows, (None, [7] * 8, 2)])
    out, _ = codes.compress(with_null_id, entries=6)
    assert out.filter(F.col("vec_id").isNull()).count() == 1 and out.count() == 31


def test_empty_table_and_bad_parameter(spark):
    out, books = codes.compress(frame(spark, []))
    assert out.columns == ["vec_id", "label", "code", "error", "label_error"] and out.count() == 0 and books == []
    with pytest.raises(ValueError, match="256"):
        codes.compress(frame(spark, []), entries=257)
