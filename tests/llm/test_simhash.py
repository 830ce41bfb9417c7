import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from curata.llm import simhash
from curata.llm.components import components
from curata.llm.queries import QUERIES


def brute_print(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, distance=3):
    prints = sorted({p for _, p in rows})
    up = {p: p for p in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(prints, 2):
        if (a ^ b).bit_count() <= distance:
            up[find(a)] = find(b)
    least = {}
    for d, p in rows:
        if d is not None:
            least[find(p)] = min(d, least.get(find(p), d))
    return [(d, p, least.get(find(p))) for d, p in rows]


def test_positions_cover():
    assert len(simhash.POSITIONS) == 14
    assert all(any(set(p) <= set(five) for p in simhash.POSITIONS) for five in combinations(range(8), 5))


@pytest.mark.parametrize("text", ["", " \t\n", "one", "one two", "A b C", "É é E", "a\x0bb\x1cc\x85d e f g", "x " * 70000, "ß\x00 null byte in it"])
def test_print_edges(text):
    assert simhash.simhash(text.encode()) == brute_print(text)


def sorted_rows(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, brute_print(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op2_simhash_near_dedup"](spark, sf).collect()
    assert sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got) == sorted(brute_components(rows))


def test_crowded_lists(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIST", 50)
    monkeypatch.setattr(simhash, "ROWS", 64)
    rng = np.random.default_rng(1)
    center = int(rng.integers(0, 1 << 63))
    values = {center ^ sum(1 << int(b) for b in rng.choice(24, rng.integers(0, 9), replace=False)) for _ in range(400)} | {int(x) for x in rng.integers(0, 1 << 63, 100)}
    values |= {v ^ 7 for v in list(values)[:30]} | {v ^ (1 << 63) for v in list(values)[:10]}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fingerprint long").repartition(3))
    got = components(edges).collect()
    root = {r.node & (1 << 64) - 1: r.root for r in got}
    groups = {}
    for v in values:
        groups.setdefault(root.get(v, ("alone", v)), set()).add(v)
    want = {}
    for d, _, c in brute_components([(v, v) for v in values]):
        want.setdefault(c, set()).add(d)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)], [(i, i ^ 1) for i in range(50)] + [(5, 90), (90, 91)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert set(got) == nodes
    seen = {}
    for a, b in edges:
        if a != b:
            assert got[a] == got[b]
    for n in nodes:
        seen.setdefault(got[n], set()).add(n)
    if len(edges) == 200 or len(edges) == 299:
        assert len(seen) == 1


def test_edge_rows_and_keep_one(spark):
    rows = [(3, "", 1), (1, None, 2), (None, "", 3), (7, "some words in a row", 4), (7, "some words in a row", 4), (8, "Some words in a row", 5), (9, "quite another text", 6), (None, "lonely text without id", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    got = simhash.near_duplicates(docs).collect()
    want = brute_components([(d, brute_print(t)) for d, t, _ in rows])
    assert sorted_rows([(r.doc_id, r.fingerprint & (1 << 64) - 1, r.component_id) for r in got]) == sorted_rows(want)
    kept = simhash.keep_one(docs).collect()
    assert sorted(r.fingerprint for r in kept) == [3, 4, 6, 7]
    assert simhash.keep_one(docs.limit(0)).count() == 0 == simhash.near_duplicates(docs.limit(0)).count()


def test_keep_one_goes_by_links_not_by_ids(spark):
    """Unlinked texts stay whatever ids they share; of each linked group one row stays, with or without ids."""
    rng = np.random.default_rng(9)
    text = lambda: " ".join("".join(rng.choice(list("abcdefghik"), 6)) for _ in range(80))
    a, b, c, d = (text() for _ in range(4))
    near = d + " one"  # a few more shingles
    rows = [(1, a), (1, b), (2, c), (None, d), (None, near), (None, a + " x y z w v u " * 30), (3, c), (1, c), (1, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    roots = {r["text_key"]: r["root"] for r in simhash.near_duplicates(df).collect()}
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect()]
    assert len(kept) == len(set(roots.values()))
    assert {(1, a), (1, b)} <= set(kept)
    assert [k for k in kept if k[1] == c] == [(1, c)]
    assert sum(k[1] in (d, near) for k in kept) == len({roots[r] for r in _keys(spark, [d, near])})


def _keys(spark, texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("xxhash64(t)").collect()]
