import hashlib

import numpy as np
import pytest

from curata.llm import syncmers
from curata.llm.queries import QUERIES


def test_choice_is_context_free():
    rng = np.random.default_rng(0)
    points = rng.integers(97, 123, 3000).astype(np.uint32)
    at, h = syncmers.closed_syncmers(points)
    alone = [i for i in range(len(points) - syncmers.K + 1) if len(syncmers.closed_syncmers(points[i : i + syncmers.K])[0])]
    assert at.tolist() == alone
    assert [syncmers.closed_syncmers(points[i : i + syncmers.K])[1][0] for i in alone] == h.tolist()


def test_edges_by_definition():
    points = np.frombuffer(("abracadabra " * 9).encode("utf-32-le"), dtype=np.uint32)
    values = points.astype(object) + 1
    mod = 1 << 64
    root = int(syncmers._ROOT)

    def inner(i):
        h = 0
        for x in values[i : i + syncmers.S]:
            h = (h * root + int(x)) % mod
        return int(syncmers._mixed(np.array([h], dtype=np.uint64))[0])

    want = []
    for i in range(len(points) - syncmers.K + 1):
        own = [inner(i + j) for j in range(syncmers.K - syncmers.S + 1)]
        if min(own) in (own[0], own[-1]):
            want.append(i)
    assert syncmers.closed_syncmers(points)[0].tolist() == want


def test_pieces_do_not_change_fingerprints(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(chr(c) for c in rng.integers(97, 105, n)) for n in (0, 1, 15, 16, 17, 100, 5000, 20000)]
    whole = syncmers.fingerprints(texts)
    monkeypatch.setattr(syncmers, "PIECE", 97)
    assert syncmers.fingerprints(texts) == whole
    assert whole[0] == "" and all(whole[1:]) and [syncmers.fingerprints([t])[0] for t in texts] == whole


def test_likeness():
    rng = np.random.default_rng(5)
    a, b = ("".join(chr(c) for c in rng.integers(97, 120, 6000)) for _ in range(2))
    fa, fb, fe, fi = syncmers.fingerprints([a, b, a[:4000] + b[:2000], "inserted words " + a])
    assert syncmers.likeness(fa, fa) == 1 and syncmers.likeness(fa, fb) == 0
    assert 0.25 < syncmers.likeness(fa, fe) < 0.8 and syncmers.likeness(fa, fi) > 0.9
    assert syncmers.likeness("", "") == 1 and syncmers.likeness("", fa) == 0


def test_long_texts_share_anchors_of_a_passage(spark):
    rng = np.random.default_rng(8)
    words = ["".join(chr(c) for c in rng.integers(97, 123, n)) for n in rng.integers(3, 9, 50_000)]
    shared = words[:300]
    a = " ".join(words[300:10_300] + shared + words[10_300:20_000])
    b = " ".join(words[20_000:35_000] + shared + words[35_000:39_700])
    fa, fb = syncmers.fingerprints([a, b])
    assert fa.count(",") > 400  # in proportion to the length
    at, h = syncmers.closed_syncmers(np.frombuffer(a.encode("utf-32-le"), dtype=np.uint32))
    assert {w[:10] for w in fa.split(",")} == {f"{int(x) >> 24:010x}" for x in h if int(x) < 1 << 59}
    got = {r.doc_id: r for r in syncmers.edited_neighbours(spark.createDataFrame([(2, a), (1, b)], "doc_id long, text string")).collect()}
    assert got[2].near_next > 0 and got[1].near_next > 0 and 0.4 < got[2].near_edited < 0.8
    other = " ".join(rng.permutation(words[40_000:]))
    assert syncmers.likeness(fa, syncmers.fingerprints([other])[0]) == 0


def check(rows, got):
    """rows: (id, text); by descending id, then text; rows without an id last."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    want = []
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        third = len(t) // 3
        e = t[: len(t) - third] + n[:third]
        f, fe, fn = syncmers.fingerprints([t, e, n])
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), f, fe, syncmers.likeness(f, fe), syncmers.likeness(f, fn)))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    check([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()], QUERIES["op1_document_fingerprints"](spark, sf).collect())


@pytest.mark.parametrize("rows", [[], [(7, "only one document in all the table")], [(None, None), (None, "x"), (3, ""), (3, "tie"), (3, "tie"), (9, "é" * 50), (-5, None), (2**62, "big id")]])
def test_edge_rows(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "g") for r in rows], "doc_id long, text string, at int, guest string")
    check(rows, syncmers.edited_neighbours(docs).collect())
    assert syncmers.fingerprint(docs).count() == len(rows)
