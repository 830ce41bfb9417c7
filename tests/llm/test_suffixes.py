import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from curata.llm import anchors, suffixes
from curata.llm.queries import QUERIES
from curata.llm.suffixes import dedup_substrings

L = anchors.LENGTH


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + L] for r in raws for i in range(len(r) - L + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, dtype=np.int64)
        for i in range(len(r) - L + 1):
            if seen[r[i : i + L]] > 1:
                gone[i : i + L] = 1
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((len(r), int(gone[:-1].sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_anchors_serve_every_start_by_content():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 30000).astype(np.uint8)
    data[9000:12000] = np.resize(data[100:105], 3000)
    data[20000:21000] = data[1000:2000]
    offsets = np.array([0, 0, 150, 349, 549, 15000, 30000])
    doc, place, first, last = anchors.anchors(data, offsets)
    served = {(d, s): p - s for d, p, a, z in zip(doc.tolist(), place.tolist(), first.tolist(), last.tolist()) for s in range(a, z + 1)}
    assert set(served) == {(d, s) for d in range(6) for s in range(offsets[d + 1] - offsets[d] - L + 1)}
    away = {}
    for (d, s), distance in served.items():
        content = data[offsets[d] + s : offsets[d] + s + L].tobytes()
        assert 0 <= distance < anchors.WINDOW and away.setdefault(content, distance) == distance


def test_long_texts_in_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 123, 20000).astype(np.uint8)
    offsets = np.array([0, 300, 17000, 20000])
    served = lambda: {(d, s): p for d, p, a, z in zip(*(x.tolist() for x in anchors.anchors(data, offsets))) for s in range(a, z + 1)}
    whole = served()
    monkeypatch.setattr(anchors, "BLOCK", 1000)
    assert served() == whole


def check(spark, texts, partitions=3):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, tag string, first int").repartition(partitions)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup_substrings(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_edges(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    p199, p200, p201, p260, p900 = (word(3 * n)[:n] for n in (150, 199, 201, 260, 900))
    exact = "".join(rng.choices("abcdefgh", k=200))
    texts = [None, "", "short", "short", p900, p900, p900[:400] + word(50) + p900[400:], word(100) + p260 + word(90), word(300) + p260, p260 + word(5), word(400) + exact, exact, exact + "z", "y" + exact[:199], word(10) + exact[1:] + word(9),
             "ab" * 99, "ab" * 100, "ab" * 101, "q" * 199, "q" * 200, "r" * 201, "xyz" * 400 + word(500) + "xyz" * 30, p199 + p199 + p199, p200 + "|" + p200, p201 * 4, word(250)]
    check(spark, texts)
    base = [word(700) for _ in range(6)]
    many = []
    for _ in range(120):
        t = rng.choice(base)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(t))
            t = t[:at] + rng.choice(["", "X", "YY", word(30)]) + t[at + rng.choice([0, 1, 5]) :]
        many.append(word(rng.randint(0, 40)) + t[rng.randint(0, 300) :])
    check(spark, many)
    check(spark, [], 1)


def test_heavy_cores_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HEAVY", 32)
    monkeypatch.setattr(suffixes, "SAMPLE", 2)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abcdefgh", k=n))
    passage, longer = word(190), word(230)
    texts = [word(rng.randint(150, 250)) + (passage if i % 2 else longer) + word(rng.randint(100, 250)) for i in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    keyed = docs.selectExpr("doc_id", "text", "xxhash64(text) AS text_key", "0L AS tag").repartition(40)
    assert suffixes._heavy_cores(keyed)
    check(spark, texts, 40)


def passage_texts(n):
    """One long passage in different surroundings, some of them alike for a while."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choices("abcdefgh", k=n))
    passage, ends = word(700), [word(60) for _ in range(4)]
    return [word(rng.randint(50, 250)) + rng.choice(ends)[rng.randint(0, 50) :] + passage + rng.choice(ends)[: rng.randint(0, 60)] + word(rng.randint(50, 250)) for _ in range(n)]


def test_crowded_cores_go_by_starts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CLASS", 8)
    monkeypatch.setattr(suffixes, "STARTS", 500)
    check(spark, passage_texts(120), 7)


def test_no_class_holds_a_crowded_core():
    texts, place = passage_texts(300), 400
    tuples = [{"place": place, "first": place - 60, "last": place - 10, "many": 0, "crowded": True} for _ in texts]
    texts = [t[:300] + texts[0][300:1000] + t[1000:] for t in texts]
    source = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([0] * 300), pa.array(texts), pa.array([[t] for t in tuples])], ["text_key", "tag", "text", "tuples"])
    rows = pa.Table.from_batches(suffixes._carried(iter([source])))
    sizes = Counter(rows.column("class").to_pylist())
    assert rows.num_rows <= 2 * 51 + 300 * 51 and max(sizes.values()) <= 51 + 1
    found = {(r["text_key"], x) for b in suffixes._induced(iter(rows.sort_by("class").to_batches())) for r in b.to_pylist() for x in range(r["first"], r["last"] + 1)}
    assert found == {(i, x) for i in range(300) for x in range(place - 60, place - 9)}


def test_kept_bytes_and_null_ids(spark):
    t = "é" * 100 + "0123456789" * 3
    docs = spark.createDataFrame([(None, "abc" + t), (7, t), (7, t[:50])], "doc_id long, text string")
    rows = dedup_substrings(docs, with_kept=True).collect()
    assert sorted(bytes(r.kept) for r in rows) == [b"", b"abc", t[:50].encode()]
    assert sorted((s.begin, s.end) for r in rows for s in r.spans) == [(0, 230), (3, 233)]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op9_substring_dedup"](spark, sf).collect()}
    assert [got[r.doc_id] for r in rows] == brute([r.text for r in rows])
