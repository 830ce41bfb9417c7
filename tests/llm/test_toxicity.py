import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from curata.llm import toxicity as t
from curata.llm.queries import QUERIES


def kernel(a, b):
    """Brute force: triples in order within SPAN places, DECAY to the power of both spans, normalised by length."""

    def triples(w):
        w = ["\x02", *w, "\x03"]
        return [(tuple(w[i] for i in c), t.DECAY ** (c[2] - c[0])) for c in combinations(range(len(w)), 3) if c[2] - c[0] <= t.SPAN]

    def norm(w):
        return max(sum(t.DECAY ** (2 * (c[2] - c[0])) for c in combinations(range(len(w) + 2), 3) if c[2] - c[0] <= t.SPAN), t.DECAY**4) ** 0.5

    return sum(x * y for f, x in triples(a) for g, y in triples(b) if f == g) / norm(a) / norm(b)


def test_kernel_equals_brute_force():
    words = ["idiot", "idxiot", "moron", "a", "", "ab", "banana", "élève", "aaaaaaaa"]
    got = t.Landmarks(words).kernel(words)
    want = [[kernel(a, b) for b in words] for a in words]
    assert np.allclose(got, want, atol=1e-5)
    assert got[0][1] > 5 * got[0][2]  # an inserted letter costs less than another word


def test_signs_do_not_hide_letters():
    w = np.random.default_rng(0).normal(size=t.CODES**3)
    w[0] = 0
    d = t.decisions(["idiot", "i.d.i.o.t", "...idiot!", "1d10t", "other"], w, 0.5)
    assert np.allclose(d[:4], d[0]) and not np.isclose(d[0], d[4])
    assert np.allclose(t.decisions(["idiot"] * 3 + ["other"], w, 0.5)[:3], d[0])
    assert "i d i o t" in t.units("you I D I O T there") and t.units("") == set() and max(map(len, t.units("x" * 1000))) == t.LONG


def corpus(n, seed):
    rng = random.Random(seed)
    bad = ["scoundrel", "numbskull", "nitwit"]
    texts, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(["ba", "ter", "on", "li", "es", "ga"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 80))]
        y = i % 3 == 0
        if y:
            words[rng.randrange(len(words))] = rng.choice(bad)
        texts.append(" ".join(words) + ".")
        labels.append(int(y))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    return t.fit(*corpus(300, 1))


def highest(model, text):
    return model.score(max(t.decisions(sorted(t.units(text)), model.weights, model.bias), default=model.threshold - 1.0))


def test_finds_words_gaps_and_insertions(model):
    texts, labels = corpus(200, 2)
    right = [(highest(model, x) >= 0.5) == bool(y) for x, y in zip(texts, labels, strict=True)]
    assert sum(right) >= 0.98 * len(right)
    clean = "ba ter on li es ga " * 5
    assert highest(model, clean) < 0.5 and highest(model, "") < 0.5
    for word in ("scoundrel", "scoundrxel", "s-c-o-u-n-d-r-e-l", "s c o u n d r e l", "Numbskull!", "n1tw1t"):
        assert highest(model, clean + word) >= 0.5, word


@pytest.mark.parametrize(("signs", "bad"), [("абвгдежзиклмнопрст", "дурак"), ("αβγδεζηθικλμνξοπρσ", "βλακας"), ("नमककलबसतरपदह", "मूर्ख"), ("अआइईउऊएऐ", "बेवकूफ"), ("אבגדהוזחטיכלמנ", "טיפשון")])
def test_other_scripts(signs, bad):
    texts, labels = scripts(240, 4, signs, bad, " ")
    learnt = t.fit(texts, labels)
    new, truth = scripts(120, 5, signs, bad, " ")
    assert sum((highest(learnt, x) >= 0.5) == bool(y) for x, y in zip(new, truth, strict=True)) >= 0.97 * len(new)


@pytest.mark.parametrize(("signs", "bad"), [("天地人山水火木金土日月年大小中上下左右前後東西南北", "混蛋"), ("あいうえおかきくけこさしすせそたちつてと", "ばかやろう")])
def test_scripts_without_spaces(signs, bad):
    texts, labels = scripts(240, 4, signs, bad, "")
    learnt = t.fit(texts, labels)
    new, truth = scripts(120, 5, signs, bad, "")
    assert sum((highest(learnt, x) >= 0.5) == bool(y) for x, y in zip(new, truth, strict=True)) >= 0.97 * len(new)


def scripts(n, seed, signs, bad, space):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(signs, k=rng.randint(2, 6))) for _ in range(rng.randint(5, 30))]
        if i % 3 == 0:
            words[rng.randrange(len(words))] = bad
        texts.append(space.join(words))
        labels.append(int(i % 3 == 0))
    return texts, labels


def test_without_both_classes():
    for texts, labels in (([], []), (["a b"], [1]), (["a b"], [0]), (["", ""], [0, 1])):
        assert highest(t.fit(texts, labels), "a b") < 0.5


def test_edge_rows(spark):
    texts, labels = corpus(150, 3)
    rows = [(i, x, "y", 1) for i, x in enumerate(texts)] + [(None, None, "y", 1), (-1, "", "y", 1), (-2, "nitwit " * 30000, "y", 1), (-2, "nitwit " * 30000, "y", 1), (-3, "x" * 100000, "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, toxic int")
    labelled = spark.createDataFrame([(i, y, "z") for i, y in enumerate(labels)] + [(None, 1, "z"), (3, None, "z"), (5000, 1, "z"), (0, labels[0], "z")], "doc_id long, toxic int, text string")
    got = t.score(docs, t.train(docs, labelled)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[-2].predicted == 1 and by[-1].predicted == by[-3].predicted == by[None].predicted == 0
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert t.score(docs.limit(0), t.train(docs.limit(0), labelled)).count() == 0
    held = {r.doc_id: r.h for r in docs.select("doc_id", t.held_out(docs.doc_id).alias("h")).collect()}
    assert held == {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in by}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(truth[r.doc_id], r.predicted) for r in QUERIES["op6_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in truth]
    hits = sum(y and p for y, p in got)
    assert len(got) > 500 and hits >= 0.85 * sum(y for y, _ in got)
    assert sum(p and not y for y, p in got) <= 0.06 * len(got)
