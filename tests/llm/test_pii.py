"""Personal data: base spans against Python's re, learnt spans on a mixed corpus, estimation by hand, edge rows."""

import hashlib
import random
import re

import pytest

from curata.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    text = text or ""
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes(k, m[0])]


def check(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.find_personal_data(df, **kw).collect()}
    for i, text in enumerate(texts):
        base, row = brute(text), out[i]
        assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), text
        assert [row[f"n_{k}"] for k in PATTERNS] == [sum(b.startswith(k) for b in base) for k in PATTERNS]
        assert set(base) <= set(row["spans"].split(","))
    return out


def test_base_spans_of_tricky_texts(spark):
    texts = [
        "a@b.c_x@d.e and x.y%z+w-q@a-b.co.uk., a@b @c.d a@@b.c a@b..c a@b.c@d.e",
        "1.2.3.4.5.6.7.8.9 256.1.1.1 000255.1.1.01 1.2.3 1..2.3.4 99999999999999999999.1.1.1 0.0.0.0",
        "4111 1111 1111 1111 and 4111-1111-1111-1111, 4111  1111 1111 1111 79927398713 4929348385146306 49293483851463061",
        "+1 (017) 555-7713 +12 +1--2 +49 30 123456 ++1 234 567 890 1 +1 234567890123456",
        "é😀 a@b.io 😀 1.1.1.1 ß +1 (017) 555-7713",
        "", None, " ", "@", "+", "....", "+1" + "(" * 50, "a" * 3000 + "@" + "b." * 2000 + "c", "1 " * 4000, "x@y.z " * 700,
    ]
    check(spark, texts)


@pytest.mark.parametrize("alphabet", ["0123. ", "01-. +()", "a.@-_", "a1@.+- (é😀"])
def test_base_spans_of_random_texts(spark, alphabet):
    rng = random.Random(alphabet)
    check(spark, ["".join(rng.choice(alphabet) for _ in range(rng.randrange(90))) for _ in range(300)])


def corpus():
    """300 documents: prose with capitals, numbers that are no data, and planted spans with context."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts, planted = [], []
    for i in range(300):
        text = f"{word().title()} {word().title()} {prose(12)}. Order {rng.randrange(10**15, 10**16 - 1)} {prose(5)}. "
        own = []
        for lead, kind, make in (
            ("ssn ", "national_id", lambda: f"{rng.randrange(100, 665)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"),
            ("call ", "local_phone", lambda: f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"),
            ("account ", "iban", lambda: rng.choice(["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606"])),
            ("signed ", "person", lambda: f"Mr {word().title()}"),
            ("contact ", "written_email", lambda: f"{word()} (at) {word()} (dot) com"),
        ):
            if rng.random() < 0.4:
                value = make()
                text += prose(4) + " " + lead
                own.append(f"{kind}:{len(text)}:{len(text) + len(value)}")
                text += value + " " + prose(3) + ". "
        texts.append(text + f"version 100-22-{rng.randrange(1000, 9999)} {prose(3)}")
        planted.append(own)
    return texts, planted


def test_learnt_spans(spark):
    texts, planted = corpus()
    out = check(spark, texts)
    found = {(i, s) for i, r in out.items() for s in r["spans"].split(",") if s and not s.startswith(tuple(PATTERNS))}
    asked = {(i, s) for i, own in enumerate(planted) for s in own}
    assert len(found & asked) >= 0.95 * len(asked)
    assert len(found - asked) <= 0.02 * len(asked)
    first = [s.split(":")[0] for s in out[0]["spans"].split(",") if s]
    assert first == sorted(first, key=[k.name for k in pii.KINDS].index)


def test_estimation_learns_which_labeler_to_trust():
    # labeler 0 agrees with labeler 1 nine times in ten; labeler 2 votes "for" at random
    code = lambda *v: sum((x + 1) * 3 ** (3 - i) for i, x in enumerate(v))
    counts = {}
    for a in (-1, 1):
        for b in (-1, 1):
            for c in (0, 1):
                counts[0, code(a, b, c, 0)] = 900 if a == b else 100
    known, table = pii.estimate(counts, 2)
    rate = table[0]["rate"]
    assert rate[0][1][2] > 0.8 and rate[0][0][2] < 0.2
    assert abs(rate[2][1][2] - rate[2][0][2]) < 0.05
    assert known[0, code(1, 1, 0, 0)] > 0.9 > 0.1 > known[0, code(-1, -1, 1, 0)]
    assert table[1]["known"] == {}


def test_running_sums(spark):
    rows = [[], [3], list(range(pii.STRETCH)), list(range(2 * pii.STRETCH + 5))]
    df = spark.createDataFrame([(r,) for r in rows], "a array<int>")
    for r, got in zip(rows, df.selectExpr(pii._running("a") + " AS s").collect(), strict=True):
        assert got["s"][: len(r)] == [sum(r[:i]) for i in range(len(r))]


def test_edge_rows(spark):
    rows = [(None, "x@y.com", 1, "s", 2), (1, None, 1, "s", 2), (2, "", 1, "s", 2), (3, "x@y.com", 1, "s", 2), (3, "x@y.com", 1, "s", 2), (3, "1.2.3.4", 1, "s", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_email int, spans string, kind int")
    out = pii.find_personal_data(df)
    assert out.columns == ["doc_id", "text", "kind", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = sorted(((r["doc_id"] or 0), r["spans"], r["n_email"], r["kind"]) for r in out.collect())
    assert got == [(0, "email:0:7", 1, 2), (1, "", 0, 2), (2, "", 0, 2), (3, "email:0:7", 1, 2), (3, "email:0:7", 1, 2), (3, "ip:0:7", 0, 2)]
    none = pii.find_personal_data(df.limit(0))
    assert none.columns == out.columns and none.count() == 0


def test_long_text_and_many_matches(spark):
    text = "lorem 12.34.56.78 ipsum " * 4000 + "9" * 3000 + " " + "x" * 4000 + "@ a@b.com"
    check(spark, [text])


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a@b.com")], "doc_id long, text string")
    plan = pii.candidates(df, "text", ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
