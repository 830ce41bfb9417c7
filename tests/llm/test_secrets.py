import hashlib
import re
import string

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from curata.llm import automaton, secrets

# letters in either case are ASCII letters: the brute-force version spells them out
_K = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
BRUTE = {
    "assign": re.compile(rf"({_K})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def brute(text):
    text = text or ""
    spans = []
    for order, (kind, rx) in enumerate(BRUTE.items()):
        for m in rx.finditer(text):
            size = len(m.group(2)) if kind == "assign" else m.end() - m.start()
            if size >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                spans.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(spans)]


def base_of(text):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    found = secrets.scan(data, np.array([0, len(data)]))
    return [f"{secrets.RULES[r].kind}:{s}:{e}" for s, r, e in found.get(0, []) if r < 3]


WORDS = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "AKIA", "=", ":", " ", "'", '"', "\n", "é", "ſecret", "toKen", "abcdef01" * 4,
         "ABCDEF0123456789", "deadbeef", "x", "hunter2hunter2", "=abc", "..", "0" * 40, "\U0001f600", "\x00"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(WORDS) | st.text(string.printable, max_size=3), max_size=25).map("".join))
def test_scan_equals_regex(text):
    assert base_of(text) == brute(text)


@pytest.mark.parametrize("text", ["secret: token: abcdefgh1", "token==abcdefgh", "password = 'short' token=longenough1", "a" * 5000, "token=" + "a" * 5000 + " x",
                                  "é" * 3000 + "AKIA" + "B" * 3000, "password" * 700 + "=x", "token" + " " * 3000 + "=abcdefgh"])
def test_scan_edges(text):
    assert base_of(text) == brute(text)


def test_lanes_agree_with_single_steps():
    auto, _ = secrets._compiled(secrets.RULES)
    rng = np.random.default_rng(1)
    data = rng.choice(np.frombuffer(b"tokenAKI=: 0123456789abcdef\xff", dtype=np.uint8), 20000)
    state, want = 0, []
    for c in data:
        state = auto.table[state, auto.classes[c]]
        want.append(state)
    for lane in (1, 7, 64, 1024):
        assert automaton.run(auto, data, lane).tolist() == want


def test_minimal_and_parser_errors():
    assert automaton.compile_rules(["ab|cb"], searching=False).table.shape[0] == 3
    for bad in ("a)", "(a", "*a", "[a"):
        with pytest.raises((ValueError, IndexError)):
            automaton.compile_rules([bad])


def test_find_and_redact(spark):
    rows = [(1, None, "x", 5), (2, "", "x", 6), (3, "é token = 'abcdefgh9' ghp_" + "Zk" * 20, "y", 7), (3, "é token = 'abcdefgh9' ghp_" + "Zk" * 20, "y", 7), (None, "clean", None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_hex int")
    got = secrets.find_secrets(docs).collect()
    assert len(got) == 5
    by = {(r.doc_id, r.n_assign) for r in got}
    assert by == {(1, 0), (2, 0), (3, 1), (None, 0)}
    three = next(r for r in got if r.doc_id == 3)
    assert three.spans.split(",")[0] == "assign:2:20" and three.spans.count("forge_token") == 1
    assert three.base_sha256 == hashlib.sha256(b"assign:2:20").hexdigest()
    red = {(r.doc_id, r.text) for r in secrets.redact_secrets(docs).collect()}
    assert red == {(1, ""), (2, ""), (3, "é [assign]' [forge_token]"), (None, "clean")}
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    from curata.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op4_secret_scan"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
