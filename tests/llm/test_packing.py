import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from curata.llm import packing, words
from curata.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ODD = ["Hello,", "world's", "DON'T", "it's'll", " ", "\n", "\t\x0b", "\xa0", " ", "\x1c", "\x85", "éÉß", "ÀÖ×÷", "²³¼9", "12345", "…", "日本語", "é", "́", "Σας ΑΣ", "İstanbul", "<|endoftext|>", "<|", "|>", "\x00", "\x7f", "😀", "ª", "µ", "­", "don''t", "'s's", "ﬁ"]


def brute_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ODD) | st.text(max_size=4), max_size=15).map("".join))
def test_word_ids_equal_library(text):
    e = words.encoder(PATH)
    assert np.frombuffer(e.encode(text.encode("utf-8", "ignore")), dtype=e.kind).tolist() == brute_ids(text.encode("utf-8", "ignore").decode())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=8), st.data())
def test_shares_are_the_greedy_schedule(weights, data):
    w = np.array(weights)
    n = data.draw(st.integers(0, 300))
    sent = np.zeros(len(w), dtype=np.int64)
    rows = [sent.copy()]
    for _ in range(n):
        sent[np.argmax(w / (2.0 * sent + 1.0))] += 1
        rows.append(sent.copy())
    assert (packing.shares(w, np.arange(n + 1)) == np.array(rows)).all()


@pytest.mark.parametrize("weights", [None, [1, 1, 1, 0], [5, 0.1, 2, 0]])
def test_schedule_sends_everything_in_order(weights):
    s = packing.Schedule([1000, 3, 70, 11], weights)
    sent = s.sent(np.arange(s.stream + 5))
    assert (np.diff(sent, axis=0) >= 0).all() and (sent[: s.stream + 1].sum(axis=1) == np.arange(s.stream + 1)).all()
    assert sent[-1].tolist() == [1000, 3, 70, 11]
    queue = np.repeat(np.arange(4), [1000, 3, 70, 11])
    place = np.concatenate([np.arange(n) for n in (1000, 3, 70, 11)])
    w = s.window_of(queue, place, 64)
    assert (s.sent(w * 64)[np.arange(len(w)), queue] <= place).all() and (s.sent((w + 1) * 64)[np.arange(len(w)), queue] > place).all()


def check(rows, pieces, length):
    want = sorted(((d is None, d or 0), [*brute_ids(t), packing.END]) for d, t in rows)
    by_sequence, by_doc = {}, {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault((p.doc_id is None, p.doc_id or 0), []).append(p)
    for s, own in by_sequence.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == length or s == max(by_sequence) and at <= length
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert sum(p.length for p in pieces) == sum(len(i) for _, i in want)
    ids = {}
    for k, i in want:
        ids.setdefault(k, []).append(i)
    assert set(ids) == set(by_doc)
    for k, own in by_doc.items():
        if len(ids[k]) == 1:
            (i,) = ids[k]
            at = 0
            for p in sorted(own, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(i)
                assert p.ids_crc32 == zlib.crc32(np.array(i[at : at + p.length], dtype="<u4").tobytes())
                at += p.length
            assert at == len(i)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    pieces = QUERIES["op7_mixture_packing"](spark, sf).collect()
    check([(r.doc_id, r.text) for r in docs], pieces, 4096)
    source, total = {r.doc_id: r.source for r in docs}, sum(p.length for p in pieces)
    share = {}
    for p in pieces:
        share[source[p.doc_id]] = share.get(source[p.doc_id], 0) + p.length
    for w in range(max(p.sequence_id for p in pieces)):  # every full window is at the proportions to a token or so
        own = {}
        for p in pieces:
            if p.sequence_id == w:
                own[source[p.doc_id]] = own.get(source[p.doc_id], 0) + p.length
        assert all(abs(own.get(s, 0) - 4096 * n / total) <= 2 for s, n in share.items())


@pytest.mark.parametrize("broadcast", [0, 50_000])
def test_edge_rows_and_targets(spark, monkeypatch, broadcast):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", broadcast)
    rows = [(1, None, "a", 1), (2, "", None, 2), (3, "tie words " * 40, "a", 3), (3, "tie words " * 40, "a", 3), (None, "no id <|endoftext|> here", "b", 4), (5, "Ünïcode é " * 500, "b", 5), (6, "x", "c", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, before int").repartition(3)
    for targets in (None, {"a": 1, "b": 1}, {None: 1.0}):
        pieces = packing.pack(docs, PATH, targets, length=64, with_ids=True).collect()
        check([r[:2] for r in rows], pieces, 64)
        assert all(zlib.crc32(np.array(p.ids, dtype="<u4").tobytes()) == p.ids_crc32 for p in pieces)
    assert packing.pack(docs.limit(0), PATH).count() == 0
