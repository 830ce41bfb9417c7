import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from curata.llm import bpe
from curata.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def brute(text):
    ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(TOKENIZER.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_texts_of_all_kinds(spark, monkeypatch):
    monkeypatch.setattr(bpe, "GROUP", 5)
    rng = random.Random(3)
    parts = ["a", "Hello", "'s", "don't", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", " ", "　", "\x1c", "\x85", "é", "é", "日本", "😀", "123", "²", ".", "...", "<|endoftext|>", "<|", "\x00", "́", "﻿", "​"]
    texts = [None, "", " ", "\n", "  x", "x  ", "x \n y", "x\n\n\ny", "\n x", "a" * 30000, "ab cd " * 20000]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(1500)]
    docs = spark.createDataFrame([(i if i % 7 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    docs = docs.withColumn("n", docs.doc_id)
    got = bpe.encode_decode(docs, PATH, keep=["doc_id", "text"], with_ids=True).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == brute(r.text), repr(r.text)
        assert r.decoded == (r.text or "") and len(r.ids) == r.n_tokens
    assert bpe.encode_decode(docs.limit(0), PATH).count() == 0


def test_wide_white_space_parts_units(spark):
    spaces = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u180e\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
    rng = random.Random(4)
    texts = [f"ab{x}cd" + f"{x}{y}e " + f" {x}f{y}" for x in spaces for y in spaces]
    texts += ["".join(rng.choices([*spaces, "a", "é", "1", ".", " the"], k=12)) for _ in range(500)] + ["one\xa0two three " * 400]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in bpe.encode_decode(docs, PATH, with_ids=True).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == brute(r.text), repr(r.text)
    longest = docs.select(bpe.units(docs.text, bpe.special_tokens(PATH)).alias("u")).selectExpr("max(array_max(transform(u, x -> length(x)))) AS n").first().n
    assert longest < 100


def test_remembered_bytes_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_BYTES", 20_000, raising=False)
    words = bpe.WordTable(PATH)
    for i in range(60):
        own = [f"w{i} {j} <|endoftext|>" + " word" * 1000 if j % 2 else f" word{i}x{j}" for j in range(10)]
        got = words.of(own)
        assert [x.tolist() for x in got] == [TOKENIZER.encode(w, add_special_tokens=False).ids for w in own]
        assert sum(len(w) + x.nbytes for w, x in words.ids.items()) < 25_000


def test_query_equals_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op5_bpe_round_trip"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == brute(texts[r.doc_id])
