import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from curata.llm import packing, secrets, toxicity
from tests.llm.test_simhash import brute_components, brute_print

SF = "/root/testdata/sf0.001"


def brute_lines(rows):
    """rows: (id, text) with different ids, by id."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        ls = text.split("\n")
        cut = set()
        for i in range(len(ls) - 2):
            k = tuple(ls[i : i + 3])
            if not "".join(k).strip(" \t\r"):
                continue
            if k in seen:
                cut |= {i, i + 1, i + 2}
            seen.add(k)
        out[d] = "\n".join(x for i, x in enumerate(ls) if i not in cut)
    return out


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    found = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == columns and out.dtypes == spark.read.parquet(f"{SF}/documents.parquet").dtypes
        rows, before = out.collect(), {r.doc_id: r for r in docs.collect()}
        if name == "toxicity":
            model = toxicity.train(docs, labels)
            keep = {d for d, r in before.items() if model.score(max(toxicity.decisions(sorted(toxicity.units(r.text or "")), model.weights, model.bias), default=model.threshold - 1.0)) < 0.5}
            assert {r.doc_id: r for r in rows} == {d: r for d, r in before.items() if d in keep} and 0 < len(rows) < len(before)
        elif name == "line dedup":
            assert {r.doc_id: r.text for r in rows} == brute_lines([(d, r.text or "") for d, r in before.items()])
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "SimHash near-dedup":
            assert sorted(r.doc_id for r in rows) == sorted({c for _, _, c in brute_components([(d, brute_print(r.text)) for d, r in before.items()])})
        elif name == "secret scans":
            assert len(rows) == len(before)
            for r in rows:
                hidden = re.findall(r"\[(?:assign|access|hex|private_key|forge_token|chat_token)\]", r.text)
                assert hidden or r.text == before[r.doc_id].text
                assert not re.search("AKIA[A-Z0-9]{12}|[0-9a-f]{32}", r.text) and r.n_chars == len(r.text)
        else:
            tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            want = {d: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for d, r in before.items()}
            got = {}
            for r in rows:
                got[r.doc_id] = got.get(r.doc_id, 0) + r.length
            assert got == want
        found.append(len(rows))
        docs = spark.createDataFrame(rows, out.schema) if name != "packing" else docs
    assert corpus_pipeline.run(spark, SF).count() == found[-1]
    assert packing.LENGTH == 4096 and secrets.RULES[:3] == secrets.BASE_RULES


def test_edge_rows(spark):
    rows = [(1, None, "en", "a", 4, 9), (2, "", None, None, None, 9), (None, "some text of no id\nwith\nlines\nwith\nlines", "en", "a", 1, 9), (4, "password = 'abcdefgh1234'", "en", "a", 1, 9), (4, "password = 'abcdefgh1234'", "en", "a", 1, 9), (5, "x " * 200000, "en", "b", 1, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    for data in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, data, SF)
            assert name == "packing" or out.columns == docs.columns
            n = out.count()
            assert n or data.limit(1).count() == 0
            data = spark.createDataFrame(out.collect(), out.schema)
