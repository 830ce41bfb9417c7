"""Corpus pipeline: toxicity, line dedup, SimHash near-dedup, secret scans, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; all but the last return the columns of ``documents``.  ``run`` writes
each stage's rows as Parquet to the shared folder and rereads them.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm import lines, packing, secrets, simhash, toxicity
from curata.llm.common import read_table, written


def _as_documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` in their order, n_chars counted anew where there is one."""
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[f"`{c}`" for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts as toxic go; it learns from the labels of ``docs`` not held out."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    score, predicted = "_cp_score", "_cp_predicted"
    scored = toxicity.score(docs, model, keep=list(docs.columns), names=(score, predicted))
    return scored.filter(F.col(predicted) == 0).select(*[f"`{c}`" for c in docs.columns])


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows are cut out of the texts; every document stays."""
    return _as_documents(lines.line_dedup(docs), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near duplicates stays (3-word shingles, 3 bits)."""
    return simhash.keep_one(docs).select(*[f"`{c}`" for c in docs.columns])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become marks of their kind; every document stays."""
    return _as_documents(secrets.redact_secrets(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixture-controlled packing of all that is left into sequences of 4096 ids: one row a piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("packing", pack),
]
ORACLE_SQL = None  # the toxicity model, SimHash and the tokenizer have no SQL form; tests hold every stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the packed pieces."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
