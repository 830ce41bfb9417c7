"""The registered queries of this folder: thin, each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm import bpe, codes, extract, lines, negatives, packing, pii, secrets, simhash, suffixes, syncmers, topk, toxicity
from curata.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line deduplication of all ``documents``: doc_id, n_lines, n_removed and the text that stays."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.line_dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


ORACLES["op10_line_dedup"] = lines.ORACLE_LINE_DEDUP


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret scan of every whole text of ``documents``: counts and digest of the base kinds, all spans."""
    return secrets.find_secrets(read_table(spark, sf_dir, "documents"), keep=["doc_id"])


@query
def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-syncmer fingerprints of every whole text of ``documents`` and of its edited text, with their likeness."""
    return syncmers.edited_neighbours(read_table(spark, sf_dir, "documents"))


@query
def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products of every 100th vector of ``embeddings`` against all others."""
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLES["op3_exact_topk"] = topk.ORACLE_TOP_K


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and component of every whole text of ``documents`` (3-word shingles, 3 bits)."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 4096 ids, every window at the sources' token proportions."""
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page of ``pages`` from its whole html."""
    return extract.extract(read_table(spark, sf_dir, "pages"), keep=["page_id", "url"])


@query
def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every whole text of ``documents`` and the text decoded from them, as digests."""
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``, learnt from the ``labels`` that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=["doc_id"]).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of every byte of ``documents`` that a repeated stretch of 200 bytes covers."""
    return suffixes.dedup_substrings(read_table(spark, sf_dir, "documents"))


@query
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``: counts and digest of the base kinds, all spans."""
    return pii.find_personal_data(read_table(spark, sf_dir, "documents"), keep=["doc_id"])


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector of ``embeddings`` for its 5 best rows of the same label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_hard_negatives(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, moved)


ORACLES["op12_hard_negatives"] = negatives.ORACLE_HARD_NEGATIVES


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every vector of ``embeddings`` in 4 parts of 256 entries, with their errors."""
    coded, books = codes.compress(read_table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", codes.codebooks_digest(books).alias("codebooks_sha256"))


ORACLES["op13_vector_codes"] = codes.ORACLE_VECTOR_CODES
