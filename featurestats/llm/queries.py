"""The registered queries of this subpackage: opN_<name> with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, lexical, merkle, nearest, personal, phrases, secrets, simhash, tiling, token_files, toxicity, warc
from .common import table

VOCAB = "byte_bpe_50k.json"


def op1_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1: toxicity scores of all documents, learned from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2: token files written and read back: offset, size and CRC-32 of each document's ids."""
    return token_files.encode_to_files(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCAB))


def op3_pii_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3: personal data spans of all documents."""
    return personal.find_personal(table(spark, sf_dir, "documents"))


def op4_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4: SimHash fingerprints and components of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op5_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5: all pages archived with revisit records and read back."""
    return warc.archive(table(spark, sf_dir, "pages"))


def op6_bpe_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6: all documents encoded and decoded."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCAB))


def op7_lang_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7: the language of all documents, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn_profiles(docs))


def op8_secret_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8: secret spans of all documents."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op9_decontam_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a benchmark item, one row for each of both."""
    return tiling.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10: fingerprints of all documents and of their edited texts."""
    return phrases.fingerprint_documents(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11: leaf, subroot, root and proof of all documents, and what tampered leaves fold to."""
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


def op12_lexical_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12: the 20 highest-scoring documents of each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13: the 5 highest inner products of every 50th vector with all others."""
    return nearest.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity_mil, op2_token_parquet, op3_pii_weak, op4_simhash_gray, op5_warc_revisit, op6_bpe_forced, op7_lang_rank,
              op8_secret_cnn, op9_decontam_tiling, op10_phrase_fingerprint, op11_merkle_manifest, op12_lexical_pipeline, op13_pivot_topk)
}
SQL: dict[str, str] = {
    "op5_warc_revisit": warc.SQL, "op11_merkle_manifest": merkle.SQL, "op12_lexical_pipeline": lexical.SQL, "op13_pivot_topk": nearest.SQL}
