"""The corpus pipeline: five stages over ``documents``, each calling one of the operators of ``featurestats.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared checkpoint
folder and reads it again as the next stage's documents.  All but the last return the columns of documents.

* language: documents whose language isn't identified (no letter, or like no profile) go;
* near_duplicates: of each SimHash component the document with the smallest doc_id stays;
* decontaminate: documents that hold a benchmark item go;
* secrets: every secret in a text is replaced by its kind, and n_chars follows;
* encode: the token ids of each document, and whether decoding them gives the text again.

Nulls, empty tables and repeated rows are treated as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from featurestats.llm import bpe, langid, secrets, simhash, tiling
from featurestats.llm.common import materialize, table
from featurestats.llm.queries import VOCAB

#: The least likeness to the nearest language profile; a few known words are well above it.
MIN_LANGUAGE_SCORE = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.reject_unidentified(docs, langid.learn_profiles(docs), MIN_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiling.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenize_documents(docs, public_tokenizers.path(VOCAB))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", mask_secrets),
    ("encode", encode),
]

#: SQL can express neither the profiles, the fingerprints' hash, the network nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
