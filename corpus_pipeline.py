"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, tokenising.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

Every stage takes nulls in any column, empty texts, repeated rows, ties, empty tables and further columns, which are kept:

* quality rules: a null or empty text has too few words and goes; repeated rows share their fate.
* near duplicates: rows that share an id are one document and stay or go together; a null id stays; a text without words
  has no duplicates.
* secret scans: a null text stays null.
* mixing sources: null sources, languages and topics are values of their own; rows are drawn by a hash of the id, or of the
  text where the id is null. The topic is a stand-in, the text's shape.
* tokenising: a null text has no tokens.

The folder of a stage is removed as soon as the next one is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cardinal.llm import bpe, mixing, ngram_join, quality, secrets
from cardinal.llm.staging import dropped, staged

TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest id stays."""
    return ngram_join.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text, and n_chars follows."""
    return secrets.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics meet their target shares of tokens."""
    return mixing.draw(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digest."""
    return bpe.digests(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources", mix_sources),
    ("BPE encoding", tokenise),
]

#: Shingle components, decoding layers and merges can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        after = staged(stage(spark, docs, sf_dir))
        if before is not None:
            dropped(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
