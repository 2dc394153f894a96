"""From raw documents to token ids in five stages; each works on what its predecessor kept."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession

from graphbatch.llm.bpe import encode_texts
from graphbatch.llm.common import read_table, write_and_reread
from graphbatch.llm.decontamination import drop_leaks
from graphbatch.llm.ngram_join import keep_one_of_each
from graphbatch.llm.pii import pseudonymise
from graphbatch.llm.quality_rules import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what fails the base rule or the decision list learned from the labels."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return keep_one_of_each(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace private values by pseudonyms of their format, under the key that the session names.

    Without one (spark.corpus.pseudonymKey) a key is drawn for this run and told to nobody: values stay linked within the run, and no one can undo them.
    """
    key = spark.conf.get("spark.corpus.pseudonymKey", None)
    if key is None:
        key = secrets.token_hex(32)
        spark.conf.set("spark.corpus.pseudonymKey", key)  # one key for all stages and tables of the session
    return pseudonymise(docs, key=key)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document as little-endian unsigned 32-bit integers."""
    return encode_texts(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("PII", pseudonyms),
    ("BPE encoding", encode),
]

#: Learned rules, edit distances, keyed networks and BPE are beyond SQL; tests/llm compares each stage with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_and_reread(docs, f"pipeline-{k}")
    return docs
