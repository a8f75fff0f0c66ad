"""Corpus preparation: from raw documents to token files, in five stages.

Each stage takes all that the one before kept and returns the columns of documents; the last
returns what the token files say of each document. documents needs doc_id, text, lang and source;
columns beyond these may have any names and come through unchanged. In every stage an empty table
gives an empty table, texts of any length are read whole, and other nulls than those named below
are values like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardloom.llm.common import drop_since, drop_written, scratch_mark, scratch_path, table, written
from shardloom.llm.decontaminate import decontaminated
from shardloom.llm.minhash_dedup import one_of_each
from shardloom.llm.mixing import mixture
from shardloom.llm.quality import scored
from shardloom.llm.token_files import default_tokenizer, read_tokens, write_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go, those without text among them; repeated rows are judged alike."""
    return scored(docs, table(spark, sf_dir, "labels")).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8).

    It is the one with the smallest doc_id, a null doc_id last; of repeated rows one stays. Documents
    without words are copies of nothing but of their own repeated rows.
    """
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, all their repeated rows too; without text there is nothing to hold."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources repeat, up to four times; every row occurs at least once. A null source is a source."""
    return mixture(docs, max_repeat=4.0).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id order, null first; one row a document, as read back. A null text has the end id alone."""
    uri = scratch_path(spark, "pipeline-tokens")
    write_tokens(docs, uri, tokenizer=default_tokenizer(), runs=True)  # epochs of a document lie together
    return read_tokens(spark, uri)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

#: Signatures, models and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table; each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, mark = docs, scratch_mark()
        docs = written(stage(spark, before, sf_dir), f"stage-{name}")
        if k < len(STAGES) - 1:  # the last one leaves the token files
            drop_since(spark, mark, docs)
        drop_written(before)
    return docs
