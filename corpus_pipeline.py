"""The corpus pipeline: from documents to packed training sequences, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm import language, line_dedup, mixing, ngram_join, packing
from emberlog.llm.common import read_documents, ship_code
from emberlog.runtime import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: no letters, or a score below one half."""
    return language.keep_known(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that resemble an earlier line go; documents of which no word is left go with them."""
    return line_dedup.drop_repeated_lines(docs, least_words=1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more, the document with the least id stays."""
    return ngram_join.keep_firsts(docs, shingle=5, num=80, den=100)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, mixed by source with weights tempered towards small sources, in the order of their slots."""
    return mixing.mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids placed in sequences of 1024."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mix_to_weights),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, with each result stored in the session's shared folder."""
    docs = read_documents(spark, sf_dir)
    ship_code(spark)
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: SQL cannot express a trained classifier or tokenization; the tests hold the run against brute force.
ORACLE_SQL = None
