"""A training-corpus pipeline over `documents`: each stage works on all that the one before it kept.

All stages but the last hand on every column of documents, whatever its name. Defined cases are those of the operators:
null texts count as empty and stay until the last stage, of copies one row stays, a table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.bpe import encode_documents, word_bpe_path
from tickloom.llm.classifier import quality_stage
from tickloom.llm.common import written
from tickloom.llm.minhash import minhash_stage
from tickloom.llm.mixing import mixed_documents
from tickloom.llm.suffix_dedup import suffix_stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_stage(spark, docs, sf_dir)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return minhash_stage(spark, docs, sf_dir)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that stand elsewhere, too."""
    return suffix_stage(spark, docs, sf_dir)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by target weights; a document drawn several times is several rows."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of the mix."""
    return encode_documents(docs, word_bpe_path())


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("suffix-array dedup", repeats),
    ("mixing sources", mixing),
    ("bpe encoding and decoding", encoding),
]

#: SQL expresses neither the classifier's fit nor the seeded mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each result written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
