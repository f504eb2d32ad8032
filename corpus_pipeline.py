"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Null and empty texts pass the stages that look for something in a text (the first one unless labelled texts without a
known word are mostly toxic) and are encoded as no tokens; a null doc_id is kept and
is no partner of another row. An empty table gives empty stages. Repeated rows are judged alike and stay repeated. All
stages but the last keep all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contestry.llm import bpe, decontaminate, neardup, passages, toxicity
from contestry.llm.common import scratch


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id."""
    return neardup.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words and more that a document with a smaller doc_id has."""
    return passages.remove_passages(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark windows."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, their number, and whether they decode to the text's bytes."""
    import public_tokenizers

    where = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode_checked(docs, *where)


STAGES = [
    ("toxicity", toxic),
    ("near-duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Nearest neighbours and connected components are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
