"""Registered queries of the training-data operators: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embeddings, fim, merkle, neardup, passages, quality, suffixes, tokencounts, toxicity, urlfilter, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents. Null and empty texts have no words; null ids, ties and repeated rows as in ``decontaminate``."""
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by 2-word shingles. Null and empty texts are alone; other cases as in ``neardup``."""
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), shingle=2, threshold=0.8).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 and more between all vectors. Null, zero and non-finite vectors are alone; other cases as in ``embeddings``."""
    return embeddings.near_vectors(_read(spark, sf_dir, "embeddings"), cosine=0.9)


def _vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and what they decode to, as digests. Null texts count as empty; other cases as in ``bpe``."""
    return bpe.round_trip_digests(_read(spark, sf_dir, "documents"), *_vocabulary())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a model of the labelled rows that are not held out; nulls and empty tables as in ``toxicity``."""
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


def op9_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all urls. Null urls and those without a scheme have an empty host and path; other cases as in ``urlfilter``."""
    return urlfilter.judge(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back. Null pages count as empty; other cases as in ``warc``."""
    return warc.round_trip(_read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that documents share with a smaller doc_id. Null and empty texts have none; other cases as in ``passages``."""
    return passages.repeated_passages(_read(spark, sf_dir, "documents"))


def op7_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of every document: words go, words come in the middle, and the end is continued."""
    docs, n = _read(spark, sf_dir, "documents"), F.coalesce(F.length("text"), F.lit(0))
    third, half = F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int")

    def edit(start, end, replacement):
        return F.struct(start.alias("start"), end.alias("end"), F.lit(replacement).alias("replacement"))

    edits = F.array(edit(third, third + 11, ""), edit(half, half, " edited text,"), edit(n + 2, n + 2, "tail 42"))
    return tokencounts.edit_counts(docs.select("doc_id", "text", edits.alias("edits")), *_vocabulary())


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that a smaller doc_id has, and what is left. Null texts count as empty; other cases as in ``suffixes``."""
    return suffixes.repeated_bytes(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents with digests of the proofs, and the roots that leaves of changed texts fold to.

    Nulls, repeated rows and empty tables as in ``merkle``.
    """
    out = merkle.audit(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
                      "folded_root", "verified")


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle forms of all documents and the texts restored from them, as digests; nulls as in ``fim``."""
    return fim.round_trip(_read(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a model of the labelled rows that are not held out; nulls as in ``quality``."""
    return quality.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_minhash": op2_minhash,
    "op3_embeddings": op3_embeddings,
    "op4_bpe": op4_bpe,
    "op5_passages": op5_passages,
    "op6_toxicity": op6_toxicity,
    "op7_tokencounts": op7_tokencounts,
    "op8_suffixes": op8_suffixes,
    "op9_urlfilter": op9_urlfilter,
    "op10_warc": op10_warc,
    "op11_merkle": op11_merkle,
    "op12_fim": op12_fim,
    "op13_quality": op13_quality,
}
