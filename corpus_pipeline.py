"""A training corpus from ``documents``: each stage reads what the one before has kept.

Part of the llm subpackage. run() writes every stage as Parquet in the shared folder and
reads it again, so a later stage never recomputes an earlier one.

Defined cases, of every stage: rows are kept or dropped singly, whatever their doc_id, and null
texts count as empty. Quality: without labels of both kinds all stay. Exact and near copies: of
each group one row stays, rows without id last. Mixing: null sources are one source, copies
repeat a row with its id, and a row is taken at most three times. Encoding: no text, no tokens.
Further columns of documents, whatever their names, reach the mix and are left out of the
encoded result. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.llm import bpe, exact_dedup, mixing, near_dedup, quality
from rowproof.llm.store import cut, documents


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality.drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, on five-word shingles at 0.8, the row with the smallest doc_id stays."""
    return near_dedup.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole document, with the digest of their round trip."""
    coded = bpe.encode_decoded(docs.select("doc_id", "source", "lang", "text"), *bpe.default_tokenizer())
    return coded.select("doc_id", "source", "lang", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("byte-level BPE", encoding_stage),
]

ORACLE_SQL = None  # classifier, near duplicates and BPE are beyond SQL; tests/llm/test_pipeline.py compares them with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
