"""A training corpus from raw documents: quality filter, exact and near deduplication, secret removal, packing.

Every stage takes any table with the columns doc_id and text, keeps all columns that it finds, and gives no rows for an empty table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import quality, secrets
from quarry.llm.common import Scratch, table
from quarry.llm.exact_dedup import deduplicated
from quarry.llm.packing import pack
from quarry.llm.queries import word_bpe
from quarry.llm.simhash import representatives

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null texts are judged as empty; repeated rows stay or go together."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def exact_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the longest, then the smallest id. Null counts as empty, null ids come last, and of repeated rows one stays."""
    return deduplicated(docs)


def near_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingle sets have a Jaccard similarity of 0.8 or more, linked transitively, that of the smallest id. Null and empty texts are alike, null ids come last."""
    return representatives(docs)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets found in its text masked; n_chars, if it is there, follows the text. Null texts stay null, empty ones empty, repeated rows all stay."""
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text"))
    return clean.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences of 4096."""
    return pack(docs, word_bpe(), end_id=1, capacity=4096)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_once),
    ("SimHash near-dedup", near_once),
    ("secret scans", no_secrets),
    ("best-fit packing", packed),
]

#: Learned scores, fingerprints and token ids are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written, and read by the next."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.keep(docs, f"stage-{i}")
    return docs
