"""From raw documents to packed training sequences: toxicity, quality, near-duplicates, mixing, packing.

Each stage works on all that the stage before it kept, written as Parquet and read again. The result has a row for each
training sequence: (pack_group, pack, doc_ids, starts, lengths, n_tokens, texts), texts being those of its pieces in order.

What each stage makes of odd rows is what its operator states: rows of null or empty text aren't toxic but fail the quality
rules; rows that repeat are one document for near-dedup, of which one row stays, the one of least doc_id, null ids last;
columns beyond doc_id, text, lang, source and n_chars reach mixing and end there; no documents give no sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from triplane.llm.mixing import mixed_documents
from triplane.llm.near_dedup import near_dedup
from triplane.llm.packing import pack_texts
from triplane.llm.quality import filter_quality
from triplane.llm.tables import materialize
from triplane.llm.toxicity import filter_toxicity, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose severity model, fitted to ``labels``, doesn't find them toxic."""
    return filter_toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the fertility bands of their language or script."""
    return filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in token blocks drawn by source weights, a row for each piece of each slot."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of pieces with their texts: the training sequences. starts count tokens from the piece that mixing made."""
    return pack_texts(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_dedup", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: The toxicity model and its successors have no SQL; ``tests/llm/test_pipeline.py`` compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
