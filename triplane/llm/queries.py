"""The registered queries of this subpackage, one for each operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from triplane.llm.chat import format_reply_trees, reply_parents

    return format_reply_trees(reply_parents(_table(spark, sf_dir, "conversations")))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from triplane.llm.near_dedup import near_duplicate_pairs

    return near_duplicate_pairs(_table(spark, sf_dir, "documents"))


def op3_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from triplane.llm.wrappers import extract

    return extract(_table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from triplane.llm.quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from triplane.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from triplane.llm.toxicity import score_toxicity, train

    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, _table(spark, sf_dir, "labels")))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from triplane.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of every vector whose id is divisible by 20, among all."""
    from triplane.llm.topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0).withColumn("distance", F.round("distance", 6))


def op9_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20, under the language model of all other documents."""
    from triplane.llm.document_lm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), F.col("doc_id") % 20 == 0)


def op9_ngram_lm_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage under the language model of all documents."""
    from triplane.llm.ngram_lm import score_texts

    return score_texts(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from triplane.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat, op2_near_dedup, op3_wrappers, op4_quality, op5_packing, op6_toxicity, op7_licenses, op8_topk, op9_ngram_lm, op9_ngram_lm_benchmark, op10_mixing)}

_TOPK_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
pairs AS (SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.x, b.x) AS d FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor_id) AS rank FROM pairs)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(d, 6) AS distance FROM ranked WHERE rank <= 10
"""


def _oracles() -> dict[str, str]:
    from triplane.llm.chat import SQL

    return {"op1_chat": SQL, "op8_topk": _TOPK_SQL}


ORACLE_SQL: dict[str, str] = _oracles()
