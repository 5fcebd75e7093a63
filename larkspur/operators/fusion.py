"""Reciprocal-rank fusion and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_fusion(dense: DataFrame, sparse: DataFrame, k: int = 10, top_k: int = 5) -> DataFrame:
    """``question_id, chunk_id, score, dense_rank, sparse_rank, rank``: score is the sum of 1 / (k + rank) over
    the lists, the old scores are dropped, ties go by first appearance (dense list, then sparse)."""
    none = F.lit(None).cast("int")
    one = dense.select("question_id", "chunk_id", F.col("dense_rank"), none.alias("sparse_rank"), F.col("dense_rank").cast("long").alias("seen"))
    two = sparse.select("question_id", "chunk_id", none.alias("dense_rank"), F.col("sparse_rank"), (F.col("sparse_rank") + F.lit(1_000_000)).cast("long").alias("seen"))
    both = one.unionByName(two).withColumn("rank", F.coalesce("dense_rank", "sparse_rank"))
    fused = both.groupBy("question_id", "chunk_id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.max("dense_rank").alias("dense_rank"), F.max("sparse_rank").alias("sparse_rank"), F.min("seen").alias("seen")
    )
    w = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), "seen")
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k).drop("seen")


def rank_label() -> Column:
    """Where a result came from, such as d2+s1."""
    return F.concat_ws("+", F.when(F.col("dense_rank").isNotNull(), F.concat(F.lit("d"), F.col("dense_rank"))), F.when(F.col("sparse_rank").isNotNull(), F.concat(F.lit("s"), F.col("sparse_rank"))))


def retrieve(mode: str, dense, sparse, top_k: int = 5, candidate_k: int = 20, rrf_k: int = 10) -> DataFrame:
    """``dense(k)`` and ``sparse(k)`` give ranked lists; any mode but those two is hybrid, which takes
    ``candidate_k`` of each before fusion."""
    if mode == "dense":
        return dense(top_k).withColumn("sparse_rank", F.lit(None).cast("int")).withColumn("rank", F.col("dense_rank"))
    if mode == "sparse":
        return sparse(top_k).withColumn("dense_rank", F.lit(None).cast("int")).withColumn("rank", F.col("sparse_rank"))
    return rank_fusion(dense(candidate_k), sparse(candidate_k), rrf_k, top_k)


def with_chunks(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Late materialisation: text and metadata of the few chunks that were retrieved."""
    return chunks.join(results, "chunk_id")
