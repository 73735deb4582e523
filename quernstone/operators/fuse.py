"""Reciprocal rank fusion of two ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Default weights of the two lists and the constant added to each rank.
SEMANTIC_WEIGHT, KEYWORD_WEIGHT, RRF_K = 0.7, 0.3, 60


def rrf_fuse(
    semantic: DataFrame,
    keyword: DataFrame,
    k: int | None = None,
    semantic_weight: float | None = None,
    keyword_weight: float | None = None,
    rrf_k: int | None = None,
) -> DataFrame:
    """Merge two lists of (query, id, score, rank) by weighted reciprocal rank.

    Returns query, id, score, semantic_rank, keyword_rank, semantic_score,
    keyword_score and the final rank. A missing or zero setting means its
    default. Equal scores keep the semantic order, then the keyword order.
    """
    if semantic_weight is not None and keyword_weight is not None:
        if abs(semantic_weight + keyword_weight - 1.0) > 0.01:
            raise ValueError(f"weights {semantic_weight} and {keyword_weight} should add up to 1")
    ws, wk, c = semantic_weight or SEMANTIC_WEIGHT, keyword_weight or KEYWORD_WEIGHT, rrf_k or RRF_K
    sides = [
        hits.select("query", "id", F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"{name}_score"))
        for name, hits in (("semantic", semantic), ("keyword", keyword))
    ]
    joined = sides[0].join(sides[1], ["query", "id"], "full_outer")
    shares = [
        F.coalesce(F.lit(float(weight)) / (F.lit(c) + F.col(f"{name}_rank")), F.lit(0.0))
        for name, weight in (("semantic", ws), ("keyword", wk))
    ]
    scored = joined.withColumn("score", shares[0] + shares[1])
    order = [
        F.col("score").desc(),
        F.col("semantic_rank").asc_nulls_last(),
        F.col("keyword_rank").asc_nulls_last(),
        F.col("id").asc(),
    ]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    kept = ranked if k is None else ranked.where(F.col("rank") <= k)
    return kept.select(
        "query", "id", "score", "semantic_rank", "keyword_rank", "semantic_score", "keyword_score", "rank"
    )
