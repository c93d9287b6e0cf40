"""Ranks, bounded top-k and rank fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Scores that agree to so many digits are ties: a shuffle doesn't fix the order in which floats are summed.
DIGITS = 9
RRF_K = 60


def ranked(scores: DataFrame, key: str = "chunk_id", by: Sequence[str] = ("qid",)) -> DataFrame:
    """With ``rank``, from 1 on: score descending, then key. NaN scores are dropped."""
    order = W.partitionBy(*by).orderBy(F.round("score", DIGITS).desc(), F.col(key))
    return scores.where(~F.isnan("score")).withColumn("rank", F.row_number().over(order).cast("long"))


def top_k(scores: DataFrame, k: int, key: str = "chunk_id", by: Sequence[str] = ("qid",)) -> DataFrame:
    """The first k of each query. Catalyst cuts each partition to k before the shuffle (WindowGroupLimit)."""
    order = W.partitionBy(*by).orderBy(F.round("score", DIGITS).desc(), F.col(key))
    rows = scores.where(~F.isnan("score")).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    return rows.withColumn("rank", F.col("_rank").cast("long")).drop("_rank")


def fuse(signals: Sequence[tuple[DataFrame, float]], key: str = "chunk_id", constant: int = RRF_K) -> DataFrame:
    """(qid, key, score): reciprocal rank fusion of ranked lists with a weight each; absent lists add nothing."""
    parts = [hits.select("qid", key, (F.lit(float(weight)) / (constant + F.col("rank"))).alias("part")) for hits, weight in signals]
    union = parts[0]
    for other in parts[1:]:
        union = union.unionByName(other)
    return union.groupBy("qid", key).agg(F.sum("part").alias("score"))


def fuse_queries(hits: DataFrame, key: str = "chunk_id", constant: int = RRF_K) -> DataFrame:
    """Across subqueries: ``hits`` (qid, sub_idx, weight, key, score, rank) -> (qid, key, score, best_score, best_sub, contributions).

    ``contributions`` maps each subquery's number to its part.
    """
    part = F.col("weight") / (constant + F.col("rank"))
    rows = hits.withColumn("part", part)
    return rows.groupBy("qid", key).agg(
        F.sum("part").alias("score"),
        F.max("score").alias("best_score"),
        F.max_by("sub_idx", F.struct("score", -F.col("sub_idx"))).alias("best_sub"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("sub_idx", "part")))).alias("contributions"),
    )
