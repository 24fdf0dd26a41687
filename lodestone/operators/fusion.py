"""Ranked lists (query_id, doc_id, rank) put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import rank


def tagged(lists: dict[str, DataFrame]) -> DataFrame:
    """All lists below each other with their name and place."""
    parts = [r.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.lit(name).alias("list"), F.lit(n).alias("place")) for n, (name, r) in enumerate(lists.items())]
    return reduce(DataFrame.unionByName, parts)


def rrf(lists: dict[str, DataFrame], k0: float = 60, weights: dict[str, float] | None = None, depth: dict[str, int] | None = None) -> DataFrame:
    """Reciprocal rank fusion over 1-based ranks; absent from a list adds nothing; ties by the lists' own ranks in order."""
    rows = tagged({n: (r.where(F.col("rank") <= depth[n]) if depth else r) for n, r in lists.items()})
    weight = reduce(lambda c, n: c.when(F.col("list") == n, float((weights or {}).get(n, 1.0))), lists, F.when(F.lit(False), 0.0))
    ranks = [F.min(F.when(F.col("list") == n, F.col("rank"))).alias(f"rank_{n}") for n in lists]
    fused = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(weight / (k0 + F.col("rank"))), 9).alias("score"), *ranks)
    order = [F.desc("score"), *[F.asc_nulls_last(f"rank_{n}") for n in lists], "doc_id"]
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def rrf_with_defaults(signals: dict[str, tuple[DataFrame, float, int]], k0: float = 60) -> DataFrame:
    """Weighted fusion over 0-based ranks; a document that a signal lacks gets the signal's default rank."""
    rows = tagged({n: s[0] for n, s in signals.items()})
    ranks = [F.min(F.when(F.col("list") == n, F.col("rank"))).alias(n) for n in signals]
    fused = rows.groupBy("query_id", "doc_id").agg(*ranks)
    score = reduce(lambda a, b: a + b, [F.lit(float(w)) / (k0 + F.coalesce(F.col(n), F.lit(default))) for n, (_, w, default) in signals.items()])
    return rank.ranked(fused.withColumn("score", F.round(score, 9)), "query_id", "score", "doc_id", first=0)


def union(lists: dict[str, DataFrame], cap: int | None = None) -> DataFrame:
    """The first list's order, then what only later lists have, in theirs."""
    rows = tagged(lists).groupBy("query_id", "doc_id").agg(F.min(F.struct("place", "rank")).alias("at"))
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at.place", "at.rank", "doc_id")))
    return (out if cap is None else out.where(F.col("rank") <= cap)).select("query_id", "doc_id", "rank")


def blended(rows: DataFrame, fusion_score: str, rerank_score: str, share: float = 0.7) -> DataFrame:
    """`blend`: share of the reranker's and the rest of the fusion's min-max score; a missing reranker score is 0."""
    low = rank.min_max(F.col(fusion_score), "query_id")
    high = F.coalesce(rank.min_max(F.col(rerank_score), "query_id"), F.lit(0.0))
    return rows.withColumn("blend", share * high + (1 - share) * low)


def head_and_tail(ranking: DataFrame, pool: int, rerank_score: str, mode: str = "tiered", share: float = 0.7) -> DataFrame:
    """Final order: the first `pool` by blend, the rest by fusion score.

    tiered keeps the head before the tail; interleave normalises both apart
    and sorts them together, so the best of the tail can overtake.
    """
    head = blended(ranking.where(F.col("rank") <= pool), "score", rerank_score, share).withColumn("tier", F.lit(0))
    tail = ranking.where(F.col("rank") > pool).withColumn("blend", rank.min_max(F.col("score"), "query_id")).withColumn("tier", F.lit(1))
    rows = head.unionByName(tail).withColumn("blend", F.round("blend", 9))
    order = ["tier", F.desc("blend"), "rank"] if mode == "tiered" else [F.desc("blend"), "rank"]
    return rows.withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
