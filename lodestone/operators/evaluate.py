"""Retrieval evaluation over rankings (query_id, doc_id, rank) and gold (query_id, doc_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 5, 10, 20, 50, 100)


def recall(found: Column, expected: Column) -> Column:
    """1 where nothing is expected."""
    return F.when(expected == 0, F.lit(1.0)).otherwise(found / expected)


def gold_ranks(ranking: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """Every query with the best rank of a gold document, null if none is ranked."""
    best = ranking.join(gold.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("best"))
    return queries.select("query_id").join(best, "query_id", "left")


def hit_rates(ranks: DataFrame, ks=KS) -> DataFrame:
    """(k, hits, n, hit_rate_pct)."""
    at = ranks.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "best")
    return at.groupBy("k").agg(F.count_if(F.col("best") <= F.col("k")).alias("hits"), F.count("*").alias("n")).withColumn("hit_rate_pct", F.round(100 * F.col("hits") / F.col("n"), 3))


def nearest_rank(column: str, share: float) -> Column:
    """The element at floor(share * n) of the sorted values (no interpolation)."""
    values = F.sort_array(F.collect_list(column))
    return F.element_at(values, F.least(F.floor(F.size(values) * share) + 1, F.size(values)).cast("int"))


def rank_summary(ranks: DataFrame) -> DataFrame:
    """Mean, median and 95th percentile of the best ranks, by nearest rank; counts per rank are aggregated first, so nothing is collected that grows with the rows."""
    hits = ranks.where("best is not null").groupBy("best").agg(F.count("*").alias("c"))
    w = Window.orderBy("best").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = hits.select("best", "c", F.sum("c").over(w).alias("upto"), F.sum("c").over(total).alias("n"))

    def at(share: float) -> Column:
        return F.min(F.when(F.col("upto") > F.floor(F.col("n") * share), F.col("best")))

    return placed.agg(F.sum("c").alias("n_hit"), F.round(F.sum(F.col("best") * F.col("c")) / F.sum("c"), 6).alias("mean_rank"), at(0.5).alias("p50_rank"), at(0.95).alias("p95_rank"))


def mrr(ranks: DataFrame) -> Column:
    return F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0)))


BUCKETS = ((1, "1"), (10, "2-10"), (100, "11-100"), (500, "101-500"), (1000, "501-1000"), (2000, "1001-2000"), (5000, "2001-5000"))


def bucket(rank: Column) -> Column:
    out = F.when(rank.isNull(), "none")
    for most, name in BUCKETS:
        out = out.when(rank <= most, name)
    return out.otherwise("over 5000")


def recall_table(ranking: DataFrame, gold: DataFrame, queries: DataFrame, ks=(10, 20, 50)) -> DataFrame:
    """Per query: expected, and found at each depth and in all; recalls default to 1 without gold."""
    expected = gold.select("query_id", "doc_id").distinct()
    found = expected.join(ranking.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    per = found.groupBy("query_id").agg(F.count("*").alias("expected"), F.count("rank").alias("found_all"), *[F.count_if(F.col("rank") <= k).alias(f"found_{k}") for k in ks])
    counts = ["expected", "found_all", *[f"found_{k}" for k in ks]]
    return queries.select("query_id").join(per, "query_id", "left").fillna(0, counts)


def jaccard(a: DataFrame, b: DataFrame, depth: int = 100) -> DataFrame:
    """Per query, the Jaccard similarity of two rankings' first documents."""
    rows = a.where(F.col("rank") <= depth).select("query_id", "doc_id", F.lit(1).alias("s")).unionByName(b.where(F.col("rank") <= depth).select("query_id", "doc_id", F.lit(2).alias("s")))
    both = rows.groupBy("query_id", "doc_id").agg(F.sum("s").alias("s"))
    return both.groupBy("query_id").agg((F.count_if(F.col("s") == 3) / F.count("*")).alias("jaccard"))
