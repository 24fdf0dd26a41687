"""Reranking by given judgements: parsing, cascades, passes, and diversity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vectors as vx
from lodestone.operators import dense, fusion, rank


def parsed_indices(reply: Column, n: Column) -> Column:
    """The first list of numbers in a reply as indices: what is out of range or repeats is dropped."""
    opened = F.slice(F.split(reply, r"\["), 2, F.greatest(F.lit(1), F.size(F.split(reply, r"\["))))
    closed = F.filter(opened, lambda part: F.contains(part, F.lit("]")))
    items = F.transform(closed, lambda part: F.filter(F.transform(F.split(F.substring_index(part, "]", 1), ","), lambda v: F.trim(v)), lambda v: v != ""))
    numbers = F.transform(items, lambda list_: F.transform(list_, lambda v: v.try_cast("double")))
    first = F.get(F.filter(numbers, lambda list_: (F.size(list_) > 0) & F.forall(list_, lambda v: v.isNotNull())), F.lit(0))
    whole = F.transform(F.filter(F.coalesce(first, F.array().cast("array<double>")), lambda v: (v >= 0) & (v < n)), lambda v: v.cast("int"))
    return F.array_distinct(whole)


def cascade(ranking: DataFrame, stages: list[tuple[int, int, DataFrame]]) -> DataFrame:
    """Each stage reorders the first `pool` by its score and keeps `kept`; the others follow in the order before.

    stages: (pool, kept, scores (query_id, doc_id, judged)); without a score a document keeps its place behind the judged ones.
    """
    out = ranking.select("query_id", "doc_id", "rank")
    for pool, kept, scores in stages:
        rows = out.join(scores.select("query_id", "doc_id", "judged"), ["query_id", "doc_id"], "left").withColumn("judged", F.when(F.col("rank") <= pool, F.col("judged")))
        w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("judged"), "rank")
        rows = rows.withColumn("place", F.when(F.col("judged").isNotNull(), F.row_number().over(w)))
        chosen = rows.withColumn("tier", F.when(F.col("place") <= kept, 0).otherwise(1))
        order = Window.partitionBy("query_id").orderBy("tier", F.when(F.col("tier") == 0, F.col("place")).otherwise(F.col("rank")))
        out = chosen.select("query_id", "doc_id", F.row_number().over(order).alias("rank"))
    return out


def yes_first(ranking: DataFrame, answer: str = "yes") -> DataFrame:
    """Documents judged yes before the others, both in the order they had."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce(F.col(answer), F.lit(False))), "rank")
    return ranking.withColumn("new_rank", F.row_number().over(w))


def graded(ranking: DataFrame, grade: str, second: str | None = None, depth: int = 30) -> DataFrame:
    """Order by grade, then by rank; a second pass over the first `depth` can only raise a grade."""
    w = Window.partitionBy("query_id").orderBy(F.desc("g"), "rank")
    out = ranking.withColumn("g", F.coalesce(F.col(grade), F.lit(0))).withColumn("new_rank", F.row_number().over(w))
    if second is not None:
        raised = F.when(F.col("new_rank") <= depth, F.greatest("g", F.coalesce(F.col(second), F.lit(0)))).otherwise(F.col("g"))
        out = out.withColumn("g", raised).withColumn("new_rank", F.row_number().over(w))
    return out


def chunk_picks(ranking: DataFrame, grade: str, pick_score: str, size: int = 10, boost: int = 3) -> DataFrame:
    """The best of every `size` consecutive ranks gains `boost`."""
    rows = ranking.withColumn("chunk", F.floor((F.col("rank") - 1) / size))
    first = F.row_number().over(Window.partitionBy("query_id", "chunk").orderBy(F.desc(pick_score), "rank")) == 1
    rows = rows.withColumn("g", F.col(grade) + F.when(first, boost).otherwise(0))
    return rows.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("g"), "rank")))


def strict_pass(ranking: DataFrame, grade: str, answer: str, depth: int = 20) -> DataFrame:
    """After grading, a strict yes among the first `depth` counts 3."""
    graded_rows = graded(ranking, grade)
    g = F.when((F.col("new_rank") <= depth) & F.col(answer), 3).otherwise(F.col("g"))
    return graded_rows.withColumn("g", g).withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("g"), "rank")))


def mmr(ranking: DataFrame, vectors: DataFrame, lam: float = 0.5, pool: int = 200, take: int = 200, query_vectors: DataFrame | None = None) -> DataFrame:
    """Greedy diversity: lam * normalised score less (1 - lam) * nearness to what is picked (or, with query vectors, to the query); equal values go by score, then doc_id.

    One query's pool is a task's group, so it is bounded by `pool`. Candidates without a vector are left out first.
    """
    rows = ranking.where(F.col("rank") <= pool).select("query_id", "doc_id", "score").join(vectors.select("doc_id", "vector"), "doc_id")
    if query_vectors is not None:
        rows = rows.join(query_vectors.select("query_id", F.col("vector").alias("q")), "query_id")

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "doc_id"], ascending=[False, True])
        score = group["score"].to_numpy()
        score = (score - score.min()) / (score.max() - score.min() + 1e-9)
        v = np.stack(group["vector"].to_list()).astype(np.float64)
        sims = v @ v.T if "q" not in group else np.tile(v @ np.asarray(group["q"].iloc[0], np.float64), (len(v), 1))
        near, left, order = np.zeros(len(v)), np.ones(len(v), bool), []
        for _ in range(min(take, len(v))):
            value = np.where(left, np.round(lam * score - (1 - lam) * near, 9), -np.inf)
            best = int(value.argmax())
            order.append(best)
            left[best] = False
            near = np.maximum(near, sims[best])
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "doc_id": group["doc_id"].to_numpy()[order], "rank": range(1, len(order) + 1)})

    return rows.groupBy("query_id").applyInPandas(pick, "query_id long, doc_id long, rank long")


def away_from_head(ranking: DataFrame, vectors: DataFrame, lam: float = 0.5, pool: int = 200, head: int = 10) -> DataFrame:
    """Normalised score less lam * nearness to the first few others."""
    rows = ranking.where(F.col("rank") <= pool).join(vectors.select("doc_id", "vector"), "doc_id")
    scaled = rows.withColumn("s", rank.min_max(F.col("score"), "query_id"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("r") <= head)
    first = first.select("query_id", F.col("doc_id").alias("other"), F.col("vector").alias("w"))
    near = scaled.join(first, "query_id").withColumn("sim", F.when(F.col("doc_id") == F.col("other"), -1.0).otherwise(vx.dot(F.col("vector"), F.col("w"))))
    value = near.groupBy("query_id", "doc_id", "s").agg(F.max("sim").alias("near"))
    return rank.ranked(value.withColumn("score", F.round(F.col("s") - lam * F.col("near"), 6)), "query_id", "score", "doc_id").select("query_id", "doc_id", "score", "rank")


def cluster_expansion(queries: DataFrame, centres: DataFrame, members: DataFrame, touched: DataFrame, clusters: int = 500, docs: int = 50) -> DataFrame:
    """Documents of the clusters nearest to a query.

    A cluster's score is the cosine times ln(1 + size), half as much again if
    a keyword hit lies in it, nothing below a cosine of 0.1.
    queries (query_id, vector), centres (cluster, centre), members (cluster,
    doc_id), touched (query_id, doc_id).
    """
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    cosine = dense.top_k(centres.select(F.col("cluster").alias("doc_id"), F.col("centre").alias("vector")), queries, clusters * 4).select("query_id", F.col("doc_id").alias("cluster"), F.col("score").alias("cosine"))
    hit = touched.join(members, "doc_id").select("query_id", "cluster").distinct().withColumn("hit", F.lit(True))
    rows = cosine.join(sizes, "cluster").join(hit, ["query_id", "cluster"], "left")
    value = F.col("cosine") * F.log1p("size") * F.when(F.col("hit"), 1.5).otherwise(1.0)
    rows = rows.withColumn("score", F.round(F.when(F.col("cosine") < 0.1, 0.0).otherwise(value), 6)).where("score > 0")
    best = rank.top_k(rows, "query_id", "score", "cluster", clusters).select("query_id", "cluster", "score", F.col("rank").alias("cluster_rank"))
    placed = members.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("doc_id"))).where(F.col("r") <= docs)
    return best.join(placed, "cluster").select("query_id", "cluster", "cluster_rank", "doc_id", "score")


def leaf_routing(scores: DataFrame, members: DataFrame, threshold: float = 0.5, least: int = 15) -> DataFrame:
    """Leaves above the threshold, or the best few; a document takes the rank of its best leaf. scores (query_id, leaf, score), members (leaf, doc_id)."""
    chosen = rank.above_or_first(scores, "query_id", "score", "leaf", threshold, least)
    return chosen.join(members, "leaf").groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))


def pool_of(lists: dict[str, DataFrame], depths: dict[str, int], cap: int) -> DataFrame:
    """Capped pool of several lists' first documents, in the lists' order."""
    return fusion.union({n: r.where(F.col("rank") <= depths[n]) for n, r in lists.items()}, cap)

