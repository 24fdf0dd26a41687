"""Class-based TF-IDF: keywords of groups of documents from one- and two-word terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import bm25, rank

FEATURES, TOP = 10_000, 10


def terms(rows: DataFrame) -> DataFrame:
    """(group, term) for each word and each pair of neighbours that are left without stop words."""
    words = bm25.full_tokens(F.col("text"))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return rows.select("group", words.alias("w")).select("group", F.explode(F.concat("w", pairs)).alias("term"))


def ctfidf(rows: DataFrame, top: int = TOP, features: int = FEATURES) -> DataFrame:
    """(group, term, score, rank) of documents (group, text).

    Only the corpus's most frequent terms count (ties by term); a term's share
    of its group times ln(1 + groups / (1 + groups with the term)).
    """
    counts = terms(rows).groupBy("group", "term").agg(F.count("*").alias("n"))
    frequent = counts.groupBy("term").agg(F.sum("n").alias("total"), F.count("*").alias("groups")).orderBy(F.desc("total"), "term").limit(features)
    kept = counts.join(F.broadcast(frequent.select("term", "groups")), "term")  # `features` rows
    sizes = kept.groupBy("group").agg(F.sum("n").alias("size"))
    n_groups = rows.select("group").distinct().agg(F.count("*").alias("n_groups"))
    scored = kept.join(sizes, "group").crossJoin(F.broadcast(n_groups)).withColumn("score", F.round(F.col("n") / F.col("size") * F.log1p(F.col("n_groups") / (1 + F.col("groups"))), 9))
    return rank.top_k(scored.where("score > 0").select("group", "term", "score"), "group", "score", "term", top)
