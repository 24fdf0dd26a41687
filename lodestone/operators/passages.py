"""Which documents hold a passage, word for word: an equi-join on an anchor of inner words, then the exact test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANCHOR = 5


def holding(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, doc_id) of passages (query_id, text) and documents (doc_id, text) that contain them.

    A passage's first and last words may touch other characters of the
    document, its inner words may not, so the second to the sixth are its
    anchor. Passages of fewer than seven words are looked for in every
    document.
    """
    tokens = F.split("text", r"\s+")
    asked = passages.select("query_id", F.col("text").alias("passage"), tokens.alias("t")).where("passage is not null")
    long = asked.where(F.size("t") >= ANCHOR + 2).select("query_id", "passage", F.array_join(F.slice("t", 2, ANCHOR), " ").alias("anchor"))
    n = F.size("t")
    grams = F.when(n >= ANCHOR, F.transform(F.sequence(F.lit(1), n - ANCHOR + 1), lambda i: F.array_join(F.slice(F.col("t"), i, ANCHOR), " ")))
    anchors = docs.select("doc_id", tokens.alias("t")).select("doc_id", F.explode(F.array_distinct(grams)).alias("anchor"))
    hits = anchors.join(long, "anchor").select("query_id", "doc_id", "passage")
    found = hits.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "passage")).select("query_id", "doc_id")
    short = asked.where(F.size("t") < ANCHOR + 2).select("query_id", "passage")
    return found.unionByName(docs.join(short, F.contains(F.col("text"), F.col("passage"))).select("query_id", "doc_id")).distinct()
