"""Training pairs: hard negatives, splits, samples, losses over stored vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import vectors as vx
from lodestone.operators import dense, rank


def hard_negatives(vectors: DataFrame, queries: DataFrame, positives: DataFrame, n: int = 24) -> DataFrame:
    """The n nearest rows of each query that are neither itself nor a positive of its; one positive a query."""
    found = dense.top_k(vectors, queries, n + 2)
    left = found.join(positives.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").where("query_id <> doc_id").drop("rank")
    return rank.top_k(left, "query_id", "score", "doc_id", n)


def positive_ranks(vectors: DataFrame, queries: DataFrame, positives: DataFrame) -> DataFrame:
    """(query_id, rank) of each query's positive among all rows, by counting what is better."""
    goal = queries.join(positives, "query_id").join(vectors.select("doc_id", F.col("vector").alias("p")), "doc_id").select("query_id", "vector", "doc_id", F.round(vx.dot(F.col("vector"), F.col("p")) / vx.norm(F.col("vector")) / vx.norm(F.col("p")), 9).alias("bar"))
    return dense.at_or_above(vectors, goal).groupBy("query_id").agg(F.sum("n").cast("int").alias("rank"))


def hash_share(ident: Column, seed: int, buckets: int = 100) -> Column:
    """A reproducible bucket of an id, 0 to buckets - 1: 28 bits of the SHA-1 over `seed:id`."""
    h = F.sha1(F.concat(F.lit(f"{seed}:"), ident.cast("string")).cast("binary"))
    return F.conv(F.substring(h, 1, 7), 16, 10).cast("long") % buckets


def split(rows: DataFrame, ident: str, seed: int, held_out: int = 1) -> DataFrame:
    """rows with `part`: held_out per cent validation, the rest training."""
    return rows.withColumn("part", F.when(hash_share(F.col(ident), seed) < held_out, "validation").otherwise("train"))


def draw_negatives(negatives: Column, ident: Column, n: int, seed: int) -> Column:
    """n of an array by a seeded order that differs from row to row."""
    keyed = F.transform(negatives, lambda x: F.struct(F.md5(F.concat(F.lit(f"{seed}:"), ident.cast("string"), F.lit(":"), x.cast("string")).cast("binary")).alias("h"), x.alias("x")))
    return F.transform(F.slice(F.sort_array(keyed), 1, n), lambda s: s["x"])


def with_end(ids: Column, most: int, end: int) -> Column:
    """Token ids cut to `most`, then the end id."""
    return F.concat(F.slice(ids, 1, most), F.array(F.lit(end)))


def spread(negatives: str, n: int) -> list[Column]:
    """An array as n columns negative_1..n, null where it is shorter."""
    return [F.get(F.col(negatives), k).alias(f"negative_{k + 1}") for k in range(n)]


def contrastive_loss(positive: Column, negatives: Column, temperature: float = 0.05) -> Column:
    """-log softmax of the positive's similarity among the negatives'."""
    every = F.transform(F.concat(F.array(positive), negatives), lambda s: s / temperature)
    top = F.array_max(every)
    total = F.aggregate(every, F.lit(0.0), lambda a, s: a + F.exp(s - top))
    return F.log(total) + top - positive / temperature
