"""Connected components of a link table by alternating large-star and small-star steps.

Each step groups with partial aggregation and joins back on the same key, so a
node with very many links is pre-aggregated and its join is split where
skewed. Nothing is collected; each round is cut to the shared folder, and the
round before it is removed there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut_at, remove, shared_path

#: Alternations double the reach of a label; more than this many would need paths of over 2 ** 40 links, and are an error.
ROUNDS = 40


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node that has a link to another; root is the smallest node reachable. Nulls and loops are ignored."""
    edges = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(F.col(u).isNotNull() & F.col(v).isNotNull()).where("u <> v").distinct()
    spark = links.sparkSession
    path = shared_path(spark, "links")
    edges = cut_at(edges, path)
    before = _state(edges)
    if not before[0]:
        return edges.toDF("node", "root")
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # after the large star every link points to a smaller node; the small star then joins the neighbours below
        large = large.unionByName(least.where("u <> m").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        old, path = path, shared_path(spark, "links")
        edges = cut_at(small.where("u <> v").distinct(), path)
        remove(spark, old)
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
