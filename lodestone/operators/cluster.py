"""Soft clustering of vectors and the cluster tree.

Reduction and hard clustering are substitutes (PCA, bisecting k-means): the
neighbourhood embedding and density clustering that the tree is usually built
with have no counterpart here, and results aren't meant to be equal. What
follows from a clustering (memberships, secondary assignment, noise, medoids)
is exact.
"""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vectors as vx
from lodestone.operators import dense


def reduced(rows: DataFrame, dims: int = 32, least: int = 15) -> DataFrame:
    """rows (doc_id, vector) in fewer dimensions; few rows are cut or padded with zeros instead."""
    if rows.limit(least + 1).count() <= least:
        padded = F.concat(vx.doubles(F.col("vector")), F.array_repeat(F.lit(0.0), dims))
        return rows.withColumn("vector", F.slice(padded, 1, dims))
    width = len(rows.select("vector").first()[0])
    if width <= dims:
        return rows
    ready = rows.withColumn("_v", array_to_vector(vx.doubles(F.col("vector"))))
    model = PCA(k=dims, inputCol="_v", outputCol="_p").fit(ready)
    return model.transform(ready).withColumn("vector", vector_to_array("_p")).drop("_v", "_p")


def split_into(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """rows with `cluster`; all in cluster 0 if there are fewer than 10."""
    if rows.limit(10).count() < 10:
        return rows.withColumn("cluster", F.lit(0))
    ready = rows.withColumn("_v", array_to_vector(vx.doubles(F.col("vector"))))
    model = BisectingKMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster", minDivisibleClusterSize=2.0).fit(ready)
    return model.transform(ready).drop("_v")


def memberships(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """(doc_id, cluster, probability): 1 - distance / (largest distance), a document's shares summing to 1."""
    pairs = rows.select("doc_id", "vector").crossJoin(dense.few(centres.select("cluster", "centre")))
    near = pairs.select("doc_id", "cluster", vx.distance(F.col("vector"), F.col("centre")).alias("distance"))
    w = Window.partitionBy("doc_id")
    share = near.withColumn("closeness", 1 - F.col("distance") / (F.max("distance").over(w) + 1e-8))
    return share.withColumn("probability", F.col("closeness") / F.sum("closeness").over(w)).select("doc_id", "cluster", "probability")


def secondary(shares: DataFrame, threshold: float = 0.5, near: float = 0.8) -> DataFrame:
    """(doc_id, cluster, is_secondary): the best cluster, and the second if it is likely enough by itself and against the first."""
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.round("probability", 9)), "cluster")
    ordered = shares.withColumn("place", F.row_number().over(w)).where("place <= 2").withColumn("first", F.max("probability").over(Window.partitionBy("doc_id")))
    keep = (F.col("place") == 1) | ((F.col("probability") > threshold) & (F.col("probability") >= near * F.col("first")))
    return ordered.where(keep).select("doc_id", "cluster", (F.col("place") == 2).alias("is_secondary"))


def noise_to_nearest(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """(doc_id, cluster): members as they are, noise (cluster -1) to its nearest centre."""
    moved = dense.nearest(rows.where("cluster = -1"), centres.where("cluster >= 0")).select("doc_id", "cluster")
    return rows.where("cluster >= 0").select("doc_id", "cluster").unionByName(moved)


def medoids(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """(cluster, doc_id): the member nearest to its centre."""
    near = rows.select("doc_id", "cluster", "vector").join(centres.select("cluster", "centre"), "cluster")
    at = F.struct(F.round(vx.distance(F.col("vector"), F.col("centre")), 9).alias("distance"), F.col("doc_id"))
    return near.groupBy("cluster").agg(F.min(at).alias("at")).select("cluster", "at.doc_id")


def refined(shares: DataFrame, scores: DataFrame, threshold: float = 0.5, band: float = 0.05) -> DataFrame:
    """(doc_id, cluster): a document whose best share is within the band around the threshold goes to its best-scoring cluster; all moves are settled before anything is built on them."""
    best = shares.groupBy("doc_id").agg(F.max_by("cluster", F.struct(F.round("probability", 9), -F.col("cluster"))).alias("cluster"), F.max("probability").alias("p"))
    judged = scores.groupBy("doc_id").agg(F.max_by("cluster", F.struct("score", -F.col("cluster"))).alias("better"))
    unsure = F.abs(F.col("p") - threshold) <= band
    return best.join(judged, "doc_id", "left").select("doc_id", F.when(unsure, F.coalesce("better", "cluster")).otherwise(F.col("cluster")).alias("cluster"))


def build_tree(rows: DataFrame, cut, leaf_size: int = 100, deepest: int = 8, branches: int = 4) -> tuple[DataFrame, DataFrame]:
    """Node table (node_id, parent_id, depth, doc_count, is_leaf) and leaf members (node_id, doc_id).

    One pass a level over all open nodes together: each splits by hyperplanes
    of its own, the signs of its members' offsets from their mean along the
    two widest components, into up to four children. `cut` ends a level's
    lineage. Levels are bounded by `deepest`.
    """
    own = rows.select("doc_id", vx.doubles(F.col("vector")).alias("vector"))
    open_ = cut(own.withColumn("node_id", F.lit("0")), "level")
    nodes, leaves = [], []
    for depth in range(deepest + 1):
        sizes = open_.groupBy("node_id").agg(F.count("*").alias("doc_count"))
        last = depth == deepest
        is_leaf = F.lit(True) if last else F.col("doc_count") <= leaf_size
        parent = F.when(F.lit(depth == 0), F.lit(None).cast("string")).otherwise(F.regexp_extract("node_id", r"^(.*)\.\d+$", 1))
        level = cut(sizes.select("node_id", parent.alias("parent_id"), F.lit(depth).alias("depth"), "doc_count", is_leaf.alias("is_leaf")), "nodes")
        nodes.append(level)
        done = level.where("is_leaf").select("node_id")
        leaves.append(open_.join(done, "node_id", "left_semi").select("node_id", "doc_id"))
        rest = open_.join(done, "node_id", "left_anti")
        if level.where("not is_leaf").isEmpty():
            break
        parts = rest.select("node_id", F.posexplode("vector").alias("i", "x")).groupBy("node_id", "i").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("spread"))
        w = Window.partitionBy("node_id").orderBy(F.desc(F.round("spread", 9)), "i")
        axes = parts.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("node_id").agg(F.min_by("i", "r").alias("i0"), F.min_by("mean", "r").alias("m0"), F.max_by("i", "r").alias("i1"), F.max_by("mean", "r").alias("m1"))
        side = (F.get("vector", F.col("i0")) > F.col("m0")).cast("int") * 2 + (F.get("vector", F.col("i1")) > F.col("m1")).cast("int")
        open_ = cut(rest.join(axes, "node_id").select("doc_id", "vector", F.concat("node_id", F.lit("."), F.least(side, F.lit(branches - 1)).cast("string")).alias("node_id")), "level")
    table, members = nodes[0], leaves[0]
    for more in nodes[1:]:
        table = table.unionByName(more)
    for more in leaves[1:]:
        members = members.unionByName(more)
    return table, members


def change_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """(node_id, event): what became of each node between two node tables."""
    a, b = before.select("node_id", F.col("doc_count").alias("old")), after.select("node_id", F.col("doc_count").alias("new"))
    event = F.when(F.col("old").isNull(), "node_created").when(F.col("new").isNull(), "node_removed").when(F.col("old") != F.col("new"), "node_updated").otherwise("node_completed")
    return a.join(b, "node_id", "full_outer").select("node_id", event.alias("event"))
