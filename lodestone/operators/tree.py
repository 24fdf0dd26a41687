"""Trees as node tables (node_id, parent_id, depth): paths, links, views, building."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paths(nodes: DataFrame, leaves: DataFrame, deepest: int) -> DataFrame:
    """(node_id, path from the root) by one join a level, `deepest` of them; joins stop growing once all are at the root."""
    step = leaves.select("node_id", F.col("node_id").alias("at"), F.col("node_id").alias("path"))
    parents = nodes.select(F.col("node_id").alias("at"), "parent_id")
    for _ in range(deepest):
        up = step.join(parents, "at", "left")
        step = up.select("node_id", F.coalesce("parent_id", F.lit("")).alias("at"), F.when(F.col("parent_id").isNull(), F.col("path")).otherwise(F.concat("parent_id", F.lit("/"), "path")).alias("path"))
    return step.select("node_id", "path")


def with_child_counts(nodes: DataFrame) -> DataFrame:
    n = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n_children"))
    return nodes.join(n, "node_id", "left").fillna(0, ["n_children"])


def stats(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("total"), F.count_if(F.col("n_children") == 0).alias("leaves"), F.count_if(F.col("n_children") > 0).alias("internal"), F.max("depth").alias("max_depth"))


def edges(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_id is not null").select(F.col("parent_id").alias("source"), F.col("node_id").alias("target"), "depth")


def view(nodes: DataFrame, deepest: int, top: int, size: str) -> DataFrame:
    """Edges among the largest nodes down to a depth, both ends kept."""
    kept = nodes.where(F.col("depth") <= deepest).orderBy(F.desc(size), "node_id").limit(top)
    ids = kept.select("node_id")
    return edges(kept).join(ids.select(F.col("node_id").alias("source")), "source", "left_semi").join(ids.select(F.col("node_id").alias("target")), "target", "left_semi")


def sibling_links(nodes: DataFrame, parent: str, ident: str, order: str) -> DataFrame:
    w = Window.partitionBy(parent).orderBy(order)
    return nodes.withColumn("next_sibling", F.lead(ident).over(w)).withColumn("sibling_idx", F.row_number().over(w) - 1).withColumn("n_siblings", F.count("*").over(Window.partitionBy(parent)))


def first_children(nodes: DataFrame, parent: str, ident: str, order: str) -> DataFrame:
    """(parent, first_child)."""
    return nodes.groupBy(parent).agg(F.min_by(ident, order).alias("first_child"))


def interval_parents(nodes: DataFrame) -> DataFrame:
    """Nodes (doc_id, level, start, end) with the bounds of the first node a level up that contains them.

    Within a document the containing node of the level above is the one that
    starts last at or before the node: an as-of look-up by window, no join.
    """
    child = nodes.select("doc_id", "level", "start", "end", F.lit(1).alias("kind"), F.col("level").alias("at"))
    parent = nodes.select("doc_id", "level", "start", "end", F.lit(0).alias("kind"), (F.col("level") + 1).alias("at"))
    w = Window.partitionBy("doc_id", "at").orderBy("start", "kind", F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.when(F.col("kind") == 0, F.struct("start", "end"))
    found = child.unionByName(parent).withColumn("p", F.last(own, ignorenulls=True).over(w)).where("kind = 1")
    inside = F.col("p.end") >= F.col("end")
    return found.select("doc_id", "level", "start", "end", F.when(inside, F.col("p.start")).alias("parent_start"), F.when(inside, F.col("p.end")).alias("parent_end"))
