"""Exact vector search: queries in bounded blocks against all rows, by matrix products on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import vectors as vx
from lodestone.operators import rank

#: Queries that are sent to every task at once; more are searched block after block.
BLOCK = 4096
#: Rows of a table of vectors up to which it is broadcast.
FEW = 20_000


def _block_scores(rows: DataFrame, queries: list, k: int, kind: str) -> DataFrame:
    ids = np.array([q[0] for q in queries], np.int64)
    matrix = np.array([q[1] for q in queries], np.float64)
    if kind == "cosine":
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    shared = rows.sparkSession.sparkContext.broadcast((ids, matrix))  # BLOCK vectors at most

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy()
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
            if kind == "cosine":
                values = values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-300)
            score = np.round(matrix @ values.T, 9)
            n = min(k + 1, len(own))  # one more: the query itself may be among them
            # a batch passes on all that ties with its last place
            bar = -np.partition(-score, n - 1, axis=1)[:, n - 1]
            q, at = np.nonzero(score >= bar[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(own[at]), pa.array(score[q, at])], ["query_id", "doc_id", "score"])

    return rows.mapInArrow(search, "query_id long, doc_id long, score double")


def top_k(rows: DataFrame, queries: DataFrame, k: int, kind: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): the best k rows (doc_id, vector) of each query (query_id, vector), by cosine or inner product."""
    usable = rows.where(F.col("vector").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "vector")
    found, block = None, []

    def add(found, block):
        made = _block_scores(usable, block, k, kind)
        return made if found is None else found.unionByName(made)

    for q in queries.where(F.col("vector").isNotNull()).select(F.col("query_id").cast("long"), "vector").toLocalIterator():
        block.append(q)
        if len(block) == BLOCK:
            found, block = add(found, block), []
    if block or found is None:
        found = add(found, block) if block else usable.selectExpr("doc_id as query_id", "doc_id", "0.0d as score").limit(0)
    if exclude_self:
        found = found.where("query_id <> doc_id")
    return rank.top_k(found, "query_id", "score", "doc_id", k)


def few(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if they are counted to be few; a larger table is joined as Spark plans it. Hand over a stored table: it is read twice."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def at_or_above(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(query_id, n): how many rows (doc_id, vector) lie, by cosine and then doc_id, at or above each goal (query_id, vector, doc_id, bar).

    Counts are summed in the task, so no list of scores is made or sorted;
    a query's counts come in parts.
    """
    usable = rows.where(F.col("vector").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "vector")
    schema = "query_id long, n long"

    def add(found: DataFrame | None, block: list) -> DataFrame:
        ids, goal = (np.array([q[k] for q in block], np.int64) for k in (0, 2))
        matrix, bar = np.array([q[1] for q in block], np.float64), np.array([q[3] for q in block], np.float64)
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        shared = rows.sparkSession.sparkContext.broadcast((ids, matrix, goal, bar))  # BLOCK vectors at most

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix, goal, bar = shared.value
            total = np.zeros(len(ids), np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = batch.column(0).to_numpy()
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
                values = values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-300)
                score = np.round(matrix @ values.T, 9)
                total += ((score > bar[:, None]) | ((score == bar[:, None]) & (own <= goal[:, None]))).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["query_id", "n"])

        made = usable.mapInArrow(count, schema)
        return made if found is None else found.unionByName(made)

    found, block = None, []
    for q in goals.where(F.col("vector").isNotNull()).select(F.col("query_id").cast("long"), "vector", F.col("doc_id").cast("long"), "bar").toLocalIterator():
        block.append(q)
        if len(block) == BLOCK:
            found, block = add(found, block), []
    if block:
        found = add(found, block)
    return rows.sparkSession.createDataFrame([], schema) if found is None else found


def scores(rows: DataFrame, queries: DataFrame, value: Column) -> DataFrame:
    """(query_id, doc_id, score) of every pair as an expression of q and v, for query sets of a few rows."""
    asked = few(queries.select("query_id", F.col("vector").alias("q")))
    return rows.select("doc_id", F.col("vector").alias("v")).crossJoin(asked).select("query_id", "doc_id", F.round(value, 9).alias("score"))


def by_distance(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Top k by L2 distance of unit vectors: the order of cosine, the score a distance."""
    found = top_k(rows, queries, k)
    return found.withColumn("score", F.round(F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))), 6))


def nearest(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """doc_id with the nearest centre (cluster, centre) and its distance."""
    pairs = rows.select("doc_id", "vector").crossJoin(few(centres.select("cluster", "centre")))
    near = pairs.select("doc_id", F.struct(F.round(vx.distance(F.col("vector"), F.col("centre")), 9).alias("distance"), "cluster").alias("at"))
    return near.groupBy("doc_id").agg(F.min("at").alias("at")).select("doc_id", "at.cluster", "at.distance")


def elementwise(rows: DataFrame, group: str, vector: str, function=F.avg) -> DataFrame:
    """(group, centre): the mean (or another aggregate) of a group's vectors, component by component."""
    parts = rows.select(group, F.posexplode(vx.doubles(F.col(vector))).alias("i", "x")).groupBy(group, "i").agg(function("x").alias("x"))
    return parts.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))
