"""Late interaction: sum over a query's vectors of the best dot product with a document's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vectors as vx
from lodestone.operators import dense, rank

#: Queries that are sent to the documents at once.
BLOCK = 1024


def token_table(rows: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    """(doc_id, vectors): each group's vectors in order."""
    packed = rows.groupBy(F.col(group).alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), vx.doubles(F.col(vector)).alias("v")))).alias("p"))
    return packed.select("doc_id", F.transform("p", lambda x: x["v"]).alias("vectors"))


def score_all(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of a stated set of queries against all documents (doc_id, vectors), in blocks of queries; documents never move."""
    spark, out = docs.sparkSession, None
    asked = [(r[0], np.array(r[1], np.float64)) for r in queries.select("doc_id", "vectors").toLocalIterator() if r[1]]
    for a in range(0, max(1, len(asked)), BLOCK):
        shared = spark.sparkContext.broadcast(asked[a : a + BLOCK])

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names = np.array([q for q, _ in shared.value], np.int64)
            first = np.cumsum([0, *(len(v) for _, v in shared.value)])[:-1]
            flat = np.concatenate([v for _, v in shared.value]) if len(names) else None
            for batch in batches:
                for doc, vectors in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if vectors and len(names):
                        made = np.add.reduceat((flat @ np.array(vectors, np.float64).T).max(1), first)
                        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(names), doc)), pa.array(np.round(made, 6))], ["query_id", "doc_id", "score"])

        part = docs.select(F.col("doc_id").cast("long"), "vectors").mapInArrow(score, "query_id long, doc_id long, score double")
        out = part if out is None else out.unionByName(part)
    return out


def rerank(candidates: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates (query_id, doc_id) by exact MaxSim; documents without vectors are dropped."""
    q = queries.select(F.col("doc_id").alias("query_id"), F.col("vectors").alias("q"))
    rows = candidates.select("query_id", "doc_id").join(docs.select("doc_id", "vectors"), "doc_id").join(q, "query_id")
    return rank.ranked(rows.select("query_id", "doc_id", F.round(vx.maxsim(F.col("q"), F.col("vectors")), 6).alias("score")), "query_id", "score", "doc_id")


def pooled(docs: DataFrame, function=F.max) -> DataFrame:
    """(doc_id, vector): a document's vectors pooled component by component, unit length."""
    flat = docs.select("doc_id", F.explode("vectors").alias("v"))
    made = dense.elementwise(flat, "doc_id", "v", function)
    return made.select("doc_id", vx.normalised(F.col("centre")).alias("vector"))


def prefilter(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k documents of each query whose pooled vector is nearest to any of the query's vectors."""
    asked = queries.select(F.col("doc_id").alias("query_id"), F.posexplode("vectors").alias("i", "vector"))
    keyed = asked.withColumn("key", F.row_number().over(Window.orderBy("query_id", "i")).cast("long"))  # the stated queries, which top_k gathers as well
    found = dense.top_k(pooled(docs), keyed.select(F.col("key").alias("query_id"), "vector"), k).withColumnRenamed("query_id", "key")
    best = found.join(keyed.select("key", "query_id"), "key").groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return rank.top_k(best, "query_id", "score", "doc_id", k)
