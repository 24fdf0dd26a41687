"""Ingest against a store: duplicates, updates, inserts; back-fill; job states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx

STATES = ("pending", "processing", "completed", "failed")


def classified(batch: DataFrame, store: DataFrame) -> DataFrame:
    """batch (id, text, seq) with hash and action.

    A text whose hash the store has, or that came earlier in the batch, is a
    duplicate; a known id with a new text is an update; anything else an insert.
    """
    rows = batch.withColumn("hash", tx.content_hash(F.col("text")))
    first = rows.groupBy("hash").agg(F.min("seq").alias("first_seq"))
    known = store.select(tx.content_hash(F.col("text")).alias("hash")).distinct().withColumn("known", F.lit(True))
    ids = store.select("id").distinct().withColumn("has_id", F.lit(True))
    rows = rows.join(first, "hash").join(known, "hash", "left").join(ids, "id", "left")
    action = F.when(F.col("known") | (F.col("seq") > F.col("first_seq")), "duplicate").when(F.col("has_id"), "update").otherwise("insert")
    return rows.select("id", "text", "seq", "hash", action.alias("action"))


def merged(batch: DataFrame, store: DataFrame) -> DataFrame:
    """The store after the batch: updated texts lose their embedding, inserts have none."""
    done = classified(batch, store)
    w = Window.partitionBy("id").orderBy(F.desc("seq"))
    new = done.where("action <> 'duplicate'").withColumn("r", F.row_number().over(w)).where("r = 1")
    kept = store.join(new.select("id"), "id", "left_anti")
    kind = dict(store.dtypes)["embedding"]
    return kept.select("id", "text", "embedding").unionByName(new.select("id", "text", F.lit(None).cast(kind).alias("embedding")))


def counts(done: DataFrame) -> DataFrame:
    return done.agg(F.count_if(F.col("action") == "insert").alias("inserted"), F.count_if(F.col("action") == "update").alias("updated"), F.count_if(F.col("action") == "duplicate").alias("duplicates"))


def deduplicated(rows: DataFrame, order: str) -> DataFrame:
    """rows without later copies of a text; the first by order stays."""
    h = rows.withColumn("hash", tx.content_hash(F.col("text")))
    first = h.groupBy("hash").agg(F.min(order).alias(order))
    return h.join(first, ["hash", order], "left_semi").drop("hash")


def backfilled(store: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """store with missing embeddings filled by an encoder of (id, text) to (id, made)."""
    made = encode(store.where("embedding is null").select("id", "text"))
    return store.join(made, "id", "left").withColumn("embedding", F.coalesce("embedding", F.col("made"))).drop("made")


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, status, processed, message) from job events (job_id, seq, status, processed, message): the last event's state; a failure stays."""
    last = events.groupBy("job_id").agg(F.max_by("status", "seq").alias("last"), F.max("processed").alias("processed"), F.max(F.when(F.col("status") == "failed", F.col("message"))).alias("message"), F.bool_or(F.col("status") == "failed").alias("failed"))
    return last.select("job_id", F.when(F.col("failed"), "failed").otherwise(F.col("last")).alias("status"), "processed", "message")
