"""Structured Streaming: tree events by type, and ingest of new files with resume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 16) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events by type and time window; what comes later than the watermark is dropped, repeats of an id within it too."""
    once = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, batch by batch; a later call goes on from the checkpoint."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(sink).start().awaitTermination()


def flush(spark: SparkSession, path: str, schema: StructType, time: str = "ts", years: int = 100) -> None:
    """End of the stream: a row far in the future moves the watermark past every open window; its own window is never emitted."""
    last = spark.read.schema(schema).parquet(path).agg(F.max(time).alias("t"))
    row = last.select(*[(F.col("t") + F.make_interval(F.lit(years))).cast(f.dataType).alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    row.where(F.col(time).isNotNull()).write.mode("append").parquet(path)


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own, so that a repeated batch replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink
