"""Shared plumbing of the training-data operators: tables, shared folder, lineage cuts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import prepare, remove, shared_path  # noqa: F401

#: Rows of one Arrow batch; documents are long, so far fewer than Spark's default.
BATCH_ROWS = 1024


def tune(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small enough for whole documents of any usual length."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    return cut_at(df, shared_path(df.sparkSession, name))


def cut_at(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, columns: list[str]) -> str:
    """The name, with as many underscores behind it as keep it apart from the columns."""
    taken = {c.casefold() for c in columns}
    while name.casefold() in taken:
        name += "_"
    return name


def with_columns(docs: DataFrame, function: Callable[[pa.RecordBatch], list], columns: str, kinds: list[pa.DataType]) -> DataFrame:
    """docs and new last columns, whatever the names of its own; function gives a batch's new columns."""
    tune(docs.sparkSession)
    own, made = [f"_c{k}" for k in range(len(docs.columns))], columns.split(", ")
    new = [f"_n{k}" for k in range(len(made))]
    schema = ", ".join([f"{n} {t}" for n, (_, t) in zip(own, docs.dtypes, strict=True)] + [f"{n} {c.split(' ', 1)[1]}" for n, c in zip(new, made, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(function(batch), kinds, strict=True))], [*own, *new])

    names = list(docs.columns)
    for c in made:
        names.append(fresh(c.split(" ")[0], names))
    return map_batches(docs.toDF(*own), run, schema).toDF(*names)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def write_blobs(blobs: DataFrame, path: str) -> None:
    """One file a row of the binary column `value`, through Spark's own writer: any store, any lost task.

    The text writer ends each row with its line separator, here a zero byte, so a blob must end with one.
    """
    rows = blobs.select(F.expr("substring(value, 1, octet_length(value) - 1)").cast("string").alias("value"))
    rows.write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of what write_blobs wrote."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
