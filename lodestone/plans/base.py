"""Registry of queries, and the tables and views that many of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import prepare, shared_path, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a table's files, from the store alone."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = system.listStatus(there)
    return path + "".join(sorted(f"|{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back: a table with known size, and an end to its lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rounded(column, digits: int = 6):
    """Rounded, and never minus zero."""
    return F.round(column, digits) + F.lit(0.0)
