"""Sources and sinks: explicit schemas, no inference, whole-folder scans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def text_tree(spark: SparkSession, root: str) -> DataFrame:
    """All *.txt files below root: path relative to it, source (first folder), text, size, modification time. Bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(root)
    relative = F.regexp_replace("path", F.lit("^.*?/" + _quoted(root.split("://")[-1].strip("/")) + "/"), F.lit(""))
    source = F.when(F.contains(relative, F.lit("/")), F.split_part(relative, F.lit("/"), F.lit(1)))
    return files.select(relative.alias("path"), source.alias("source"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("length").alias("size"), "modificationTime")


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c not in "/_" else c for c in text)


def flat_texts(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """One row a file: id (name without extension) and stripped text; blank files are skipped."""
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(F.regexp_extract(F.input_file_name(), r"([^/]*)\.txt$", 1).alias("id"), text.alias("text")).where("text <> ''")
    return rows if limit is None else rows.orderBy("id").limit(limit)


def json_lines(spark: SparkSession, path: str, schema: StructType | str, first: int | None = None) -> DataFrame:
    rows = spark.read.schema(schema).json(path)
    rows = rows.where(F.coalesce(*[F.col(c).isNotNull() for c in rows.columns]))
    return rows if first is None else rows.limit(first)


def csv_rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def parquet_subset(spark: SparkSession, path: str, columns: list[str], ids: DataFrame, key: str) -> DataFrame:
    """Only some columns of the rows whose key is among the ids."""
    return spark.read.parquet(path).select(*columns).join(ids.select(key).distinct(), key, "left_semi")


def numpy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, vector) of two-dimensional .npy files."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = np.load(io.BytesIO(content), allow_pickle=False)
                yield pd.DataFrame({"path": name, "row": range(len(rows)), "vector": list(rows.astype("float32"))})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content").mapInPandas(load, "path string, row long, vector array<float>")


def first_containing(rows: DataFrame, column: str, part: str, order: str) -> DataFrame:
    """The first row, by order, whose column holds the part."""
    return rows.where(F.contains(F.col(column), F.lit(part))).orderBy(order).limit(1)


def missing(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows that a store doesn't have yet (resume)."""
    return rows.join(stored.select(key).distinct(), key, "left_anti")


def fingerprint(paths: DataFrame, column: str) -> DataFrame:
    """One row: a hash of the set of paths that needs no sort and no single list: SHA-256 over their number and the sum of their hashes."""
    part = F.conv(F.substring(F.md5(F.col(column).cast("string").cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = paths.agg(F.count("*").alias("n"), F.coalesce(F.sum(part), F.lit(0).cast("decimal(38,0)")).alias("total"))
    return sums.select("n", F.sha2(F.concat(F.col("n").cast("string"), F.lit(":"), F.col("total").cast("string")).cast("binary"), 256).alias("fingerprint"))


def append(rows: DataFrame, path: str) -> None:
    """Create the store or add to it."""
    rows.write.mode("append").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_texts(rows: DataFrame, path: str, column: str = "text", folder: str | None = None) -> None:
    """One .txt file a row, below a folder for each value of a column."""
    chosen = rows.select(*([folder] if folder else []), F.col(column).cast("string").alias("value"))
    writer = chosen.write.mode("overwrite").option("maxRecordsPerFile", 1)
    (writer.partitionBy(folder) if folder else writer).text(path)
