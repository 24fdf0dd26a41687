"""Session settings, and the package's own code on the executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on; the rest is the cluster's business.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings and give Python workers this package, whatever their path."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp()  # the driver's own; executors fetch the file from the driver
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        to = Path(folder) / "lodestone.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, f"lodestone/{p.relative_to(here)}")
        spark.sparkContext.addPyFile(str(to))
        _shipped.add(app)
    return spark


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores if their files give fewer partitions than there are cores (a small table in one row group); else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine, where it is unset (tests), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        found = "file:///tmp/checkpoints/lodestone"
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is removed when the application ends."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    system, there = _file_system(spark, folder)
    system.mkdirs(there)
    system.deleteOnExit(there)
    return f"{folder}/data"


def remove(spark: SparkSession, path: str) -> None:
    """Remove what no plan reads any more."""
    system, there = _file_system(spark, path)
    system.delete(there, True)
