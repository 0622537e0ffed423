"""Tables written to the folder that the cluster shares, to cut a lineage, and what the file system holds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only local mode, as in tests, does without: there one temporary folder serves."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="veilspark-shared-"))
    return _OWN[0]


def located(spark: SparkSession, path: str):
    """(file system, path) as Hadoop has them."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = located(spark, path)
    return fs.exists(jpath)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it is a file or not there."""
    fs, jpath = located(spark, path)
    if not fs.exists(jpath) or not fs.getFileStatus(jpath).isDirectory():
        return []
    return [s.getPath().getName() for s in fs.listStatus(jpath)]


def passing(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that goes when the application ends, a failed one included."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, jpath = located(spark, path)
    fs.deleteOnExit(jpath)
    return path


def through_storage(df: DataFrame) -> DataFrame:
    path = passing(df.sparkSession, "s")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
