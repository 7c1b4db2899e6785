"""Interim tables and files in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder all executors share; one of our own only where that is unset and all run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='vicinal-')}")
        folder = spark.sparkContext.getCheckpointDir()
    return re.sub(r"^file:/+", "file:///", folder)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def folder(spark: SparkSession, name: str, make: bool = False) -> str:
    """A fresh path in the shared folder, deleted at the latest when the application ends; with ``make`` it is there."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    if make:
        files.mkdirs(at)
    return path


def delete(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table: computed once, however often it is read, and kept when executors are lost. It goes by ``dropped``, at the latest when the application ends."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing that is still to be computed reads it."""
    for df in tables:
        delete(df.sparkSession, df._written_at)


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile runs in methods that the JVM compiles: a whole stage in a method of over 8000 bytes, as the features are, would be interpreted."""
    name = "spark.sql.codegen.hugeMethodLimit"
    usual = spark.conf.get(name, None)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.unset(name) if usual is None else spark.conf.set(name, usual)
