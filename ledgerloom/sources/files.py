"""Folders of whatever file system Spark reads: what is there, and taking it away."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a pattern with wildcards."""
    where, fs = _at(spark, pattern)
    return [f.getPath().toString() for f in fs.globStatus(where) or []]


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)
