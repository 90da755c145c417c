"""What the operators of this package share: word rules, free column names, shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words in order; null or blank text gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from names that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, local sessions take a folder of this machine; clusters raise ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: the operators need a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables are."""
    return f"{shared_dir(spark)}/ledgerloom/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{session_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df written to shared storage and read again: its lineage ends there and lost executors cost no recomputation."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of shared storage."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame | None) -> None:
    """Deletes materialized tables that nothing will read again."""
    for t in tables:
        if path := getattr(t, "written_to", None):
            remove(t.sparkSession, path)


def drop_intermediates(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application. To be called when its results have been written."""
    remove(spark, session_dir(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
