"""Reports as files: a folder per run, its lines in order, without a sort over all runs; or all runs in bundles.

Rows are dealt by run and sorted within each task, so a run is one stretch of one task and becomes one file in the
folder of the run. Writing again replaces the folders of the runs that are written, and no others.

A file per run is made, moved and listed one by one by the driver, so it is for runs that are handed out. The reports
of all runs go to bundles: a file per task, in which each run, named in the first column, is one stretch in its order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "process_run_id"
#: Quotes inside a field are doubled, white space stays; blank and missing texts are alike in a report's file.
EXACT = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# The columns of the report.
REPORT_COLUMNS = ("SECUENCIA", "FECHA", "HORA", "REFERENCIA", "VALOR", "ARCHIVO_ORIGEN", "ES_MES_ACTUAL", "OBSERVACIONES", "DESCRIPCION")


def _by_run(rows: DataFrame, order: tuple[str, ...], columns: list) -> DataFrame:
    """rows with a column `run`, in one task and in order for each run. What the order needs and the file does not is dropped behind the sort."""
    dealt = rows.withColumn("run", F.col(RUN)).repartition("run").sortWithinPartitions("run", *order)
    return dealt.select("run", *columns)


def _lines(lines: DataFrame) -> DataFrame:
    return _by_run(lines, ("part", "line"), [F.coalesce("value", F.lit("")).alias("value")])


def _rows(report: DataFrame) -> DataFrame:
    return _by_run(report, ("image_index", "source_image_id", "SECUENCIA", "deposit_id"), list(REPORT_COLUMNS))


def write_markdown(lines: DataFrame, path: str) -> None:
    """A text file per run from (process_run_id, part, line, value), as diagnostic_report gives unordered."""
    _lines(lines).write.mode("overwrite").partitionBy("run").option("partitionOverwriteMode", "dynamic").text(path)


def write_csv(report: DataFrame, path: str) -> None:
    """A CSV file with header per run from export_report's rows, in the order of its images and deposits."""
    _rows(report).write.mode("overwrite").partitionBy("run").option("partitionOverwriteMode", "dynamic").options(**EXACT).csv(path)


def bundle_markdown(lines: DataFrame, path: str) -> None:
    """The lines of all runs in CSV files of run and value, as many as there are tasks. path must be new."""
    _lines(lines).write.options(**EXACT).csv(path)


def bundle_csv(report: DataFrame, path: str) -> None:
    """The reports of all runs in CSV files of run and the report's columns, as many as there are tasks. path must be new."""
    _rows(report).write.options(**EXACT).csv(path)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """run and value, the lines of a file in order."""
    return spark.read.schema("value string, run long").option("wholetext", "false").text(path).select("run", "value")


def read_bundled_markdown(spark: SparkSession, path: str) -> DataFrame:
    """run and value: the lines of a run follow each other in order."""
    return spark.read.schema("run long, value string").options(**EXACT, multiLine="true").csv(path).fillna("", ["value"])


def _report_schema() -> str:
    return ", ".join(f"{c} {'int' if c == 'SECUENCIA' else 'decimal(14,2)' if c == 'VALOR' else 'string'}" for c in REPORT_COLUMNS)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{_report_schema()}, run long").option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)


def read_bundled_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"run long, {_report_schema()}").options(**EXACT, multiLine="true").csv(path)
