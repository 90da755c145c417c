"""The four tables in a database, over JDBC: read in parts, with declared types and filters that reach the database; written and read back.

Spark reads a table in as many queries as it has parts, each over a stretch of the ids. Where the stretches lie
is asked of the database first: one row with the least and largest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns and types of the tables; lists and JSON are kept as text.
TABLES = {
    "process_runs": "id bigint, original_filename string, status string, created_at timestamp, started_at timestamp, finished_at timestamp, error_message string",
    "source_images": "id bigint, process_run_id bigint, sequence_index int, source_name string, image_file string, ocr_status string, error_message string, content_hash string, context_date string",
    "deposits": "id bigint, process_run_id bigint, source_image_id bigint, sequence_index int, fecha_consignacion string, hora_consignacion string, referencia string, valor decimal(14,2), is_current_month boolean, observations string, created_at timestamp",
    "logs": "id bigint, process_run_id bigint, source_image_id bigint, stage string, is_error boolean, notes string, raw_payload string, created_at timestamp",
}
#: Rows of a part that a read aims at, and rows that go over in one round trip.
PART_ROWS, FETCH_ROWS = 500_000, 10_000


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _reader(spark: SparkSession, url: str, options: dict[str, str] | None):
    return spark.read.format("jdbc").option("url", url).option("fetchsize", FETCH_ROWS).options(**(options or {}))


def _own_names(spark: SparkSession, url: str, table: str, options: dict[str, str] | None) -> dict[str, str]:
    """The database's names of a table's columns, by their lower-case names."""
    return {c.lower(): c for c in _reader(spark, url, options).option("dbtable", table).load().columns}


def bounds(spark: SparkSession, url: str, table: str, key: str = "id", options: dict[str, str] | None = None) -> tuple[int | None, int | None, int]:
    """Least and largest key and the number of rows, computed by the database."""
    own = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(_own_names(spark, url, table, options)[key.lower()])
    asked = _reader(spark, url, options).option("query", f"SELECT MIN({own}) AS lo, MAX({own}) AS hi, COUNT(*) AS n FROM {table}").load().toDF("lo", "hi", "n").first()
    return asked["lo"], asked["hi"], int(asked["n"])


def scan_table(spark: SparkSession, url: str, table: str, schema: str | None = None, parts: int | None = None, key: str = "id", options: dict[str, str] | None = None) -> DataFrame:
    """A table in parts over stretches of `key`, whose rows are more or less evenly spread; with the types of `schema`, or those of TABLES. Filters and columns are pushed down.

    parts: as many, or one for PART_ROWS rows. An empty table is one part.
    """
    schema = schema or TABLES[table]
    own = _own_names(spark, url, table, options)
    lo, hi, n = bounds(spark, url, table, key, options)
    typed = ", ".join(f"`{own[c.split()[0].lower()]}` {c.split(maxsplit=1)[1]}" for c in schema.split(", "))
    reader = _reader(spark, url, options).option("dbtable", table).option("customSchema", typed)
    if n and hi > lo:
        reader = reader.option("partitionColumn", own[key.lower()]).option("lowerBound", lo).option("upperBound", hi + 1).option("numPartitions", parts or max(1, -(-n // PART_ROWS)))
    frame = reader.load()
    return frame.select(*[F.col(f"`{own[c.lower()]}`").alias(c) for c in _names(schema)])


def scan_tables(spark: SparkSession, url: str, parts: int | None = None, options: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The four tables; lists that were written as JSON text are lists again."""
    found = {name: scan_table(spark, url, name, parts=parts, options=options) for name in TABLES}
    found["deposits"] = found["deposits"].withColumn("observations", F.from_json("observations", "array<string>"))
    return found


def _plain(frame: DataFrame, schema: str) -> DataFrame:
    """The columns of the schema with its types; arrays and structs as JSON, absent ones null."""
    def column(name: str, kind: str) -> Column:
        if name not in frame.columns:
            return F.lit(None).cast(kind).alias(name)
        nested = dict(frame.dtypes)[name].startswith(("array", "struct", "map"))
        return (F.to_json(name) if nested else F.col(name).cast(kind)).alias(name)

    return frame.select(*[column(*c.split(maxsplit=1)) for c in schema.split(", ")])


def write_table(frame: DataFrame, url: str, table: str, schema: str | None = None, mode: str = "overwrite", writers: int = 8, text_type: str | None = None, options: dict[str, str] | None = None) -> None:
    """Writes a table, over at most `writers` connections at a time. text_type: the database's type for texts, as VARCHAR(200); its dialect's own if not given."""
    schema = schema or TABLES[table]
    out = _plain(frame, schema)
    out = out.coalesce(writers) if out.rdd.getNumPartitions() > writers else out
    writer = out.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", FETCH_ROWS).options(**(options or {}))
    if text_type:
        writer = writer.option("createTableColumnTypes", ", ".join(f"{c.split()[0]} {text_type}" for c in schema.split(", ") if c.split()[1] == "string"))
    writer.mode(mode).save()


def write_tables(url: str, tables: dict[str, DataFrame], **options) -> None:
    for name, frame in tables.items():
        write_table(frame, url, name, **options)
