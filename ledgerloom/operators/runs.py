"""Runs with their images and deposits: reuse, status, counters, joins, reports, deletion."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.describe import describe_deposit
from ledgerloom.operators.diagnostics import real_images
from ledgerloom.sources import files

PIPELINE_VERSION = "1"
TERMINAL = ("completed", "completed_with_errors", "failed")
REUSABLE = ("uploaded", "processing", "completed")


def processing_fingerprint(document_hash: Column, config: dict) -> Column:
    """Hash of the document hash, the settings in key order and the version of the pipeline."""
    settings = json.dumps(config, sort_keys=True) + PIPELINE_VERSION
    return F.sha2(F.concat(document_hash, F.lit(settings)), 256)


def config_hash(config: dict) -> str:
    return sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def reuse_runs(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """Per document the newest run of the same hash and fingerprint that can be taken again; run_id is null where there is none."""
    newest = runs.filter(F.col("status").isin(*REUSABLE)).groupBy("document_hash", "fingerprint").agg(F.max_by("id", F.struct("created_at", "id")).alias("run_id"))
    return documents.join(newest, ["document_hash", "fingerprint"], "left")


def image_limit_policy(images: DataFrame, most: int, block: bool = False) -> DataFrame:
    """Runs with more images than `most`; 0 turns the rule off."""
    n = real_images(images).groupBy("process_run_id").agg(F.count("*").alias("n_images"))
    return n.filter((F.col("n_images") > most) & F.lit(most > 0)).withColumn("verdict", F.lit("blocked" if block else "warning"))


def normalize_provider(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t.isin("", "ollama_vision"), "ollama").otherwise(t)


def terminal_status(c: Column) -> Column:
    return F.coalesce(c.isin(*TERMINAL), F.lit(False))


def gates(runs: DataFrame) -> DataFrame:
    """What a run's status allows, with a code where it does not."""
    s = F.col("status")
    return runs.select(
        "id", s.isin("completed", "completed_with_errors").alias("exportable"), (s != "processing").alias("editable"), (~s.isin("processing", "completed")).alias("processable"),
        F.when(s == "processing", "already_processing").when(s == "completed", "needs_force").otherwise("").alias("code"))


def run_counters(runs: DataFrame, images: DataFrame, deposits: DataFrame) -> DataFrame:
    """Each side is counted before it is joined, so nothing multiplies."""
    i = real_images(images).groupBy(F.col("process_run_id").alias("id")).agg(F.count("*").alias("total_images"))
    d = deposits.groupBy(F.col("process_run_id").alias("id")).agg(F.count("*").alias("total_records"))
    return runs.select("id").join(i, "id", "left").join(d, "id", "left").fillna(0, ["total_images", "total_records"])


def run_rollup(runs: DataFrame, images: DataFrame, deposits: DataFrame) -> DataFrame:
    i = images.groupBy(F.col("process_run_id").alias("id")).agg(F.count("*").alias("images"))
    d = deposits.groupBy(F.col("process_run_id").alias("id")).agg(F.count("*").alias("records"), F.sum("valor").alias("total"))
    return runs.select("id", "original_filename", "status").join(i, "id", "left").join(d, "id", "left").fillna(0, ["images", "records"])


def run_rollup_literal(runs: DataFrame, images: DataFrame, deposits: DataFrame) -> DataFrame:
    """As documented: both sides joined to the run first, so the sum is multiplied by the images."""
    i = images.select(F.col("process_run_id").alias("id"), F.col("id").alias("image_id"))
    d = deposits.select(F.col("process_run_id").alias("id"), F.col("id").alias("deposit_id"), "valor")
    # The pairs of a run are never made: a sum over images x deposits is the product of both sides.
    a, b = i.groupBy("id").agg(F.count("image_id").alias("images")), d.groupBy("id").agg(F.count("deposit_id").alias("records"), F.sum("valor").alias("one"))
    out = runs.select("id").join(a, "id", "left").join(b, "id", "left").fillna(0, ["images", "records"])
    return out.select("id", "images", "records", (F.col("one") * F.greatest("images", F.lit(1)).cast("decimal(10,0)")).cast("decimal(30,2)").alias("total"))


def _status_inputs(images: DataFrame, deposits: DataFrame) -> DataFrame:
    failed = F.col("ocr_status") == "failed"
    i = real_images(images).groupBy("process_run_id").agg(
        F.count("*").alias("total_images"), F.count_if(failed).alias("failed_images"),
        F.min_by(F.when(failed, F.col("error_message")), F.when(failed, F.struct("sequence_index", "id"))).alias("first_error"))
    d = deposits.groupBy("process_run_id").agg(F.count("*").alias("total_records"))
    return i.join(d, "process_run_id", "left").fillna(0, ["total_records"])


def final_status(images: DataFrame, deposits: DataFrame) -> DataFrame:
    """failed without records if all images failed, with errors if any did, else completed; the first error stays."""
    s = _status_inputs(images, deposits)
    all_failed = (F.col("failed_images") == F.col("total_images")) & (F.col("total_records") == 0)
    return s.withColumn("status", F.when(all_failed, "failed").when(F.col("failed_images") > 0, "completed_with_errors").otherwise("completed")).withColumn(
        "error_message", F.coalesce("first_error", F.lit(""))).drop("first_error")


def partial_status(images: DataFrame, deposits: DataFrame) -> DataFrame:
    """After part of a run was done again: any record, or any image that did not fail, keeps it from failed."""
    s = _status_inputs(images, deposits)
    status = F.when(F.col("failed_images") == 0, "completed").when((F.col("total_records") > 0) | (F.col("failed_images") < F.col("total_images")), "completed_with_errors").otherwise("failed")
    return s.withColumn("status", status).withColumn("error_message", F.when(F.col("failed_images") == 0, "").otherwise(F.coalesce("first_error", F.lit("")))).drop("first_error")


def mark_failed(runs: DataFrame, failed: DataFrame, as_of: Column) -> DataFrame:
    """failed: id, message."""
    out = runs.join(failed.select("id", F.col("message").alias("_message")), "id", "left")
    hit = F.col("_message").isNotNull()
    return out.withColumns({"status": F.when(hit, "failed").otherwise(F.col("status")), "error_message": F.coalesce("_message", "error_message"),
                            "finished_at": F.when(hit, as_of).otherwise(F.col("finished_at"))}).drop("_message")


def deposits_with_run(deposits: DataFrame, runs: DataFrame) -> DataFrame:
    r = runs.select(F.col("id").alias("process_run_id"), F.col("status").alias("process_run__status"), F.col("original_filename").alias("process_run__original_filename"))
    return deposits.join(r, "process_run_id")


def logs_with_image(logs: DataFrame, images: DataFrame) -> DataFrame:
    return logs.join(images.select(F.col("id").alias("source_image_id"), "sequence_index", "source_name"), "source_image_id", "left")


def export_report(runs: DataFrame, images: DataFrame, deposits: DataFrame, ordered: bool = True) -> DataFrame:
    """The report's nine columns for runs that may be exported, ordered by run, image (its number, id) and deposit (its number, id); SECUENCIA is the deposit's number.

    DESCRIPCION reads the payload's plain values, the image's text and the context, as far as there are such columns.
    """
    ok = runs.filter(F.col("status").isin("completed", "completed_with_errors")).select(F.col("id").alias("process_run_id"))
    texts = [c for c in ("ocr_raw_text", "context_text") if c in images.columns]
    i = images.select(F.col("id").alias("source_image_id"), F.col("sequence_index").alias("image_index"), F.col("source_name").alias("ARCHIVO_ORIGEN"), *texts)
    rows = describe_deposit(deposits.join(ok, "process_run_id", "left_semi").join(i, "source_image_id"), out="DESCRIPCION")
    order = ("process_run_id", "image_index", "source_image_id", "sequence_index", "id")
    return (rows.orderBy(*order) if ordered else rows).select(
        "process_run_id", "image_index", "source_image_id", F.col("sequence_index").alias("SECUENCIA"), F.col("id").alias("deposit_id"), F.col("fecha_consignacion").alias("FECHA"), F.col("hora_consignacion").alias("HORA"), F.col("referencia").alias("REFERENCIA"),
        F.col("valor").alias("VALOR"), "ARCHIVO_ORIGEN", F.when(F.col("is_current_month"), "Si").otherwise("No").alias("ES_MES_ACTUAL"), F.array_join("observations", "; ").alias("OBSERVACIONES"), "DESCRIPCION")


# What a deposit, an image and a run show of themselves.
DEPOSIT_SHOWN = ("id", "sequence_index", "fecha_consignacion", "hora_consignacion", "referencia", "valor", "descripcion", "is_current_month", "observations", "structured_payload", "created_at")
IMAGE_SHOWN = ("id", "sequence_index", "source_name", "content_hash", "context_date", "context_text", "context_payload", "ocr_status", "ocr_provider", "ocr_raw_text", "error_message", "image_file", "deposits", "created_at", "updated_at")
RUN_SHOWN = ("id", "original_filename", "status", "source_docx", "excel_file", "total_images", "total_records", "error_message", "provider_config_snapshot", "started_at", "finished_at", "created_at", "updated_at")
LOG_SHOWN = ("id", "source_image_id", "sequence_index", "stage", "provider", "model", "ocr_mode", "raw_payload", "raw_text", "notes", "is_error", "created_at")


def _shown(frame: DataFrame, names: tuple[str, ...]) -> list[str]:
    """Those of the names that frame has."""
    return [n for n in names if n in frame.columns]


def with_counters(runs: DataFrame, images: DataFrame, deposits: DataFrame) -> DataFrame:
    """runs with total_images and total_records as counted, in place of columns of these names."""
    return runs.drop("total_images", "total_records").join(run_counters(runs, images, deposits), "id")


def run_detail(runs: DataFrame, images: DataFrame, deposits: DataFrame) -> DataFrame:
    """Runs with their counters, their images by number and id, and those with their deposits by number and id, nested: all that the tables hold of what is shown.

    descripcion is what describe_deposit says. The deposits of an image and the images of a run become one value.
    """
    texts = [c for c in ("ocr_raw_text", "context_text") if c in images.columns]
    told = deposits
    if texts:
        told = told.join(images.select(F.col("id").alias("source_image_id"), *texts), "source_image_id", "left")
    told = describe_deposit(told, out="descripcion")
    order = lambda frame, names: F.struct("sequence_index", "id", F.struct(*_shown(frame, names)).alias("row"))
    rows = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda x: x["row"])
    per_image = told.groupBy(F.col("source_image_id").alias("id")).agg(rows(order(told, DEPOSIT_SHOWN)).alias("deposits"))
    i = images.join(per_image, "id", "left")
    i = i.groupBy(F.col("process_run_id").alias("id")).agg(rows(order(i, IMAGE_SHOWN)).alias("source_images"))
    counted = with_counters(runs, images, deposits)
    return counted.select(*_shown(counted, RUN_SHOWN)).join(i, "id", "left")


def delete_cascade(gone: DataFrame, **children: DataFrame) -> dict[str, DataFrame]:
    """Child tables without the rows of the runs in gone (id)."""
    ids = gone.select(F.col("id").alias("process_run_id"))
    return {name: child.join(ids, "process_run_id", "left_anti") for name, child in children.items()}


def files_to_delete(gone: DataFrame, images: DataFrame) -> DataFrame:
    """Each file of the runs once."""
    ids = gone.select(F.col("id").alias("process_run_id"))
    return images.join(ids, "process_run_id", "left_semi").filter("image_file <> ''").select(F.col("image_file").alias("path")).distinct()


# Stages whose events a run keeps when all of it is done again.
KEPT_STAGES = ("source_image_created", "source_image_duplicate_skipped", "existing_job_reused", "duplicate_http_request_ignored")


def clear_for_reprocess(images: DataFrame, deposits: DataFrame, logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """deposits and logs without those of the images (id) that are done again."""
    again = images.select(F.col("id").alias("source_image_id")).distinct()
    return tuple(t.join(again, "source_image_id", "left_anti").select(*t.columns) for t in (deposits, logs))


def clear_runs(runs: DataFrame, deposits: DataFrame, logs: DataFrame, kept: tuple[str, ...] = KEPT_STAGES) -> tuple[DataFrame, DataFrame]:
    """deposits and logs before whole runs (id) are done again: no deposits, and of their events those of docx_* and of the kept stages."""
    again = runs.select(F.col("id").alias("process_run_id")).distinct()
    stays = F.col("stage").startswith("docx_") | F.col("stage").isin(*kept)
    return deposits.join(again, "process_run_id", "left_anti").select(*deposits.columns), logs.filter(stays).unionByName(logs.filter(~stays).join(again, "process_run_id", "left_anti").select(*logs.columns))


def run_list(runs: DataFrame, images: DataFrame, deposits: DataFrame) -> DataFrame:
    """All runs with their counters, newest first."""
    listed = with_counters(runs, images, deposits).select("id", "original_filename", "status", "total_images", "total_records", "started_at", "finished_at", "created_at")
    return listed.orderBy(F.desc("created_at"), F.desc("id"))


def run_overview(runs: DataFrame) -> DataFrame:
    """All runs, newest first."""
    return runs.select("id", "original_filename", "status", "created_at", "started_at", "finished_at", "error_message").orderBy(F.desc("created_at"), F.desc("id"))


def log_list(logs: DataFrame, images: DataFrame) -> DataFrame:
    """Each run's log rows with the number of their image, in the order of that number (rows without image first) and id."""
    numbered = logs.drop("sequence_index").join(images.select(F.col("id").alias("source_image_id"), "sequence_index"), "source_image_id", "left")
    order = (F.col("process_run_id"), F.col("sequence_index").asc_nulls_first(), F.col("id"))
    return numbered.orderBy(*order).select("process_run_id", *_shown(numbered, LOG_SHOWN))


def images_of_deposits(images: DataFrame, deposits: DataFrame) -> DataFrame:
    """The images that some of the deposits are from."""
    return images.join(deposits.select(F.col("source_image_id").alias("id")), "id", "left_semi")


# The tables that an installation has.
REQUIRED_TABLES = ("process_runs", "source_images", "deposits", "logs")
TOP_TABLES = 10


@contextmanager
def _footer_counts(spark: SparkSession) -> Iterator[None]:
    """Counts over Parquet files are answered from their footers: the V2 reader with aggregate pushdown, for as long as this lasts."""
    settings = {"spark.sql.sources.useV1SourceList": ",".join(x for x in spark.conf.get("spark.sql.sources.useV1SourceList").split(",") if x != "parquet"), "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def footer_count(spark: SparkSession, path: str) -> tuple[int, str]:
    """Rows of a Parquet table and the plan that counted them, which reads no column."""
    with _footer_counts(spark):
        counted = spark.read.parquet(path).agg(F.count("*").alias("n"))
        return counted.first()["n"], counted._jdf.queryExecution().executedPlan().toString()


def table_stats(spark: SparkSession, paths: dict[str, str], required: tuple[str, ...] = REQUIRED_TABLES, most: int = TOP_TABLES) -> DataFrame:
    """(table_name, present, n, place): the `most` largest tables, and required ones whatever their size; one that is missing is a row without n.

    paths: the folder or file of each table, in Parquet. Rows are counted from the files' footers, a short job a table.
    """
    counts = {name: footer_count(spark, path)[0] for name, path in paths.items() if files.exists(spark, path)}
    largest = sorted(counts, key=lambda name: (-counts[name], name))
    rows = [(name, True, counts[name], k) for k, name in enumerate(largest, 1) if k <= most or name in required]
    rows += [(name, False, None, None) for name in required if name not in counts]
    return spark.createDataFrame(rows, "table_name string, present boolean, n long, place int")


def completed_summary(runs: DataFrame, valid: DataFrame) -> DataFrame:
    done = runs.filter("status = 'completed'").select(F.col("id").alias("process_run_id"))
    return valid.join(done, "process_run_id", "left_semi").agg(F.count_distinct("process_run_id").alias("runs"), F.count("*").alias("records"), F.sum("valor").alias("total"))


def last_record(runs: DataFrame, valid: DataFrame) -> DataFrame:
    """The newest valid deposit of the newest completed run that has one."""
    done = runs.filter("status = 'completed'").select(F.col("id").alias("process_run_id"), F.col("created_at").alias("run_created"))
    return valid.join(done, "process_run_id").orderBy(F.desc("run_created"), F.desc("process_run_id"), F.desc("created_at"), F.desc("id")).limit(1)


def findings(runs: DataFrame, deposits: DataFrame, logs: DataFrame, most: int = 3, most_logs: int = 8, note_chars: int = 120) -> DataFrame:
    """Per run with its header: how many deposits have observations, the first of them, and the first log rows with their notes cut.

    Only the first rows of a run are numbered and gathered, never all.
    """
    def firsts(rows: DataFrame, n: int, item: Column, out: str) -> DataFrame:
        at = F.row_number().over(Window.partitionBy("process_run_id").orderBy("id"))
        return rows.withColumn("_at", at).filter(F.col("_at") <= n).groupBy("process_run_id").agg(F.sort_array(F.collect_list(item)).alias(out))

    noted = deposits.filter(F.size("observations") > 0)
    n = noted.groupBy("process_run_id").agg(F.count("*").alias("n_with_observations"))
    rows = firsts(noted, most, F.struct("id", "referencia", "valor", F.array_join("observations", ", ").alias("observations")), "first_rows")
    log = firsts(logs, most_logs, F.struct("id", "stage", F.left(F.coalesce("notes", F.lit("")), F.lit(note_chars)).alias("notes")), "first_logs")
    head = runs.select(F.col("id").alias("process_run_id"), "original_filename", "status", "error_message")
    return head.join(n, "process_run_id", "left").join(rows, "process_run_id", "left").join(log, "process_run_id", "left").fillna(0, ["n_with_observations"])
