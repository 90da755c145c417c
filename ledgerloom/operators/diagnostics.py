"""What the stage log says about runs and images: one aggregate each, for all runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOW_MS, STALE_SECONDS, LARGE_IMAGE, BUDGET_SECONDS = 30_000, 300, 3 * 1024 * 1024, 900


#: Payload fields that events show, with their types.
EVENT_FIELDS = {"duration_ms": "bigint", "records_count": "bigint", "raw_text_chars": "bigint", "prompt_chars": "bigint", "response_chars": "bigint", "image_bytes": "bigint", "error_class": "string"}
TERMINAL_EVENTS, LIMIT_STAGE = ("completed", "failed", "timeout"), "docx_image_limit_warning"


def field(payload: str, name: str, kind: str = "string") -> Column:
    """A field of a JSON payload, null where it is not there or not of the kind."""
    return F.try_variant_get(F.try_parse_json(F.col(payload)), f"$.{name}", kind)


def parsed_logs(logs: DataFrame, payload: str = "raw_payload") -> DataFrame:
    """logs with status and duration_ms read from the JSON payload."""
    v = F.try_parse_json(F.col(payload))
    return logs.withColumns({"status": F.try_variant_get(v, "$.status", "string"), "duration_ms": F.coalesce(F.try_variant_get(v, "$.duration_ms", "bigint"), F.lit(0))})


def _done(stage: str) -> Column:
    return (F.col("stage") == stage) & (F.col("status") == "completed")


def _total(when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, F.col("duration_ms"))), F.lit(0))


def stage_summary(logs: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Per run: calls, totals, floor averages, the slowest stage and its image (first of equal ones), timeouts, image-limit warnings, last event.

    With images also how many failed and were processed; failed ones make the provider suspect, as timeouts and long totals do.
    """
    ended = F.col("status").isin(*TERMINAL_EVENTS)
    longest = F.when(ended, F.struct("duration_ms", -F.col("id")))
    out = logs.groupBy("process_run_id").agg(
        F.count_if(_done("ocr")).alias("ocr_calls"), F.count_if(_done("llm_structuring")).alias("llm_calls"),
        _total(_done("ocr")).alias("total_ocr_duration_ms"), _total(_done("llm_structuring")).alias("total_llm_duration_ms"),
        F.max_by(F.when(ended, F.col("stage")), longest).alias("slowest_stage"), F.max_by(F.when(ended, F.col("source_image_id")), longest).alias("slowest_source_image_id"),
        F.count_if(F.col("status") == "timeout").alias("timeouts"), F.count_if(F.col("stage") == LIMIT_STAGE).alias("image_limit_warnings"), F.max("created_at").alias("last_event_at"))
    average = lambda total, n: F.coalesce(F.floor(F.try_divide(F.col(total), F.col(n))), F.lit(0)).cast("long")
    suspect = (F.col("timeouts") > 0) | (F.col("total_llm_duration_ms") > SLOW_MS) | (F.col("total_ocr_duration_ms") > SLOW_MS)
    if images is not None:
        out = out.join(image_counts(images).drop("total_images"), "process_run_id", "left").fillna(0, ["failed_images", "processed_images"])
        suspect = suspect | (F.col("failed_images") > 0)
    return out.withColumns({
        "avg_ocr_duration_ms": average("total_ocr_duration_ms", "ocr_calls"), "avg_llm_duration_ms": average("total_llm_duration_ms", "llm_calls"), "provider_suspected": suspect})


def image_counts(images: DataFrame) -> DataFrame:
    """Per run how many real images there are, were processed and failed."""
    return real_images(images).groupBy("process_run_id").agg(
        F.count("*").alias("total_images"), F.count_if(F.col("ocr_status") == "processed").alias("processed_images"), F.count_if(F.col("ocr_status") == "failed").alias("failed_images"))


def real_images(images: DataFrame) -> DataFrame:
    """Without the text of the document itself and rows without a file."""
    return images.filter(~((F.col("sequence_index") == 0) & (F.col("source_name") == "document_text")) & (F.coalesce("image_file", F.lit("")) != ""))


def image_stage_durations(logs: DataFrame, images: DataFrame, deposits: DataFrame) -> DataFrame:
    """Per real image its milliseconds in OCR and structuring, its errors in the log, its deposits and its error message."""
    spent = logs.filter("source_image_id IS NOT NULL").groupBy(F.col("source_image_id").alias("id")).agg(
        _total(_done("ocr")).alias("ocr_duration_ms"), _total(_done("llm_structuring")).alias("llm_duration_ms"), F.count_if("is_error").alias("errors"))
    stored = deposits.groupBy(F.col("source_image_id").alias("id")).agg(F.count("*").alias("records_count"))
    out = real_images(images).select("id", "process_run_id", "sequence_index", "error_message").join(spent, "id", "left").join(stored, "id", "left")
    return out.fillna(0, ["ocr_duration_ms", "llm_duration_ms", "errors", "records_count"]).withColumnRenamed("id", "source_image_id")


def recommendations(summary: DataFrame, images: DataFrame, stale: DataFrame | None = None, logs: DataFrame | None = None) -> DataFrame:
    """Per run the codes of what to look at. stale: ids of runs that stand still; logs: whose image-limit notes are added."""
    per_run = real_images(images).groupBy("process_run_id").agg(F.max("image_bytes").alias("largest"), F.count_if(F.col("ocr_status") == "failed").alias("failed"))
    out = summary.join(per_run, "process_run_id", "left")
    still, notes = F.lit(False), F.array().cast("array<string>")
    if stale is not None:
        out = out.join(stale.select(F.col("id").alias("process_run_id"), F.lit(True).alias("_still")), "process_run_id", "left")
        still = F.coalesce("_still", F.lit(False))
    if logs is not None:
        noted = logs.filter((F.col("stage") == LIMIT_STAGE) & (F.coalesce("notes", F.lit("")) != ""))
        told = noted.groupBy("process_run_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "notes"))), lambda x: x["notes"]).alias("_notes"))
        out = out.join(told, "process_run_id", "left")
        notes = F.coalesce("_notes", notes)
    codes = F.array_compact(F.array(
        F.when((F.col("total_llm_duration_ms") > 2 * F.col("total_ocr_duration_ms")) & (F.col("llm_calls") > 0), "llm_dominates"),
        F.when(F.col("largest") > LARGE_IMAGE, "large_images"), F.when(still, "stale"), F.when(F.col("failed") > 0, "failed_images")))
    return out.select("process_run_id", F.array_join(F.concat(codes, notes), ",").alias("recommendations"))


def probable_cause(stale: Column, ocr: Column, llm: Column, failed: Column) -> Column:
    return F.when(stale, "stale").when((llm > 2 * ocr) & (llm > 0), "llm").when((ocr > 2 * llm) & (ocr > 0), "ocr").when(failed > 0, "failures").otherwise("none")


def stale_runs(runs: DataFrame, logs: DataFrame, as_of: Column) -> DataFrame:
    """Runs in processing whose last sign of life is more than five minutes old."""
    last = logs.groupBy(F.col("process_run_id").alias("id")).agg(F.max("created_at").alias("last_event"))
    seen = runs.filter("status = 'processing'").join(last, "id", "left").withColumn("last_sign", F.coalesce("last_event", "started_at", "created_at"))
    return seen.filter(F.col("last_sign") < as_of - F.expr(f"INTERVAL {STALE_SECONDS} SECONDS")).select("id", "last_sign")


def run_duration_ms(started: Column, finished: Column, as_of: Column) -> Column:
    return ((F.unix_micros(F.coalesce(finished, as_of)) - F.unix_micros(started)) / 1000).cast("long")


def trace_by_image(logs: DataFrame, images: DataFrame, deposits: DataFrame) -> DataFrame:
    """Per real image: candidate sums of the model and the fallback, rejected candidates, stored records, first explicit date, and where the final date is from.

    logs carry a JSON payload. Rejected candidates and records of an image are in order of their ids.
    The log of an image and its records are gathered, as one image is one output row.
    """
    stage = F.col("stage")
    llm, fallback, checked = stage.startswith("llm_structuring"), stage.startswith("heuristic_fallback"), stage == "candidate_record_validation"
    number = lambda name: F.coalesce(field("raw_payload", name, "bigint"), F.lit(0))
    some = lambda name: F.nullif(field("raw_payload", name), F.lit(""))
    first = lambda name: F.min_by(F.when(llm, some(name)), F.when(llm & some(name).isNotNull(), F.col("id")))
    seen = logs.filter("source_image_id IS NOT NULL").groupBy(F.col("source_image_id").alias("id")).agg(
        F.sum(F.when(llm, number("llm_structured_records_count")).otherwise(0)).alias("llm_candidates"), F.sum(F.when(fallback, number("heuristic_records_count")).otherwise(0)).alias("fallback_candidates"),
        F.sort_array(F.collect_list(F.when(checked & (field("raw_payload", "candidate_status") == "rejected"), F.struct("id", "raw_payload")))).alias("_rejected"),
        first("explicit_ocr_date").alias("explicit_ocr_date"), first("final_date_source").alias("_source"), F.min_by(F.when(F.col("is_error"), F.col("notes")), F.when(F.col("is_error"), F.col("id"))).alias("first_error"))
    record = F.struct("id", "fecha_consignacion", "hora_consignacion", "referencia", F.col("valor").cast("string").alias("valor"), "is_current_month", "observations")
    stored = deposits.groupBy(F.col("source_image_id").alias("id")).agg(F.sort_array(F.collect_list(record)).alias("persisted_records"))
    i = real_images(images)
    context = F.col("context_date") if "context_date" in i.columns else F.lit(None).cast("string")
    out = i.select("id", "process_run_id", "sequence_index", "source_name", context.alias("context_date")).join(seen, "id", "left").join(stored, "id", "left")
    final = F.get("persisted_records", F.lit(0))["fecha_consignacion"]
    source = F.coalesce("_source", F.when(F.coalesce(final, F.lit("")) != "", F.when(final == F.col("explicit_ocr_date"), "image_explicit").when(final == F.col("context_date"), "docx_context").otherwise("record")))
    return out.fillna(0, ["llm_candidates", "fallback_candidates"]).select(
        F.col("id").alias("source_image_id"), "process_run_id", "sequence_index", "source_name", "context_date", "llm_candidates", "fallback_candidates",
        F.coalesce(F.transform("_rejected", lambda x: x["raw_payload"]), F.array().cast("array<string>")).alias("rejected_candidates"), "persisted_records", "explicit_ocr_date", final.alias("final_date"),
        source.alias("date_source"), "first_error")


def run_states(runs: DataFrame, logs: DataFrame, as_of: Column) -> DataFrame:
    """runs (id, status, started_at, ...) with current_stage, last_event_at, elapsed_ms up to as_of, and stale: in processing and silent for five minutes."""
    last = logs.groupBy("process_run_id").agg(F.max_by("stage", "id").alias("current_stage"), F.max_by("created_at", "id").alias("last_event_at"))
    out = runs.join(last.withColumnRenamed("process_run_id", "id"), "id", "left")
    sign = F.coalesce("last_event_at", "started_at", "created_at")
    stale = (F.col("status") == "processing") & (sign < as_of - F.expr(f"INTERVAL {STALE_SECONDS} SECONDS"))
    return out.withColumns({"elapsed_ms": run_duration_ms(F.col("started_at"), F.col("finished_at"), as_of), "stale": F.coalesce(stale, F.lit(False))})


def processing_state(runs: DataFrame, logs: DataFrame, images: DataFrame, deposits: DataFrame, as_of: Column) -> DataFrame:
    """Per run: current stage, images in all, processed and failed, deposits, last event, elapsed milliseconds, and whether it stands still."""
    state = run_states(runs.select("id", "status", "started_at", "finished_at", "created_at"), logs, as_of).drop("started_at", "finished_at", "created_at")
    stored = deposits.groupBy(F.col("process_run_id").alias("id")).agg(F.count("*").alias("total_records"))
    out = state.join(image_counts(images).withColumnRenamed("process_run_id", "id"), "id", "left").join(stored, "id", "left")
    return out.fillna(0, ["total_images", "processed_images", "failed_images", "total_records"])


def trace_events(logs: DataFrame) -> DataFrame:
    """Flat events with what the payload tells: a missing status follows from is_error, a missing error from an error message."""
    get = lambda name, kind="string": field("raw_payload", name, kind)
    text = lambda *parts: F.coalesce(*[F.nullif(p, F.lit("")) for p in parts], F.lit(""))
    message = F.coalesce(get("error_message"), F.col("notes"), F.lit(""))
    made = F.when(F.col("is_error") | get("error_message").isNotNull(), F.concat_ws(": ", F.nullif(F.coalesce(get("error_class"), F.lit("")), F.lit("")), message))
    columns = [c for c in ("provider", "model", "ocr_mode") if c in logs.columns]
    return logs.select(
        "id", "process_run_id", F.col("created_at").alias("timestamp"), "stage", F.coalesce(get("status"), F.when(F.col("is_error"), "failed").otherwise("completed")).alias("status"), "source_image_id",
        text(get("agent")).alias("agent"), *[text(F.col(c), get(c)).alias(c) for c in columns], F.coalesce(get("attempt", "int"), F.lit(0)).alias("attempt"), F.coalesce(get("duration_ms", "bigint"), F.lit(0)).alias("duration_ms"),
        F.coalesce(get("input"), F.lit("{}")).alias("input"), F.coalesce(get("output"), F.lit("{}")).alias("output"), text(get("decision")).alias("decision"), F.coalesce(get("error"), made).alias("error"), text(F.col("notes"), get("notes")).alias("notes"))


def event_rows(logs: DataFrame) -> DataFrame:
    """Log rows as events: what the payload lacks of status and error message is taken from the row."""
    columns = [c for c in ("provider", "model", "ocr_mode") if c in logs.columns]
    get = lambda name, kind: field("raw_payload", name, kind)
    return logs.select(
        "id", "process_run_id", "source_image_id", "stage", F.coalesce(get("status", "string"), F.when(F.col("is_error"), "failed").otherwise("completed")).alias("status"), *columns,
        *[get(name, kind).alias(name) for name, kind in EVENT_FIELDS.items()], F.coalesce(F.nullif(get("error_message", "string"), F.lit("")), "notes").alias("error_message"), "created_at")


def diagnostic_report(summary: DataFrame, advice: DataFrame, events: DataFrame, ordered: bool = True) -> DataFrame:
    """A Markdown report per run, as numbered lines (process_run_id, part, line, value): header figures, recommendations, table of events without started ones.

    summary: of stage_summary with images; advice: of recommendations; events: of event_rows.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    header = ["ocr_calls", "llm_calls", "processed_images", "failed_images", "slowest_stage", "total_ocr_duration_ms", "total_llm_duration_ms", "avg_ocr_duration_ms", "avg_llm_duration_ms", "provider_suspected"]
    lines = F.array(F.concat(F.lit("# Run "), F.col("process_run_id").cast("string")), *[F.concat(F.lit(f"- {c}: "), shown(c)) for c in header])
    top = summary.select("process_run_id", F.lit(0).alias("part"), F.posexplode(lines).alias("line", "value"))
    told = advice.filter("recommendations <> ''").select("process_run_id", F.lit(1).alias("part"), F.posexplode(F.split("recommendations", ",")).alias("line", "code")).select(
        "process_run_id", "part", "line", F.concat(F.lit("* "), "code").alias("value"))
    cells = F.concat_ws(" | ", shown("id"), shown("stage"), shown("status"), shown("duration_ms"), F.coalesce(F.nullif(F.col("error_message"), F.lit("")), F.lit("-")))
    table = events.filter("status <> 'started'").select("process_run_id", F.lit(2).alias("part"), F.col("id").cast("int").alias("line"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("value"))
    lines = top.unionByName(told).unionByName(table)
    return lines.orderBy("process_run_id", "part", "line") if ordered else lines


def run_audit(logs: DataFrame, run: int) -> DataFrame:
    """The log of one run in order, each row OK or ERROR."""
    return logs.filter(F.col("process_run_id") == run).select("id", "stage", F.when(F.col("is_error"), "ERROR").otherwise("OK").alias("result")).orderBy("id")


def first_rejections(events: DataFrame) -> DataFrame:
    """Per image the first event that is no success, by id."""
    return events.filter(~F.col("status").isin("completed", "started")).groupBy("source_image_id").agg(F.min_by(F.struct("id", "stage", "status"), "id").alias("first")).select("source_image_id", "first.*")


def over_budget(logs: DataFrame, seconds: int = BUDGET_SECONDS) -> DataFrame:
    """Runs whose stages took longer than a run may."""
    return logs.groupBy("process_run_id").agg(F.sum("duration_ms").alias("spent_ms")).filter(F.col("spent_ms") > seconds * 1000)
