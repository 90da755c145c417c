"""Event rows that follow from records and attempts, for the stage log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.redact import redact_payload
from ledgerloom.functions.text import score_text, settled, significant_text, stable_hash, strip, truncate
from ledgerloom.functions.validate import candidate_reject_reason, skip_reason
from ledgerloom.operators import attempts as at
from ledgerloom.operators.records import dedup_exact, with_keys

MAX_ROUNDS, ACCEPTED = 3, 0.5


def _event(when: Column, stage: str, reason: Column) -> Column:
    return F.when(when, F.struct(F.lit(stage).alias("stage"), reason.cast("string").alias("reason")))


def candidate_events(candidates: DataFrame) -> DataFrame:
    """One event per candidate: record_skipped, candidate_rejected, result_duplicate_skipped or candidate_accepted, the first that holds."""
    c = settled(dedup_exact(with_keys(candidates)), skip=skip_reason(F.col("referencia"), F.col("valor")), reject=candidate_reject_reason(F.col("referencia"), F.col("valor")))
    skipped, rejected, twice = F.col("skip") != "", F.col("reject") != "", F.col("duplicate_of").isNotNull()
    event = F.coalesce(_event(skipped, "record_skipped", F.col("skip")), _event(rejected, "candidate_rejected", F.col("reject")),
                       _event(twice, "result_duplicate_skipped", F.concat(F.lit("duplicate_of:"), F.col("duplicate_of").cast("string"))), _event(F.lit(True), "candidate_accepted", F.lit("")))
    return c.select("source_image_id", "idx", event.alias("e")).select("source_image_id", "idx", "e.stage", "e.reason")


def persistence_summaries(events: DataFrame) -> DataFrame:
    """From candidate_events: per image how many candidates came, were persisted, skipped, rejected and duplicates."""
    n = lambda stage: F.count_if(F.col("stage") == stage)
    return events.groupBy("source_image_id").agg(
        F.count("*").alias("candidates"), n("candidate_accepted").alias("persisted"), n("record_skipped").alias("skipped"), n("candidate_rejected").alias("rejected"), n("result_duplicate_skipped").alias("duplicates"))


def extraction_events(extracted: DataFrame) -> DataFrame:
    """From with_record: a rejected_candidate event per amount that was not taken, then one event for the text.

    Where extracted has the column llm_failure_event (null if the model's answer held), the failure and
    the start of the fallback come before them; texts without a failure have no fallback and no events.
    """
    event = lambda stage, reason: F.struct(F.lit(stage).alias("stage") if isinstance(stage, str) else stage.alias("stage"), reason.alias("reason"))
    rejected = F.transform(F.filter("candidates", lambda c: c["reason"].isNotNull()), lambda c: event("rejected_candidate", c["reason"]))
    last = F.array(event(F.when(F.col("record").isNotNull(), "fallback_completed").otherwise("fallback_empty"), F.coalesce("reason", F.lit(""))))
    events = F.concat(rejected, last)
    if "llm_failure_event" in extracted.columns:
        first = F.array(event(F.col("llm_failure_event"), F.lit("")), event("heuristic_fallback_started", F.col("llm_failure_event")))
        events = F.when(F.col("llm_failure_event").isNotNull(), F.concat(first, events)).otherwise(F.array().cast("array<struct<stage:string,reason:string>>"))
    return extracted.select("id", F.posexplode(events).alias("position", "e")).select("id", "position", "e.stage", "e.reason")


def llm_failure(response: Column, error_class: Column, n_records: Column) -> Column:
    """What to log of a model's answer: empty, not JSON, not valid, another error's class, or null where it held."""
    blank = F.coalesce(strip(response), F.lit("")) == ""
    return (F.when(blank, "llm_empty_response").when(error_class == "JSONDecodeError", "llm_invalid_json").when(error_class == "ValidationError", "llm_validation_failed")
            .when(error_class.isNotNull(), error_class).when(n_records == 0, "llm_validation_failed"))


def structure_summary(extracted: DataFrame, most_chars: int = 8000) -> DataFrame:
    """Figures of one structuring, from with_record: sizes, hash and sample of the text, whether it was cut for the model, counts of records and candidates, failure.

    extracted: id, text, candidates, record, and of the model's answer response, error_class, llm_records_count.
    """
    t, r = F.coalesce("text", F.lit("")), F.coalesce("response", F.lit(""))
    fallback = F.col("llm_records_count") == 0
    heuristic = F.when(fallback & F.col("record").isNotNull(), 1).otherwise(0)
    records = F.when(fallback, heuristic).otherwise(F.col("llm_records_count")).cast("int")
    rejected = F.when(fallback, F.size(F.filter("candidates", lambda c: c["reason"].isNotNull()))).otherwise(0)
    return extracted.select(
        "id", F.length(t).alias("raw_text_chars"), stable_hash(F.col("text")).alias("raw_text_sha256"), truncate(t).alias("raw_text_sample"), (F.length(t) > most_chars).alias("ocr_text_truncated_for_llm"),
        records.alias("structured_records_count"), F.col("llm_records_count").alias("llm_structured_records_count"), fallback.alias("heuristic_fallback_started"), (heuristic > 0).alias("heuristic_fallback_used"),
        rejected.alias("heuristic_rejected_count"), F.length(r).alias("response_chars"), truncate(r).alias("raw_response_preview"), (strip(r) == "").alias("empty_provider_response"),
        llm_failure(F.col("response"), F.col("error_class"), records).alias("llm_failure_event"))


def aggregation_event(attempts: DataFrame) -> DataFrame:
    """One row per image: attempts, best, consensus, conflicts, confidence, recommendation."""
    return at.aggregation(attempts).select("source_image_id", F.lit("aggregation").alias("stage"), F.col("n").alias("attempts"), F.col("attempt_number").alias("best"), "n_consensus", "n_conflict", "aggregation_confidence", "recommendation")


def ocr_attempt_rows(texts: DataFrame, text: str = "text", sample: int = 500) -> DataFrame:
    """texts with size, a sample and the score, without the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return texts.withColumns({"chars": F.length(t), "sample": F.left(t, F.lit(sample)), "score": score_text(F.col(text))}).drop(text)


def persistence_check(images: DataFrame, structured: DataFrame, persisted: DataFrame) -> DataFrame:
    """images: source_image_id, text. Whether records or readable text led to nothing that was stored."""
    s = structured.groupBy("source_image_id").agg(F.count("*").alias("structured"))
    p = persisted.groupBy("source_image_id").agg(F.count("*").alias("persisted"))
    out = images.join(s, "source_image_id", "left").join(p, "source_image_id", "left").fillna(0, ["structured", "persisted"])
    readable = significant_text(F.col("text"))
    return out.select("source_image_id", "structured", "persisted", ((F.col("persisted") == 0) & ((F.col("structured") > 0) | readable)).alias("mismatch"), ((F.col("structured") == 0) & readable).alias("structuring_empty"))


def row_summary(deposits: DataFrame, most: int = 3) -> DataFrame:
    return deposits.select("id", "referencia", "valor", F.slice("observations", 1, most).alias("observations"), F.size("observations").alias("n_observations"))


def attempt_rounds(pending: DataFrame, attempts: DataFrame, rounds: int = MAX_ROUNDS, accepted: float = ACCEPTED) -> DataFrame:
    """What each round decides: accepted images leave, others go on with the settings of their retry, until rounds or retries end.

    pending: source_image_id, mode, model, timeout. The result of attempt k comes from the attempts
    table (attempt_number, error, confidence). Each round is one join over all images still pending.
    """
    out = None
    for k in range(1, rounds + 1):
        got = attempts.filter(F.col("attempt_number") == k).select("source_image_id", "error", F.col("confidence").alias("got"))
        now = pending.join(got, "source_image_id")
        done = F.col("error").isNull() & (F.col("got") >= accepted)
        kind = F.when(F.col("error").isNull(), "validation_failed").otherwise(at.classify_error(F.col("error")))
        now = settled(now, done=done, kind=kind)
        now = settled(now, decision=at.retry_decision(F.col("kind"), F.lit(k - 1), F.col("got"), F.col("mode"), F.col("model")))
        rows = now.select("source_image_id", F.lit(k).alias("round"), F.when(F.col("done"), "accepted").otherwise(F.col("decision.strategy")).alias("outcome"))
        out = rows if out is None else out.unionByName(rows)
        nxt = now.filter(~F.col("done") & F.col("decision.should_retry"))
        pending = nxt.select("source_image_id", at.apply_retry(F.col("mode"), F.col("model"), F.col("timeout"), F.col("decision")).alias("n")).select("source_image_id", "n.mode", "n.model", "n.timeout")
    return out


def write_log(events: DataFrame, path: str) -> None:
    """Appends events to a log, one folder per stage; secrets in raw_payload are taken out on the way."""
    if "raw_payload" in events.columns:
        events = events.withColumn("raw_payload", redact_payload(F.col("raw_payload")))
    events.write.mode("append").partitionBy("stage").parquet(path)
