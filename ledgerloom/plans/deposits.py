"""From texts to stored deposits in one plan: clean, extract, date, validate, merge, keep what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import detect_date
from ledgerloom.functions.extract import resolve_date, with_record
from ledgerloom.functions.text import cleaned_text, settled
from ledgerloom.functions.validate import candidate_reject_reason, skip_reason, validate_record
from ledgerloom.operators.records import dedup_merge, existing_key_anti, with_keys


def texts_to_candidates(texts: DataFrame, as_of: Column) -> DataFrame:
    """texts: source_image_id, content_hash, text, context_date. One candidate per text that holds a record, with what speaks against it."""
    cleaned = settled(texts, cleaned=cleaned_text(F.col("text"))).drop("text").withColumnRenamed("cleaned", "text")
    found = with_record(cleaned).filter("record IS NOT NULL")
    dated = settled(found, when=resolve_date(detect_date(F.col("text")), F.col("record.fecha_consignacion"), F.col("context_date")))
    rows = dated.select("source_image_id", "content_hash", F.lit(1).alias("idx"), F.col("when.date").alias("fecha_consignacion"), F.col("when.source").alias("date_source"), F.col("record.hora_consignacion").alias("hora_consignacion"),
                        F.col("record.referencia").alias("referencia"), F.col("record.valor").cast("decimal(14,2)").cast("string").alias("valor"))
    v = validate_record(F.col("referencia"), F.col("valor"), F.col("fecha_consignacion"), F.col("hora_consignacion"), as_of)
    return settled(rows, check=v).withColumns({"confidence": F.col("check.confidence"), "is_valid": F.col("check.is_valid"),
                                                    "skip": skip_reason(F.col("referencia"), F.col("valor")), "reject": candidate_reject_reason(F.col("referencia"), F.col("valor"))}).drop("check")


def texts_to_deposits(texts: DataFrame, stored: DataFrame, as_of: Column) -> DataFrame:
    """New deposits: valid candidates, merged per image, whose key is not stored."""
    good = texts_to_candidates(texts, as_of).filter("is_valid AND skip = '' AND reject = ''")
    merged = dedup_merge(good.select("source_image_id", "content_hash", "idx", "fecha_consignacion", "hora_consignacion", "referencia", "valor", "confidence"))
    keyed = with_keys(merged.join(texts.select("source_image_id", "content_hash").distinct(), "source_image_id"))
    return existing_key_anti(keyed, stored)
