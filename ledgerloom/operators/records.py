"""Candidate records: keys, duplicates, corrections, what gets stored."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerloom.functions.dates import normalize_date, normalize_time, to_ddmmyyyy
from ledgerloom.functions.money import normalize_amount, normalize_reference
from ledgerloom.functions.text import settled
from ledgerloom.functions.validate import criteria_rules, observations, valid_record
from ledgerloom.sources import files

FIELDS = ("fecha_consignacion", "hora_consignacion", "referencia", "valor")


def with_parts(c: DataFrame) -> DataFrame:
    """The normalized parts of keys, behind n_."""
    return settled(c, n_fecha=normalize_date(F.col("fecha_consignacion")), n_hora=normalize_time(F.col("hora_consignacion")),
                   n_referencia=normalize_reference(F.col("referencia")), n_valor=normalize_amount(F.col("valor")))


def _key(*stamp: str) -> Column:
    usable = (F.col("n_referencia") != "") & F.col("n_valor").isNotNull()
    return F.when(usable, F.concat(F.lit("v1:"), F.sha2(F.concat_ws("|", "content_hash", *stamp, F.col("n_valor").cast("string"), "n_referencia"), 256))).otherwise("")


def with_keys(c: DataFrame) -> DataFrame:
    """canonical_key and loose_key ('' without reference or amount), with the normalized parts behind n_."""
    # Joins and filters on the exact key would hash once more each; the loose one is left to whoever asks for it.
    return settled(with_parts(c), canonical_key=_key("n_fecha", "n_hora")).withColumn("loose_key", _key())


def completeness(filled: list[Column], confidence: Column) -> Column:
    """Ordered: how many fields are there, then confidence."""
    return F.struct(sum((F.when(F.coalesce(f.cast("string"), F.lit("")) != "", 1).otherwise(0) for f in filled), F.lit(0)).alias("filled"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"))


def dedup_exact(c: DataFrame) -> DataFrame:
    """keyed candidates with duplicate_of: idx of the first record with the key, null for first ones and for those without key."""
    first = F.min("idx").over(Window.partitionBy("source_image_id", "canonical_key"))
    return c.withColumn("duplicate_of", F.when((F.col("canonical_key") != "") & (first < F.col("idx")), first))


MERGED = "source_image_id long, idx int, fecha_consignacion string, hora_consignacion string, referencia string, valor string, merged int"
EVENTS = "source_image_id long, idx int, stage string, other int, reason string"
REASONS = {"result_duplicate_skipped": "same_canonical_transaction_key", "result_candidate_merged": "same_reference_and_amount_with_missing_datetime"}
#: Candidates of a loose key are reduced in stretches of so many idx, each in a task of its own.
STRETCH = 4096


def _reduced(c: DataFrame, members: bool = False) -> DataFrame:
    """keyed candidates, those of one loose key and stamp (date, time) reduced to the ones that can change the fold: in one partition a loose key, in the order of idx.

    A candidate does what the one before it with the same stamp did unless it is more confident and lacks
    date or time: a full stamp is seen from its first candidate on, others are merged until one
    becomes the head, which only more confidence can bring about. So a row is a candidate, how many follow it
    that do the same (n_like, with members their idx), and how many rows its loose key has (n_rows). A
    loose key that many rows share is reduced in stretches of idx before it meets in one place;
    candidates without key stay as they are and are spread.
    """
    keyed = settled(with_parts(c).withColumn("loose_key", _key()), n_confidence=F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)))
    keyed = keyed.select("source_image_id", "idx", *[F.col(f).cast("string").alias(f) for f in FIELDS], "n_fecha", "n_hora", F.col("n_confidence").alias("confidence"), "loose_key",
                         F.floor(F.col("idx") / STRETCH).alias("stretch"))
    stamp = Window.partitionBy("source_image_id", "loose_key", "stretch", "n_fecha", "n_hora").orderBy("idx", *FIELDS, "confidence")
    before = F.max("confidence").over(stamp.rowsBetween(Window.unboundedPreceding, -1))
    partial = (F.col("n_fecha") == "") | (F.col("n_hora") == "")
    # A column of its own, as windows do not nest.
    turns = keyed.withColumn("turn", F.when((F.col("loose_key") == "") | before.isNull() | partial & (F.col("confidence") > before), 1).otherwise(0))
    turns = turns.withColumn("turn", F.sum("turn").over(stamp.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.struct("idx", *FIELDS, "confidence"))
    like = [F.sort_array(F.collect_list("idx")).alias("members")] if members else []
    rows = turns.groupBy("source_image_id", "loose_key", "stretch", "n_fecha", "n_hora", "turn").agg(first.alias("r"), F.count("*").cast("int").alias("n_like"), *like)
    rows = rows.select("source_image_id", F.when(F.col("loose_key") != "", F.col("loose_key")).otherwise(F.concat(F.lit("#"), F.floor(F.col("r.idx") / 64).cast("string"))).alias("loose_key"),
                       F.col("loose_key") == "", "n_fecha", "n_hora", "n_like", *[x for x in ("members",) if members], "r.*").toDF(
        "source_image_id", "loose_key", "keyless", "n_fecha", "n_hora", "n_like", *[x for x in ("members",) if members], "idx", *FIELDS, "confidence")
    loose = Window.partitionBy("source_image_id", "loose_key")
    counted = rows.withColumn("n_rows", F.when(F.col("keyless"), 1).otherwise(F.count("*").over(loose)))
    return counted.sortWithinPartitions("source_image_id", "loose_key", "idx", *FIELDS)


class _Fold:
    """The records of one loose key, candidate by candidate in the order of idx.

    A candidate whose stamp was seen goes; one joins the first record if one of the two lacks date
    or time, and the more complete of the two gives the fields; all others are kept beside it.
    """

    def __init__(self, r):
        self.head, self.first, self.merged, self.rank = r, r.idx, 1, self._rank(r)
        self.seen = {(r.n_fecha, r.n_hora): r.idx}

    @staticmethod
    def _rank(r) -> tuple:
        return (r.n_fecha != "") + (r.n_hora != ""), r.confidence

    def add(self, r) -> tuple[str, str, int]:
        """What happens to r, what to those like it, and the idx of the record they go to; "kept" is a record of its own."""
        stamp = (r.n_fecha, r.n_hora)
        if stamp in self.seen:
            return "result_duplicate_skipped", "result_duplicate_skipped", self.seen[stamp]
        if all(stamp) and self.head.n_fecha and self.head.n_hora:
            self.seen[stamp] = r.idx
            return "kept", "result_duplicate_skipped", r.idx
        if self._rank(r) > self.rank:
            self.head, self.rank = r, self._rank(r)
            self.seen[stamp] = self.first
            self.merged += 1
            return "result_candidate_merged", "result_duplicate_skipped", self.first
        self.merged += r.n_like
        return "result_candidate_merged", "result_candidate_merged", self.first


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list, list]]:
    """Per batch: rows that are alone with their loose key; (row, what, what to those like it, idx) of the others but for first ones; the folds that ended."""
    fold, at = None, None
    for batch in batches:
        alone, done, ended = batch["n_rows"] == 1, [], []
        for r in batch[~alone].itertuples(index=False):
            if at != (at := (r.source_image_id, r.loose_key)):
                ended += [fold] if fold else []
                fold = _Fold(r)
                done.append((r, "head", "result_duplicate_skipped", r.idx))
            else:
                done.append((r, *fold.add(r)))
        yield batch[alone], done, ended
    yield pd.DataFrame(), [], [fold] if fold else []


def dedup_merge(c: DataFrame) -> DataFrame:
    """One row per record that stays: image, idx of its first candidate, the fields, merged (how many went in).

    Equal exact keys have equal loose keys, so each loose key is folded by itself, from its reduced rows.
    """
    names = _names(MERGED)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for alone, done, ended in _folded(batches):
            if len(alone):
                yield alone.assign(merged=1)[names]
            out = [(r.source_image_id, r.idx, *(getattr(r, f) for f in FIELDS), 1) for r, what, _, _ in done if what == "kept"]
            out += [(f.head.source_image_id, f.first, *(getattr(f.head, x) for x in FIELDS), f.merged) for f in ended]
            yield pd.DataFrame(out, columns=names)

    return _reduced(c).mapInPandas(run, MERGED)


def dedup_events(c: DataFrame) -> DataFrame:
    """What dedup_merge does to candidates: a row for each one that was skipped or merged, with the idx of the record it went to."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for alone, done, _ in _folded(batches):
            out = []
            several = alone[(alone["n_like"] > 1) & ~alone["keyless"]].itertuples(index=False) if len(alone) else ()
            for r, what, like, other in [*((r, "head", "result_duplicate_skipped", r.idx) for r in several), *done]:
                if what.startswith("result"):
                    out.append((r.source_image_id, r.idx, what, other))
                out += [(r.source_image_id, i, like, other) for i in r.members[1:]]
            rows = pd.DataFrame(out, columns=_names(EVENTS)[:4])
            yield rows.assign(reason=rows["stage"].map(REASONS))

    return _reduced(c, members=True).mapInPandas(run, EVENTS)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


KEY = ("source_image_id", "canonical_key")


def _keyless() -> Column:
    return F.coalesce("canonical_key", F.lit("")) == ""


def _stored_keys(stored: DataFrame) -> DataFrame:
    return stored.select(*KEY).filter(~_keyless()).distinct()


def existing_key_anti(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates to be stored: those without key, all of them, and of each key that is not stored for the image yet the one with the smallest idx.

    new: source_image_id, canonical_key, idx and what else is to be kept; columns that cannot be ordered (maps) raise. Of rows that
    also share the idx the smallest in the order of the other columns stays.
    """
    order = ["idx", *[c for c in new.columns if c not in (*KEY, "idx")]]
    row = F.struct(*order)
    # One pass over new: rows without key are grouped by all they hold, and come out as often as they came.
    fresh = new.join(_stored_keys(stored), list(KEY), "left_anti").groupBy(*KEY, F.when(_keyless(), row).alias("_row")).agg(F.min(row).alias("_r"), F.when(_keyless(), F.count("*")).otherwise(1).alias("_n"))
    return fresh.select("*", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int")))).select(*KEY, "_r.*").select(*new.columns)


def key_outcomes(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Each candidate with what storing does to it: stage and reason; one that goes has the reason existing_persisted_canonical_key, whether the key was stored before or with this batch."""
    firsts = new.filter(~_keyless()).groupBy(*KEY).agg(F.min("idx").alias("first_idx"))
    known = firsts.join(_stored_keys(stored).withColumn("was_stored", F.lit(True)), list(KEY), "left")
    told = new.join(known, list(KEY), "left")
    goes = F.coalesce(F.col("was_stored") | (F.col("idx") > F.col("first_idx")), F.col("was_stored"), F.col("idx") > F.col("first_idx"), F.lit(False))
    return told.withColumns({"stage": F.when(goes, "result_duplicate_skipped").otherwise("record_created"), "reason": F.when(goes, "existing_persisted_canonical_key").otherwise("")}).select(*new.columns, "stage", "reason")


def existing_key_semi(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates whose key is stored for their image; those without key are never known."""
    return new.join(_stored_keys(stored), list(KEY), "left_semi")


def unknown_ids_anti(corrections: DataFrame, deposits: DataFrame) -> DataFrame:
    return corrections.join(deposits.select("id"), "id", "left_anti").select("id")


def apply_corrections(deposits: DataFrame, corrections: DataFrame, order: str | None = None, month: int | None = None, year: int | None = None, criteria: Sequence[dict] = ()) -> DataFrame:
    """Fields replaced where a correction has them, others kept; of several corrections of an id the last by `order` holds. Adds manually_corrected.

    Of a corrected deposit what follows from the fields is made anew, as far as deposits has it:
    observations and is_current_month by the period month, year and the criteria, and fecha_date.
    """
    if order:
        corrections = corrections.withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(order)))).filter("_rn = 1").drop("_rn", order)
    known = {"id", "manually_corrected", *FIELDS}
    if unknown := [x for x in corrections.columns if x not in known]:
        raise ValueError(f"corrections may not have: {', '.join(unknown)}")
    fields = [f for f in FIELDS if f in corrections.columns]
    c = corrections.select(F.col("id").alias("_id"), *[F.col(f).alias(f"_{f}") for f in fields])
    out = deposits.join(c, F.col("id") == F.col("_id"), "left")
    new = {f: F.coalesce(to_ddmmyyyy(F.col(f"_{f}")) if f == "fecha_consignacion" else F.col(f"_{f}"), F.col(f)) for f in fields}
    out = out.withColumns(new | {"manually_corrected": F.col("_id").isNotNull()}).drop("_id", *[f"_{f}" for f in fields])
    rules = criteria_rules(list(criteria), lambda key: F.col(key) if key in FIELDS else F.lit(None).cast("string"))
    made = observations(F.col("fecha_consignacion"), month, year, rules)
    follows = {"observations": made["observations"], "is_current_month": made["is_current_month"], "fecha_date": F.try_to_date("fecha_consignacion", "dd/MM/yyyy")}
    return out.withColumns({k: F.when(F.col("manually_corrected"), v).otherwise(F.col(k)) for k, v in follows.items() if k in deposits.columns})


def partial_correction(deposits: DataFrame, item: dict, month: int | None = None, year: int | None = None) -> DataFrame:
    """One deposit with some of its four fields replaced. item: id and the new values; other keys raise ValueError, as does one without a field."""
    if unknown := sorted(set(item) - {"id", *FIELDS}):
        raise ValueError(f"fields that cannot be corrected: {', '.join(unknown)}")
    if not set(item) & set(FIELDS) or item.get("id") is None:
        raise ValueError("a correction needs an id and at least one field")
    types = {f: ("decimal(14,2)" if f == "valor" else "string") for f in FIELDS}
    one = deposits.sparkSession.range(1).select(F.lit(item["id"]).cast("long").alias("id"), *[F.lit(item[f]).cast(types[f]).alias(f) for f in FIELDS if f in item])
    return apply_corrections(deposits, one, None, month, year)


def correction_row(rows: DataFrame) -> DataFrame:
    """Corrections checked as records: id, the four fields as they would be stored (amount with two decimals), and error, null where the row holds.

    rows: id and the four fields; reference and amount are required, blank date and time stay blank.
    """
    amount = F.col("valor").cast("string").try_cast("decimal(14,2)")
    blank = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    checked = settled(rows, check=valid_record(F.col("referencia"), amount.cast("string"), blank("fecha_consignacion"), blank("hora_consignacion")))
    error = F.when(F.coalesce(F.col("id"), F.lit(0)) < 1, "id must be 1 or more").otherwise(F.col("check.error"))
    some = lambda c: F.when(error.isNull(), F.coalesce(f"check.{c}", F.lit("")))
    return checked.select("id", some("fecha_consignacion").alias("fecha_consignacion"), some("hora_consignacion").alias("hora_consignacion"),
                          F.when(error.isNull(), F.col("check.referencia")).alias("referencia"), F.when(error.isNull(), F.col("check.valor").cast("decimal(14,2)")).alias("valor"), error.alias("error"))


class Written(NamedTuple):
    """What a batch has stored, read back; how many candidates came, were stored and were skipped."""

    rows: DataFrame
    accepted: int
    created: int
    skipped: int


def stored_deposits(spark: SparkSession, path: str, schema: StructType, without: str | None = None) -> DataFrame:
    """The deposits of all batches under path, or of all but one; an empty frame where there are none."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(StructType([*schema.fields, StructField("batch", StringType())])).parquet(path)
    return (found.filter(F.col("batch") != without) if without is not None else found).select(*schema.names)


def write_deposits(accepted: DataFrame, path: str, batch: str, stored: DataFrame | None = None) -> Written:
    """Stores the candidates of a batch that are new, in a folder of the batch; what other batches (and `stored`) hold is not stored again.

    A batch that is repeated, after a failure or by mistake, is compared with the others only and
    replaces its own folder, so the table is the same whether it ran once or twice. Counts come with the
    job that writes.
    """
    spark = accepted.sparkSession
    known = stored_deposits(spark, path, accepted.schema, without=batch).select(*KEY)
    known = known.unionByName(stored.select(*KEY)) if stored is not None else known
    came, kept = Observation(), Observation()
    # Keyless candidates are counted with what is written, the others as they come in: each row passes one counter once.
    keyed = accepted.filter(~_keyless()).observe(came, F.count("*").alias("n"))
    # The empty branch of keyed has no shuffle, so its counter tells 0 also where nothing comes and the branch with one is left out.
    new = existing_key_anti(keyed, known).unionByName(keyed.filter(_keyless())).unionByName(accepted.filter(_keyless())).observe(kept, F.count("*").alias("n"), F.count_if(_keyless()).alias("keyless"))
    target = f"{path.rstrip('/')}/batch={quote(batch, safe='-_.')}"
    new.write.mode("overwrite").parquet(target)
    accepted_n, created = came.get["n"] + kept.get["keyless"], kept.get["n"]
    return Written(spark.read.schema(accepted.schema).parquet(target), accepted_n, created, accepted_n - created)
