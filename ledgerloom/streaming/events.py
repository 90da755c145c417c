"""The stage log and incoming documents as streams. Rows behind the watermark are dropped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from ledgerloom.sources.docx import raw_references

STALE_SECONDS, MAX_RETRIES = 300, 3
FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_ingest(documents: DataFrame, late: str = "10 minutes") -> DataFrame:
    """documents (fingerprint, received_at, ...) without those whose fingerprint came before, within the watermark."""
    return documents.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["fingerprint"])


def document_stream(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """DOCX files under path as they come: path, length, content, fingerprint (SHA-256), received_at."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_at_once).load(path)
    return files.select("path", "length", "content", F.sha2("content", 256).alias("fingerprint"), F.col("modificationTime").alias("received_at"))


def stream_references(documents: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The references of each document that has not come before: a row per run, or per image in it."""
    return raw_references(stream_ingest(documents, late).select("path", "content"))


def batch_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch in a folder of its number. One that is repeated after a failure replaces what it wrote before, so no row comes twice."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={number}")

    return write


def stream_stage_metrics(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Calls, milliseconds and errors per run, stage and window."""
    window = F.window("created_at", width, slide) if slide else F.window("created_at", width)
    return events.withWatermark("created_at", late).groupBy(window, "process_run_id", "stage").agg(
        F.count("*").alias("calls"), F.sum("duration_ms").alias("total_ms"), F.floor(F.avg("duration_ms")).alias("avg_ms"), F.count_if("is_error").alias("errors"))


class InOrder(StatefulProcessor):
    """Events of a key in the order of their time and id, whatever order they came in.

    They wait in a list until the watermark has passed them, when nothing can come before them any more; a
    timer at the earliest of them wakes the key. Subclasses say what an event does, and what the
    watermark does that has passed them all; what waits is bounded by the events within the watermark's delay.
    """

    #: Columns of an event behind created_at and id, with their types.
    extra: tuple[StructField, ...] = ()
    names: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([StructField("us", LongType()), StructField("id", LongType()), *self.extra]))

    def event(self, key: tuple, us: int, number: int, *more) -> Iterator[tuple]:
        raise NotImplementedError

    def passed(self, key: tuple, us: int) -> Iterator[tuple]:
        return iter(())

    def load(self) -> None:
        """Reads the rest of the state, before events are told."""

    def save(self) -> None:
        """Writes the rest of the state."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            us = part["created_at"].to_numpy("datetime64[us]").astype("int64").tolist()
            first = min(us) if first is None else min(first, *us)
            self.waiting.appendList(list(zip(us, part["id"].tolist(), *(part[f.name].tolist() for f in self.extra), strict=True)))
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        # Nothing is told yet: a frame without rows for each key would cost more than the rest.
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(map(tuple, self.waiting.get())) if self.waiting.exists() else []
        ready = [r for r in waiting if r[0] <= mark]
        later = waiting[len(ready) :]
        self.load()
        out = [row for r in ready for row in self.event(key, *r)]
        out += self.passed(key, mark)
        self.save()
        if ready:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if later:
            self.handle.registerTimer(-(-later[0][0] // 1000))
        return iter([pd.DataFrame(out, columns=self.names)] if out else [])

    def close(self) -> None:
        pass


class RetryCounter(InOrder):
    """How often each image failed in a row; a success starts again and leaves no state."""

    extra = (StructField("is_error", BooleanType()),)
    names = ("source_image_id", "id", "retries", "may_retry")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.count = handle.getValueState("retries", StructType([StructField("n", IntegerType())]))

    def load(self) -> None:
        self.n = self.count.get()[0] if self.count.exists() else 0

    def event(self, key: tuple, us: int, number: int, failed: bool) -> Iterator[tuple]:
        self.n = self.n + 1 if failed else 0
        yield int(key[0]), number, self.n, self.n < MAX_RETRIES

    def save(self) -> None:
        if self.n:
            self.count.update((self.n,))
        elif self.count.exists():
            self.count.clear()


RETRIES = StructType([StructField("source_image_id", LongType()), StructField("id", LongType()), StructField("retries", IntegerType()), StructField("may_retry", BooleanType())])


def stream_retry_state(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """Per event the failures in a row of its image up to it, in the order of time and id, once the watermark has passed it. Needs the RocksDB state store provider."""
    return events.withWatermark("created_at", late).groupBy("source_image_id").transformWithStateInPandas(statefulProcessor=RetryCounter(), outputStructType=RETRIES, outputMode="Append", timeMode="EventTime")


class Silence(InOrder):
    """Runs that fall silent without having ended, and those that speak again."""

    extra = (StructField("stage", StringType()),)
    names = ("process_run_id", "kind", "at", "events", "last_stage")

    def __init__(self, gap: int):
        self.gap = gap * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.run = handle.getValueState("run", StructType([StructField("last", LongType()), StructField("events", LongType()), StructField("stage", StringType()), StructField("warned", BooleanType())]))

    def load(self) -> None:
        self.now = tuple(self.run.get()) if self.run.exists() else None

    def _row(self, key: tuple, kind: str, us: int) -> tuple:
        return int(key[0]), kind, pd.Timestamp(us, unit="us"), self.now[1], self.now[2]

    def event(self, key: tuple, us: int, number: int, stage: str) -> Iterator[tuple]:
        yield from self.passed(key, us)
        n, warned = (self.now[1], self.now[3]) if self.now else (0, False)
        self.now = (us, 1 if warned else n + 1, stage, False)
        if warned:
            yield self._row(key, "resumed", us)
        if stage == "job_completed":
            self.now = None

    def passed(self, key: tuple, us: int) -> Iterator[tuple]:
        if self.now and not self.now[3] and self.now[0] + self.gap <= us:
            self.now = (*self.now[:3], True)
            yield self._row(key, "stale", self.now[0] + self.gap)

    def save(self) -> None:
        if self.now:
            self.run.update(self.now)
            if not self.now[3]:
                self.handle.registerTimer(-(-(self.now[0] + self.gap) // 1000))
        elif self.run.exists():
            self.run.clear()


SILENCES = StructType([StructField("process_run_id", LongType()), StructField("kind", StringType()), StructField("at", TimestampType()), StructField("events", LongType()), StructField("last_stage", StringType())])


def stream_silences(events: DataFrame, late: str = "1 minute", gap: int = STALE_SECONDS) -> DataFrame:
    """A row when a run has been silent for `gap` seconds without a job_completed (stale: since when, events since it last began to speak, last stage), and one when it speaks again (resumed).

    It comes as soon as the watermark says so; job_completed ends a run's state at once. Needs the RocksDB state store provider.
    """
    return events.withWatermark("created_at", late).groupBy("process_run_id").transformWithStateInPandas(statefulProcessor=Silence(gap), outputStructType=SILENCES, outputMode="Append", timeMode="EventTime")


def stream_stale_runs(events: DataFrame, late: str = "1 minute", gap: int = STALE_SECONDS) -> DataFrame:
    """A row per run and silence, in append mode."""
    return stream_silences(events, late, gap).filter("kind = 'stale'").select("process_run_id", F.col("at").alias("stale_since"), "events", "last_stage")
