"""Streams run to their end over files; each test has one row behind the watermark."""

import io
import zipfile
from datetime import datetime, timedelta

from pyspark.errors import StreamingQueryException

from ledgerloom.streaming import events as ev

T0 = datetime(2024, 1, 1, 12)
EVENTS = "id long, process_run_id long, source_image_id long, stage string, duration_ms long, is_error boolean, created_at timestamp"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def stream(spark, folder, schema, *batches):
    """A file stream that reads one batch after the other."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def collect(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
    finally:
        q.stop()
    return spark.table(name).collect()


def test_ingest_once(spark, tmp_path):
    schema = "fingerprint string, received_at timestamp"
    df = stream(spark, tmp_path / "in", schema, [("a", at(0)), ("a", at(1)), ("b", at(60))], [("d", at(61))], [("c", at(0))])
    got = sorted(r["fingerprint"] for r in collect(spark, ev.stream_ingest(df), "ingest", tmp_path))
    # c is late: the watermark of a batch holds for those after the next.
    assert got == ["a", "b", "d"]


def test_stage_metrics(spark, tmp_path):
    rows = [(1, 1, 1, "ocr", 100, False, at(0)), (2, 1, 1, "ocr", 51, True, at(4)), (3, 1, 1, "ocr", 10, False, at(6)), (4, 1, 1, "ocr", 1, False, at(60))]
    df = stream(spark, tmp_path / "in", EVENTS, rows, [(6, 1, 1, "ocr", 5, False, at(90))], [(5, 1, 1, "ocr", 999, False, at(1)), (7, 1, 1, "ocr", 5, False, at(120))])
    got = {r["window"]["start"]: (r["calls"], r["total_ms"], r["avg_ms"], r["errors"]) for r in collect(spark, ev.stream_stage_metrics(df), "metrics", tmp_path)}
    assert got[at(0)] == (2, 151, 75, 1) and got[at(5)] == (1, 10, 10, 0)


def test_silences(spark, tmp_path):
    # Run 1 falls silent twice and speaks again twice; run 2 ends; 4 comes out of order; 9 is behind the watermark of the batch before and is dropped.
    first = [(1, 1, 1, "ocr", 1, False, at(0)), (2, 1, 1, "llm", 1, False, at(2)), (3, 2, 1, "ocr", 1, False, at(0)), (4, 2, 1, "job_completed", 1, False, at(1))]
    second = [(5, 1, 1, "ocr", 1, False, at(20)), (7, 1, 1, "end", 1, False, at(50)), (6, 1, 1, "x", 1, False, at(3))]
    rest = [[(8, 3, 1, "ocr", 1, False, at(90))], [(9, 1, 1, "late", 1, False, at(4)), (10, 3, 1, "ocr", 1, False, at(92))], [(11, 1, 1, "job_completed", 1, False, at(96))], [(12, 4, 1, "ocr", 1, False, at(120))]]
    df = stream(spark, tmp_path / "in", EVENTS, first, second, *rest)
    got = sorted(((r["process_run_id"], r["at"], r["kind"], r["events"], r["last_stage"]) for r in collect(spark, ev.stream_silences(df), "silences", tmp_path)))
    assert got == [(1, at(8), "stale", 3, "x"), (1, at(20), "resumed", 1, "ocr"), (1, at(25), "stale", 1, "ocr"), (1, at(50), "resumed", 1, "end"), (1, at(55), "stale", 1, "end"), (1, at(96), "resumed", 1, "job_completed"), (3, at(97), "stale", 2, "ocr")]


RETRY_ROWS = [(i, 1, 5 + i % 3, "ocr", 1, i % 7 > 0, at(i / 4)) for i in range(90)]


def test_retry_state_does_not_depend_on_batches(spark, tmp_path):
    """Events in one batch, or shuffled within the watermark over ten."""
    flush = [(99, 1, 9, "ocr", 1, False, at(500))]
    want, n = {}, {}
    for i, _, image, _, _, failed, _ in RETRY_ROWS:
        n[image] = n.get(image, 0) + 1 if failed else 0
        want[i] = (image, n[image], n[image] < 3)
    # Neighbours change places, also across batches, by less than the delay.
    order = sorted(range(90), key=lambda i: i + (i * 37 % 11))
    shuffled = [[RETRY_ROWS[i] for i in order[k : k + 9]] for k in range(0, 90, 9)]
    for name, batches in (("one", [RETRY_ROWS]), ("ten", shuffled)):
        df = stream(spark, tmp_path / name, EVENTS, *batches, flush)
        rows = collect(spark, ev.stream_retry_state(df, "5 minutes"), f"retries_{name}", tmp_path)
        assert {r["id"]: (r["source_image_id"], r["retries"], r["may_retry"]) for r in rows} == want and len(rows) == 90


def document(word):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("word/document.xml"), f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>{word}</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


def test_documents_come_once_though_a_batch_is_repeated(spark, tmp_path):
    """The query dies after its second batch was written and before that was noted; started again, it writes the batch again."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for k in range(4):
        (folder / f"{k}.docx").write_bytes(document(f"text{k}"))
    (folder / "copy.docx").write_bytes(document("text0"))
    (folder / "note.txt").write_text("no document")
    sink, died = ev.batch_sink(out), []

    def write(batch, number):
        sink(batch, number)
        if number == 1 and not died:
            died.append(number)
            raise RuntimeError("stopped")

    for _ in range(2):
        references = ev.stream_references(ev.document_stream(spark, str(folder), files_at_once=2), "30 days")
        q = references.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
        except StreamingQueryException:
            assert died == [1]
    rows = spark.read.parquet(out)
    assert sorted(r["text"] for r in rows.collect()) == ["text0", "text1", "text2", "text3"] and rows.select("batch").distinct().count() >= 2


def test_keys_with_nothing_to_tell_give_no_frame():
    """Events are put aside as plain values, and no frame without rows is made for their key."""
    import pandas as pd

    class Kept:
        def __init__(self):
            self.rows, self.timers = [], []

        def getListState(self, *_):
            return self

        def getValueState(self, *_):
            return self

        def appendList(self, rows):
            self.rows += rows

        def registerTimer(self, ms):
            self.timers.append(ms)

    kept = Kept()
    silence = ev.Silence(300)
    silence.init(kept)
    parts = [pd.DataFrame({"created_at": pd.to_datetime(["1970-01-01 00:00:01.000001", "1970-01-01"], format="ISO8601"), "id": [7, 8], "stage": ["a", None]}), pd.DataFrame({"created_at": pd.to_datetime(["1970-01-01 00:00:05"]), "id": [9], "stage": ["b"]})]
    assert list(silence.handleInputRows((1,), iter(parts), None)) == []
    assert kept.rows == [(1_000_001, 7, "a"), (0, 8, None), (5_000_000, 9, "b")] and kept.timers == [0]
    assert {type(x) for r in kept.rows for x in r} == {int, str, type(None)}
