"""WARC archives: written and read by Spark, and assembled to captures.

A capture is a response or revisit record with the request and metadata records that name it in
WARC-Concurrent-To. Archives are gzip files of records in the WARC 1.1 format; the sink is Spark's
text writer, whose line separator is the two line ends that close a record. The source reads whole
files (binaryFile), so the writer bounds how many captures and bytes a file holds.

Of captures with equal payloads of at least MIN_REVISIT bytes, that with the largest page_id
carries it; the others are revisits that refer to it. They learn length and digest from that
record when they are read.

Defined results: null html is an empty payload, null url an empty target; rows that repeat are
captures that repeat, and several rows of the largest page_id all carry the payload; a null page_id
is written as none and comes back null, and revisits nothing; empty tables give no records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, new_folder, table

CLOSE = "\r\n\r\n"
MIN_REVISIT = 1000
#: Captures in one file at most, and bytes of their records, but for a capture that is larger alone; a file is read as a whole.
FILE_CAPTURES, FILE_BYTES = 500, 1 << 27
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, record_type string, target_uri string, concurrent_to string, refers_to string, payload_digest string, content_type string, fields string, payload binary, payload_bytes long, block_digest string"


def _record_id(kind: str, page: Column, digest: Column) -> Column:
    """A URN that depends on the kind of record, the page and its payload."""
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("none")), digest))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def with_revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest (SHA-1, hex), bytes, refers_to (page_id, null where the page carries its payload)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    sized = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html")).withColumns({"digest": F.sha1("html"), "bytes": F.octet_length("html").cast("long")})
    chosen = sized.filter(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("carrier"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Few payloads repeat: written out, the table of carriers shows its true size to the join.
    chosen = materialize(chosen, "warc-carriers")
    joined = sized.join(chosen, ["digest", "bytes"], "left")
    return joined.withColumn("refers_to", F.when(F.col("page_id") < F.col("carrier"), F.col("carrier"))).drop("carrier")


def _head(kind: str, lines: list[tuple[str, Column]], body: Column) -> Column:
    """A record without its closing line ends. Null lines are left out."""
    shown = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in lines]
    return F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\n"), F.concat_ws("", *shown), F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(CLOSE), body)


def records(revisited: DataFrame) -> DataFrame:
    """One column, record: three records per page, of the output of with_revisits."""
    page, digest, url = F.col("page_id"), F.col("digest"), F.regexp_replace("url", r"[\r\n]+", " ")
    is_revisit = F.col("refers_to").isNotNull()
    main = F.when(is_revisit, _record_id("revisit", page, digest)).otherwise(_record_id("response", page, digest))
    base = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.when(url != "", url))]
    sha = F.concat(F.lit("sha1:"), digest)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(CLOSE))
    response = _head("response", [("WARC-Record-ID", main), *base, ("WARC-Payload-Digest", sha), ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(http, F.col("html")))
    revisit = _head("revisit", [
        ("WARC-Record-ID", main), *base, ("WARC-Payload-Digest", sha), ("WARC-Profile", F.lit(PROFILE)),
        ("WARC-Refers-To", _record_id("response", F.col("refers_to"), digest)), ("Content-Type", F.lit("application/http; msgtype=response"))], http)
    request = _head("request", [("WARC-Record-ID", _record_id("request", page, digest)), *base, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http; msgtype=request"))],
                    F.concat(F.lit("GET / HTTP/1.1"), F.lit(CLOSE)))
    metadata = _head("metadata", [("WARC-Record-ID", _record_id("metadata", page, digest)), *base, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields"))],
                     F.concat(F.lit("page-id: "), F.coalesce(page.cast("string"), F.lit("none")), F.lit("\r\n")))
    # The three stay in one value, so they stay in one file.
    return revisited.select(F.concat_ws(CLOSE, F.when(is_revisit, revisit).otherwise(response), request, metadata).alias("record"))


def write_archives(written: DataFrame, path: str, largest: int | None = None, file_captures: int = FILE_CAPTURES, file_bytes: int = FILE_BYTES) -> None:
    """The sink: gzip files of records under path. largest: the bytes of the largest payload, where known.

    Where file_captures of the largest could pass file_bytes, captures go to files of their own size
    class: each class is at most eight times as large as the one before, and its files hold as many as fit.
    """
    def write(rows: DataFrame, captures: int) -> None:
        rows.write.mode("append").option("lineSep", CLOSE).option("compression", "gzip").option("maxRecordsPerFile", captures).text(path)

    if largest is not None and (largest + 4096) * file_captures <= file_bytes:
        return write(written, file_captures)
    size, low, high = F.octet_length("record"), -1, file_bytes // file_captures
    while True:
        last = high >= file_bytes or largest is not None and high >= largest + 4096
        write(written.filter(size > low) if last else written.filter((size > low) & (size <= high)), max(1, file_bytes // high))
        if last:
            return None
        low, high = high, min(high * 8, file_bytes)


def _hex_digest(value: str | None) -> str | None:
    """Bare lower-case hex of a digest header: hex as it is, or the 32 characters of base 32."""
    if not value:
        return None
    bare = value.split(":", 1)[-1].strip()
    return base64.b32decode(bare.upper()).hex() if len(bare) == 32 else bare.lower()


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record; lengths decide where a record ends, not its content."""
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"WARC: no record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size, start = int(head["content-length"]), end + 4
        if start + size > len(data):
            raise ValueError("WARC: cut off")
        yield head, data[start : start + size]
        at = start + size


def _unzipped(data: bytes) -> bytes:
    """The content of a gzip file of one or many members; other files as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    parts = []
    while data[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        parts.append(one.decompress(data) + one.flush())
        data = one.unused_data
    return b"".join(parts)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record. The payload is the block behind HTTP headers, else the block; its digest is computed, not believed."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file in batch["content"]:
                rows = []
                for head, block in parse_records(_unzipped(bytes(file))):
                    http = head.get("content-type", "").startswith("application/http")
                    payload = block.partition(b"\r\n\r\n")[2] if http else block
                    is_fields = head.get("content-type") == "application/warc-fields"
                    rows.append((
                        head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-concurrent-to"), head.get("warc-refers-to"),
                        _hex_digest(head.get("warc-payload-digest")), head.get("content-type"), block.decode("utf-8", "replace") if is_fields else None,
                        payload, len(payload), hashlib.sha1(payload).hexdigest()))
                yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInPandas(run, RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: response or revisit, with arrays of its requests and metadata.

    Requests and metadata are gathered by the record they are concurrent to before the join, so a
    capture never multiplies. A response that itself names a request takes that one as well.
    payload, payload_bytes and payload_digest of a revisit are those of the record it refers to,
    null where that is missing or its digest differs. found may come without its payload column.
    Records are read by several joins: hand in a written table, not a bare reader.
    """
    whole = ["payload"] if "payload" in found.columns else []
    main = found.filter(F.col("record_type").isin("response", "revisit"))
    side = found.filter(F.col("record_type").isin("request", "metadata"))
    item = F.struct("record_id", "content_type", "fields")
    attached = side.filter("concurrent_to IS NOT NULL").groupBy("concurrent_to").agg(
        F.sort_array(F.collect_list(F.when(F.col("record_type") == "request", item))).alias("requests"),
        F.sort_array(F.collect_list(F.when(F.col("record_type") == "metadata", item))).alias("metadata"))
    carried = main.filter("record_type = 'response'").select(
        F.col("record_id").alias("carrier_id"), *[F.col(c).alias("carried") for c in whole], F.col("payload_bytes").alias("carried_bytes"), F.col("block_digest").alias("carried_digest"))
    wanted = main.filter("record_type = 'revisit'").select(F.col("refers_to").alias("carrier_id")).distinct()
    carried = carried.join(wanted, "carrier_id", "left_semi").dropDuplicates(["carrier_id"])
    named = main.filter("concurrent_to IS NOT NULL").select(F.col("record_id").alias("by_id"), F.col("concurrent_to").alias("request_id"))
    named = named.join(side.filter("record_type = 'request'").select(F.col("record_id").alias("request_id"), item.alias("named")), "request_id").groupBy("by_id").agg(F.collect_set("named").alias("named"))
    none = F.array().cast("array<struct<record_id:string,content_type:string,fields:string>>")
    is_revisit = F.col("record_type") == "revisit"
    same = F.col("carried_digest") == F.coalesce(F.col("payload_digest"), F.col("carried_digest"))
    pick = lambda own, theirs: F.when(is_revisit, F.when(same, F.col(theirs))).otherwise(F.col(own))
    joined = main.join(attached.withColumnRenamed("concurrent_to", "key"), F.col("record_id") == F.col("key"), "left").drop("key")
    joined = joined.join(named, F.col("record_id") == F.col("by_id"), "left").join(carried, F.col("refers_to") == F.col("carrier_id"), "left")
    return joined.select(
        "record_id", "record_type", "target_uri", "refers_to",
        pick("payload_bytes", "carried_bytes").alias("payload_bytes"), pick("block_digest", "carried_digest").alias("payload_digest"), *[pick(c, "carried").alias(c) for c in whole],
        F.array_union(F.coalesce("requests", none), F.coalesce("named", none)).alias("requests"), F.coalesce("metadata", none).alias("metadata"))


def page_id_of(metadata: Column) -> Column:
    """The page-id field of a capture's metadata; null where there is none."""
    fields = F.array_join(F.transform(metadata, lambda m: F.coalesce(m["fields"], F.lit(""))), "\n")
    return F.nullif(F.regexp_extract(fields, r"(?m)^page-id: (-?\d+)\r?$", 1), F.lit("")).cast("long")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    write_archives(records(with_revisits(pages)), path, largest)
    captures = assemble(materialize(read_archives(spark, path).drop("payload"), "warc-records"))
    own = materialize(captures.select("record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", page_id_of(F.col("metadata")).alias("page_id")), "warc-captures")
    carrier = own.filter("record_type = 'response'").join(own.filter("refers_to IS NOT NULL").select(F.col("refers_to").alias("record_id")).distinct(), "record_id", "left_semi")
    carrier = carrier.select(F.col("record_id").alias("carrier_id"), F.col("page_id").alias("carrier_page")).dropDuplicates(["carrier_id"])
    out = own.join(carrier, F.col("refers_to") == F.col("carrier_id"), "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("carrier_page").alias("refers_to"))


OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS carrier FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < carrier THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < carrier THEN carrier END AS refers_to
FROM m
"""
