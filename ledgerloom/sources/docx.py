"""DOCX files: raw references from the ZIP in one pass, order, context and duplicates in Spark.

Only raw_references touches file bytes; what follows are windows over its rows.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerloom.functions.dates import SPANISH_MONTHS, _month, _real_date, _year
from ledgerloom.functions.text import let, strip

MAX_DOCX_BYTES, MAX_IMAGE_BYTES, MIN_IMAGE_BYTES = 50 * 1024 * 1024, 5 * 1024 * 1024, 32
# XML names of the format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RELATIONS = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
IDS = ("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}embed", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}link")
REFERENCES = "path string, par int, run int, text string, target string, content binary, content_hash string, error string"


def scan_docx(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content, sha256 of the DOCX files under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "content", F.sha2("content", 256).alias("document_hash"))


def _rows_of(path: str, data: bytes) -> list[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            body = ElementTree.fromstring(z.read("word/document.xml"))
            links = ElementTree.fromstring(z.read("word/_rels/document.xml.rels")) if "word/_rels/document.xml.rels" in names else []
            targets = {}
            for link in links.iter(RELATIONS) if links else []:
                target = link.get("Target", "")
                targets[link.get("Id")] = target.lstrip("/") if target.startswith("/") else str(PurePosixPath("word") / target).replace("word/../", "")
            rows = []
            for par, p in enumerate(body.iter(f"{W}p"), 1):
                runs = p.findall(f"{W}r")
                for run, r in enumerate(runs, 1):
                    text = "".join(t.text or "" for t in r.iter(f"{W}t"))
                    found = [targets.get(e.get(i)) for e in r.iter() for i in IDS if e.get(i)]
                    found = [t for t in found if t in names]
                    if not found:
                        rows.append((path, par, run, text, None, None, None, None))
                    for k, target in enumerate(found):
                        content = z.read(target)
                        rows.append((path, par, run, text if k == 0 else "", target, content, hashlib.sha256(content).hexdigest(), None))
            return rows
    except (zipfile.BadZipFile, KeyError) as error:
        return [(path, 0, 0, None, None, None, None, "invalid_docx" if isinstance(error, zipfile.BadZipFile) else "docx_conversion_error")]
    except ElementTree.ParseError:
        return [(path, 0, 0, None, None, None, None, "docx_conversion_error")]


def stretches(documents: Iterable[list[tuple]], most_rows: int = 2048, most_bytes: int = 8 * 1024 * 1024) -> Iterator[list[tuple]]:
    """Rows of many documents together, in their order: a frame of its own for each small document would cost more than reading it. Ends behind the document that reaches a bound."""
    held, size = [], 0
    for rows in documents:
        held += rows
        size += sum(len(r[5] or b"") for r in rows)
        if len(held) >= most_rows or size >= most_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def raw_references(files: DataFrame) -> DataFrame:
    """A row per run, or per image reference in it; a file that cannot be read is one row with an error."""
    names = [c.split()[0] for c in REFERENCES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in stretches(_rows_of(path, bytes(content)) for path, content in zip(batch["path"], batch["content"], strict=True)):
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, REFERENCES)


def validate_docx(files: DataFrame, references: DataFrame) -> DataFrame:
    """path and the first reason to reject the file, '' where it is good."""
    per_file = references.groupBy("path").agg(F.max("error").alias("error"), F.count("target").alias("images"), F.max(F.length("content")).alias("largest"))
    checked = files.select("path", "length", F.substring("content", 1, 4).alias("head")).join(per_file, "path", "left")
    return checked.select("path", F.when(F.col("length") > MAX_DOCX_BYTES, "file_too_large").when(~F.lower("path").endswith(".docx"), "invalid_extension")
                          .when(F.col("head") != F.unhex(F.lit("504B0304")), "invalid_docx").when(F.col("error").isNotNull(), F.col("error"))
                          .when(F.col("largest") > MAX_IMAGE_BYTES, "docx_unsupported_content").when(F.coalesce("images", F.lit(0)) == 0, "docx_no_images").otherwise("").alias("reason"))


def _text_of(content: bytes) -> str:
    """Paragraphs that hold text, a line each, trimmed; a file that cannot be read has the empty text."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if "word/document.xml" not in z.namelist():
                return ""
            body = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, ElementTree.ParseError, EOFError, NotImplementedError, RuntimeError, zlib.error):
        return ""
    lines = ("".join(t.text or "" for t in p.iter(f"{W}t")) for p in body.iter(f"{W}p"))
    return "\n".join(line for line in lines if line).strip()


@F.pandas_udf(StringType())
def text_of(content: pd.Series) -> pd.Series:
    return content.map(lambda c: _text_of(bytes(c or b"")))


def docx_text(source: DataFrame) -> DataFrame:
    """path and text of each file, its paragraphs that hold text a line each; a damaged file has the empty text.

    source: files (path, content), where text boxes and links count with their paragraph, or their raw references, which know runs alone.
    """
    if "par" not in source.columns:
        return source.select("path", text_of("content").alias("text"))
    runs = F.transform(F.sort_array(F.collect_list(F.struct("run", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    lines = source.groupBy("path", "par").agg(F.array_join(runs, "").alias("line"))
    told = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("par", "line"))), lambda x: x["line"]), lambda line: line != "")
    return lines.groupBy("path").agg(strip(F.array_join(told, "\n")).alias("text"))


def _join_runs(texts: Column) -> Column:
    """Run texts joined; a digit behind a number of two digits or more gets a space before it."""
    def step(done: Column, text: Column) -> Column:
        return F.concat(done, F.when(done.rlike(r"\d\d$") & text.rlike(r"^\d"), " ").otherwise(""), text)
    return F.aggregate(texts, F.lit(""), step)


NAMED = r"(?iu)\b(\d{1,2})\s*(?:de\s+)?(" + "|".join(SPANISH_MONTHS) + r")\s*(?:de\s+)?(20\d{2}|\d{2})\b"
DIGITS = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\b"


def last_date(text: Column) -> Column:
    """struct of place, text and DD/MM/YYYY of the last date of either kind in a text; null without one."""
    def candidate(pattern: str, named: bool) -> Column:
        def read(t: Column) -> Column:
            part = lambda i: F.regexp_extract(t, pattern, i)
            month = _month(F.lower(part(2)), SPANISH_MONTHS) if named else part(2).try_cast("int")
            return F.date_format(_real_date(_year(part(3)), F.coalesce(month, F.lit(0)), F.coalesce(part(1).try_cast("int"), F.lit(0))), "dd/MM/yyyy")

        last = F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))) - 1)
        # The last match ends where the rest behind it begins.
        rest = F.length(F.get(F.split(text, pattern, -1), F.size(F.split(text, pattern, -1)) - 1))
        return let(last, lambda t: F.when(t.isNotNull() & read(t).isNotNull(), F.struct((-rest).alias("place"), t.alias("date_text"), read(t).alias("date"))))
    return F.array_max(F.array_compact(F.array(candidate(NAMED, True), candidate(DIGITS, False))))


def with_context(references: DataFrame) -> DataFrame:
    """references with prefix (paragraph text up to the run) and the date context carried forward through the document."""
    upto = Window.partitionBy("path", "par").orderBy("run", "seq").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("path").orderBy("par", "run", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = references.filter("error IS NULL").withColumn("seq", F.row_number().over(Window.partitionBy("path", "par", "run").orderBy(F.desc("text"), "target")))
    rows = rows.withColumn("prefix", _join_runs(F.collect_list(F.coalesce("text", F.lit(""))).over(upto)))
    return rows.withColumn("context", F.last(last_date(F.col("prefix")), ignorenulls=True).over(whole))


def kept_images(references: DataFrame) -> DataFrame:
    """Images in document order with sequence_index and date context, and the duplicates that were skipped with a reason.

    A reference is a duplicate if its target was seen before in the file, or if its bytes equal
    those of the reference just before it.
    """
    by_order = Window.partitionBy("path").orderBy("par", "run", "seq")
    images = with_context(references).filter("target IS NOT NULL").withColumn("ref", F.row_number().over(by_order))
    again = F.row_number().over(Window.partitionBy("path", "target").orderBy("ref")) > 1
    adjacent = F.coalesce(F.lag("content_hash").over(Window.partitionBy("path").orderBy("ref")) == F.col("content_hash"), F.lit(False))
    images = images.withColumn("skip_reason", F.when(again, "same_package_target").when(adjacent, "adjacent_same_binary_content"))
    n = F.count(F.when(F.col("skip_reason").isNull(), 1)).over(Window.partitionBy("path").orderBy("ref").rowsBetween(Window.unboundedPreceding, 0))
    return images.select("path", "ref", F.when(F.col("skip_reason").isNull(), n).alias("sequence_index"), "target", "content", "content_hash", "skip_reason",
                         F.coalesce("context.date_text", F.lit("")).alias("context_date_text"), F.coalesce("context.date", F.lit("")).alias("context_date"), F.trim("prefix").alias("heading"))


def image_kind(content: Column) -> Column:
    """Kind of picture by its first bytes, null for others."""
    def starts(h: str) -> Column:
        return F.substring(content, 1, len(h) // 2) == F.unhex(F.lit(h))
    webp = starts("52494646") & (F.substring(content, 9, 4) == F.unhex(F.lit("57454250")))
    return (F.when(starts("89504E470D0A1A0A"), "png").when(starts("FFD8FF"), "jpeg").when(starts("474946383761") | starts("474946383961"), "gif").when(starts("424D"), "bmp").when(webp, "webp"))


def validate_image(content: Column) -> Column:
    return (F.when(F.octet_length(content) < MIN_IMAGE_BYTES, "too_small").when(F.octet_length(content) > MAX_IMAGE_BYTES, "too_large").when(image_kind(content).isNull(), "unknown_format").otherwise(""))
