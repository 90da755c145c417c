"""Substring dedup: words in passages of LENGTH words or more that also stand in a document with a smaller doc_id are removed.

1. Seeds: of the SEED-word sequences in each window of LENGTH words the one with the smallest hash is its
   anchor (winnowing), so equal windows have equal anchors at equal places, and the windows of a text fall
   into stretches with one anchor each. About one word in fifteen is an anchor.
2. Anchors that stand in documents of one id only cannot be part of a repeat and go; documents are joined on the
   others.
3. Extension: around an anchor, both ways. First over the whole stretch at once: occurrences
   whose stretches are equal are one class, and all but those of its smallest doc_id repeat it. Where the occurrences of an
   anchor are of several classes, the smallest of each class is extended window by window, one word
   less to the left and one more to the right each time; what stands in a document with a smaller doc_id repeats.
4. Windows that repeat are joined to maximal repeats, each at least LENGTH words long.

A passage in very many documents makes no pairs: classes and windows are aggregates with partial
sums, joined back by plain equi-joins that may be split; only one document of each class is looked at closer.
Stretches are compared by 128 bits.

Defined results: words are runs of anything but ASCII white space, compared by their bytes; null, empty, blank
and short texts keep all words; documents without doc_id are neither smaller nor larger than others: they keep all
words and cost none; documents that share a doc_id do not cost each other words; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, release, table
from ledgerloom.llm.packing import slices

LENGTH, SEED = 50, 20
#: Bytes of text that are looked at together, and words of a piece of a very long text.
STRETCH_BYTES, PIECE_WORDS = 4 << 20, 1 << 22
SEEDS = "doc_id long, text_key long, start int, windows int, anchor long, stretch long"
WINDOWS = "doc_id long, text_key long, start int, anchor long, window long"
_BASE = 0x9E3779B97F4A7C15
#: Low bits of a key that hold the place of a seed.
_PLACE = 24


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """A string of words whose parts have hashes that depend on their words alone."""

    def __init__(self, words: list[bytes]):
        h = _mix(pd.util.hash_array(np.asarray(words, object), categorize=True)) if words else np.empty(0, np.uint64)
        powers = np.cumprod(np.append(np.uint64(1), np.full(len(h), _BASE, np.uint64)), dtype=np.uint64)
        self.sums = np.append(np.uint64(0), np.cumsum(h * powers[:-1], dtype=np.uint64))
        self.back = np.cumprod(np.append(np.uint64(1), np.full(len(h), pow(_BASE, -1, 2**64), np.uint64)), dtype=np.uint64)

    def hashes(self, starts: np.ndarray, lengths) -> np.ndarray:
        lengths = np.asarray(lengths, np.int64)
        return _mix((self.sums[starts + lengths] - self.sums[starts]) * self.back[starts] + lengths.astype(np.uint64))


def anchors(words: Words, starts: np.ndarray, length: int = LENGTH, seed: int = SEED) -> np.ndarray:
    """For windows at `starts` (rising) the place of the seed with the smallest hash, the leftmost of equal ones."""
    n = len(words.sums) - seed
    place = np.arange(n, dtype=np.uint64)
    key = (words.hashes(np.arange(n), seed) >> np.uint64(_PLACE) << np.uint64(_PLACE)) | place
    span, wide = 1, length - seed + 1
    while 2 * span <= wide:
        key, span = np.minimum(key[:-span], key[span:]), 2 * span
    best = np.minimum(key[starts], key[starts + wide - span])
    return (best & np.uint64((1 << _PLACE) - 1)).astype(np.int64)


def _pieces(texts: list[list[bytes]], length: int) -> Iterator[tuple[list[int], list[bytes], np.ndarray, np.ndarray]]:
    """Texts of `length` words or more: which, their words one behind the other, and for each its place there and in its own text.

    A text of more than PIECE_WORDS words comes in pieces that overlap by length - 1 words.
    """
    which, out, at, own, n = [], [], [], [], 0
    for k, text in enumerate(texts):
        for low in range(0, len(text) - length + 1, PIECE_WORDS):
            part = text[low : low + PIECE_WORDS + length - 1]
            if n and n + len(part) > PIECE_WORDS:
                yield which, out, np.asarray(at), np.asarray(own)
                which, out, at, own, n = [], [], [], [], 0
            which.append(k)
            at.append(n)
            own.append(low)
            out += part
            n += len(part)
    if n:
        yield which, out, np.asarray(at), np.asarray(own)


def stretches(texts: list[list[bytes]], length: int = LENGTH, seed: int = SEED) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, start, windows, anchor, stretch) of the runs of windows with one anchor."""
    for which, words, at, own in _pieces(texts, length):
        string, sizes = Words(words), np.diff(np.append(at, len(words)))
        windows = sizes - length + 1
        piece = np.repeat(np.arange(len(at)), windows)
        starts = np.arange(windows.sum()) + np.repeat(at - np.append(0, np.cumsum(windows)[:-1]), windows)
        place = anchors(string, starts, length, seed)
        first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (piece[1:] != piece[:-1])))
        count = np.diff(np.append(first, len(starts)))
        s, p, t = starts[first], place[first], piece[first]
        whole = _mix(string.hashes(s, count + length - 1) + (p - s).astype(np.uint64))
        yield np.asarray(which)[t], s - at[t] + own[t], count, string.hashes(p, seed).view(np.int64), whole.view(np.int64)


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text (binary) of documents with an id and a text."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))


def _parts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in parts of about STRETCH_BYTES of text, one row at least."""
    for batch in batches:
        numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(column)], ["row", column])
        for rows, _ in slices(numbered, STRETCH_BYTES):
            yield batch.slice(rows[0].as_py(), len(rows))


def _structs(lists: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each struct in lists of structs, and the fields."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), [f.to_numpy(zero_copy_only=False).astype(np.int64) for f in lists.flatten().flatten()]


def seeds(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, text_key, start, windows, anchor, stretch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            split = [(t or b"").split() for t in part.column("text").to_pylist()]
            for text, start, count, anchor, stretch in stretches(split, length, seed):
                row = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(row), part.column("text_key").take(row), pa.array(start, pa.int32()), pa.array(count, pa.int32()), pa.array(anchor), pa.array(stretch)],
                    ["doc_id", "text_key", "start", "windows", "anchor", "stretch"])

    return _identified(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, SEEDS)


def _windows(docs: DataFrame, lists: DataFrame, length: int) -> DataFrame:
    """Every window of the stretches in lists (doc_id, text_key, open: start, windows, anchor), with its hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            split = [t.split() for t in part.column("text").to_pylist()]
            words, before = Words([w for text in split for w in text]), np.cumsum([0, *map(len, split)])
            row, (start, count, anchor) = _structs(part.column("open"))
            at = np.arange(count.sum()) + np.repeat(start - np.append(0, np.cumsum(count)[:-1]), count)
            row = np.repeat(row, count)
            window, rows = words.hashes(before[row] + at, length).view(np.int64), pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(rows), part.column("text_key").take(rows), pa.array(at, pa.int32()), pa.array(np.repeat(anchor, count)), pa.array(window)],
                ["doc_id", "text_key", "start", "anchor", "window"])

    asked = _identified(docs).join(lists, ["doc_id", "text_key"])
    return asked.select("doc_id", "text_key", "text", "open").mapInArrow(run, WINDOWS)


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, text_key, spans (start of the first window, windows): what also starts in a document with a smaller doc_id."""
    # What groups give is written before it is joined, so that the joins stand alone and their hot keys can be split.
    found = materialize(seeds(docs, length, seed), "seeds")
    of_anchor = found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.min("stretch") < F.max("stretch")).alias("several"))
    of_anchor = materialize(of_anchor.filter("lo < hi").select("anchor", "lo", "several"), "shared-anchors")
    shared = materialize(found.join(of_anchor, "anchor"), "shared-seeds")
    release(found, of_anchor)
    # One class: all but the smallest document's occurrences repeat it.
    alike = shared.filter("NOT several").filter("doc_id > lo").select("doc_id", "text_key", "start", "windows")
    several = shared.filter("several").drop("lo")
    classes = materialize(several.groupBy("anchor", "stretch").agg(F.min("doc_id").alias("lo")), "classes")
    members = materialize(several.join(classes, ["anchor", "stretch"]), "anchor-classes")
    repeated = members.filter("doc_id > lo").select("doc_id", "text_key", "start", "windows")
    closer = members.filter("doc_id = lo").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "windows", "anchor")).alias("open"))
    windows = materialize(_windows(docs, closer, length), "windows")
    of_window = materialize(windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor", "window", "lo"), "shared-windows")
    single = windows.join(of_window, ["anchor", "window"]).filter("doc_id > lo").select("doc_id", "text_key", "start", F.lit(1).alias("windows"))
    spans = alike.unionByName(repeated).unionByName(single).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    out = materialize(spans, "repeats")
    release(shared, classes, members, windows, of_window)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, repeats (start, words: maximal, in order), kept (the other words joined by one space)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            split = [(t or b"").split() for t in part.column("text").to_pylist()]
            # One place more in each text, at which every span has ended.
            before = np.cumsum([0, *(len(w) + 1 for w in split)])
            row, (start, windows) = _structs(part.column("spans"))
            change = np.zeros(before[-1] + 1, np.int64)
            np.add.at(change, before[row] + start, 1)
            np.add.at(change, before[row] + start + windows - 1 + length, -1)
            covered = np.cumsum(change) > 0
            edges = np.flatnonzero(covered[1:] != covered[:-1]) + 1
            if covered[0]:
                edges = np.append(0, edges)
            first, end = edges[::2], edges[1::2]
            owner = np.searchsorted(before, first, "right") - 1
            for k in np.unique(owner):
                split[k] = [w for w, gone in zip(split[k], covered[before[k] :], strict=False) if not gone]
            found = pa.StructArray.from_arrays([pa.array(first - before[owner]), pa.array(end - first)], ["start", "words"])
            offsets = np.searchsorted(owner, np.arange(len(split) + 1))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(before) - 1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found), pa.array([b" ".join(w).decode() for w in split], pa.string())],
                ["doc_id", "n_words", "repeats", "kept"])

    spans = repeats(docs, length, seed)
    joined = _identified(docs).join(spans, ["doc_id", "text_key"], "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, repeats array<struct<start:long,words:long>>, kept string")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda n, r: n + r["words"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
