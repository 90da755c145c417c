"""Packing documents into sequences of several lengths with little padding.

Each document becomes token ids and one end id. Documents are routed to context-size tiers by
length; windows of a tier are opened by its own documents, longest first, and the gap that is left
is filled with whole pieces of shorter tiers (best fit), at last with a piece cut to size. Windows
are then dealt to step groups so that each group has about equally many tokens.

Everything happens inside the scan's own partitions, a bounded pool of tokens at a time, so there
is no shuffle and no group that grows. What a partition has left at its end goes into tiers down
to the smallest; only its very last sequence is padded.

Defined results: null or empty text is one piece with the end id alone; rows with equal ids are
packed once each; very long texts are cut at the longest tier; an empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import table

TIERS = (2048, 1024, 512, 256)
END_ID = 1
#: Tokens that a task gathers before it packs them, runs whose ids a worker remembers, text bytes encoded at once, tokens of a step group.
POOL_TOKENS = 1 << 20
CACHE_RUNS = 250_000
SLICE_BYTES = 1 << 21
STEP_TOKENS = 1 << 17
SENTINEL = "\U0001f60d"
#: A word of Latin letters (composed, with a lower case of their own) and the ASCII marks behind them.
PLAIN = "^(?P<run>[A-Za-z\xaa\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]*)(?P<marks>[!-&(-/:-@\\[-`{-~]*)$"
PIECES = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _visible_bytes() -> dict[int, str]:
    """The character by which byte-level models write each byte: itself where it shows, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def spread(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of flat numbered `at`, joined, and their lengths."""
    n = lengths[at]
    ends = np.cumsum(n)
    total = int(ends[-1]) if n.size else 0
    kind = np.int32 if max(total, flat.size) < 1 << 31 else np.int64
    where = np.repeat((starts[at] - ends + n).astype(kind), n)
    where += np.arange(total, dtype=kind)
    return flat[where], n


class WordIds:
    """Token ids of texts by a tokenizer that drops white space: each distinct word of a batch is looked at once.

    Arrow splits a batch at ASCII white space and numbers its distinct words. A word of Latin
    letters with marks behind them is one run of letters and one of marks to the tokenizer; the
    lower-case letters go to the tokenizer's model alone. All other words pass the whole tokenizer,
    many to a call, with a one-token sentinel between them; words that hold the sentinel are
    encoded alone. The ids of runs are remembered from batch to batch, up to `most` of them.
    """

    def __init__(self, path: str, most: int = CACHE_RUNS) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model, self.bytes = self.tokenizer.model, _visible_bytes()
        (self.mark,) = self._encode([SENTINEL])[0]
        self.clear()

    def clear(self) -> None:
        """Forget all runs. The empty one is number 0."""
        self.at: dict[str, int] = {"": 0}
        self.flat, self.lengths = array("I"), array("q", [0])

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, runs: list[str], ids: Iterable[Sequence[int]]) -> None:
        for run, found in zip(runs, ids, strict=True):
            self.at[run] = len(self.lengths)
            self.lengths.append(len(found))
            self.flat.extend(found)

    def _of_letters(self, run: str) -> list[int]:
        shown = run if run.isascii() else run.encode().decode("latin-1").translate(self.bytes)
        return [token.id for token in self.model.tokenize(shown)]

    def _of_words(self, words: list[str]) -> Iterator[list[int]]:
        """Ids by the whole tokenizer."""
        for low in range(0, len(words), 500):
            group = words[low : low + 500]
            got = np.asarray(self._encode([f" {SENTINEL} ".join(group)])[0], np.uint32)
            cuts = np.flatnonzero(got == self.mark)
            yield from (part.tolist() for part in np.split(got, cuts)[:1])
            yield from (part[1:].tolist() for part in np.split(got, cuts)[1:])

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """Numbers of the letters and of the marks of each word, (n, 2); other words have their number in the first place."""
        split = pc.extract_regex(words, PLAIN)
        plain = pc.is_valid(split)
        run, marks = (pc.fill_null(pc.struct_field(split, i), "") for i in (0, 1))
        first, marks = (pc.dictionary_encode(x) for x in (pc.if_else(plain, pc.utf8_lower(run), words), marks))
        known, theirs = (x.dictionary.to_numpy(zero_copy_only=False).tolist() for x in (first, marks))
        new = {w for part in (known, theirs) for w in part if w not in self.at}
        if len(self.at) + len(new) > self.most:
            self.clear()
            new = {w for part in (known, theirs) for w in part if w}
        odd = set(pc.unique(pc.filter(words, pc.invert(plain))).to_numpy(zero_copy_only=False).tolist())
        letters = [w for w in new if w not in odd and w[0].isalpha()]
        self._learn(letters, map(self._of_letters, letters))
        rest = list(new.difference(letters))
        for group, encode in (([w for w in rest if SENTINEL not in w], self._of_words), ([w for w in rest if SENTINEL in w], self._encode)):
            self._learn(group, encode(group))
        each = [np.fromiter(map(self.at.__getitem__, part), np.int64, len(part)) for part in (known, theirs)]
        return np.stack([x[c.indices.to_numpy()] for x, c in zip(each, (first, marks), strict=True)], axis=1)

    def encode(self, texts: pa.Array, end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and how many each has; null is empty. end: an id behind each text."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        bounds = split.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(split.flatten())
        numbers = self._numbers(coded.dictionary).ravel()
        lengths = np.array(self.lengths, np.int64)
        flat, n = spread(np.array(self.flat, np.uint32), np.cumsum(lengths) - lengths, lengths, numbers)
        per_word = n.reshape(-1, 2).sum(axis=1)
        ids, n = spread(flat, np.cumsum(per_word) - per_word, per_word, coded.indices.to_numpy())
        ends = np.concatenate([[0], np.cumsum(n)])[bounds - bounds[0]]
        if end is not None:
            ids = np.insert(ids, ends[1:], np.uint32(end))
        return ids, np.diff(ends) + (end is not None)

    def ids(self, text: str, end: int | None = END_ID) -> np.ndarray:
        return self.encode(pa.array([text], pa.string()), end)[0]


@cache
def worker_ids(path: str) -> WordIds:
    """The memory of this Python worker, shared by the tasks that run in it one after the other."""
    return WordIds(path)


def tier_of(length: int, tiers: tuple[int, ...] = TIERS) -> int:
    """The smallest tier that holds so many tokens."""
    return min(t for t in tiers if t >= length)


def pack_pool(pieces: list[tuple], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list[tuple[int, list[tuple]]], list[tuple]]:
    """Windows (tier, pieces) and what is left over. A piece is (length, document, start).

    Without `last`, the pieces of a window that could not be filled are left over; with it they
    fill shorter tiers, and the rest makes one short window.
    """
    longest, windows, items = max(tiers), [], []
    for length, doc, start in pieces:
        whole = length // longest * longest
        windows += [(longest, [(longest, doc, start + at)]) for at in range(0, whole, longest)]
        if length > whole:
            items.append((length - whole, doc, start + whole))
    items.sort()
    left: list[tuple] = []
    while items:
        first = items.pop()
        tier = tier_of(first[0], tiers)
        window, gap = [first], tier - first[0]
        while gap and items:
            at = bisect.bisect_right(items, gap, key=lambda x: x[0]) - 1
            if at >= 0:
                piece = items.pop(at)
            else:
                length, doc, start = items.pop(0)
                piece = (gap, doc, start)
                bisect.insort(items, (length - gap, doc, start + gap))
            window.append(piece)
            gap -= piece[0]
        if gap:
            left = window
        else:
            windows.append((tier, window))
    if not last:
        return windows, left
    for tier in sorted(tiers, reverse=True):
        while sum(x[0] for x in left) >= tier:
            window, gap, rest = [], tier, []
            for length, doc, start in left:
                take = min(gap, length)
                if take:
                    window.append((take, doc, start))
                if length > take:
                    rest.append((length - take, doc, start + take))
                gap -= take
            windows.append((tier, window))
            left = rest
    if left:
        windows.append((longest, left))
    return windows, []


def step_groups(windows: list[tuple[int, list[tuple]]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each window: long ones first, each to and fro over the groups, so that groups have about equally many tokens."""
    n = max(1, round(sum(x[0] for _, w in windows for x in w) / step_tokens))
    order = sorted(range(len(windows)), key=lambda i: -sum(x[0] for x in windows[i][1]))
    groups = [0] * len(windows)
    for place, i in enumerate(order):
        lap, at = divmod(place, n)
        groups[i] = at if lap % 2 == 0 else n - 1 - at
    return groups


def pack(docs: DataFrame, path: str | None = None, tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL_TOKENS, with_ids: bool = True) -> DataFrame:
    """Pieces of the documents, with their ids (unsigned, 32 bits, little-endian), in sequences.

    docs: doc_id, text. path: of a tokenizer whose words are apart at white space. A sequence's
    tier is the length it is padded to. with_ids: whether ids are returned, or null and their CRC-32 alone.
    """
    found = path or vocabulary_path()
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = worker_ids(found), TaskContext.get().partitionId() << 40
        numbers, groups = count(part), part
        held: dict[int, tuple] = {}
        waiting: list[tuple] = []
        pooled = serial = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal waiting, pooled, groups
            windows, waiting = pack_pool(waiting, tiers, last)
            dealt, rows = step_groups(windows), []
            for (tier, window), group in zip(windows, dealt, strict=True):
                sequence, offset = next(numbers), 0
                for length, doc, start in window:
                    doc_id, ids = held[doc]
                    piece = ids[start : start + length].tobytes()
                    rows.append((doc_id, start, length, piece if with_ids else None, zlib.crc32(piece), ids.size, sequence, offset, tier, groups + group))
                    offset += length
            groups += max(dealt, default=-1) + 1
            kept = {doc for _, doc, _ in waiting}
            for doc in [d for d in held if d not in kept]:
                del held[doc]
            pooled = sum(x[0] for x in waiting)
            pa.default_memory_pool().release_unused()
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            types = [pa.binary() if n == "ids" else pa.int32() if n == "tier" else pa.int64() for n in names]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for doc_ids, texts in slices(batch):
                ids, sizes = words.encode(texts)
                parts = np.split(ids, np.cumsum(sizes)[:-1])
                for doc_id, own in zip(doc_ids.to_pylist(), parts, strict=True):
                    held[serial] = (doc_id, own)
                    waiting.append((own.size, serial, 0))
                    serial, pooled = serial + 1, pooled + own.size
                    if pooled >= pool_tokens:
                        yield flush(False)
        yield flush(True)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The doc_id and text columns in stretches of about so many bytes of text, one row at least."""
    texts = batch.column(1)
    before = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:], strict=False):
        if high > low:
            yield batch.column(0).slice(low, high - low), texts.slice(low, high - low)


def op8_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), with_ids=False))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")
