"""Periodic runs of words: stretches that repeat a block of words, found exactly and collapsed to one period.

1. Harmonic grid: a run of period q that holds four periods holds four multiples of q next to each
   other, all at the same word. So for each q only every q-th word is looked at, and places where
   four in a row agree are candidates; over all periods that is a harmonic sum of words.
2. Recompression: the texts with candidates become one string of numbered words, a separator of its own
   between any two, and a grammar over it: by turns, equal neighbours become one block with a length, and
   neighbours that are a left and a right symbol become a pair. What is decided depends on the
   symbols alone, so equal stretches are parsed alike but for their ends.
3. Extension: how far two places agree, forwards and backwards, is read off the grammar: up while
   both places are symbol borders, one comparison or two a level, then down to the first difference.
   All candidates of an octave of periods go at once. A run of period q is a candidate with what it
   agrees with q words further on; runs found by multiples of their period are kept at the smallest.

Everything happens inside tasks, on stretches of bounded bytes (a text longer than that is one
stretch); there is no shuffle.

Defined results: words are runs of anything but ASCII white space and are compared by their bytes;
null, empty and blank texts have no words and no runs, and collapse to the empty text; rows that
repeat, or share a doc_id, are treated each for itself; a null doc_id stays null and gets no planted
period; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import let
from ledgerloom.llm.common import table, words
from ledgerloom.llm.packing import slices

#: A run is at least so many words long, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text that are looked at together.
STRETCH_BYTES = 4 << 20
#: The grammar is built until so few symbols are left.
TOP_SYMBOLS = 64
RUNS = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Level:
    """A string of the grammar, and where its borders are in the next one.

    symbols ends with a -1 behind the last symbol, which is also what stands before the first.
    down: for each border of the next level its place here; up: for each place here the border of
    the next level, or -1; owner: for block levels, the symbol of the next level at each place.
    """

    def __init__(self, symbols: np.ndarray):
        self.symbols = np.append(symbols, -1)
        self.down = self.up = self.owner = None

    def close(self, starts: np.ndarray, blocks: bool) -> None:
        n = len(self.symbols) - 1
        self.down = np.append(starts, n)
        self.up = np.full(n + 1, -1, np.int64)
        self.up[self.down] = np.arange(len(self.down))
        if blocks:
            self.owner = np.append(np.repeat(np.arange(len(starts)), np.diff(self.down)), 0)

    def agree(self, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        """How many symbols to go on from places x and y with equal symbols; 0 where the next ones differ."""
        before = -1 if step < 0 else 0
        same = self.symbols[x + before] == self.symbols[y + before]
        if self.owner is None:
            return same.astype(np.int64)
        # Inside blocks, as far as the shorter rest goes.
        ends = [abs(self.down[self.owner[at + before] + (step > 0)] - at) for at in (x, y)]
        return np.where(same, np.minimum(*ends), 0)


def _named(keys: np.ndarray, first: int) -> np.ndarray:
    """Numbers from `first` on, equal for equal keys."""
    return np.unique(keys, return_inverse=True)[1] + first


def _side(symbols: np.ndarray, turn: int) -> np.ndarray:
    """Left or right, by a hash of the symbol that changes with each turn."""
    x = (symbols.astype(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(63)).astype(bool)


def grammar(symbols: np.ndarray) -> list[Level]:
    """The levels of a recompression of `symbols` (numbers from 0 on), the string itself first."""
    symbols = symbols.astype(np.int64)
    fresh = int(symbols.max(initial=0)) + 1
    levels, turn = [Level(symbols)], 0
    while len(symbols) > TOP_SYMBOLS:
        starts = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        if len(starts) < len(symbols):
            levels[-1].close(starts, True)
            length = np.diff(np.append(starts, len(symbols)))
            symbols, many = symbols[starts].copy(), length > 1
            symbols[many] = _named(symbols[many] * (int(length.max()) + 1) + length[many], fresh)
            fresh = int(symbols.max()) + 1
            levels.append(Level(symbols))
        side = _side(symbols, turn)
        turn += 1
        second = np.append(False, ~side[:-1] & side[1:])
        starts = np.flatnonzero(~second)
        first = np.flatnonzero(np.append(second[1:], False))
        if not first.size:
            continue
        levels[-1].close(starts, False)
        names = symbols.copy()
        names[first] = _named(symbols[first] * fresh + symbols[first + 1], fresh)
        symbols = names[starts]
        fresh = max(fresh, int(symbols.max()) + 1)
        levels.append(Level(symbols))
    return levels


def extension(levels: list[Level], i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from places i and j on (step 1), or before them (step -1); i < j."""
    x, y = i.copy(), j.copy()
    open_ = np.arange(len(i))
    stopped = []
    for level in levels:
        low = open_ if level.up is None else open_[(level.up[x[open_]] < 0) | (level.up[y[open_]] < 0)]
        over = []
        while low.size:
            n = level.agree(x[low], y[low], step)
            x[low] += step * n
            y[low] += step * n
            over.append(low[n == 0])
            low = low[n > 0]
            if level.up is not None:
                low = low[(level.up[x[low]] < 0) | (level.up[y[low]] < 0)]
        stopped.append(np.concatenate(over) if over else open_[:0])
        open_ = np.setdiff1d(open_, stopped[-1], assume_unique=True)
        if level.up is not None:
            x[open_], y[open_] = level.up[x[open_]], level.up[y[open_]]
    going = stopped[-1]
    for level, here in zip(levels[-2::-1], stopped[-2::-1], strict=True):
        x[going], y[going] = level.down[x[going]], level.down[y[going]]
        low = going
        while low.size:
            n = level.agree(x[low], y[low], step)
            x[low] += step * n
            y[low] += step * n
            low = low[n > 0]
        going = np.concatenate([going, here])
    return np.abs(x - i)


def grid_candidates(symbols: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): multiples of each period up to `most` at which four in a row are equal."""
    places, periods = [], []
    for q in range(1, most + 1):
        at = symbols[::q]
        same = at[1:] == at[:-1]
        found = np.flatnonzero(same[2:] & same[1:-1] & same[:-2])
        if found.size:
            places.append(found * q)
            periods.append(np.full(found.size, q))
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def _joined(texts: list[np.ndarray], separator: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one string with separators of their own, numbered from `separator` on, behind each; where each starts."""
    parts = [p for k, t in enumerate(texts) for p in (t, [separator + k])]
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    return np.concatenate(parts), starts


def find_runs(texts: list[np.ndarray], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[np.ndarray]:
    """For each text (numbers of words) its runs as rows (start, length, period), by start, then period. periods: 4 or more."""
    if periods < 4:
        raise ValueError("the grid finds runs of four periods or more")
    none = np.empty((0, 3), np.int64)
    out, beyond = [none] * len(texts), 1 + max((int(t.max()) for t in texts if t.size), default=0)
    sizes = np.asarray([len(t) for t in texts])
    places, rates = [], []
    for bits in np.unique([int(n).bit_length() for n in sizes[sizes >= least]]):
        # Texts of one order of size are looked at together: none is searched for periods it cannot hold.
        group = np.flatnonzero((sizes >> (int(bits) - 1)) == 1)
        whole, starts = _joined([texts[k] for k in group], beyond)
        at, q = grid_candidates(whole, int(sizes[group].max()) // periods)
        # Four in a row may lie in different texts.
        owner = np.searchsorted(starts, at, "right") - 1
        inside = owner == np.searchsorted(starts, at + 3 * q, "right") - 1
        owner, at, q = owner[inside], at[inside], q[inside]
        places.append((group[owner], at - starts[owner]))
        rates.append(q)
    if not places or not sum(map(len, rates)):
        return out
    text, at, q = np.concatenate([t for t, _ in places]), np.concatenate([a for _, a in places]), np.concatenate(rates)
    hot, place_of = np.unique(text, return_inverse=True)
    whole, starts = _joined([texts[k] for k in hot], beyond)
    levels, i = grammar(np.unique(whole, return_inverse=True)[1]), starts[place_of] + at
    known = np.empty((0, 3), np.int64)
    for octave in np.unique(np.log2(q).astype(int)):
        # Multiples of a period come in later octaves, and what lies in a run of the period is not asked again.
        some = np.flatnonzero((q >> octave) == 1)
        if len(known):
            last = np.searchsorted(known[:, 0], i[some], "right") - 1
            s, length, period = known[last].T
            some = some[(last < 0) | (i[some] + 3 * q[some] >= s + length) | (q[some] % period > 0)]
        a, b = i[some], i[some] + q[some]
        back, ahead = extension(levels, a, b, -1), extension(levels, a, b, 1)
        length = q[some] + back + ahead
        good = length >= np.maximum(least, periods * q[some])
        known = np.unique(np.concatenate([known, np.stack([a - back, length, q[some]], axis=1)[good]]), axis=0)
    owner = np.searchsorted(starts, known[:, 0], "right") - 1
    rows = np.column_stack([hot[owner], known[:, 0] - starts[owner], known[:, 1:]])
    if not len(rows):
        return out
    # Of equal stretches the first has the smallest period.
    rows = rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cuts = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
    for low, high in zip(cuts, [*cuts[1:], len(rows)], strict=True):
        out[rows[low, 0]] = rows[low:high, 1:]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words stays: one that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def collapse_runs(docs: DataFrame, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, runs (start, length, period, by start, then period), collapsed (the words that stay, joined by one space)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in slices(batch, STRETCH_BYTES):
                split = [(t or b"").split() for t in texts.to_pylist()]
                sizes = np.asarray([len(w) for w in split])
                codes = pd.factorize(np.asarray([w for ws in split for w in ws] or [b""], object))[0]
                found = find_runs(np.split(codes[: sizes.sum()], np.cumsum(sizes)[:-1]), least, periods)
                for k in (k for k, r in enumerate(found) if len(r)):
                    split[k] = [w for w, stays in zip(split[k], kept_words(len(split[k]), found[k]), strict=True) if stays]
                rows = np.concatenate(found)
                offsets = np.cumsum([0, *map(len, found)])
                structs = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], ["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs).cast(ARROW_RUNS)
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), runs, pa.array([b" ".join(w).decode() for w in split], pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, RUNS)


def with_planted_period(text: Column, doc_id: Column) -> Column:
    """text, for a tenth of the ids with a periodic tail: by h = crc32 of the decimal id, from word a on, p words repeat."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(w, lambda _, i: F.get(w, place(i))), " ")

    planted = let(words(text), lambda w: F.when(F.size(w) > 0, tail(w)))
    return F.when((h % 10 == 0) & text.isNotNull(), planted).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """Runs and collapsed texts as counts, the run of most periods, and hashes."""
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    # Quotients of whole numbers this small differ as doubles where they differ.
    rank = lambda r: F.struct((-(r["length"] / r["period"])).alias("k"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))
    best = found.withColumn("best", F.array_min(F.transform("runs", rank)))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest(collapse_runs(docs.select("doc_id", with_planted_period(F.col("text"), F.col("doc_id")).alias("text"))))
