"""Toxicity by subword bags: character n-gram vectors, averaged, under a linear softmax, trained together in numpy.

Words are lower-case runs between white space without the marks around them. A word is the bag of
its character n-grams, from MIN_N to MAX_N long, with < and > at its ends, and of itself; each is a
row of the embedding table found by hash, so a misspelling that was never seen still shares most
vectors with the word it comes from. Every run of SPAN words is averaged; the softmax of the run
that looks worst is the text's score, so a few words in a long text count as they would alone.

Training takes a bounded sample of labelled rows on the driver: MAX_TRAIN a label, of those with one
to TRAIN_CHARS characters (longer ones are not learned from, but scored whole as all are). The model
that goes out to tasks is one number a bucket, BUCKETS in all.

Settings were chosen by cross-validation inside the rows that may be learned from (toxicity_settings.py).

Defined results: null and blank texts get the score of no evidence; without labelled rows of both
kinds every score is PRIOR; equal texts get equal scores; other columns stay, and where one has the
name of the new column, that gets underscores in front.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import fresh, table

MIN_N, MAX_N, SPAN, BUCKETS, WIDTH = 3, 6, 8, 1 << 18, 8
MAX_TRAIN, TRAIN_CHARS, STEPS, EPOCHS, RATE, BATCH, DECAY, MAX_BALANCE = 3000, 20_000, 400, (3, 80), 0.3, 64, 3e-3, 4.0
#: A bucket learns if this share of the toxic texts has it, within these bounds, and so many times the share of the others.
MIN_SHARE, MIN_TEXTS, MIN_LIFT = 0.02, (3, 6), 3.0
THRESHOLD, PRIOR = 0.7, 0.1
CACHE_WORDS = 250_000
MARKS = ".,;:!?\"'()[]{}#*$%&|<>-_…«»¡¿`~/\\"


def tokens(text: str | None) -> list[str]:
    """Lower-case runs between white space; a word that repeats the one before it counts once."""
    words = (text or "").lower().split()
    return [w for w, before in zip(words, [None, *words], strict=False) if w != before]


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket): the buckets of all n-grams of the words, each with the index of its word."""
    marked = [f"<{w.strip(MARKS)}>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if not code.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(marked)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(code.size)
    owners, found = [], []
    for n in range(MIN_N, min(MAX_N, code.size) + 1):
        h = np.full(code.size - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ code[k : code.size - n + 1 + k]) * np.uint64(0x100000001B3) + np.uint64(k)
        whole = left[: h.size] >= n
        owners.append(owner[: h.size][whole])
        found.append(h[whole])
    # The whole word, as one more feature: a sum of hashes of letter and place.
    place = (sizes[owner] - left).astype(np.uint64)
    letter = (code + place * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    letter ^= letter >> np.uint64(29)
    owners.append(np.arange(len(marked)))
    found.append(np.add.reduceat(letter * np.uint64(0x94D049BB133111EB), np.cumsum(sizes) - sizes))
    h = np.concatenate(found)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return np.concatenate(owners), (h >> np.uint64(64 - int(np.log2(BUCKETS)))).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """What a bucket adds to the log odds of toxic, and what they start at."""

    weights: np.ndarray
    bias: float

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum over a word's buckets, and how many they are."""
        owner, bucket = subwords(words)
        return np.bincount(owner, self.weights[bucket], len(words)), np.bincount(owner, minlength=len(words)).astype(float)


def spans(n: int, width: int = SPAN, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of words that are averaged."""
    starts = np.arange(0, max(1, n - width + 1), step)
    return starts, np.minimum(starts + width, n)


def worst(sums: np.ndarray, counts: np.ndarray) -> float:
    """The largest average over runs of words."""
    if not sums.size:
        return 0.0
    starts, ends = spans(sums.size)
    s, c = (np.concatenate([[0.0], np.cumsum(x)]) for x in (sums, counts))
    return float(((s[ends] - s[starts]) / np.maximum(1, c[ends] - c[starts])).max())


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """Embeddings and softmax together, by AdaGrad steps. Each text is represented by its run that looks worst at the time."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS), float(np.log(PRIOR / (1 - PRIOR))))
    rng = np.random.default_rng(seed)
    at: dict[str, int] = {}
    docs = [np.fromiter((at.setdefault(w, len(at)) for w in tokens(t)), np.int32) for t in texts]
    names = list(at)
    del at
    # Words go through in portions: a word has some twenty buckets, and all at once they would fill the driver.
    portions, lengths = [], []
    for low in range(0, len(names), 20_000):
        owner, found = subwords(names[low : low + 20_000])
        portions.append(found[np.argsort(owner, kind="stable")].astype(np.int32))
        lengths.append(np.bincount(owner, minlength=min(20_000, len(names) - low)))
    del names
    bucket, n_sub = np.concatenate(portions), np.concatenate(lengths)
    del portions
    first = np.cumsum(n_sub) - n_sub
    # Buckets that few toxic texts have, or that toxic texts do not have clearly more often than others, learn nothing and stay 0, like those that no text has.
    seen = np.zeros((2, BUCKETS), np.int32)
    for words, label in zip(docs, labels, strict=True):
        if words.size:
            own = np.unique(words)
            n = n_sub[own]
            seen[label, np.unique(bucket[np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))])] += 1
    n_clean, n_toxic = max(1, int((labels == 0).sum())), int((labels == 1).sum())
    live = (seen[1] >= np.clip(MIN_SHARE * n_toxic, *MIN_TEXTS)) & (seen[1] / n_toxic >= MIN_LIFT * (seen[0] + 1) / n_clean)
    del seen
    table_ = np.where(live[:, None], rng.normal(0, 0.02, (BUCKETS, WIDTH)), 0).astype(np.float32)
    weight = np.asarray([1.0, min(MAX_BALANCE, (labels == 0).sum() / max(1, (labels == 1).sum()))])
    soft = rng.normal(0, 0.3, (WIDTH, 2)).astype(np.float32)
    bias, sum_table, sum_soft, sum_bias = np.zeros(2), np.full(BUCKETS, 1e-6, np.float32), np.full((WIDTH, 2), 1e-6), np.full(2, 1e-6)
    def flat_of(words: np.ndarray) -> np.ndarray:
        n = n_sub[words]
        ends = np.cumsum(n)
        return bucket[np.repeat(first[words] - ends + n, n) + np.arange(int(ends[-1]))]

    for _ in range(int(np.clip(STEPS * BATCH // len(docs), *EPOCHS))):
        # What each known word adds to the log odds, for finding the worst runs.
        line = table_ @ (soft[:, 1] - soft[:, 0])
        per_word = np.add.reduceat(line[bucket], first)
        chosen = []
        for words in docs:
            if not words.size:
                chosen.append(words)
                continue
            starts, ends = spans(words.size, step=max(1, SPAN // 4))
            s, c = (np.concatenate([[0.0], np.cumsum(x)]) for x in (per_word[words], n_sub[words].astype(float)))
            i = int(((s[ends] - s[starts]) / (c[ends] - c[starts])).argmax())
            chosen.append(words[starts[i] : ends[i]])
        shuffled = rng.permutation(len(docs))
        for low in range(0, len(docs), BATCH):
            batch = [d for d in shuffled[low : low + BATCH] if chosen[d].size]
            if not batch:
                continue
            parts = [flat_of(chosen[d]) for d in batch]
            sizes = np.asarray([p.size for p in parts])
            flat, who = np.concatenate(parts), np.repeat(np.arange(len(batch)), sizes)
            starts = np.cumsum(sizes) - sizes
            mean = np.add.reduceat(table_[flat], starts, axis=0) / sizes[:, None]
            logits = SPAN * (mean @ soft) + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1
            p *= weight[labels[batch]][:, None]
            g_soft, g_bias, g_mean = SPAN * (mean.T @ p), p.sum(axis=0), SPAN * (p @ soft.T)
            kept = live[flat]
            touched, where = np.unique(flat[kept], return_inverse=True)
            if not touched.size:
                continue
            each = (g_mean / sizes[:, None])[who[kept]]
            g = np.stack([np.bincount(where, each[:, k], touched.size) for k in range(WIDTH)], axis=1).astype(np.float32)
            g += DECAY * table_[touched]
            sum_table[touched] += (g * g).mean(axis=1)
            table_[touched] -= RATE * g / np.sqrt(sum_table[touched])[:, None]
            sum_soft += g_soft**2
            soft -= (RATE * g_soft / np.sqrt(sum_soft)).astype(np.float32)
            sum_bias += g_bias**2
            bias -= RATE * g_bias / np.sqrt(sum_bias)
    return Model((SPAN * (table_ @ (soft[:, 1] - soft[:, 0]))).astype(np.float64), float(bias[1] - bias[0]))


def held_out(doc_id):
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> pd.DataFrame:
    """Texts and labels to learn from: of each label the `most` rows whose ids have the smallest hashes, without those held out. Of an id with several texts the least one counts."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id", "toxic").distinct()
    there = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n")).filter(F.col("n").between(1, TRAIN_CHARS)).select("doc_id").distinct()
    usable = usable.join(there, "doc_id", "left_semi")
    parts = [usable.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    chosen = parts[0].unionAll(parts[1])
    texts = docs.select("doc_id", "text").filter(F.length("text").between(1, TRAIN_CHARS)).join(F.broadcast(chosen), "doc_id")
    rows = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return rows.toPandas().sort_values(["doc_id", "toxic", "text"]).reset_index(drop=True)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample = labelled_sample(docs, labels)
    return train(sample["text"].tolist(), sample["toxic"].to_numpy(np.int64))


def with_scores(df: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """df with the probability that the text is toxic. The model is broadcast: BUCKETS numbers."""
    (name,) = fresh(df, score)
    shipped = df.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = shipped.value
        local = Model(weights, bias)
        known, sums, counts = {}, np.empty(0), np.empty(0)
        for texts in batches:
            out = np.empty(len(texts))
            for low in range(0, len(texts), 256):
                split = [tokens(t) for t in texts.iloc[low : low + 256]]
                new = list({w for words in split for w in words if w not in known})
                if len(known) + len(new) > CACHE_WORDS:
                    known, sums, counts = {}, np.empty(0), np.empty(0)
                    new = list({w for words in split for w in words})
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                if new:
                    s, c = local.word_scores(new)
                    sums, counts = np.concatenate([sums, s]), np.concatenate([counts, c])
                for i, words in enumerate(split, low):
                    at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                    out[i] = worst(sums[at], counts[at]) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -500, 500))))

    return df.withColumn(name, run(F.col(text)))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not toxic, with the columns of docs."""
    (score,) = fresh(docs, "toxicity")
    return with_scores(docs, fit(docs, labels), score=score).filter(F.col(score) < threshold).select(*docs.columns)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
