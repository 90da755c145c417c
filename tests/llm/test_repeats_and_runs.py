"""Substring dedup, hard negatives and periodic runs: against brute force, and on odd rows."""

import hashlib
import zlib

import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import hard_negatives, periodic_runs, substring_dedup

SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().split()


def sha(parts):
    return hashlib.sha256(b" ".join(parts)).hexdigest()


def documents(sf=SF):
    return [(r["doc_id"], r["text"]) for r in ds.dataset(f"{sf}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()]


# Substring dedup ------------------------------------------------------------------------------


def brute_removed(rows, length):
    first = {}
    for doc, text in rows:
        w = words(text)
        for s in range(len(w) - length + 1) if doc is not None else ():
            key = tuple(w[s : s + length])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - length + 1) if doc is not None else ():
            if first[tuple(w[s : s + length])] < doc:
                gone[s : s + length] = [True] * length
        spans = [i for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])]
        out.append((doc, len(w), sum(gone), tuple(spans), sha([x for x, g in zip(w, gone) if not g])))
    return sorted(out, key=repr)


def removed(df, **options):
    rows = substring_dedup.remove_repeats(df, **options).collect()
    return sorted(((r["doc_id"], r["n_words"], sum(x["words"] for x in r["repeats"]), tuple(x["start"] for x in r["repeats"]), hashlib.sha256(r["kept"].encode()).hexdigest()) for r in rows), key=repr)


def test_repeats_of_the_given_documents(spark):
    rows = documents()
    want = brute_removed(rows, 50)
    assert sum(n for _, _, n, _, _ in want) > 0
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.op11_substring_dedup(spark, SF).collect()]
    assert sorted(got, key=repr) == [(a, b, c, e) for a, b, c, _, e in want]


def test_repeats_of_pasted_passages(spark):
    """Few words, so that anchors have many neighbours; passages in many documents, in one twice, cut at either end, copies, one id twice."""
    rng = np.random.default_rng(5)
    passages = [[f"w{x}" for x in rng.integers(0, 30, int(rng.integers(4, 40)))] for _ in range(12)]
    rows = []
    for doc in range(120):
        parts = []
        for _ in range(int(rng.integers(0, 6))):
            p = passages[int(rng.integers(12))]
            low = int(rng.integers(0, 3))
            parts += p[low : len(p) - int(rng.integers(0, 3))] + [f"w{x}" for x in rng.integers(0, 3, int(rng.integers(0, 6)))]
        rows.append((doc, " ".join(parts)))
    rows += [(200, rows[3][1]), (-5, rows[4][1]), (None, rows[5][1]), (7, rows[8][1]), (7, rows[8][1]), (300, "a " * 400), (301, "a " * 300), (302, "a b " * 200), (303, None), (304, ""), (305, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit("mine"), "text_key": F.lit(1)})
    for length, seed in ((10, 4), (8, 8), (6, 1)):
        assert removed(df, length=length, seed=seed) == brute_removed(rows, length)
    assert removed(df.limit(0)) == []


def test_pieces_of_a_long_text(spark, monkeypatch):
    rng = np.random.default_rng(8)
    shared = [f"w{x}" for x in rng.integers(0, 50, 120)]
    texts = [[w.encode() for w in [*map(str, rng.integers(0, 9, 70)), *shared, *map(str, rng.integers(0, 9, k))]] for k in (5, 200)]
    whole = {(int(t), int(a), s + k) for t, s, n, a, _ in zip(*next(substring_dedup.stretches(texts, 20, 8)), strict=True) for k in range(n)}
    monkeypatch.setattr(substring_dedup, "PIECE_WORDS", 64)
    cut = {(int(t), int(a), int(s) + k) for part in substring_dedup.stretches(texts, 20, 8) for t, s, n, a, _ in zip(*part, strict=True) for k in range(n)}
    assert {(t, s) for t, _, s in whole} == {(t, s) for t, _, s in cut} and whole == cut


# Hard negatives -------------------------------------------------------------------------------


def brute_negatives(rows, anchor, positives=5, negatives=3):
    ok = {}
    for i, label, v in sorted(rows, key=repr):
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            if i not in ok or (label, v) < ok[i]:
                ok[i] = (label, v)
    width = max((len(v) for _, v in ok.values()), default=0)
    ids = sorted(ok)
    m = np.array([list(ok[i][1]) + [0] * (width - len(ok[i][1])) for i in ids]).reshape(len(ids), width).astype(int)
    out = []
    for k, i in enumerate(ids):
        if not anchor(i):
            continue
        scores = m @ m[k]
        order = sorted((x for x in range(len(ids)) if x != k), key=lambda x: (-scores[x], ids[x]))
        for p in [x for x in order if ok[ids[x]][0] == ok[i][0]][:positives]:
            fits = [x for x in order if ok[ids[x]][0] != ok[i][0] and 50 * scores[p] <= 100 * scores[x] <= 95 * scores[p]][:negatives]
            out += [(i, ids[p], rank, ids[x], int(scores[p]), int(scores[x])) for rank, x in enumerate(fits, 1)]
    return sorted(out)


def test_negatives_of_crowded_and_odd_vectors(spark):
    """Copies of one vector, ties, rare labels, windows that hold nothing or everything, rows that take no part."""
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(3)) if i % 40 else 9, rng.integers(-40, 60, 12).astype(float).tolist()) for i in range(600)]
    rows += [(1000 + i, 0, [30.0] * 12) for i in range(150)] + [(2000, 8, [30.0] * 12), (2010, 7, []), (2020, 7, [5.0]), (2030, 1, [0.0] * 12)]
    rows += [(3000, None, [1.0] * 12), (3010, 1, None), (3020, 1, [None] * 12), (3030, 1, [float("nan")] * 12), (3040, 1, [float("inf")] * 12), (None, 1, [1.0] * 12), (10, 5, [1.0] * 12), (20, 0, [99.0] * 12), (20, 0, [99.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<double>").withColumns({"score": F.lit("mine"), "slot": F.lit(0)})
    for block in ((64, 64), (1024, 4096)):
        got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, block_rows=block).collect())
        assert got == brute_negatives(rows, lambda i: i % 10 == 0)
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_norm_bounds_spare_pairs_and_lose_none():
    rng = np.random.default_rng(3)
    a, x = rng.integers(-50, 50, (40, 64)).astype(float), rng.integers(-50, 50, (500, 64)).astype(float)
    scores = a @ x.T
    for low in (np.full(40, np.sort(scores, axis=None)[-60]), np.sort(scores, axis=1)[:, -5], np.full(40, -np.inf)):
        i, j, s, looked_at = hard_negatives.joined_pairs(a, x, low)
        assert {(*p,) for p in zip(i, j, s)} == {(i, j, scores[i, j]) for i, j in zip(*np.nonzero(scores >= low[:, None]))}
    assert hard_negatives.joined_pairs(a, x, np.full(40, np.sort(scores, axis=None)[-60]))[3] < scores.size / 5


# Periodic runs --------------------------------------------------------------------------------


def brute_runs(w, least=6, periods=4):
    out = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, periods * q):
                out.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_digest(doc, text):
    w = words(text)
    if doc is not None and w and (h := zlib.crc32(str(doc).encode())) % 10 == 0:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return doc, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), sha([x for i, x in enumerate(w) if i not in gone])


def test_runs_against_brute_force():
    rng = np.random.default_rng(4)
    texts = [np.empty(0, np.int64), np.zeros(300, np.int64), np.tile(np.arange(7), 40), np.tile(np.repeat(np.arange(3), 9), 5)]
    for _ in range(400):
        t = rng.integers(0, rng.integers(1, 6), int(rng.integers(0, 140)))
        if t.size > 10 and rng.random() < 0.6:
            a = int(rng.integers(t.size))
            i = np.arange(t.size)
            t = t[np.where(i < a, i, a + (i - a) % (1 + (t.size - a) // int(rng.integers(3, 11))))]
        texts.append(t)
    assert [[tuple(map(int, r)) for r in found] for found in periodic_runs.find_runs(texts)] == [brute_runs(t.tolist()) for t in texts]
    for least, periods in ((2, 4), (20, 5)):
        assert [[tuple(map(int, r)) for r in found] for found in periodic_runs.find_runs(texts, least, periods)] == [brute_runs(t.tolist(), least, periods) for t in texts]
    with pytest.raises(ValueError):
        periodic_runs.find_runs(texts, 6, 3)


def test_grammar_answers_extensions():
    """Every pair of places, both ways; and the grammar is short where the string repeats itself."""
    rng = np.random.default_rng(6)
    for s in (rng.integers(0, 2, 150), np.tile(rng.integers(0, 3, 10), 15), np.zeros(150, np.int64)):
        n = len(s)
        levels = periodic_runs.grammar(s)
        i, j = (x[np.triu_indices(n, 1)] for x in np.meshgrid(np.arange(n), np.arange(n), indexing="ij"))
        ahead = np.array([next((k for k in range(n - b) if s[a + k] != s[b + k]), n - b) for a, b in zip(i, j)])
        back = np.array([next((k for k in range(a) if s[a - 1 - k] != s[b - 1 - k]), a) for a, b in zip(i, j)])
        assert (periodic_runs.extension(levels, i, j, 1) == ahead).all() and (periodic_runs.extension(levels, i, j, -1) == back).all()
    assert len(periodic_runs.grammar(np.zeros(1 << 16, np.int64))) == 2


def test_runs_of_the_given_documents(spark):
    want = sorted((brute_digest(*r) for r in documents()), key=repr)
    assert sum(r[1] > 0 for r in want) > 10
    got = sorted((tuple(r) for r in periodic_runs.op13_periodic_runs(spark, SF).collect()), key=repr)
    assert got == want


def test_runs_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "x"), (None, "a " * 50), (6, "a " * 50), (6, "a " * 50), (7, "the cat sat " * 900), (8, "é ñ " * 5 + "漢字 " * 7), (9, "w" * 50_000)]
    rows += [(i, " ".join(f"w{(i * k) % 23}" for k in range(60))) for i in range(100, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit("mine"), "best": F.lit(0)})
    planted = df.withColumn("text", periodic_runs.with_planted_period(F.col("text"), F.col("doc_id")))
    got = sorted((tuple(r) for r in periodic_runs.digest(periodic_runs.collapse_runs(planted)).collect()), key=repr)
    assert got == sorted((brute_digest(*r) for r in rows), key=repr)
    assert periodic_runs.digest(periodic_runs.collapse_runs(df.limit(0))).count() == 0
