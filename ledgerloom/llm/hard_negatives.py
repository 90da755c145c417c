"""Hard negatives: for an anchor its nearest rows of the same label, and for each of these the nearest rows of other labels in a window below it.

Both are threshold joins of the anchors with all rows, in blocks:

1. Rows and anchors are dealt to blocks by a hash; each pair of blocks is one task. A label, a vector
   or a group of copies that many rows share is spread over all blocks.
2. In a task the dimensions are an inverted index in PARTS stretches. A row's leading stretches are left out
   of it as long as their norm times the largest norm of an anchor there stays below the lowest
   threshold: no anchor reaches its threshold in them alone. Partial scores are added up from the last stretch on,
   and a pair is dropped once its score so far and the product of the norms that remain do not reach the
   anchor's threshold. What is left is verified by the exact rest of the product. A task returns the best
   few rows for a window, never the pairs.
3. Thresholds start high and are lowered for the windows that did not fill. One block, a random
   part of all rows, is searched first: what it holds says how dense the rows lie, and from which
   threshold on about SPARE times as many rows as needed can be expected. A window that is not full is lowered
   twice, the second time to its end (for positives: to what the first block holds, which must fill it).
   Full windows hold the best rows of all, so results are exact whatever was expected.

Defined results: rows without id, label or vector, or with a component that is null or not finite,
take no part; of rows that share an id one takes part, that with the smallest label, then vector;
vectors that are shorter than others have zeros behind; scores are exact while the sum of the products stays
below 2**53. Other columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, release, table

POSITIVES, NEGATIVES = 5, 3
#: Stretches of dimensions.
PARTS = 4
#: Rows of a block: a 64th of all, between these.
BLOCK_ROWS = (1024, 16384)
#: Pairs whose scores are held at once in a task.
HELD_PAIRS = 1 << 20
#: A first threshold is set so that about so many times the rows that are needed can be expected.
SPARE = 8
#: Products are sums of whole numbers, norms are not: bounds are taken this much wider.
SLACK = 1e-6
FOUND = "anchor_id long, slot int, row_id long, score double"


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


def _prefix_norms(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Norms of the first edges[k] components, for each row and k."""
    squares = np.cumsum(np.pad(x * x, ((0, 0), (1, 0))), axis=1)
    return np.sqrt(squares[:, edges]) * (1 + SLACK)


def joined_pairs(anchors: np.ndarray, rows: np.ndarray, low: np.ndarray, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(anchor, row, score) of all pairs with a score of low[anchor] or more, and how many pairs had to be verified."""
    edges = np.linspace(0, rows.shape[1], parts + 1).astype(int)
    of_anchors, of_rows = _prefix_norms(anchors, edges), _prefix_norms(rows, edges)
    # Products of prefix norms grow with the prefix, so what is covered is a prefix too.
    omitted = (of_rows[:, 1:] * of_anchors[:, 1:].max(axis=0) < low.min() - SLACK).sum(axis=1)
    order = np.argsort(omitted, kind="stable")
    rows, of_rows, omitted = rows[order], of_rows[order], omitted[order]
    scores = np.zeros((len(anchors), len(rows)))
    for part in range(parts - 1, -1, -1):
        n = np.searchsorted(omitted, part, "right")
        dims = slice(edges[part], edges[part + 1])
        scores[:, :n] += anchors[:, dims] @ rows[:n, dims].T
        done = np.maximum(omitted, part)
        live = scores + of_anchors[:, done] * of_rows[np.arange(len(rows)), done] >= low[:, None] - SLACK
        if live.mean() < 1 / 8:
            break
    i, j = np.nonzero(live)
    found = scores[i, j]
    for part in np.unique(done[j]):
        some = np.flatnonzero(done[j] == part)
        for at in range(0, some.size, HELD_PAIRS >> 6):
            s = some[at : at + (HELD_PAIRS >> 6)]
            found[s] += np.einsum("nd,nd->n", anchors[i[s], : edges[part]], rows[j[s], : edges[part]])
    good = found >= low[i]
    return i[good], order[j[good]], found[good], len(i)


def block_join(queries: pd.DataFrame, rows: pd.DataFrame, most: int, same: bool) -> pd.DataFrame:
    """For each window (slot) of each query the best `most` rows of the same label, or of others, with a score within it."""
    if not len(queries) or not len(rows):
        return pd.DataFrame({"anchor_id": [], "slot": [], "row_id": [], "score": []})
    width = max(queries["vector"].map(len).max(), rows["vector"].map(len).max())
    x, ids, labels = _matrix(rows["vector"], width), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    windows = queries["lows"].map(len).max()
    out = []
    for at in range(0, len(queries), step := max(1, HELD_PAIRS // len(rows))):
        some = queries.iloc[at : at + step]
        anchors, own = some["anchor_id"].to_numpy(), some["label"].to_numpy()
        low, high = np.full((len(some), windows), np.inf), np.full((len(some), windows), -np.inf)
        slots = np.zeros((len(some), windows), np.int64)
        for k, (a, b, s) in enumerate(zip(some["lows"], some["highs"], some["slots"], strict=True)):
            low[k, : len(a)], high[k, : len(b)], slots[k, : len(s)] = a, b, s
        i, j, score, _ = joined_pairs(_matrix(some["vector"], width), x, low.min(axis=1))
        fits = ((labels[j] == own[i]) == same) & (ids[j] != anchors[i])
        i, j, score = i[fits], j[fits], score[fits]
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        for w in range(windows):
            inside = np.flatnonzero((score >= low[i, w]) & (score <= high[i, w]))
            first = np.searchsorted(i[inside], i[inside])
            best = inside[np.arange(inside.size) - first < most]
            out.append(pd.DataFrame({"anchor_id": anchors[i[best]], "slot": slots[i[best], w], "row_id": ids[j[best]], "score": score[best]}))
    return pd.concat(out)


def threshold_join(rows: DataFrame, queries: DataFrame, blocks: tuple[int, int], most: int, same: bool, first_block: bool = False) -> DataFrame:
    """(anchor_id, slot, row_id, score): the best `most` rows of each window.

    rows: vec_id, label, vector, row_block. queries: anchor_id, label, vector, slots, lows, highs, anchor_block. blocks: of rows, of anchors.
    """
    of_rows = 1 if first_block else blocks[0]
    left = queries.withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(of_rows - 1))))
    right = rows.filter(F.col("row_block") < of_rows).withColumn("anchor_block", F.explode(F.sequence(F.lit(0), F.lit(blocks[1] - 1))))
    key = ("row_block", "anchor_block")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda q, r: block_join(q, r, most, same), FOUND)
    best = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "row_id"))
    return materialize(found.withColumn("rank", best).filter(F.col("rank") <= most), "nearest")


def _lowered(rows: DataFrame, open_: DataFrame, anchors: DataFrame, blocks: tuple[int, int], most: int, same: bool) -> DataFrame:
    """Best rows of each window of open_ (anchor_id, slot, high, thresholds: falling, the last one final)."""
    results, tries = [], 3
    for turn in range(tries):
        low = F.get("thresholds", F.lit(turn))
        asked = open_.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("slot", low.alias("low"), "high"))).alias("w"))
        asked = asked.select("anchor_id", F.col("w.slot").alias("slots"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
        found = threshold_join(rows, anchors.join(asked, "anchor_id"), blocks, most, same)
        if turn == tries - 1:
            results.append(found)
            break
        counts = found.groupBy("anchor_id", "slot").agg(F.count("*").alias("n"))
        last = F.element_at("thresholds", -1)
        state = open_.join(counts, ["anchor_id", "slot"], "left").withColumn("done", (F.coalesce("n", F.lit(0)) >= most) | (low <= last))
        before, state = open_, materialize(state, "windows")
        results.append(found.join(state.filter("done").select("anchor_id", "slot"), ["anchor_id", "slot"]))
        open_ = state.filter("NOT done").select("anchor_id", "slot", "high", "thresholds")
        release(before)
        if open_.isEmpty():
            break
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.select("anchor_id", "slot", "row_id", F.col("score").cast("long").alias("score"), "rank")


def usable(rows: DataFrame) -> DataFrame:
    """One row per id of those with id, label and a vector of finite numbers: vec_id, label, vector (doubles)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<double>")).filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    kept = kept.filter(F.coalesce(F.forall("vector", finite), F.lit(False)))
    return kept.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector")


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = (50, 95), block_rows: tuple[int, int] = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, vector of whole numbers; a score is the product of the vectors. Positives of an anchor are
    its first other rows of its label by score, ties by id. Each has the first rows of other labels
    whose score is between window[0] and window[1] per cent of the positive's.
    """
    whole = materialize(usable(rows).withColumn("is_anchor", is_anchor), "vectors")
    n, of_anchors = whole.agg(F.count("*"), F.count_if("is_anchor")).first()
    size = min(max(math.ceil(n / 64), block_rows[0]), block_rows[1])
    blocks = (max(1, math.ceil(n / size)), max(1, math.ceil(of_anchors / size)))
    share = 1 / blocks[0]
    hashed = lambda seed, m: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(m)).cast("int")
    all_rows = whole.select("vec_id", "label", "vector", hashed(0, blocks[0]).alias("row_block"))
    anchors = materialize(whole.filter("is_anchor").select(F.col("vec_id").alias("anchor_id"), "label", "vector", hashed(1, blocks[1]).alias("anchor_block")), "anchors")

    # Positives: the tail of the scores in the first block, taken as exponential, gives the first threshold.
    none, inf = F.lit(float("-inf")), F.lit(float("inf"))
    one = lambda c: F.array(c)
    pilot = threshold_join(all_rows, anchors.withColumns({"slots": one(F.lit(0)), "lows": one(none), "highs": one(inf)}), blocks, positives, True, True)
    seen = pilot.groupBy("anchor_id").agg(F.count("*").alias("n"), F.max("score").alias("top"), F.min("score").alias("last"))
    full = F.coalesce(F.col("n"), F.lit(0)) >= positives
    slope = (F.col("top") - F.col("last")) / math.log(max(2, positives))
    start = F.greatest(F.col("last"), F.col("top") - slope * math.log(SPARE * positives * share))
    steps = F.when(full, F.array(start, (start + F.col("last")) / 2, F.col("last"))).otherwise(F.array(none, none, none))
    asked = materialize(anchors.select("anchor_id").join(seen, "anchor_id", "left").select("anchor_id", F.lit(0).alias("slot"), inf.alias("high"), steps.alias("thresholds")), "windows")
    nearest = materialize(_lowered(all_rows, asked, anchors, blocks, positives, True), "positives")
    release(pilot)

    # Negatives: windows below each positive; the first stretch below the top is as wide as the first block suggests.
    low, high = F.ceil(F.col("score") * window[0] / 100).cast("double"), F.floor(F.col("score") * window[1] / 100).cast("double")
    windows = nearest.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"), low.alias("low"), high.alias("high")).filter("low <= high")
    grouped = windows.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("slot", "low", "high"))).alias("w"))
    pilot = threshold_join(all_rows, anchors.join(grouped.select("anchor_id", F.col("w.slot").alias("slots"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs")), "anchor_id"), blocks, negatives, False, True)
    seen = pilot.groupBy("anchor_id", "slot").agg(F.count("*").alias("n"), F.min("score").alias("last"))
    reach = F.col("high") - F.when(F.coalesce("n", F.lit(0)) >= negatives, F.col("last")).otherwise(F.col("low"))
    step = lambda times: F.greatest(F.col("low"), F.floor(F.col("high") - reach * min(1.0, times * share)).cast("double"))
    asked = windows.join(seen, ["anchor_id", "slot"], "left").select("anchor_id", "slot", "high", F.array(step(SPARE), step(SPARE**2), F.col("low")).alias("thresholds"))
    found = _lowered(all_rows, materialize(asked, "windows"), anchors, blocks, negatives, False)
    out = found.select("anchor_id", "slot", "rank", F.col("row_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(windows, ["anchor_id", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 256).cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vector = F.when(F.coalesce(finite, F.lit(False)), vector)
    return hard_negatives(rows.select("vec_id", label.alias("label"), vector.alias("vector")), F.col("vec_id") % 50 == 0)


#: The same by comparing every anchor with every row.
OP12_SQL = """
WITH part AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id AS row_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
    FROM part a JOIN part r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
positives AS (
    SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5),
ranked AS (
    SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.row_id) AS INT) AS rank,
           s.row_id AS negative_id, p.positive_score, s.score AS negative_score
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT * FROM ranked WHERE rank <= 3
"""
