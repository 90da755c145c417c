"""N-gram Jaccard join: documents whose sets of five-word shingles are alike to 0.8 or more.

1. Texts are told apart by the hash of their lower-case words; copies become one text with a
   multiplicity. Each text gets TREES labels of LABEL MinHash values, and one byte of each value.
2. The labels of a tree, sorted, are its prefix trie: texts that share a prefix are neighbours. The
   prefix is shortened down to the length at which texts at the threshold meet in some tree with the
   target recall (6 values for 0.999): no text needs a shorter one, and none can do with a longer one,
   as a partner at the threshold may be left whatever closer ones were met.
3. Who meets is compared by all TREES * LABEL bytes, neighbours at whole labels first, then at prefixes
   shortened by a value at a time; texts that are connected already are not compared again, so a set of
   close copies takes about a comparison a text and not one a pair. Texts whose estimate is not LOOSE
   apart from the threshold (over five standard errors) are candidates. A node of more than NODE_TEXTS
   texts is not compared, its texts all become candidates of its first one. Components of the
   candidates are cut into blocks of bounded size, by number of shingles and hash; each pair of blocks is one task
   that verifies all its pairs of texts exactly, by a product of incidence matrices over the shingles. Blocks
   whose numbers of shingles are too far apart to be alike are not paired. A task returns counts
   per text and one edge per text to the first of its component there, never the pairs, so copies and
   large sets do not grow by their square.
4. Components of the links are the classes.

Defined results: words are runs of anything but ASCII white space, in lower case; a text of one to
four words has one shingle, all its words; documents without words (null text too) have no
shingles and stand alone; rows that repeat are copies of each other. A class is named by its
smallest doc_id; n_links counts the other documents alike to one, copies of its own text included.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh, materialize, release, table
from ledgerloom.llm.graph import components

SHINGLE, THRESHOLD = 5, 0.8
TREES, LABEL, RECALL, LOOSE = 24, 8, 0.999, 0.15
#: Up to so many texts a node of a trie compares its texts with each other.
NODE_TEXTS = 256
#: A block holds about so many texts, or about so many words. Up to so many rows of 60 bytes are sent to all tasks.
BLOCK_TEXTS, BLOCK_WORDS, SENT_ROWS = 128, 1 << 19, 500_000
SEED = 20240917
_ODD = np.uint64(0x9E3779B97F4A7C15)


def met(similarity, depth: int, trees: int = TREES):
    """The probability that two texts agree in the first `depth` values of some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shortest_prefix(trees: int = TREES, label: int = LABEL, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix at which texts as alike as the threshold meet with the target probability: no text needs a shorter one."""
    depth = label
    while depth > 1 and met(threshold, depth, trees) < recall:
        depth -= 1
    return depth


@cache
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    byte = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return byte, rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, all at once: sums of byte weights times powers of an odd number, from word start to word end."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not raw.size:
        return np.empty(0, np.uint64)
    inside = np.empty(raw.size + 2, np.bool_)
    inside[0] = inside[-1] = False
    inside[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not starts.size:
        return np.empty(0, np.uint64)
    place = np.arange(raw.size, dtype=np.int64)
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, raw.size)))
    byte = _tables(1)[0]
    weighed = _mix(byte[raw] + place.astype(np.uint64) * _ODD)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighed, dtype=np.uint64)])
    return _mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str, n: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    words = word_hashes(text)
    if not words.size:
        return words
    size = min(n, words.size)
    joined = np.full(words.size - size + 1, size, np.uint64)
    for k in range(size):
        joined = _mix(joined * _ODD + words[k : words.size - size + 1 + k])
    return np.unique(joined)


def signature(found: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values of a set of shingle hashes; the set is taken in pieces that fit the processor's cache."""
    _, multiply, add = _tables(n)
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, found.size, 1 << 10):
        part = found[at : at + (1 << 10)]
        np.minimum(out, (multiply[:, None] * part + add[:, None]).min(axis=1), out=out)
    return out


def tree_nodes(text: str, trees: int, label: int, shortest: int) -> tuple[int, np.ndarray, bytes]:
    """Number of distinct shingles; the node of each tree at the shortest prefix (a hash of the tree and the values so far); a byte of each value."""
    found = shingles(text)
    if not found.size:
        return 0, np.empty(0, np.int64), b""
    values = signature(found, trees * label)
    labels = values.reshape(trees, label)
    node = np.arange(1, trees + 1, dtype=np.uint64)
    for k in range(shortest):
        node = _mix(node * _ODD + labels[:, k])
    return found.size, node.view(np.int64), (_mix(values) >> np.uint64(56)).astype(np.uint8).tobytes()


def text_table(docs: DataFrame, trees: int, label: int, shortest: int) -> DataFrame:
    """One row per distinct text with words: text_id, text_key, doc_id (smallest), copies, n_words, nodes, sketch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [tree_nodes(t, trees, label, shortest) for t in batch["text"]]
            yield pd.DataFrame({"text_key": batch["text_key"], "doc_id": batch["doc_id"], "n_words": [n for n, _, _ in made], "nodes": [p for _, p, _ in made], "sketch": [s for _, _, s in made]})

    keyed = _keyed(docs).select("text_key", F.col("doc_id"), "text")
    rows = keyed.mapInPandas(run, "text_key binary, doc_id long, n_words long, nodes array<long>, sketch binary").filter("n_words > 0")
    texts = rows.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n_words", "nodes", "sketch")])
    return materialize(texts.withColumn("text_id", F.monotonically_increasing_id()), "texts")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with lower-case text and text_key, a 128-bit hash of its words."""
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    return docs.select("doc_id", text.alias("text")).withColumn("text_key", F.unhex(F.md5(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")))))


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from rows of sketch bytes; different values share a byte once in 256 times."""
    return np.clip(((a == b).mean(axis=-1) - 1 / 256) * 256 / 255, 0, 1)


def node_edges(ids: np.ndarray, labels: np.ndarray, sketches: np.ndarray, shortest: int, least: float) -> tuple[list[tuple[int, int]], int]:
    """Candidates among the texts of one node, as edges to the smallest id of their component here, and how many pairs were compared.

    labels: (texts, values), a byte of each value of the tree; the node's texts agree in the first
    `shortest` ones. From whole labels on, texts are compared with those before them in the trie that share the
    prefix, the nearest first, as long as they are not connected; pairs that met at a longer prefix are done.
    """
    order = np.lexsort((ids, *labels.T[::-1]))
    ids, labels, sketches = ids[order], labels[order], sketches[order]
    n, label = labels.shape
    top, compared, finer = np.arange(n), 0, np.arange(n)
    for depth in range(label, shortest - 1, -1):
        group = np.append(0, np.cumsum((labels[1:, :depth] != labels[:-1, :depth]).any(axis=1)))
        for i in np.flatnonzero(group[1:] == group[:-1]) + 1:
            left = np.arange(np.searchsorted(group, group[i]), i)
            if depth < label:
                left = left[finer[left] != finer[i]]
            some = 1
            while (left := left[top[left] != top[i]]).size:
                near, left, some = left[-some:], left[:-some], 2 * some
                compared += near.size
                for j in near[estimates(sketches[near], sketches[i]) >= least]:
                    top[top == top[j]] = top[i]
        finer = group
    names = np.zeros(n, np.int64)
    for t in np.unique(top):
        names[top == t] = ids[top == t].min()
    return [(int(x), int(t)) for x, t in zip(ids, names, strict=True) if x != t], compared


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def trie_edges(members: DataFrame, shortest: int, least: float) -> DataFrame:
    """Edges (a, b) within nodes. members: node, text_id, label, sketch, all texts of a node in one partition, sorted by label: the trie in order."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in _then_none(batches):
            whole = batch if rest is None else rest if batch is None else pd.concat([rest, batch], ignore_index=True)
            if whole is None or not len(whole):
                continue
            node = whole["node"].to_numpy()
            starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            # The last node may go on in the next batch.
            bounds = np.append(starts, len(whole)) if batch is None else starts
            rest = None if batch is None else whole.iloc[starts[-1] :].reset_index(drop=True)
            ids, sizes = whole["text_id"].to_numpy(), np.diff(bounds)
            two = bounds[:-1][sizes == 2]
            out = []
            if two.size:
                near = two[estimates(_bytes(whole["sketch"].iloc[two]), _bytes(whole["sketch"].iloc[two + 1])) >= least]
                out.append(pd.DataFrame({"a": ids[near], "b": ids[near + 1]}))
            for low, size in zip(bounds[:-1][sizes > 2], sizes[sizes > 2], strict=True):
                part = slice(low, low + size)
                edges = node_edges(ids[part], _bytes(whole["label"].iloc[part]), _bytes(whole["sketch"].iloc[part]), shortest, least)[0]
                out.append(pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64))
            if out:
                yield pd.concat(out).drop_duplicates()

    return members.mapInPandas(run, "a long, b long")


def _then_none(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def candidate_sets(texts: DataFrame, trees: int = TREES, label: int = LABEL, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(node, component): texts that are candidates of each other, directly or by others."""
    shortest = shortest_prefix(trees, label, threshold, recall)
    own = texts.select("text_id", F.explode("nodes").alias("node"))
    nodes = materialize(own.groupBy("node").agg(F.min("text_id").alias("hub"), F.count("*").alias("n")).filter("n > 1"), "tree-nodes")
    met_there = materialize(own.join(nodes, "node"), "tree-members")
    large = met_there.filter(F.col("n") > NODE_TEXTS).select(F.col("text_id").alias("a"), F.col("hub").alias("b"))
    small = met_there.filter(F.col("n") <= NODE_TEXTS).select("node", "text_id")
    # Of a text's trees only those whose node holds others; a tree's label is its stretch of the sketch.
    some = materialize(small.select("text_id").distinct(), "tree-texts")
    joined = small.join(texts.select("text_id", "nodes", "sketch").join(_sent(some), "text_id", "left_semi"), "text_id")
    tree = F.array_position("nodes", F.col("node")).cast("int") - 1
    members = joined.select("node", "text_id", F.substring(F.col("sketch"), tree * label + 1, F.lit(label)).alias("label"), "sketch")
    ordered = members.repartition("node").sortWithinPartitions("node", "label", "text_id")
    found = components(large.unionByName(trie_edges(ordered, shortest, threshold - LOOSE)))
    release(nodes, met_there, some)
    return found


def _links(ids: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, threshold: float) -> pd.DataFrame:
    """Exact links between texts at `rows` and `columns` (equal, or apart): counts per text, and from each text an edge to the first one of its component here.

    A product of 0/1 matrices over the shingles counts what two texts share; shingles of one text
    alone cannot be shared and are left out. Products are taken over slices of bounded width.
    """
    same = rows is columns or np.array_equal(rows, columns)
    sizes = np.asarray([s.size for s in sets])
    every = np.concatenate(sets)
    _, code, seen = np.unique(every, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    often = seen[code] > 1
    code, owner = code[often], owner[often]
    _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    shared = np.zeros((rows.size, columns.size), np.int64)
    place_r, place_c = np.full(len(sets), -1), np.full(len(sets), -1)
    place_r[rows], place_c[columns] = np.arange(rows.size), np.arange(columns.size)
    width = 4096
    for low in range(0, int(code[-1]) + 1 if code.size else 0, width):
        a, b = np.searchsorted(code, [low, low + width])
        part, who = code[a:b] - low, owner[a:b]
        left = np.zeros((rows.size, width), np.float32)
        inside = place_r[who] >= 0
        left[place_r[who][inside], part[inside]] = 1
        if same:
            right = left
        else:
            right = np.zeros((columns.size, width), np.float32)
            inside = place_c[who] >= 0
            right[place_c[who][inside], part[inside]] = 1
        shared += (left @ right.T).astype(np.int64)
    union = sizes[rows][:, None] + sizes[columns][None, :] - shared
    scale = 10**6
    alike = shared * scale >= union * round(threshold * scale)
    if same:
        np.fill_diagonal(alike, False)
    else:
        alike[rows[:, None] == columns[None, :]] = False
    out = [pd.DataFrame({"a": ids[rows], "b": -1, "links": alike @ copies[columns], "text_links": alike.sum(1)})]
    if not same:
        out.append(pd.DataFrame({"a": ids[columns], "b": -1, "links": copies[rows] @ alike, "text_links": alike.sum(0)}))
    top = np.arange(len(sets))
    while True:
        before = top.copy()
        far = len(sets)
        top[rows] = np.minimum(top[rows], np.where(alike, top[columns][None, :], far).min(axis=1, initial=far))
        top[columns] = np.minimum(top[columns], np.where(alike, top[rows][:, None], far).min(axis=0, initial=far))
        if (top == before).all():
            break
    moved = np.flatnonzero(top != np.arange(len(sets)))
    out.append(pd.DataFrame({"a": ids[moved], "b": ids[top[moved]], "links": 0, "text_links": 0}))
    return pd.concat(out).query("b >= 0 or links > 0")


def verified(docs: DataFrame, texts: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, links, text_links): per text and task what it is linked to (b is -1), and tree edges a to b."""
    # Texts of which one has less than `threshold` of the other's shingles are not alike: in a component of several blocks a class of sizes is paired with itself and the next.
    size = F.floor(F.log(F.col("n_words").cast("double")) / -float(np.log(threshold)) + 1e-9).cast("int")
    members = sets.select(F.col("node").alias("text_id"), "component").join(texts.select("text_id", "text_key", "doc_id", "copies", "n_words"), "text_id").withColumn("size", size)
    needed = lambda n, w: F.greatest(F.ceil(F.col(n) / BLOCK_TEXTS), F.ceil(F.col(w) / BLOCK_WORDS)).cast("int")
    per_class = members.groupBy("component", "size").agg(F.count("*").alias("n"), F.sum("n_words").alias("w"))
    blocks = per_class.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("size", needed("n", "w").alias("m")))).alias("blocks"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    # Most components are one block, whatever their sizes.
    blocks = materialize(blocks.select("component", F.when(needed("n", "w") > 1, F.col("blocks")).alias("blocks")), "set-blocks")
    of_class = lambda k: F.coalesce(F.try_element_at("blocks", F.col("size") + k), F.lit(0))
    members = members.join(blocks, "component").withColumn("size", F.when(F.col("blocks").isNull(), 0).otherwise(F.col("size")))
    members = members.withColumn("m", F.when(F.col("blocks").isNull(), 1).otherwise(of_class(0)))
    members = materialize(members.select("text_id", "text_key", "doc_id", "copies", "component", "size", F.pmod(F.xxhash64("text_id"), F.col("m")).cast("int").alias("block"), "m", of_class(-1).alias("m_below"), of_class(1).alias("m_above")), "set-members")
    whole = _with_text(docs, members)
    # A pair of blocks is named (class, block, class, block), the smaller first.
    own = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: F.struct(F.col("size").alias("c1"), F.least("block", o).alias("low"), F.col("size").alias("c2"), F.greatest("block", o).alias("high")))
    none = F.array().cast("array<struct<c1:int,low:int,c2:int,high:int>>")
    beside = lambda m, pair: F.when(F.col(m) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col(m) - 1, F.lit(0))), pair)).otherwise(none)
    above = beside("m_above", lambda o: F.struct(F.col("size").alias("c1"), F.col("block").alias("low"), (F.col("size") + 1).alias("c2"), o.alias("high")))
    below = beside("m_below", lambda o: F.struct((F.col("size") - 1).alias("c1"), o.alias("low"), F.col("size").alias("c2"), F.col("block").alias("high")))
    pairs = whole.withColumn("pair", F.explode(F.concat(own, above, below))).select("component", "pair.*", "size", "block", "text_id", "copies", "text")

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("text_id").sort_values("text_id")
        ids, copies = group["text_id"].to_numpy(), group["copies"].to_numpy()
        sets_ = [shingles(t) for t in group["text"]]
        size, block = group["size"].to_numpy(), group["block"].to_numpy()
        rows, columns = (np.flatnonzero((size == key[k]) & (block == key[k + 1])) for k in (1, 3))
        if not rows.size or not columns.size:
            return pd.DataFrame({"a": [], "b": [], "links": [], "text_links": []})
        return _links(ids, copies, sets_, rows, columns, threshold)

    done = materialize(pairs.groupBy("component", "c1", "low", "c2", "high").applyInPandas(run, "a long, b long, links long, text_links long"), "links")
    release(blocks)
    return done


def _sent(rows: DataFrame) -> DataFrame:
    """Narrow rows of a written table, to be joined with texts: up to SENT_ROWS go to the texts, more meet them in a shuffle that Spark plans."""
    return F.broadcast(rows) if rows.count() <= SENT_ROWS else rows


def _with_text(docs: DataFrame, members: DataFrame) -> DataFrame:
    """members with their text, from the rows of docs that hold the text's smallest doc_id."""
    d = _keyed(docs).select(F.col("text_key").alias("k"), F.col("doc_id").alias("i"), "text")
    m = _sent(members)
    return d.join(m, (F.col("k") == F.col("text_key")) & F.col("i").eqNullSafe(F.col("doc_id"))).drop("k", "i")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, label: int = LABEL, recall: float = RECALL) -> DataFrame:
    """Per row of docs: doc_id, class_id, n_links, n_text_links, class_size."""
    texts = text_table(docs, trees, label, shortest_prefix(trees, label, threshold, recall))
    found = verified(docs, texts, candidate_sets(texts, trees, label, threshold, recall), threshold)
    counts = found.filter("b < 0").groupBy(F.col("a").alias("text_id")).agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    classes = components(found.filter("b >= 0").select("a", "b")).select(F.col("node").alias("text_id"), "component")
    rich = texts.select("text_id", "text_key", "doc_id", "copies").join(classes, "text_id", "left").join(counts, "text_id", "left")
    rich = rich.withColumn("component", F.coalesce("component", "text_id"))
    names = rich.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    rich = materialize(rich.join(names, "component").select(
        "text_key", "class_id", "class_size",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("text_links", F.lit(0)).alias("n_text_links")), "near-classes")
    # Documents without words share one key and are in no class: they stay out of the join.
    rows = _keyed(docs).select("doc_id", F.when(F.col("text_key") != F.unhex(F.md5(F.lit(""))), F.col("text_key")).alias("text_key"))
    return rows.join(rich, "text_key", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The columns of docs, for the first row of each class: smallest doc_id, and of rows with that id one.

    Documents without a doc_id are in no class they could name and are all kept.
    """
    order, rows = fresh(docs, "near_order", "near_rows")
    found = near_duplicates(docs.select("doc_id", "text"), **options).filter(F.col("doc_id") == F.col("class_id"))
    keep = materialize(found.groupBy("doc_id").agg(F.count("*").alias(rows)), "near-keep")
    single = docs.join(_sent(keep.filter(F.col(rows) == 1).select("doc_id")), "doc_id", "left_semi")
    # Ids that come more than once, of which there should be none.
    twice = docs.join(_sent(keep.filter(F.col(rows) > 1).select("doc_id")), "doc_id", "left_semi")
    picked = twice.withColumn(order, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).filter(F.col(order) == 1)
    return single.select(*docs.columns).unionByName(picked.select(*docs.columns)).unionByName(docs.filter("doc_id IS NULL"))
