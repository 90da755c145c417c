"""The operators that run Python: against brute force, round trips, held-out labels, and on odd rows."""

import hashlib
import re
import zlib
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import graph, html_text, media, near_duplicates, packing, token_counts, toxicity, toxicity_settings, warc

SF = "/root/testdata/sf0.001"
ODD = [(1, "Hello, the quick brown fox. " * 9), (2, None), (3, ""), (4, " \n "), (5, "w" * 5000), (6, "the cat " * 4000), (7, "Hello, the quick brown fox. " * 9), (7, "Hello, the quick brown fox. " * 9), (None, "été ñ 漢字 😍 x")]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("n_words", F.lit("mine"))


# Near duplicates ------------------------------------------------------------------------------


def brute_classes(rows):
    def grams(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for _, t in rows]
    top, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 5 * shared >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                top[max(find(i), find(j))] = min(find(i), find(j))
    first = {}
    for i, (doc, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), doc), doc)
    return sorted((doc, first[find(i)], links[i]) for i, (doc, _) in enumerate(rows))


def corpus(n=160, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 4 and rows:
            words = rows[int(rng.integers(len(rows)))][1].split()
            for _ in range(int(rng.integers(0, 6))):
                words[int(rng.integers(len(words)))] = f"e{rng.integers(999)}"
        else:
            words = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(3, 120)))]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("block, sent", [(near_duplicates.BLOCK_TEXTS, near_duplicates.SENT_ROWS), (8, 0)])
def test_classes_equal_brute_force(spark, monkeypatch, block, sent):
    monkeypatch.setattr(near_duplicates, "BLOCK_TEXTS", block)
    monkeypatch.setattr(near_duplicates, "SENT_ROWS", sent)
    rows = corpus() + [(900, "ONE  two\tthree"), (901, "one two three"), (902, None), (903, ""), (904, "one")]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()) == brute_classes(rows)


def test_one_of_each_on_odd_rows(spark):
    docs = odd(spark)
    kept = near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6]
    assert near_duplicates.one_of_each(docs.limit(0)).count() == 0


def test_exact_threshold_counts(spark):
    """4 of 5 shingles shared is exactly 0.8."""
    a, b = "a b c d e f g h", "a b c d e f g h i"
    got = near_duplicates.near_duplicates(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"))
    assert [r["class_id"] for r in got.collect()] == [1, 1]


def test_shortest_prefix_reaches_the_recall():
    d = near_duplicates.shortest_prefix()
    assert near_duplicates.met(0.8, d) >= near_duplicates.RECALL > near_duplicates.met(0.8, d + 1)


def test_prefixes_are_shortened_where_recall_is_short():
    """Whole labels suffice for close copies; a pair at the threshold that agrees in a short prefix alone is still found."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, 192, dtype=np.uint8)
    def changed(share):
        out = base.copy()
        at = rng.permutation(192)[: int(192 * share)]
        out[at] ^= 255
        return out
    sketches = np.stack([base, changed(0.02), changed(0.2), rng.integers(0, 256, 192, dtype=np.uint8)])
    ids = np.array([10, 11, 12, 13])
    # All agree in six values; the first two in all eight, the third in seven, the last in none more.
    labels = np.array([[9] * 6 + [2, 3], [9] * 6 + [2, 3], [9] * 6 + [2, 4], [9] * 6 + [5, 6]], np.uint8)
    assert near_duplicates.node_edges(ids, labels, sketches, 6, 0.65)[0] == [(11, 10), (12, 10)]
    assert near_duplicates.node_edges(ids[:2], labels[:2], sketches[:2], 6, 0.65) == ([(11, 10)], 1)
    assert near_duplicates.node_edges(ids[[0, 3]], labels[[0, 3]], sketches[[0, 3]], 6, 0.65) == ([], 1)


@pytest.mark.parametrize("sets", [1, 3, 40])
def test_the_trie_spares_comparisons_and_loses_no_connection(sets):
    """Near copies of a few texts in one node: about a comparison a text among near copies; those of different texts are all compared; the components are those of all pairs."""
    rng, n = np.random.default_rng(sets), 240
    base = rng.integers(0, 256, (sets, 192), dtype=np.uint8)
    sketches, labels = base[np.arange(n) % sets].copy(), np.full((n, 8), 9, np.uint8)
    labels[:, 6:] = (np.arange(n) % sets)[:, None] % 200
    for i in range(n):
        at = rng.permutation(192)[: int(rng.integers(0, 30))]
        sketches[i, at] ^= 255
        labels[i, 8 - int(rng.integers(1, 4)) + 1 :] = int(rng.integers(0, 256))
    ids = rng.permutation(1000)[:n]
    edges, compared = near_duplicates.node_edges(ids, labels, sketches, 6, 0.65)
    alike = np.stack([near_duplicates.estimates(sketches, s) for s in sketches]) >= 0.65
    top = np.arange(n)
    while (top != (top := np.array([top[alike[i]].min() for i in range(n)]))).any():
        pass
    assert {x: t for x, t in edges} == {int(ids[i]): int(ids[top == top[i]].min()) for i in range(n) if ids[i] != ids[top == top[i]].min()}
    assert compared < n * (n - 1) / 2 * (0.05 if sets == 1 else 0.7 if sets == 3 else 0.999)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test data")
@pytest.mark.parametrize("node", [near_duplicates.NODE_TEXTS, 2])
def test_links_of_real_documents_are_exact(spark, monkeypatch, node):
    monkeypatch.setattr(near_duplicates, "NODE_TEXTS", node)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets, links = {}, {}
    for d, t in docs.select("doc_id", "text").collect():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
        sets[d] = {hash(tuple(w[i : i + 5])) for i in range(max(1, len(w) - 4))} if w else set()
    holders = {}
    for d, grams in sets.items():
        for g in grams:
            holders.setdefault(g, []).append(d)
    shared = {}
    for group in holders.values():
        for i, a in enumerate(group):
            for b in group[:i]:
                shared[a, b] = shared.get((a, b), 0) + 1
    for (a, b), n in shared.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    got = near_duplicates.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["n_links"] for r in got if r["n_links"]} == links and len(got) == len(sets)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(50, 70)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {x: 50 for x in [*range(50, 70), 100]} | {200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_released_tables_are_gone(spark):
    from ledgerloom.llm import common

    made = common.materialize(spark.range(3), "gone")
    path = made.written_to.removeprefix("file://").removeprefix("file:")
    assert Path(path).exists()
    common.release(made, None, spark.range(1))
    assert not Path(path).exists()


# Toxicity -------------------------------------------------------------------------------------


def test_held_out_is_crc32(spark):
    got = {r["i"]: r["h"] for r in spark.range(50).select(F.col("id").alias("i"), toxicity.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test data")
def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.op2_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert toxic.predicted.mean() >= 0.85 and clean.predicted.mean() <= 0.03
    assert got.score.between(0, 1).all()


def synthetic(n=240):
    rng = np.random.default_rng(1)
    texts, labels = [], []
    for i in range(n):
        words = [f"{'aeiou'[x % 5]}{'bcdfg'[x % 7 % 5]}{x}" for x in rng.integers(0, 60, 40)]
        if i % 3 == 0:
            words[int(rng.integers(40))] = ["dreadful", "dreadfull", "dreadfuly", "ddreadful"][i % 4]
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return texts, np.asarray(labels)


def test_unseen_misspelling_shares_vectors(spark):
    model = toxicity.train(*synthetic())
    base = " ".join(f"ab{i}" for i in range(30))
    df = spark.createDataFrame([(base,), (base + " dreadfulll " + base,), (base + " !!DREADFUL!! " + base,), (None,), ("",)], "text string")
    clean, typo, loud, null, empty = (r["score"] for r in toxicity.with_scores(df, model).collect())
    assert min(typo, loud) > clean and null == empty
    same = toxicity.train(*synthetic())
    assert (same.weights == model.weights).all()


def brute_score(text, model):
    """Word by word and n-gram by n-gram, with plain numbers."""
    wide = (1 << 64) - 1
    words = (text or "").lower().split()
    words = [w for i, w in enumerate(words) if i == 0 or words[i - 1] != w]
    bags = []
    for w in words:
        marked = "<" + w.strip(toxicity.MARKS) + ">"
        hashes = []
        for n in range(3, 7):
            for i in range(len(marked) - n + 1):
                h = n
                for k in range(n):
                    h = ((h ^ ord(marked[i + k])) * 0x100000001B3 + k) & wide
                hashes.append(h)
        whole = 0
        for i, c in enumerate(marked):
            x = (ord(c) + i * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & wide
            x ^= x >> 29
            whole += x * 0x94D049BB133111EB
        hashes.append(whole & wide)
        bags.append([float(model.weights[((h ^ (h >> 32)) * 0xD6E8FEB86659FD93 & wide) >> 46]) for h in hashes])
    runs = [sum(bags[i : i + toxicity.SPAN], []) for i in range(max(1, len(bags) - toxicity.SPAN + 1))]
    odds = max((sum(r) / len(r) for r in runs if r), default=0.0) + model.bias
    return 1 / (1 + np.exp(-odds))


def test_scores_equal_plain_loops(spark):
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(0, 3, toxicity.BUCKETS).astype(np.float32), -0.5)
    texts = [t for _, t in ODD if t is None or len(t) < 6000] + ["a", "a a a", "... !!", "Ünïcode wörds, (quoted) 'x' naïve 😍😍 y", " ".join(f"w{i}" for i in range(50))]
    got = toxicity.with_scores(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    for r in got:
        assert r["score"] == pytest.approx(brute_score(r["text"], model), abs=1e-5)
    clash = toxicity.with_scores(spark.createDataFrame([("x", "mine")], "text string, Score string"), model)
    assert clash.columns == ["text", "Score", "_score"] and clash.first()["Score"] == "mine"


def test_toxicity_sample_takes_one_text_of_an_id(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1][:6]
    hot, labels = ids[0], spark.createDataFrame([(i, 0, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(hot, f"hot {n:03d}") for n in range(300)] + [(hot, "")] + [(i, t) for i in ids[1:] for t in (f"b {i}", f"a {i}")], "doc_id long, text string")
    got = toxicity.labelled_sample(docs, labels, 3)
    want = sorted((i, k % 2, "hot 000" if i == hot else f"a {i}") for k, i in enumerate(ids))
    assert list(got[["doc_id", "toxic", "text"]].itertuples(index=False, name=None)) == want


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = odd(spark).withColumn("toxicity", F.lit(1))
    kept = toxicity.clean(docs, none)
    assert kept.columns == docs.columns and kept.count() == docs.count() and toxicity.clean(docs.limit(0), none).count() == 0


# WARC -----------------------------------------------------------------------------------------


def pages_of(spark, folder, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return f"file://{folder}"


def test_warc_round_trip(spark, tmp_path):
    big, tail = "é<p>" * 400, "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 40
    rows = [(1, "http://a", big), (2, "http://b", big), (9, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u\r\nX: y", None), (6, "u", tail), (7, "u", tail), (7, "u", tail), (None, "u", big)]
    got = sorted(map(tuple, warc.op4_warc(spark, pages_of(spark, tmp_path, rows)).collect()), key=repr)
    wanted = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if h == html and p is not None]
        carrier = max(same, default=None)
        revisit = len(raw) >= 1000 and page is not None and page < carrier
        wanted.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", carrier if revisit else None))
    assert got == sorted(wanted, key=repr)


def test_warc_assembly_keeps_payload_and_sides(spark, tmp_path):
    rows = [(1, "http://a", "y" * 1200), (2, "http://b", "y" * 1200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(warc.records(warc.with_revisits(pages)), str(tmp_path / "w"))
    got = warc.assemble(warc.read_archives(spark, str(tmp_path / "w"))).collect()
    assert sorted(r["record_type"] for r in got) == ["response", "revisit"]
    assert all(bytes(r["payload"]) == b"y" * 1200 and len(r["requests"]) == 1 and len(r["metadata"]) == 1 for r in got)


def test_warc_files_are_bounded_by_bytes(spark, tmp_path):
    rows = [(i, "u", "x" * n) for i, n in enumerate([10] * 20 + [3000] * 6 + [50_000] * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(warc.records(warc.with_revisits(pages, 10**9)), str(tmp_path / "w"), 50_000, file_captures=10, file_bytes=20_000)
    held = spark.read.format("binaryFile").load(str(tmp_path / "w")).select("content").collect()
    sizes = [len(warc._unzipped(bytes(r["content"]))) for r in held]
    assert max(n for n in sizes if n < 50_000) <= 20_000 + 4096 and sum(n > 50_000 for n in sizes) == 3
    got = warc.assemble(warc.read_archives(spark, str(tmp_path / "w"))).collect()
    assert sorted(r["payload_bytes"] for r in got) == sorted(len(h) for _, _, h in rows)


def test_warc_of_nothing(spark, tmp_path):
    assert warc.op4_warc(spark, pages_of(spark, tmp_path, [])).count() == 0


def test_warc_parser_rejects_damage():
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort"))


# Media ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_round_trip(channels):
    rng = np.random.default_rng(channels)
    for height, width in ((1, 1), (3, 64), (40, 7)):
        for samples in (rng.integers(0, 256, (height, width, channels), dtype=np.uint8), np.add.accumulate(np.ones((height, width, channels), np.uint8), axis=0, dtype=np.uint8)):
            assert (media.decode_png(media.encode_png(samples)) == samples).all()


def test_all_line_filters():
    rng = np.random.default_rng(0)
    want = rng.integers(0, 256, (10, 6, 3), dtype=np.uint8)
    flat, step, width = want.reshape(10, 18).astype(int), 3, 18
    kinds, lines = np.arange(10) % 5, np.zeros((10, 18), np.uint8)
    for y in range(10):
        for x in range(width):
            a, b = (flat[y, x - step] if x >= step else 0), (flat[y - 1, x] if y else 0)
            c = flat[y - 1, x - step] if y and x >= step else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            lines[y, x] = (flat[y, x] - (0, a, b, (a + b) // 2, paeth)[kinds[y]]) % 256
    assert (media._unfilter(kinds, lines, step).reshape(10, 6, 3) == want).all()


def test_damaged_png_is_noticed():
    good = media.encode_png(np.zeros((4, 64, 3), np.uint8))
    for bad in (good[:-1], good[:40] + b"\x00" + good[41:] if good[40:41] != b"\x00" else good[:40] + b"\x01" + good[41:], b"x" + good[1:]):
        with pytest.raises(ValueError):
            media.decode_png(bad)


def test_media_columns(spark):
    got = media.with_features(media.with_media(odd(spark))).withColumn("sha", F.sha2("media", 256)).collect()
    for r in got:
        raw = (r["text"] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        f = r["features"]
        assert (f["payload_bytes"], f["payload_sha256"], f["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert media.decode_png(bytes(r["media"])).tobytes() == payload and r["n_words"] == "mine"
    first = {r["text"]: (r["sha"], bytes(r["features"]["dct_hash"])) for r in got}
    assert all(first[r["text"]] == (r["sha"], bytes(r["features"]["dct_hash"])) for r in got)


def brute_cosine_hash(samples):
    """The low frequencies by the sum of the definition, on the picture averaged or repeated to 32 by 32."""
    grey = samples.astype(float).sum(axis=2)
    h, w = grey.shape
    cuts = lambda n: [(k * n // 32, max(k * n // 32 + 1, (k + 1) * n // 32)) for k in range(32)]
    small = [[grey[a:b, c:d].mean() for c, d in cuts(w)] for a, b in cuts(h)]
    wave = [[np.cos(np.pi / 32 * (x + 0.5) * k) for x in range(32)] for k in range(8)]
    low = [round(sum(wave[u][y] * wave[v][x] * small[y][x] for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = np.median(low[1:])
    return np.packbits([x > middle for x in low]).tobytes()


@pytest.mark.parametrize("height", [1, 7, 32, 50, 128])
def test_cosine_hash_equals_its_definition(height):
    samples = np.random.default_rng(height).integers(0, 256, (height, 64, 3), dtype=np.uint8)
    assert media.cosine_hash(samples) == brute_cosine_hash(samples)


def test_media_in_one_pass_equals_two_and_null_files(spark):
    docs = odd(spark).withColumn("media", F.lit("mine"))
    one = media.with_media_and_features(docs)
    assert one.columns == [*docs.columns, "_media", "features"]
    two = media.with_features(media.with_media(odd(spark))).select("media", "features")
    assert sorted(map(repr, one.select(F.col("_media").alias("media"), "features").collect())) == sorted(map(repr, two.collect()))
    assert media.with_features(spark.createDataFrame([(None,)], "media binary")).first()["features"] is None


# Packing --------------------------------------------------------------------------------------


def test_ids_equal_whole_text_encoding():
    w = packing.WordIds(packing.vocabulary_path(), most=50)
    texts = [t or "" for _, t in ODD] + ["İstanbul ΣΑΣ. O'Neil's don't l'été, a.b,c ....,, 12,3. x y \x1cz a😍b <|endoftext|> <|startoftext|>x ét ß. ﬁ ŉ Ǆ x́. ́a", "a\x0bb c d,", ",.a.,"]
    for t in texts:
        assert w.ids(t).tolist() == [*w.tokenizer.encode(t, add_special_tokens=False).ids, 1]


def check_pieces(pieces, ids_of):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for group in by_sequence.values():
        at = 0
        for p in sorted(group, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 2048
    for doc, group in by_doc.items():
        joined = b"".join(bytes(p["ids"]) for p in sorted(group, key=lambda p: p["start"]))
        assert np.frombuffer(joined, "<u4").tolist() == ids_of[doc]
        assert all(p["doc_tokens"] == len(ids_of[doc]) for p in group)
    sizes = [sum(p["length"] for p in g) for g in by_sequence.values()]
    return sum(2048 - n for n in sizes if n & (n - 1)), sum(sizes)


@pytest.mark.parametrize("pool", [1 << 20, 3000])
def test_every_id_is_in_one_piece(spark, pool):
    rows = [(d, t) for i, (d, t) in enumerate(ODD) if i != 7] + [(i + 100, t) for i, t in corpus(60)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), pool_tokens=pool).collect()
    w = packing.WordIds(packing.vocabulary_path())
    padding, _ = check_pieces(pieces, {d: w.ids(t or "").tolist() for d, t in rows})
    assert padding <= 2048
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_step_groups_are_even():
    windows, left = packing.pack_pool([(n, i, 0) for i, n in enumerate(np.random.default_rng(2).integers(1, 5000, 500).tolist())])
    assert not left
    totals = np.bincount(packing.step_groups(windows), [sum(x[0] for x in w) for _, w in windows])
    assert totals.max() - totals.min() <= 2 * 2048


# Token counts ---------------------------------------------------------------------------------


def brute_count(word, scores):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(best[end - 1][0] + n * token_counts.BYTE_SCORE, -(-best[end - 1][1] + n))]
        options += [(best[s][0] + scores[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in scores]
        best.append(max((a, b if b <= 0 else -b) for a, b in options))
    return -best[-1][1]


def test_counts_equal_plain_search(spark):
    scores = token_counts.piece_scores(token_counts.vocabulary_path())
    words = {token_counts.MARK + w for _, t in [*ODD, *corpus(20)] for w in (t or "").split() if len(w) < 200}
    prefixes = token_counts.piece_prefixes(token_counts.vocabulary_path())
    assert token_counts.trie_counts(list(words), prefixes) == {w: brute_count(w, scores) for w in words}
    rows = token_counts.with_token_counts(odd(spark)).collect()
    each = {t: token_counts.trie_counts([token_counts.MARK + w for w in (t or "").split()], prefixes) for _, t in ODD}
    for r in rows:
        w = (r["text"] or "").split()
        assert (r["counts"]["n_pretokens"], r["counts"]["n_tokens"]) == (len(w), sum(each[r["text"]][token_counts.MARK + x] for x in w))
    assert token_counts.with_token_counts(odd(spark).limit(0)).count() == 0
    clash = token_counts.with_token_counts(odd(spark).withColumn("Counts", F.lit("mine")))
    assert clash.columns[-2:] == ["Counts", "_counts"] and clash.first()["Counts"] == "mine"


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test data")
def test_settings_are_judged_without_held_out_rows(spark):
    """Cross-validation sees only rows that may be learned from, scores each by a model of other folds, and leaves the settings as they were."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    sample = toxicity.labelled_sample(docs.select("doc_id", "text"), labels)
    assert not any(zlib.crc32(b"%d" % d) % 3 == 1 for d in sample["doc_id"])
    before = toxicity.MIN_LIFT
    got = toxicity_settings.cross_validated(sample, 2, MIN_LIFT=before)
    assert toxicity.MIN_LIFT == before and got["toxic"] + got["clean"] == len(sample) and got["found"] > 0.3 and got["called"] < 0.05


# Pages ----------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>top</header><nav><ul><li>menu</li></ul></nav><div id="cookie-notice">we use</div>
<div class="sidebar"><article>teaser</article></div><article class="post has-comments"><header><h1>Big &eacute; &lt;b&gt;</h1></header><p>One<br>two <a href="a>b" class="x">li<b>n</b>k</a>
 more</p><script>var a="</p>";</script><!-- <p>no</p> --><aside>related</aside><ul><li>a<li>b</ul><div class="ad banner">buy<div>now</div></div><form><input>go</form><footer>tags</footer></article><section class="comments">bad</section><footer>&copy; x</footer>"""


def test_article_blocks():
    assert html_text.page_blocks(PAGE) == (["Big é <b>", "One two link more", "a", "b"], True)
    assert html_text.page_blocks('<div class="ad">x<article>y</article>') == (["y"], True)
    assert html_text.page_blocks("<p>a</p><nav>x</nav><p>b &amp c <scr") == (["a", "b & c"], False)
    assert html_text.page_blocks("<main><p>m</p></main><p>out") == (["m"], True)
    assert html_text.page_blocks("") == ([], False) and html_text.page_blocks("1 < 2 <3") == (["1 < 2 <3"], False)


@pytest.mark.parametrize("page, blocks", [
    ("<article><p class=share>x<p>Body one<p>Body two</article>", ["Body one", "Body two"]),
    ("<article><ul><li class=ad>x<li>a<li>b</ul><p>c</article>", ["a", "b", "c"]),
    ("<article><dl><dt class=ad>x<dd>a<dt>b</dl></article>", ["a", "b"]),
    ("<article><table><tr><td class=ad>x<td>a<tr class=promo><td>y<tr><td>b</table>c</article>", ["a", "b", "c"]),
    ("<article>a<div class=share>x<p>y</article>z<article>b</article>", ["a", "b"]),
    ("<article><div>a<section class=ad>x<span>y</div>b</article>", ["a", "b"]),
    ("<article>a<div class=ad>x<div>y</div>z</div>b</article>", ["a", "b"]),
    ("<article><p>a <span class=ad>x</p><p>b</article>", ["a", "b"]),
    ("<article>a<article class=comment>x</article>b</article>", ["a", "b"]),
    ("<head><title>t</title><meta name=a><p>a<form><select><option>x<option>y</select></form>b", ["a", "b"]),
    ("<div class=ad>x" * 60 + "<article>y</article>", ["y"]),
    # Names are compared whole: not inside values, nor inside other names. Of two of one name the first holds.
    ('<article><p>See <a href="/hidden/gems">these places</a> today</p></article>', ["See these places today"]),
    ('<article><p title="hidden gem">Body text one</p><p aria-hidden="false">two</p></article>', ["Body text one", "two"]),
    ('<article><div data-id="share">Body</div><a href="?id=search">linked words</a></article>', ["Body", "linked words"]),
    ('<article><p data-class=ad x-role=navigation>a</p><p id = "share">b</p><p class=lead class=ad>c</p><p class=ad class=lead>d</p></article>', ["a", "c"]),
    ("<article><p hidden>a<p hidden=until-found>b<p HIDDEN=''>c<p ROLE='Search'>d<p/hidden>e<p =class=ad>f</article>", ["b", "f"]),
])
def test_skips_end_as_html_ends_elements(page, blocks):
    assert html_text.page_blocks(page) == (blocks, "<article" in page)


def brute_repeated(streams, least, long):
    where = {}
    for i, s in enumerate(streams):
        for k in range(len(s) - long + 1):
            where.setdefault(tuple(s[k : k + long]), set()).add(i)
    out = []
    for s in streams:
        hit = np.zeros(len(s), bool)
        for k in range(len(s) - long + 1):
            if len(where[tuple(s[k : k + long])]) >= least:
                hit[k : k + long] = True
        out.append(hit)
    return out


@pytest.mark.parametrize("long", [1, 2, 5, 8])
def test_repeated_runs_equal_brute_force(long):
    rng = np.random.default_rng(long)
    streams = [rng.integers(0, 3, int(n)) for n in rng.integers(0, 30, 12)]
    for mine, theirs in zip(html_text.repeated(streams, 3, long), brute_repeated(streams, 3, long), strict=True):
        assert (mine == theirs).all()


def test_open_pages_lose_host_boilerplate(spark):
    same = "read our terms of use before you go on here"
    rows = [(i, f"https://h.example/{i}", f"<p>unique words number {i} {i * 7} end{i}</p><p>{same}</p>") for i in range(6)] + [(50, "https://other.example/x", f"<p>{same}</p>"), (51, None, None), (52, "u", PAGE), (52, "u", PAGE)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"unique words number {i} {i * 7} end{i}" for i in range(6)) and got[50] == same and got[51] == ""
    assert got[52] == "Big é <b>\n\nOne two link more\n\na\n\nb"
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


PLAIN_SKIP = set("head nav aside footer form button select option svg canvas object dialog menu audio video script style textarea title noscript template iframe".split())
PLAIN_INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img input ins kbd label link mark meta q s samp small span strike strong sub sup time tt u var wbr".split())
PLAIN_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
PLAIN_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
PLAIN_WORDS = set("nav menu footer sidebar aside ad ads advert promo banner cookie notice newsletter share social related comment comments breadcrumb breadcrumbs widget".split())


class PlainPage(HTMLParser):
    """The article of a page whose skipped elements have end tags, by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.blocks, self.parts, self.depth, self.skipped, self.inner = [], [], 0, "", 0
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text and self.depth:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if self.skipped:
            self.inner += tag == self.skipped
            return
        if tag not in PLAIN_INLINE:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        marks = {w for k, v in attrs if k in ("class", "id") for w in re.split("[^a-z0-9]+", (v or "").lower())}
        roles = {v for k, v in attrs if k == "role"}
        if tag in PLAIN_VOID:
            return
        if tag in PLAIN_SKIP or tag == "header" and not self.depth or (marks & PLAIN_WORDS or roles & PLAIN_ROLES) and not (tag == "article" and not self.depth):
            self.skipped, self.inner = tag, 1
        elif tag == "article":
            self.depth += 1

    def handle_endtag(self, tag):
        if self.skipped:
            self.inner -= tag == self.skipped
            if not self.inner:
                self.skipped = ""
            return
        if tag not in PLAIN_INLINE:
            self.flush()
        if tag == "article" and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.skipped:
            self.parts.append(data)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test data")
def test_query_equals_a_plain_parser(spark):
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.op9_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    want = {k: "\n\n".join(PlainPage(v).blocks) for k, v in pages.items()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


@pytest.mark.parametrize("group_pages", [500, 4])
def test_every_page_goes_through_the_host_array(spark, group_pages):
    """Articles keep what the array calls repeated; what stands around them tells it about open pages; what stands in them does not."""
    note, passage = "follow all of our stories each day on this site", "a passage of ten words that many articles have here"
    rows = [(i, f"https://mixed.example/{i}", f"<div><p>{note}</p></div><article><p>own text of article {i}</p><p>{passage}</p>" + (f"<p>{note}</p>" if i == 3 else "") + "</article>") for i in range(9)]
    rows += [(20, "https://mixed.example/open", f"<p>{note}</p><p>{passage}</p><p>left open</p>"), (30, "https://few.example/open", f"<p>{note}</p>")]
    rows += [(31, "https://few.example/1", f"<p>{note}</p><article>x</article>"), (32, "https://few.example/2", "<article></article><p>y</p>")]
    dealt = html_text.dealt_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), group_pages)
    got = {r["page_id"]: ("|".join(r["blocks"]), r["n_repeated"]) for r in html_text.judged_pages(dealt).collect()}
    want = {i: (f"own text of article {i}|{passage}", 0) for i in range(9)} | {3: (f"own text of article 3|{passage}|{note}", 1)}
    assert got == want | {20: (f"{passage}|left open", 0), 30: (note, 0), 31: ("x", 0), 32: ("", 0)}
    if group_pages == 4:
        assert dealt.filter("url LIKE '%mixed%'").agg({"part": "max"}).first()[0] > 0


def test_large_host_counts_over_its_parts(spark):
    rng, n = np.random.default_rng(7), 3 * html_text.GROUP_PAGES
    footer, rare, twice = ["foot%d" % i for i in range(9)], ["rare%d" % i for i in range(10)], ["two%d" % i for i in range(8)]
    pages = []
    for i in range(n):
        words = ["w%d" % k for k in rng.integers(0, 10**6, 12)]
        pages.append(words + (footer if i % 25 == 0 else []) + (rare if i in (3, 700, 1400) else []) + (twice if i in (9, 1200) else []))
    codes = {}
    streams = [[codes.setdefault(w, len(codes)) for w in p] for p in pages]
    gone = brute_repeated(streams, html_text.MIN_PAGES, html_text.LONG)
    rows = [(i, f"https://big.example/{i}", f"<p>{' '.join(p[:12])}</p>" + (f"<p>{' '.join(p[12:])}</p>" if len(p) > 12 else "")) for i, p in enumerate(pages)]
    again = [rows[9]] * 4
    got = html_text.main_text(spark.createDataFrame(rows + again, "page_id long, url string, html string")).collect()
    assert len(got) == n + 4
    for r in got:
        i = r["page_id"]
        blocks = [pages[i][:12]] + ([pages[i][12:]] if len(pages[i]) > 12 else [])
        marks = [gone[i][:12], gone[i][12:]]
        assert r["text"] == "\n\n".join(" ".join(b) for b, m in zip(blocks, marks, strict=False) if not len(m) or m.mean() < html_text.COVERED)
    assert sum(int(g.sum()) for g in gone) == 60 * 9 + 3 * 10


def test_articles_of_a_large_open_host_stay_whole(spark):
    """Ten thousand open pages: phrases of eight words that hundreds of articles share cost them nothing, menus and footers go."""
    rng, n = np.random.default_rng(11), 10_000
    phrases = [" ".join("p%d" % k for k in rng.integers(0, 400, 8)) for _ in range(40)]
    menu, footer = "<ul>" + "".join(f"<li>section {k} of the site" for k in range(6)) + "</ul>", "<p>all rights are reserved by the owner of this host since long ago</p>"
    rows, want = [], []
    for i in range(n):
        article = [" ".join(["w%d" % k for k in rng.integers(0, 10**6, 12)] + [phrases[int(rng.integers(40))]] + ["w%d" % k for k in rng.integers(0, 10**6, 9)]) for _ in range(2)]
        rows.append((i, f"https://large.example/{i}", menu + "".join(f"<p>{a}</p>" for a in article) + footer))
        want.append("\n\n".join(article))
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(n)] == want
    story = [(i, f"https://h.example/s{i}", f"<p>Story {i} said the quick brown fox jumps over the lazy dog and left {i * 13}</p>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(story, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} said the quick brown fox jumps over the lazy dog and left {i * 13}" for i in range(3))


# The pipeline ---------------------------------------------------------------------------------


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test data")
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == names
        n = out.count()
        assert n <= before if name != "mixing" else n > 0
        docs, before = spark.createDataFrame(out.collect(), docs.schema), n
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.filter("length > 2048 OR length < 1").count() == 0
    per_doc = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert per_doc.filter("n % t <> 0").count() == 0


DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, mix_copies int, near_order int"


def stage_docs(spark):
    """Good prose, copies and near copies of it, toxic prose, and rows that are odd in one way each; columns with the names the stages use."""
    rng = np.random.default_rng(11)
    prose = lambda seed: " ".join(f"word{x}" + ("." if k % 9 == 8 else "") for k, x in enumerate(np.random.default_rng(seed).integers(0, 900, 60)))
    rows = [(i, prose(i) + (" vile filth" if i % 5 == 0 else ""), "en", f"s{i % 3}", 1) for i in range(120)]
    rows += [(200, prose(1), "en", "s1", 1), (201, prose(1).replace("word", "Word", 1) + " more", "en", "s2", 1), (202, None, "en", "s0", None), (203, "", None, None, 0), (204, " \n ", "en", "s9", 3), (205, prose(7), None, None, None), (205, prose(7), None, None, None),
             (None, prose(301), "en", "s0", 5), (206, " ".join(prose(k) for k in range(400, 480)), "en", "s0", 9)]
    order = rng.permutation(len(rows)).tolist()
    docs = spark.createDataFrame([(*rows[i], "mine", 0.5, 7, 9) for i in order], DOC)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    docs, labels = stage_docs(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stages, folder = dict(corpus_pipeline.STAGES), f"file://{tmp_path}"
    run = lambda name, d: stages[name](spark, d, folder)
    ids = lambda d: sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in d.select("doc_id").collect())

    good = run("quality", docs)
    assert good.columns == docs.columns and not {202, 203, 204} & set(ids(good)) and ids(good).count(205) in (0, 2)

    mild = run("toxicity", docs)
    assert mild.columns == docs.columns
    vile = {i for i in range(0, 120, 5)}
    assert len(vile & set(ids(mild))) <= 3 and {202, 203, 204, -1, 206} <= set(ids(mild)) and len(set(range(120)) - vile - set(ids(mild))) <= 2 and ids(mild).count(205) == 2
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.clean(docs, nothing).count() == docs.count()

    single = run("near_duplicates", docs)
    brute = {d: c for d, c, _ in brute_classes([(r["doc_id"], r["text"]) for r in docs.filter("doc_id IS NOT NULL").collect()])}
    wordless = {202, 203, 204}
    assert single.columns == docs.columns and ids(single) == sorted([-1] + [d for d, c in brute.items() if c == d or d in wordless])

    mixed = run("mixing", docs)
    assert mixed.columns == docs.columns and 204 not in ids(mixed) and ids(mixed).count(205) % 2 == 0 and ids(mixed) == ids(run("mixing", docs))

    pieces = run("packing", docs)
    w = packing.WordIds(packing.vocabulary_path())
    expected = {}
    for r in docs.collect():
        expected[r["doc_id"]] = expected.get(r["doc_id"], 0) + len(w.ids(r["text"] or ""))
    got = {r["doc_id"]: r["n"] for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == expected

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_pipeline_equals_its_stages(spark, tmp_path):
    """run() is the stages one after the other, and each decision takes effect."""
    import corpus_pipeline

    docs, labels = stage_docs(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    folder = f"file://{tmp_path}"
    step = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, step, folder).write.parquet(str(tmp_path / f"step{k}"))
        step = spark.read.parquet(str(tmp_path / f"step{k}"))
    want = corpus_pipeline.STAGES[-1][1](spark, step, folder)
    per_doc = lambda d: sorted((r["doc_id"] or -1, r["n"], r["c"]) for r in d.groupBy("doc_id").agg(F.sum("length").alias("n"), F.count_if(F.col("start") == 0).alias("c")).collect())
    got = per_doc(corpus_pipeline.run(spark, folder))
    assert got == per_doc(want) and got
    copies = {r["doc_id"] or -1: r["count"] for r in step.groupBy("doc_id").count().collect()}
    assert {d: c for d, _, c in got} == copies
