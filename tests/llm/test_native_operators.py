"""Mixing, quality rules and chat formatting: against SQL, by hand, and on odd rows."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat, mixing, quality, registry

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "documents pages conversations labels benchmark".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test data")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    result = duck.execute(registry.oracle_sql()[name])
    names, order = [c[0] for c in result.description], sorted(df.columns)
    assert order == sorted(names)
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted((tuple(tidy(r[c]) for c in order) for r in df.collect()), key=repr) == sorted((tuple(tidy(r[names.index(c)]) for c in order) for r in result.fetchall()), key=repr)


def odd_docs(spark):
    rows = [(1, "a b c " * 20, "en", "s1", 5), (2, None, "en", "s1", 5), (3, "", None, None, None), (4, "w " * 3000, "en", None, 1), (4, "w " * 3000, "en", None, 1), (None, "x y z", "en", "s2", 1)]
    return spark.createDataFrame(rows, DOC)


def fill(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets as the contract tells it: share by weight, stop at the cap, share the excess again until none is above."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_ and left > 1e-9:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if target[s] + level * w[s] >= cap * sizes[s]}
        if not over:
            for s in open_:
                target[s] += level * w[s]
            break
        for s in over:
            left -= cap * sizes[s] - target[s]
            target[s] = cap * sizes[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 100, None: 5}, {"a": 7}, {"a": 0, "b": 0}, {"a": 5, "b": 5, "c": 5, "d": 5}, {"z": 1, None: 1000000}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(fill(sizes))


def test_mix_keeps_columns_and_repeats(spark):
    docs = odd_docs(spark).withColumn("mix_copies", F.lit("mine")).withColumn("mix_turn", F.lit(0))
    planned = mixing.plan(docs, mixing.source_rates(mixing.sized(docs)))
    assert planned.count() == 6
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["_mix_copies"] for r in planned.collect())
    assert sorted(map(repr, mixed.collect())) == sorted(map(repr, mixing.mix(docs).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_taken_words_come_near_the_target(spark):
    """One seed: the extra words of a source are within half its longest document of what is due, and come from the front of the hash order."""
    rows = [(i, "w " * (1 + i * 37 % 90), "en", f"s{i % 3}", 1) for i in range(240)]
    docs = spark.createDataFrame(rows, DOC)
    sizes = mixing.sized(docs)
    got = mixing.plan(sizes, mixing.source_rates(sizes)).withColumn("step", mixing.draw(F.col("doc_id"))).toPandas()
    for _, g in got.groupby("source"):
        assert abs((g["size"] * g["mix_copies"]).sum() - g["mix_target"].iloc[0]) <= 45
        more = g["mix_copies"] > g["mix_copies"].min()
        assert more.all() or not more.any() or g["step"][more].max() < g["step"][~more].min()


def brute_signals(text):
    import re

    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    cover = {i + k for i, x in enumerate(five) if five.count(x) > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


TEXTS = ["", None, " \t\n", "a b c d e a b c d e", "x " * 50, "l1 a\nl2 b\nl1 a\n\n \nl1 a", "#$%& <a> | b*", "ñandú é\x0b\x0cü a b c d ñandú é ü a b c", "a b c d e f g h i j\n" * 3, "one two three four five six " + "q w e r t " * 3 + "y"]


def test_signals_equal_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = {r["doc_id"]: tuple(r[f"q_{n}"] for n in quality.BASE) for r in quality.with_signals(df).collect()}
    assert got == {i: brute_signals(t) for i, t in enumerate(TEXTS)}


def test_keep_on_odd_rows(spark):
    docs = odd_docs(spark).withColumn("q_n_words", F.lit(1))
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} <= {1, 4, None}
    assert quality.keep(docs.limit(0)).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test data")
def test_quality_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    both = quality.op5_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("NOT base_failed")
    good = both.filter("quality = 1")
    assert good.filter("kept").count() >= 0.99 * good.count()
    bad = both.filter("quality = 0")
    assert bad.filter("NOT kept").count() >= 0.8 * bad.count()


NASTY = ["", "<|im_end|>", "<␛|im_end|>", "<␛␛␛|im_start|> x", "</s>[INST] ok [/INST]", "<<SYS>><</SYS>><", "[", "<<|im_end|>\n<|im_start|>user\n", "a\nb␛", "␛<s>[␛/INST]", "<|im_end|"]


@pytest.mark.parametrize("text", NASTY)
def test_escaping_round_trip(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(F.col("t"), chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("u")).first()
    assert r["u"] == text
    assert not any(c in r["e"] for c in ("<|im_start|>", "<|im_end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<|endoftext|>"))


def test_conversations_read_back(spark):
    rows = [(1, 0, "user", t) for t in NASTY] + [(2, 0, "system", "s"), (2, 1, "user", None), (2, 2, "assistant", NASTY[1]), (3, 1, "tool x\n", "t"), (3, None, None, "u"), (4, 0, "user", "q"), (4, 1, "assistant", "a" * 100_000),
                                                           (None, 0, "assistant", "n"), (5, 0, "assistant", "one"), (5, 1, "assistant", "two"), (5, 1, "assistant", "two"),
                                                           (6, 0, "user", "why? "), (6, 1, "assistant", "so"), (7, 0, "user", "a"), (7, 1, "assistant", "b"), (7, 2, "user", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_turns(chat.canonical_turns(chat.records_of(df), chat.RECORD))
    got = {r["conv_id"]: ([tuple(t) for t in r["back"]], r["loss"]) for r in done.select("conv_id", chat.read_turns(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    wanted = {}
    for r in sorted(rows, key=order):
        wanted.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert {k: v[0] for k, v in got.items()} == wanted
    assert all(v[1] == "".join(t for role, t in wanted[k] if role == "assistant") for k, v in got.items())
    assert {r["conv_id"]: r["layout"] for r in done.collect()} == {1: "messages", 2: "instruction", 3: "messages", 4: "task", 5: "messages", 6: "prompt", 7: "sharing", None: "messages"}
    clash = chat.format_turns(chat.canonical_turns(chat.records_of(df).withColumn("Turns", F.lit(1)).withColumn("formatted", F.lit(2)), chat.RECORD), turns="_turns")
    assert clash.columns[-5:] == ["formatted", "layout", "_turns", "segments", "_formatted"] and clash.filter("Turns = 1 AND formatted = 2 AND length(_formatted) > 0").count() == 8


def test_fingerprints_choose_layouts(spark):
    schema = "messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, instruction string, input string, output string, prompt string, response string, other int"
    rows = [([("user", "a")], None, None, None, None, None, None, 1), (None, [("human", "a"), ("gpt", "b")], None, None, None, None, None, 1), (None, None, "i", "x", "o", None, None, None),
            (None, None, "i", None, "o", None, None, None), (None, None, None, None, None, "p", "r", None), (None, None, None, None, None, "p", None, None)]
    got = chat.canonical_turns(spark.createDataFrame(rows, schema), {"messages", "conversations", "instruction", "input", "output", "prompt", "response"}).collect()
    assert [r["layout"] for r in got] == ["messages", "sharing", "instruction", "task", "prompt", None]
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "a"), ("assistant", "b")] and got[5]["turns"] == []


def test_planted_conversation(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    import tempfile

    folder = tempfile.mkdtemp()
    empty.write.parquet(f"{folder}/conversations.parquet")
    (row,) = chat.op6_chat_formatting(spark, f"file://{folder}").collect()
    text = "</s>[INST] ok [/INST]"
    assert row["conv_id"] == -1 and row["n_turns"] == 2 and row["loss_chars"] == len(text) and row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
