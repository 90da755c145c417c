"""Quality rules as weak supervision.

Each rule looks at one signal of a text and votes good (1), bad (-1) or abstains (0). How far a
vote is to be trusted is estimated without labels by expectation-maximisation: per rule, how often
it votes bad on bad and on good texts. The posterior probability that a text is good then decides,
in place of a demand that all rules pass.

The estimation sees only how often each pattern of votes occurs, at most 3 ** rules rows however
many documents there are.

Defined results: null text has no words, and like any text of under 10 words it is rejected;
repeated rows are judged alike; in an empty table the estimates are the priors. Columns of docs are
carried along; the ones added start with a prefix that can be chosen.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh, materialize, table, words

WINDOW = 5
ROUNDS = 12
#: Prior weight as a share of all documents, and prior means: bad votes on bad and on good texts, good texts.
PRIOR_SHARE, PRIOR_BAD, PRIOR_FALSE, PRIOR_GOOD = 0.02, 0.2, 0.005, 0.8
MIN_WORDS, MAX_REPEATED = 10, 20
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Signals that only the rules use.
MORE = ("n_lines", "n_closed_lines", "n_bar_lines", "n_upper", "n_shouts")
CLOSING = (".", "!", "?", '"', "…", "。")


def _removed(text: Column, pattern: str) -> Column:
    """Characters of a class in text."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def with_signals(docs: DataFrame, text: str = "text", prefix: str = "q_") -> DataFrame:
    """docs with the counts of BASE and MORE, one long column each, all from the row's own text.

    Repeats are found inside the row: the hashes of all five-word windows, sorted with their
    places, put equal windows side by side; a word counts once, however many such windows cover it.
    Rows in which all windows differ, which most are, skip the sort.
    """
    names = fresh(docs, *[prefix + n for n in (*BASE, *MORE)])
    at = dict(zip((*BASE, *MORE), names, strict=True))
    t, w, lines, windows, order, starts = fresh(docs, *[prefix + n for n in ("text", "words", "lines", "windows", "order", "starts")])
    c = F.col
    out = docs.withColumn(t, F.coalesce(c(text), F.lit("")))
    out = out.withColumns({w: words(c(t)), lines: F.filter(F.split(c(t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    n = F.size(w)
    out = out.withColumn(windows, F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(c(w), i + k) for k in range(WINDOW)]))))
    paired = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn(order, F.when(F.size(F.array_distinct(windows)) < F.size(windows), paired))
    twin = lambda x, k: (F.get(c(order), k + 1)["h"] == x["h"]) | (F.get(c(order), k - 1)["h"] == x["h"])
    out = out.withColumn(starts, F.sort_array(F.transform(F.filter(order, lambda x, k: F.coalesce(twin(x, k), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(c(starts), k + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda acc, x: acc + x)
    closed = lambda x: reduce(lambda a, b: a | b, [F.rtrim(x, F.lit(" \t\x0b\x0c\r")).endswith(e) for e in CLOSING])
    out = out.withColumns({
        at["n_words"]: n.cast("long"),
        at["word_chars"]: F.length(F.array_join(w, "")).cast("long"),
        at["n_symbols"]: _removed(c(t), "[#*$%&|<>]+"),
        at["n_dup_lines"]: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        at["n_repeat_words"]: F.coalesce(covered, F.lit(0)).cast("long"),
        at["n_lines"]: F.size(lines).cast("long"),
        at["n_closed_lines"]: F.size(F.filter(lines, closed)).cast("long"),
        at["n_bar_lines"]: F.size(F.filter(lines, lambda x: x.contains("|"))).cast("long"),
        at["n_upper"]: _removed(c(t), "[A-ZÀ-ÖØ-Þ]+"),
        at["n_shouts"]: (F.length(t) - F.length(F.replace(c(t), F.lit("!"), F.lit("")))).cast("long"),
    })
    return out.drop(t, w, lines, windows, order, starts)


@dataclass(frozen=True)
class Rule:
    """Votes on numerator / denominator: good and bad are (at least, at most) bounds; with neither it abstains, as with a denominator under `least`."""

    name: str
    over: str
    under: str
    good: tuple[float, float]
    bad: tuple[tuple[float, float], ...]
    least: int = 1


ALL = float("inf")
RULES = (
    Rule("length", "n_words", "", (50, ALL), ((0, 9),)),
    Rule("word length", "word_chars", "n_words", (3.5, 6.5), ((0, 2.5), (7.5, ALL)), 20),
    Rule("symbols", "n_symbols", "n_words", (0, 0.02), ((0.1, ALL),)),
    Rule("equal lines", "n_dup_lines", "n_lines", (0, 0.1), ((0.3, ALL),), 8),
    Rule("repeats", "n_repeat_words", "n_words", (0, 0.05), ((0.2, ALL),), 30),
    Rule("capitals", "n_upper", "word_chars", (0, 0.15), ((0.4, ALL),)),
    Rule("shouting", "n_shouts", "n_words", (0, 0.05), ((0.2, ALL),)),
    Rule("bars", "n_bar_lines", "n_lines", (0, 0.02), ((0.1, ALL),)),
    Rule("closed lines", "n_closed_lines", "n_lines", (0.8, ALL), ((0, 0.4),), 3),
)


def _vote_sql(rule: Rule, prefix: str) -> str:
    """A rule as SQL that both engines read."""
    over, under = f"{prefix}{rule.over}", f"{prefix}{rule.under}" if rule.under else "1"
    value = f"(CAST({over} AS DOUBLE) / {under})"
    def inside(bounds: tuple[float, float]) -> str:
        low, high = bounds
        tests = [f"{value} >= CAST({low} AS DOUBLE)"] + ([f"{value} <= CAST({high} AS DOUBLE)"] if math.isfinite(high) else [])
        return "(" + " AND ".join(tests) + ")"
    enough = f"WHEN {under} < {rule.least} THEN 0 " if rule.under else ""
    return f"CASE {enough}WHEN {inside(rule.good)} THEN 1 WHEN {' OR '.join(map(inside, rule.bad))} THEN -1 ELSE 0 END"


def with_votes(scored: DataFrame, prefix: str = "q_", votes: str = "q_votes", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """scored, as with_signals returns it, with an array of votes."""
    return scored.withColumn(votes, F.array(*[F.expr(_vote_sql(r, prefix)) for r in rules]))


@dataclass(frozen=True)
class Model:
    """Share of good texts; per rule, how often its votes are bad on bad and on good texts."""

    good: float
    on_bad: tuple[float, ...]
    on_good: tuple[float, ...]

    def posterior(self, votes: str) -> Column:
        """Probability that a text with these votes is good."""
        total = F.lit(math.log(self.good / (1 - self.good)))
        for j, (s, f) in enumerate(zip(self.on_bad, self.on_good, strict=True)):
            vote = F.get(F.col(votes), F.lit(j))
            total = total + F.when(vote == -1, math.log(f / s)).when(vote == 1, math.log((1 - f) / (1 - s))).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(voted: DataFrame, votes: str = "q_votes", n_rules: int = len(RULES), rounds: int = ROUNDS) -> Model:
    """EM over the table of vote patterns; each round is one aggregate over at most 3 ** n_rules rows."""
    patterns = materialize(voted.groupBy(F.col(votes).alias("votes")).agg(F.count("*").alias("n")), "quality-patterns")
    model = Model(PRIOR_GOOD, (PRIOR_BAD,) * n_rules, (PRIOR_FALSE,) * n_rules)
    zero = F.lit(0.0)
    for _ in range(rounds):
        shared = patterns.withColumn("good", F.col("n") * model.posterior("votes")).withColumn("bad", F.col("n") - F.col("good"))
        sums = [F.coalesce(F.sum("n").cast("double"), zero), F.coalesce(F.sum("good"), zero)]
        for j in range(n_rules):
            vote = F.get(F.col("votes"), F.lit(j))
            for weight in ("bad", "good"):
                sums += [F.coalesce(F.sum(F.when(vote == -1, F.col(weight))), zero), F.coalesce(F.sum(F.when(vote != 0, F.col(weight))), zero)]
        total, n_good, *rest = shared.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        prior = PRIOR_SHARE * total + 1
        share = lambda hits, votes_cast, mean: (hits + prior * mean) / (votes_cast + prior)  # noqa: B023, E731
        model = Model(
            share(n_good, total, PRIOR_GOOD),
            tuple(share(*rest[4 * j : 4 * j + 2], PRIOR_BAD) for j in range(n_rules)),
            tuple(share(*rest[4 * j + 2 : 4 * j + 4], PRIOR_FALSE) for j in range(n_rules)),
        )
    return model


def judge(docs: DataFrame, text: str = "text", prefix: str = "q_", threshold: float = 0.5) -> DataFrame:
    """docs with its signals, {prefix}base_failed, {prefix}posterior and {prefix}kept.

    What is counted once per text is written to shared storage, as both the estimates and the
    verdicts need it.
    """
    (votes, failed, posterior, kept) = fresh(docs, *[prefix + n for n in ("votes", "base_failed", "posterior", "kept")])
    voted = materialize(with_votes(with_signals(docs, text, prefix), prefix, votes), "quality-votes")
    model = fit(voted, votes)
    base = (F.col(prefix + "n_words") < MIN_WORDS) | (100 * F.col(prefix + "n_repeat_words") > MAX_REPEATED * F.col(prefix + "n_words"))
    return voted.withColumns({failed: base, posterior: model.posterior(votes)}).withColumn(kept, ~F.col(failed) & (F.col(posterior) >= threshold)).drop(votes)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns of docs."""
    prefix = "q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return judge(docs, prefix=prefix).filter(F.col(prefix + "kept")).select(*docs.columns)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The signals alone are written, not the texts.
    voted = materialize(with_votes(with_signals(docs)).drop("text"), "quality-votes")
    model = fit(voted)
    base = (F.col("q_n_words") < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > MAX_REPEATED * F.col("q_n_words"))
    return voted.select("doc_id", *[F.col("q_" + n).alias(n) for n in BASE], base.alias("base_failed"), (~base & (model.posterior("q_votes") >= 0.5)).alias("kept"))


def _oracle() -> str:
    """The same in SQL for another engine: EM as a chain of one-row tables."""
    n = len(RULES)
    votes = ", ".join(f"{_vote_sql(r, '')} AS v{j}" for j, r in enumerate(RULES))
    names = ", ".join(f"v{j}" for j in range(n))
    def posterior(m: str) -> str:
        terms = [f"CASE v{j} WHEN -1 THEN ln({m}.f{j} / {m}.s{j}) WHEN 1 THEN ln((1 - {m}.f{j}) / (1 - {m}.s{j})) ELSE 0 END" for j in range(n)]
        return f"1 / (1 + exp(-(ln({m}.good / (1 - {m}.good)) + {' + '.join(terms)})))"
    first = ", ".join(f"{PRIOR_BAD}::DOUBLE AS s{j}, {PRIOR_FALSE}::DOUBLE AS f{j}" for j in range(n))
    steps = [f"m0 AS (SELECT {PRIOR_GOOD}::DOUBLE AS good, {first})"]
    for k in range(ROUNDS):
        share = lambda hit, cast, mean: f"(coalesce({hit}, 0) + prior * {mean}) / (coalesce({cast}, 0) + prior)"
        rates = ", ".join(
            f"{share(f'sum(n * (1 - r)) FILTER (WHERE v{j} = -1)', f'sum(n * (1 - r)) FILTER (WHERE v{j} <> 0)', PRIOR_BAD)} AS s{j}, "
            f"{share(f'sum(n * r) FILTER (WHERE v{j} = -1)', f'sum(n * r) FILTER (WHERE v{j} <> 0)', PRIOR_FALSE)} AS f{j}" for j in range(n))
        steps.append(f"e{k} AS MATERIALIZED (SELECT p.*, {posterior(f'm{k}')} AS r, {PRIOR_SHARE} * sum(n) OVER () + 1 AS prior FROM patterns p, m{k})")
        rates = rates.replace("prior", "any_value(prior)")
        steps.append(f"m{k + 1} AS MATERIALIZED (SELECT (sum(n * r) + any_value(prior) * {PRIOR_GOOD}) / (sum(n) + any_value(prior)) AS good, {rates} FROM e{k})")
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT row, i, array_to_string(w[i : i + 4], ' ') AS five FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twins AS (
  SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, five) > 1
), covered AS (
  SELECT row, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n_repeat_words
  FROM (SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS nxt FROM twins) GROUP BY row
), signals AS (
  SELECT d.row, doc_id, len(w)::BIGINT AS n_words, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '[.!?"…。][\x20\x09\x0B-\x0D]*$')))::BIGINT AS n_closed_lines,
         len(list_filter(lines, lambda x: contains(x, '|')))::BIGINT AS n_bar_lines,
         (length(text) - length(regexp_replace(text, '[A-ZÀ-ÖØ-Þ]+', '', 'g')))::BIGINT AS n_upper,
         (length(text) - length(replace(text, '!', '')))::BIGINT AS n_shouts
  FROM d LEFT JOIN covered USING (row)
), voted AS MATERIALIZED (SELECT *, {votes} FROM signals),
patterns AS MATERIALIZED (SELECT {names}, count(*)::DOUBLE AS n FROM voted GROUP BY {names}),
{", ".join(steps)}
SELECT doc_id, {", ".join(BASE)}, base_failed, NOT base_failed AND posterior >= 0.5 AS kept
FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed, {posterior(f"m{ROUNDS}")} AS posterior FROM voted, m{ROUNDS})
"""


OP5_SQL = _oracle()
