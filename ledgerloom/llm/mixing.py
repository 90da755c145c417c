"""Mixing sources to target weights.

Words are counted per source, each source gets a target, and target / words is the source's
repetition rate. Every document is then taken floor(rate) times, plus one more time if a hash of
its id, read as a number in [0, 1), is below a threshold. The threshold of a source is the place in
hash order up to which its documents hold the fraction of its words that is due: the fraction
itself on many documents, and near the target also on few long ones. There is one seed.

Defined results: null text counts no words; a null source is a source of its own (last in the
order of sources); a source without words has rate 0; rows with equal ids share one decision;
an empty table gives an empty mix. Columns that docs has besides are carried along unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh, materialize, table, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
#: Steps of the hash at which a threshold can lie.
STEPS, STRETCH = 1 << 16, 1 << 8


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, null last, take the weights in turn and share `share` times all
    words. A target stops at cap times its source's words and what is over goes to the others by
    weight, until none is above. That end state is target = least(limit, level * weight): going
    up the order of limit / weight, the level is the first one that does not fill its source.
    The window has one row per source, never one per document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = sizes.select("source", "source_size", F.row_number().over(by_name).alias("at"))
    rows = rows.withColumns({
        "weight": F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("at") - 1) % len(weights) + 1).cast("int")).cast("double"),
        "limit": F.col("source_size") * F.lit(cap),
    })
    up = Window.orderBy(F.col("limit") / F.col("weight"), "at")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "place": F.row_number().over(up),
        "level": (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    })
    open_place = F.when(F.col("level") * F.col("weight") < F.col("limit"), F.col("place"))
    rows = rows.withColumn("first_open", F.min(open_place).over(everything))
    rows = rows.withColumn("found", F.max(F.when(F.col("place") == F.col("first_open"), F.col("level"))).over(everything))
    target = F.when(F.col("found").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("found") * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target"))


def draw(key: Column, seed: str = SEED, steps: int = STEPS) -> Column:
    """The step, from 0 to steps - 1, at which a key lies in hash order: 52 bits of an MD5 of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.floor(F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52 / steps)).cast("int")


def _rate(target: Column, size: Column) -> Column:
    return F.when(size > 0, target / size).otherwise(F.lit(0.0))


def with_thresholds(targets: DataFrame, steps: DataFrame) -> DataFrame:
    """targets with whole (copies that every document gets) and below (documents of earlier steps get one more).

    steps: source, step, size, words summed per step of the hash, STEPS rows a source at most. Words
    are cumulated inside stretches of steps and over the stretches of a source, so no task has all
    steps of one. Of the places between two steps that is taken at which the words before it come
    closest to what is due.
    """
    stretch = F.floor(F.col("step") / STRETCH).cast("int").alias("stretch")
    inside = Window.partitionBy("source", "stretch").orderBy("step")
    before = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    over = steps.groupBy("source", stretch).agg(F.sum("size").alias("words")).select(
        F.col("source").alias("s"), F.col("stretch").alias("k"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("earlier"))
    sums = steps.select("source", "step", stretch, "size").withColumn("words", F.sum("size").over(inside))
    sums = sums.join(over, F.col("source").eqNullSafe(F.col("s")) & (F.col("stretch") == F.col("k"))).select("source", "step", (F.col("words") + F.col("earlier")).alias("words"))
    # Before the first step there are no words.
    places = sums.select("source", (F.col("step") + 1).alias("below"), "words").unionByName(
        steps.select("source").distinct().select("source", F.lit(0).alias("below"), F.lit(0).cast("long").alias("words")))
    rate = _rate(F.col("target"), F.col("source_size"))
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target", F.floor(rate).cast("int").alias("whole"))
    due = F.col("target") - F.col("whole") * F.col("source_size")
    rows = places.join(t, F.col("source").eqNullSafe(F.col("t_source")))
    off = F.struct(F.abs(F.col("words").cast("double") - due), "below")
    return rows.groupBy("t_source", "source_size", "target", "whole").agg(F.min_by("below", off).alias("below")).withColumnRenamed("t_source", "source")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words) of docs, written out: the one pass over the texts."""
    return materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")


def source_rates(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """source, source_size, target, whole, below: what sizes (doc_id, source, size) says about its sources. Written out, so joins see its true size."""
    steps = materialize(sizes.groupBy("source", draw(F.col("doc_id"), seed).alias("step")).agg(F.sum("size").alias("size")), "mix-steps")
    targets = source_targets(steps.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    return materialize(with_thresholds(targets, steps), "mix-rates")


def plan(rows: DataFrame, rates: DataFrame, seed: str = SEED, prefix: str = "mix_") -> DataFrame:
    """rows (doc_id, source and any others) with {prefix}source_size, {prefix}target and {prefix}copies, also for documents taken 0 times."""
    total, target, copies, key, whole, below = fresh(rows, *[prefix + c for c in ("source_size", "target", "copies", "key", "whole", "below")])
    r = rates.select(F.col("source").alias(key), F.col("source_size").alias(total), F.col("target").alias(target), F.col("whole").alias(whole), F.col("below").alias(below))
    joined = rows.join(r, rows["source"].eqNullSafe(F.col(key)), "left")
    return joined.withColumn(copies, F.col(whole) + F.when(draw(F.col("doc_id"), seed) < F.col(below), 1).otherwise(0)).drop(key, whole, below)


def mix(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The mix itself: the columns of docs, each row as often as it is taken."""
    copies, turn = fresh(docs, "mix_copies", "mix_turn")
    planned = plan(docs, source_rates(sized(docs), seed=seed, **options), seed).filter(F.col(copies) > 0)
    return planned.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sized(table(spark, sf_dir, "documents"))
    return plan(sizes, source_rates(sizes)).select(
        "doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("size") * F.col("mix_copies")).alias("taken"))


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS pos
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([3, 1, 2])[((pos - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap_words FROM sources
), ranked AS (
  SELECT *, row_number() OVER up AS place,
         (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
          - coalesce(sum(cap_words) OVER (ORDER BY cap_words / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER ()
          - coalesce(sum(weight) OVER (ORDER BY cap_words / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed WINDOW up AS (ORDER BY cap_words / weight, pos)
), found AS (
  SELECT min_by(level, place) AS level FROM ranked WHERE level * weight < cap_words
), targets AS (
  SELECT source, source_size, CASE WHEN found.level IS NULL THEN cap_words ELSE least(cap_words, found.level * weight) END AS target
  FROM ranked CROSS JOIN found
), rated AS (
  SELECT source, source_size, target, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END)::INT AS whole FROM targets
), drawn AS (
  SELECT *, floor((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE * 65536.0::DOUBLE)::INT AS step FROM sized
), places AS (
  SELECT source, step + 1 AS below, sum(sum(size)) OVER (PARTITION BY source ORDER BY step) AS words FROM drawn GROUP BY source, step
  UNION ALL SELECT DISTINCT source, 0, 0 FROM drawn
), chosen AS (
  SELECT r.source, source_size, target, whole, arg_min(below, struct_pack(o := abs(words::DOUBLE - (target - whole * source_size)), b := below)) AS below
  FROM places p JOIN rated r ON p.source IS NOT DISTINCT FROM r.source GROUP BY ALL
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN step < below THEN 1 ELSE 0 END))::BIGINT AS taken
FROM drawn d JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source
"""
