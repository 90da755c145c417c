"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, release


SALTS = 16


def follow(rows: DataFrame, column: str, points: DataFrame, salt: str) -> DataFrame:
    """rows with `column` replaced by where points (node, to) leads from it; what points does not know stays.

    A hub is the value of many rows: each row takes one of SALTS copies of its pointer, chosen by its column `salt`.
    """
    ahead = points.select(F.col("node").alias("_at"), F.col("to").alias("_beyond"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = rows.withColumn("_s", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    joined = salted.join(ahead, (F.col(column) == F.col("_at")) & (F.col("_s") == F.col("_salt")), "left")
    return joined.withColumn(column, F.coalesce("_beyond", column)).select(*rows.columns)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); a component is named by its smallest node.

    Each round, every node points to the smallest of itself and its neighbours, the pointers are
    followed twice over, and the edges move to where their ends point; edges inside one point go.
    So the edges at least halve as trees grow, and the rounds are logarithmic in the longest path.
    Rounds are written to shared storage. All steps are aggregates, whose partial sums shrink a
    hub's edges before any shuffle, and equi-joins in which a hub's rows are salted.
    """
    spark = edges.sparkSession
    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    open_edges = materialize(both, "component-edges")
    known = None
    while not open_edges.isEmpty():
        sides = open_edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionAll(open_edges.select(F.col("b").alias("node"), F.col("b").alias("to")))
        points = materialize(sides.groupBy("node").agg(F.min("to").alias("to")), "component-points")
        for _ in range(2):
            # Only nodes that are pointed to need be looked up.
            asked = points.select(F.col("to").alias("node")).distinct()
            before, points = points, materialize(follow(points, "to", points.join(asked, "node", "left_semi"), "node"), "component-points")
            release(before)
        old = known
        known = points if known is None else materialize(follow(known, "to", points, "node"), "component-known")
        moved = follow(follow(open_edges, "a", points, "b"), "b", points, "a")
        moved = moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        before, open_edges = open_edges, materialize(moved.filter("a <> b").distinct(), "component-edges")
        release(before, old, None if known is points else points)
    release(open_edges)
    if known is None:
        return spark.createDataFrame([], "node long, component long")
    return known.select("node", F.col("to").alias("component"))
