"""Connected components of an undirected graph by alternating large-star and small-star steps.

Everything stays in DataFrames. Each round's edges are written to the shared folder, which cuts the lineage and
survives lost executors; the rounds grow with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.session import remove, written

ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its least neighbour, or to itself if it is less."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    larger = edges.select(F.col("a").alias("b"), F.col("b").alias("a")).filter("b > a").unionByName(edges.filter("b > a"))
    return larger.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its lesser neighbours to the least of them. Edges are (larger a, lesser b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the least node it reaches. Loops and repeats are allowed; null ends are not."""
    now = written(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = None
    for _ in range(ROUNDS):
        big = _large_star(now).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        new = written(spark, _small_star(big), "edges")
        seen = new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        remove(spark, now)
        now = new
        if mark == seen:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
