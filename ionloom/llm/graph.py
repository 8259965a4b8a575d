"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.session import let_go, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, u: str, v: str, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has a link; the component is its smallest node.

    Alternating large-star and small-star steps until every node points at its smallest one. A hub costs
    a join row per link, never a list; each round is stored, so a lost executor costs a re-read. After each round the
    driver lets go of what the round has broadcast and shuffled.
    """
    now = materialise(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(most_rounds):
        now = materialise(_small_star(_large_star(now)).distinct())
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = state
        let_go(now.sparkSession)
    raise RuntimeError("the components did not settle; raise most_rounds")
