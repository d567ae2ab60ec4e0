"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.shared import stored


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest of u and its neighbours."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u, are linked to the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(u, component) of every id that edges (u, v) touch, component the smallest id reachable.

    Each round is written to the shared folder. Links of an id to itself and nulls are dropped; no edges give no rows.
    The number of rounds grows with the logarithm of a component's size; rounds is a safety stop, and going over it raises.
    """
    e = stored(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return e.select("u", F.col("v").alias("component")).union(e.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct())
        mark = now
        e = stored(_small_star(_large_star(e)).distinct(), "stars")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
