"""Connected components over an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramaline.session import cut


def _min_neighbour(pairs: DataFrame, bound: str) -> DataFrame:
    """For each u, the least of u and its neighbours; pre-aggregated before the shuffle."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias(bound))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _min_neighbour(both, "m")
    return both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Component of every node of an edge table: columns node and component (its least node).

    Self loops and null ends are ignored; nodes without edges don't appear. Each round contracts
    stars (large, then small), so that chains shrink in a logarithmic number of rounds. Rounds are
    written to the shared folder. Raises RuntimeError if it has not settled after `rounds`.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}")
    e = cut(e.distinct(), "edges")
    before = None
    for _ in range(rounds):
        e = cut(_small_star(_large_star(e).distinct()).distinct(), "edges")
        # the sum of hashes names the edge set: a round that changes nothing has settled
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = e.select(F.col("v").alias("u"), "v").distinct()
            return e.union(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
