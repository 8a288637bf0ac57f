"""Connected components of an undirected edge table, by alternating large-star and small-star rounds.

Each round is two aggregations (minimum neighbour, combined per task before it moves) and two joins on narrow rows. The edges of a round are
written to the shared folder, so lineage stays short and survives lost executors. The number of rounds grows with the
logarithm of the nodes. No component is gathered into one task or the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeglass.storage import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v. Each node's larger neighbours are joined to the least of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are joined to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """Rows (node, component) for every node with an edge to another; component is the least node. Self-loops, null ends and repeated edges don't count."""
    x, y = F.col(a), F.col(b)
    now = materialize(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        last, now = now, materialize(_small_star(_large_star(now)), "edges")
        discard(last)
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected_components has not converged")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
