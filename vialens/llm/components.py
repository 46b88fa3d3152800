"""Connected components of a link table by alternating large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vialens.llm.common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round on edges (a, b). Minima are aggregated before the shuffle and joined back, so a hub with a third of
    all links costs a skewed join (which Spark splits), never one task's memory."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if large:  # every larger neighbour is linked to the least of the neighbourhood
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # every smaller neighbour, and the node itself, is linked to the least
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, tag: str = "components", most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of the edges (``a``, ``b``: longs), the root being the least node reachable.

    Loops and repeated edges do no harm; no edges give no rows. Rounds go on until the edges no longer change, which
    their count and the sum of their hashes show.
    """
    edges = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b").distinct(), tag)
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    seen = None
    for _ in range(most_rounds):
        before, edges = edges, written(_star(_star(edges, large=True), large=False), tag)
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first()
        if seen == tuple(now):
            break
        seen = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
