"""Connected components of a small-diameter graph by repeated minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vialens.operators.stored import discard, stored


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``node, root`` (the least node reachable), for ``nodes`` (node) and ``edges`` (a, b, both ways given).

    Each round a node takes the least root among its own and its neighbours', and its root's root (which halves long paths).
    Each round is written and the one before deleted; they end when no root changes.
    """
    edges = stored(edges.select("a", "b").distinct(), "edges")
    labels = stored(nodes.select("node", F.col("node").alias("root")).distinct(), "labels")
    for _ in range(most_rounds):
        heard = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("heard"))
        new = labels.join(heard, F.col("node") == F.col("a"), "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("heard", "root")).alias("root"))
        up = new.select(F.col("node").alias("up"), F.col("root").alias("higher"))
        new = new.join(up, F.col("root") == F.col("up"), "left").select("node", "old", F.least("root", F.coalesce("higher", "root")).alias("root"))
        new = stored(new, "labels")
        discard(labels)
        if new.where("root <> old").isEmpty():
            discard(edges)
            return new.select("node", "root")
        labels = new.select("node", "root")
    raise RuntimeError("components did not settle")
