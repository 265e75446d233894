"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, for every node of ``edges`` (``a``, ``b``).

    Each round takes the least label among neighbours, then the label of that label (pointer jumping), so
    rounds grow with the logarithm of the longest chain; labels are written to the shared folder each round.
    Loops and repeated edges do no harm; without edges the result is empty.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a is not null and b is not null").distinct(), "edges")
    least = both.groupBy("a").agg(F.min("b").alias("b"))
    labels = materialize(least.select(F.col("a").alias("node"), F.least("a", "b").alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        near = labels.join(seen, "node").select("node", "component", F.least("component", "l").alias("l"))
        above = labels.select(F.col("node").alias("l"), F.col("component").alias("up"))
        step = near.join(above, "l").select("node", F.least("l", "up").alias("component"), (F.least("l", "up") != F.col("component")).alias("moved"))
        now = materialize(step, "labels")
        discard(labels)
        labels = now.select("node", "component")
        labels._materialized_at = now._materialized_at
        if now.where("moved").isEmpty():
            discard(both)
            return labels
