"""Connected components of an edge table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import durable


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for every node of ``edges`` (a, b: numbers or strings); no edges give no rows.

    Each round takes the least label among the neighbours and then the label of that
    label, so long chains halve. Labels stay distributed and are checkpointed each
    round; the driver sees one count.
    """
    ends = edges.select("a", "b").where("a is not null and b is not null")
    both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    loops = both.select("a", F.col("a").alias("b"))
    both = durable(both.unionByName(loops).distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label"))
        old = labels.select("node", F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = near.join(jump, "label", "left").select("node", F.least("label", "next").alias("label"))
        moved = durable(moved.join(old, "node").select("node", "label", (F.col("label") != F.col("old")).alias("changed")))
        labels = moved.select("node", "label")
        if not moved.where("changed").limit(1).count():
            return labels
