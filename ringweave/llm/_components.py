"""Connected components over a table of links, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Tables


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """node, label (the smallest node reachable) for every node that a link (a, b) names.

    Each round takes the smallest label among the neighbours and then the label of that label, so the
    rounds grow with the logarithm of a component's width. A node with very many links is aggregated
    on the map side and joined by a join that can be split. State is written to the shared folder; what later
    rounds don't read is removed.
    """
    tables = Tables(links.sparkSession)
    both = tables.keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "both")
    labels = tables.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    for _ in range(rounds):
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        own = labels.join(seen, labels.node == seen.a, "left").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("root"), F.col("label").alias("further"))
        new = tables.keep(own.join(jump, own["to"] == jump["root"], "left").select("node", F.least("to", "further").alias("label"), "was"), "labels")
        tables.drop_all_but("labels")
        moved = new.where("label <> was").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            tables.drop("both")
            return labels
    raise RuntimeError(f"components need more than {rounds} rounds")
