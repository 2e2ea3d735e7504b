"""Connected components of a table of links, by smallest label and pointer jumping, without leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.session import drop, materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; ``component`` is the smallest node that links reach.

    Links may repeat, run either way and join a node with itself; rows with a null end are left out.
    Each round every node takes the smallest label around it and then that label's own label, so the number of
    rounds follows the logarithm of the longest chain.
    """
    ends = links.select(F.col(a).alias("node"), F.col(b).alias("other")).dropna()
    both = ends.unionByName(ends.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()
    both = materialize(both, "links")
    labels = both.groupBy("node").agg(F.least("node", F.min("other")).alias("component"))
    held = labels = materialize(labels, "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("seen")), "other")
        least = around.groupBy("node").agg(F.min("seen").alias("seen"))
        stepped = labels.join(least, "node").select(
            "node", F.col("component").alias("before"), F.least("component", "seen").alias("component")
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        stepped = stepped.join(jump, "component").select(
            "node", "before", F.least("component", "further").alias("component")
        )
        stepped = materialize(stepped, "labels")
        drop(held)
        held, labels = stepped, stepped.select("node", "component")
        if stepped.where(F.col("before") != F.col("component")).isEmpty():
            drop(both)
            return labels
