"""Connected components of a link table by distributed label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicell.llm.shared import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows ``(node, root)`` for every node in ``links``; ``root`` is the smallest node it can reach.

    Each round takes the smallest label among a node's neighbours (a map-side combined minimum) and then
    the label of that label, so chains shrink by halves.  Labels stay in the cluster; the driver only
    learns whether any label changed.  An empty link table gives an empty result.
    """
    edges = cut(
        links.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .union(links.select(F.col(b).alias("u"), F.col(a).alias("v")))
        .filter("u is not null and v is not null")
        .distinct()
    )
    labels = cut(edges.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("root")))
    while True:
        nearby = (
            edges.join(labels, edges.v == labels.node)
            .groupBy("u")
            .agg(F.min("root").alias("nearest"))
        )
        lower = labels.join(nearby, labels.node == nearby.u).select(
            "node", F.col("root").alias("before"), F.least("root", "nearest").alias("root")
        )
        above = labels.select(F.col("node").alias("up"), F.col("root").alias("up_root"))
        lower = cut(
            lower.join(above, lower.root == above.up, "left").select(
                "node", "before", F.least("root", F.coalesce("up_root", "root")).alias("root")
            )
        )
        if lower.filter("root <> before").isEmpty():
            return lower.select("node", "root")
        labels = lower.select("node", "root")
