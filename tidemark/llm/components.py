"""Connected components of a graph of links, as a few joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small
from tidemark.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the least node of its component) for every node of ``links`` (``a, b``).

    Every round takes the least label among a node and its neighbours and then the label of that label,
    until no label changes; a star is done after one round, a chain after about the logarithm of
    its length. Labels and links are written each round, nothing is gathered by the driver.
    """
    both = cut_lineage(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")))
    known = small(labels)
    while True:
        near = both.join(known.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = near.join(known.withColumnRenamed("node", "a"), "a").select(F.col("a").alias("node"), "component", F.least("component", "near").alias("least"))
        up = known.select(F.col("node").alias("least"), F.col("component").alias("above"))
        after = cut_lineage(step.join(up, "least", "left").select("node", F.col("component").alias("before"), F.least("least", F.coalesce("above", "least")).alias("component")))
        labels = after.select("node", "component")
        if not after.filter("before <> component").limit(1).count():
            return labels
        known = small(labels)
