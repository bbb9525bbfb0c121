"""Connected components of a link table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node of the component. links may hold any pairs, also repeated.

    Every round takes the smallest label among neighbours and then jumps to the label's own label, so
    chains shorten by half; labels are written each round, which cuts lineage and survives lost executors.
    """
    forth = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = materialise(forth.unionByName(forth.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u != v").distinct(), "links")
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("v"), F.col("root").alias("r")), "v").groupBy("u").agg(F.min("r").alias("r"))
        near = labels.join(seen, labels["node"] == seen["u"]).select("node", F.least("root", "r").alias("near"), F.col("root").alias("old"))
        near = materialise(near, "near")
        jump = near.select(F.col("node").alias("near"), F.col("near").alias("root"))
        step = materialise(near.join(jump, "near").select("node", "root", "old"), "labels")
        labels = step.select("node", "root")
        if step.filter("root != old").isEmpty():
            return labels
