"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notefold.llm.common import cut, forget


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every end of links (a, b); component is the smallest node reachable.

    Each round takes the smallest label among a node's own and its neighbours',
    then jumps to that label's label, so labels travel doubling distances.
    Minima are aggregated before each exchange, so a node with very many links
    is no hot spot; rounds end when no label changes.
    """
    edges = cut(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v").distinct(), "edges")
    # the first labels need no join: each node starts with its smallest neighbour
    labels = cut(edges.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("component")), "labels")
    old = labels
    while True:
        near = edges.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy("u").agg(F.min("component").alias("low")).select(F.col("u").alias("node"), "low")
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "low").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("far"))
        new = cut(step.join(jump, "to").select("node", F.least("to", "far").alias("component"), (F.col("was") != F.least("to", "far")).alias("changed")), "labels")
        forget(old)
        old, labels = new, new.drop("changed")
        if new.where("changed").isEmpty():
            forget(edges)
            return labels
