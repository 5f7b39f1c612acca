"""Connected components of links, by contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import land


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): the component is its smallest node.

    Each round lets a node follow the smaller of itself and its smallest neighbour, shortens these paths, and
    replaces links by links between the nodes followed. Nodes with many links are combined before the shuffle.
    """
    links = land(links.where("a <> b").select("a", "b").distinct(), "links")
    names: DataFrame | None = None  # node -> the node it follows so far
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        follow = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to"))
        follow = land(follow, "follow")
        for _ in range(2):
            next_ = follow.select(F.col("node").alias("to"), F.col("to").alias("further"))
            follow = follow.join(next_, "to").select("node", F.col("further").alias("to"))
        follow = land(follow, "follow")
        if names is None:
            names = follow
        else:
            step = follow.withColumnRenamed("node", "at").withColumnRenamed("to", "further")
            names = land(
                names.join(step, names["to"] == step["at"], "left").select("node", F.coalesce("further", "to").alias("to")),
                "names",
            )
        a, b = follow.select(F.col("node").alias("a"), F.col("to").alias("_a")), follow.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        links = land(
            links.join(a, "a").join(b, "b").where("_a <> _b")
            .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(),
            "links",
        )
    if names is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return names.withColumnRenamed("to", "component")
