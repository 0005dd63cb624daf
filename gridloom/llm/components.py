"""Connected components over an edge table, by the smallest label with pointer jumping. Nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import SIDE_ROWS, sided, written


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of the undirected edges (a, b); label is the component's smallest node.

    Each round takes the smallest label among the neighbours and then the label of that label, so paths halve; partial
    minima are taken before the shuffle, so a node with many neighbours is no hot spot. Labels are broadcast up to SIDE_ROWS nodes. No edges: no rows.
    """
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))  # the edges are computed once
    both = written(edges.select(ways.alias("e")).select("e.a", "e.b").distinct())
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    few = labels.count() <= SIDE_ROWS
    for _ in range(most_rounds):
        near = both.join(sided(labels, few), both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        mine = labels.join(sided(near, few), labels.node == near.a).select("node", "label", F.least("label", "near").alias("low"))
        roots = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        moved = written(mine.join(sided(roots, few), "low").select("node", F.least("low", "jump").alias("label"), (F.least("low", "jump") != F.col("label")).alias("moved")))
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")
