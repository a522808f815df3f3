"""Connected components by least labels, with joins and partial minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.storage import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of the edges (a, b), stored in ``scratch``; a component is its least node.

    Each round takes the least label of all neighbours and then the label of that label. Every
    round's table is stored, and the one before it deleted; none of it comes to the driver but a
    flag. Null nodes, and edges from a node to itself, are left out; repeated edges count once;
    without edges there is no node.
    """
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    e = scratch.put(edges.where("a <> b").select(both).select("e.*").distinct(), "edges")
    labels = scratch.put(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component"), F.lit(True).alias("moved")), "labels")
    while True:
        known = labels.select("node", "component")
        near = e.join(known, e.b == known.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = known.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        above = known.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = hooked.join(above, "component", "left").select("node", F.least("component", F.coalesce("above", "component")).alias("component"), "was")
        after = scratch.put(jumped.select("node", "component", (F.col("component") != F.col("was")).alias("moved")), "labels")
        scratch.drop(labels)
        labels = after
        if not after.where("moved").limit(1).count():
            scratch.drop(e)
            return after.select("node", "component")
