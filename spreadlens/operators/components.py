"""Connected components by contraction with pointer jumping."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlens.session import cut_lineage


def _jump(parent: DataFrame) -> DataFrame:
    """Replace every parent by the root of its tree (parent(v) <= v, so trees are acyclic)."""
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        stepped = cut_lineage(parent.join(up, "parent").select("node", F.col("root").alias("parent"),
                                                               (F.col("root") != F.col("parent")).alias("moved")))
        if stepped.filter("moved").isEmpty():
            return stepped.select("node", "parent")
        parent = stepped.select("node", "parent")


def contract(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges(src, dst)``; component = smallest node reachable.

    Each round hooks every node to its smallest neighbour, flattens the hooks by
    pointer jumping and keeps only the edges between different roots.  A node
    survives a round only as a local minimum, so rounds grow with the logarithm
    of the number of nodes; the loop ends when no edge is left, never at a limit.
    Every aggregate combines on the map side and no neighbour list is gathered.
    Null ends and self edges link nothing; a node seen only there is not returned.
    """
    live = cut_lineage(edges.select("src", "dst").filter("src <> dst")
                       .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    labels = None
    while not live.isEmpty():
        both = live.union(live.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hooks = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low"))
        parent = _jump(cut_lineage(hooks.select("node", F.least("node", "low").alias("parent"))))
        if labels is None:
            labels = parent.withColumnRenamed("parent", "component")
        else:
            up = parent.select(F.col("node").alias("component"), F.col("parent").alias("root"))
            labels = cut_lineage(labels.join(up, "component", "left")
                                 .select("node", F.coalesce("root", "component").alias("component")))
        one = parent.select(F.col("node").alias("src"), F.col("parent").alias("a"))
        two = parent.select(F.col("node").alias("dst"), F.col("parent").alias("b"))
        live = cut_lineage(live.join(one, "src").join(two, "dst").filter("a <> b")
                           .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    if labels is None:
        return live.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return labels
