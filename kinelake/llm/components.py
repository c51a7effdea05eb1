"""Connected components of an edge table, by hooking to the smallest neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.frames import settled


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), ``root`` being the same for all nodes of a component.

    Every round hooks each node to its smallest neighbour, follows hooks four deep, and replaces the graph
    by that of the hooks. Tables are written to the shared folder each round; nothing is collected.
    """
    graph = settled(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while not graph.isEmpty():
        both = graph.union(graph.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root"))
        hooks = settled(hooks, "hooks")
        for _ in range(2):
            onward = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            hooks = hooks.join(onward, "root").select("node", F.col("next").alias("root"))
        hooks = settled(hooks, "hooks")
        if labels is None:
            labels = hooks
        else:
            onward = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = settled(labels.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        ends = (hooks.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
        for end in ends:
            graph = graph.join(end, end.columns[0])
        graph = settled(graph.where("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return labels
