"""Connected components of an edge table by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of ``edges`` (a, b): nodes that can reach one another have the same label, one of them.

    A round sends each node to the smallest one around it and replaces the edges by those between the targets; stars
    are done in one round, and with nodes in random order (here they are hashes) the number of rounds grows with the
    logarithm of the number of nodes. Targets are a partial aggregate, and are written before they are joined to the
    edges, so that both sides of a join are plain exchanges and adaptive execution can split a node with very many edges.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    labels = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        target = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "targets")
        if labels is None:
            labels = target.select(F.col("a").alias("node"), F.col("m").alias("label"))
        else:
            moved = target.select(F.col("a").alias("label"), F.col("m").alias("next"))
            labels = labels.join(moved, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        ends = now.join(target, "a").select(F.col("m").alias("x"), "b").join(target.select(F.col("a").alias("b"), F.col("m").alias("y")), "b")
        now = written(ends.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
        if now.isEmpty():
            return labels
