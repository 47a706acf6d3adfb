"""Connected components of an edge table by contraction: nodes join their smallest neighbour until no edge is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netreach.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of ``edges`` (a, b), label being the smallest node of its component.

    Self-loops and repeated edges are allowed; an edge with a null end is ignored. A round takes every node to its
    smallest neighbour's smallest neighbour and keeps the edges between different labels, at most half as many nodes.
    Smallest neighbours are aggregated before their shuffle. The joins are plain sort-merge joins of two shuffles, so
    where a node has very many edges, adaptive execution splits its rows over tasks.
    """
    left = stage(edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(left.select(F.col("b").alias("node"), F.col("b").alias("near")))
        near = ends.groupBy("node").agg(F.min("near").alias("near"))
        jump = near.select(F.col("node").alias("near"), F.col("near").alias("to"))
        to = stage(near.join(jump, "near").select("node", "to"), "parents")
        if labels is None:
            labels = to.withColumnRenamed("to", "label")
        else:
            onward = labels.join(to.withColumnRenamed("node", "label"), "label", "left")
            labels = stage(onward.select("node", F.coalesce("to", "label").alias("label")), "labels")
        moved = left.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        left = stage(moved.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
        if not left.limit(1).count():
            return labels
