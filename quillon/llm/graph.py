"""Connected components of an edge table by contraction, in the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(edges: DataFrame, ws: Workspace, tag: str) -> DataFrame:
    """(node, comp) for the nodes of edges (a, b) of longs. Each round every node moves to the least of itself and
    its neighbours and edges are drawn between the new names; stars vanish in one round, paths shrink by a constant
    share. Tables are written every round."""
    left = ws.save(edges.select("a", "b").filter("a != b").distinct(), f"{tag}_edges")
    names, k = None, 0
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        least = ws.save(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).withColumnRenamed("a", "node"), f"{tag}_least{k}")
        if names is None:
            names = least.select("node", F.col("to").alias("comp"))
        else:
            moved = least.select(F.col("node").alias("comp"), "to")
            names = names.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        names = ws.save(names, f"{tag}_names{k}")
        to = lambda c: least.select(F.col("node").alias(c), F.col("to").alias(f"{c}2"))
        left = ws.save(left.join(to("a"), "a").join(to("b"), "b").select(F.col("a2").alias("a"), F.col("b2").alias("b")).filter("a != b").distinct(), f"{tag}_left{k}")
        if k:
            ws.drop(f"{tag}_names{k - 1}", f"{tag}_left{k - 1}", f"{tag}_least{k - 1}")
        k += 1
    return names if names is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).limit(0)
