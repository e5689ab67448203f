"""Connected components of an undirected graph by contraction, each step a few joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.shared import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of edges: root is the smallest node of its component. Self-loops and repeated edges do no harm.

    Each node points to its smallest neighbour, if that is smaller; pointers are doubled until they end in local minima, and the
    edges are contracted to those. At least half of what still has an edge vanishes each time, so the number of
    rounds is logarithmic. Smallest neighbours are pre-aggregated, so nodes with many edges cost no more.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = None
    while True:
        point = both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("root"))
        point = _doubled(written(point, "points"))
        roots = point if roots is None else written(_through(roots, point), "roots")
        to = point.select(F.col("node"), F.col("root").alias("to"))
        left = both.join(to.withColumnRenamed("node", "a"), "a").select(F.col("to").alias("a"), "b")
        left = left.join(to.withColumnRenamed("node", "b"), "b").select("a", F.col("to").alias("b")).filter("a <> b").distinct()
        both = written(left, "edges")
        if both.isEmpty():
            return roots


def _through(roots: DataFrame, point: DataFrame) -> DataFrame:
    """roots, followed on by point."""
    p = point.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return roots.join(p, "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def _doubled(point: DataFrame) -> DataFrame:
    """point, followed to its ends."""
    while True:
        on = point.select(F.col("node").alias("root"), F.col("root").alias("to"))
        if point.join(on, "root").filter("to <> root").isEmpty():
            return point
        point = written(point.join(on, "root").select("node", F.col("to").alias("root")), "points")
