"""Connected components of an edge table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of the edges (a, b); the root is a component's smallest
    node. Every round each node hooks to its smallest smaller neighbour, the chains are
    flattened by doubling, and the edges are carried over to the roots; the rounds needed
    grow with the logarithm of the component's size. Only row counts reach the driver."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    left = materialise(edges.select(low.alias("a"), high.alias("b")).where("a <> b").distinct(), "edges")
    total = None
    while True:
        hooks = _flatten(materialise(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "hooks"))
        if total is None:
            ends = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
            total = materialise(_carried(ends.withColumn("root", F.col("node")), hooks, "root"), "roots")
        else:
            total = materialise(_carried(total, hooks, "root"), "roots")
        moved = _carried(_carried(left, hooks, "a"), hooks, "b")
        left = materialise(moved.select(low.alias("a"), high.alias("b")).where("a <> b").distinct(), "edges")
        if left.isEmpty():
            return total


def _carried(df: DataFrame, hooks: DataFrame, column: str) -> DataFrame:
    to = hooks.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return (df.join(to, F.col(column) == F.col("_node"), "left")
            .withColumn(column, F.coalesce("_root", column)).drop("_node", "_root"))


def _flatten(hooks: DataFrame) -> DataFrame:
    while True:
        up = hooks.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        joined = hooks.join(up, F.col("root") == F.col("_node"), "left")
        shorter = materialise(joined.select("node", F.coalesce("_root", "root").alias("root"),
                                            F.col("_root").isNotNull().alias("_moved")), "hooks")
        hooks = shorter.drop("_moved")
        if shorter.where("_moved").isEmpty():
            return hooks
