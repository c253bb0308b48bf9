"""Hierarchy closures by breadth-first joins, every few levels written to the shared folder.

A (start, ancestor) pair is kept at its smallest depth and never visited again, so cycles of bad sources end. A level
joins the frontier with the edges on the edge's child: rows are spread by child, and a hub parent with very many
children is met once for each start that reaches it, not once for each pair of its children.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import cut

STEPS = 4  # levels for each write
FOLD = 4  # writes after which what was seen becomes one table again


def closure(edges: DataFrame, starts: DataFrame | None = None, name: str = "closure") -> DataFrame:
    """``start, node, depth`` with depth >= 1 over edges ``child, parent``; of all children, or of ``starts`` (column start)."""
    edges = edges.select("child", "parent").distinct()
    seen, frontier = None, (edges.select("child") if starts is None else starts.select(F.col("start").alias("child"))).distinct().select(F.col("child").alias("start"), F.col("child").alias("node"))
    for turn in count():
        levels = []
        for depth in range(turn * STEPS + 1, (turn + 1) * STEPS + 1):
            frontier = frontier.join(edges, F.col("node") == F.col("child")).select("start", F.col("parent").alias("node")).distinct()
            levels.append(frontier.withColumn("depth", F.lit(depth)))
        reached = reduce(DataFrame.unionByName, levels).groupBy("start", "node").agg(F.min("depth").alias("depth"))
        if seen is not None:
            reached = reached.join(seen, ["start", "node"], "left_anti")
        reached = cut(reached, name)
        seen = reached if seen is None else seen.unionByName(reached)
        frontier = reached.where(F.col("depth") == (turn + 1) * STEPS).select("start", "node")
        if frontier.isEmpty():
            return seen
        if turn % FOLD == FOLD - 1:
            seen = cut(seen, name)


def with_self(closed: DataFrame, nodes: DataFrame) -> DataFrame:
    """The closure and each node (column start) at depth 0."""
    return nodes.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct().unionByName(closed)


def ancestors(extends: DataFrame, label: str, starts: DataFrame | None = None) -> DataFrame:
    return closure(extends.where(F.col("label") == label), starts, f"ancestors-{label.lower()}")


def descendants(extends: DataFrame, label: str, starts: DataFrame) -> DataFrame:
    """``start, node, depth``: everything that extends the starts."""
    turned = extends.where(F.col("label") == label).select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    return closure(turned, starts, f"descendants-{label.lower()}")
