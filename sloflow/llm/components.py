"""Connected components of links, on the cluster, and union of links inside one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sloflow.llm.common import written


def roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The roots of the entries ``at``; paths are shortened on the way."""
    found = parent[at]
    while True:
        up = parent[found]
        if np.array_equal(up, found):
            break
        found = up
    parent[at] = found
    return found


def unite(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Join the sets of ``left[i]`` and ``right[i]`` for all i; a root is the smallest member."""
    while len(left):
        a, b = roots(parent, left), roots(parent, right)
        apart = a != b
        if not apart.any():
            return
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def connected(links: DataFrame) -> DataFrame:
    """Columns node and root for every node of ``links`` (a, b); a root is the smallest node it reaches.

    Each round hooks every node to its smallest smaller neighbour, shortens the paths by doubling and
    replaces the links by those between different roots.  All steps are joins and partial aggregations
    over the cluster; a node with very many links is one row after the map side.  Every round is written
    to the shared folder, which ends its lineage.  Links of a node with itself and repeated ones do no
    harm; no links give an empty table.
    """
    kind = links.schema["a"].dataType
    low, high = F.least("a", "b"), F.greatest("a", "b")
    left = written(links.select(low.alias("a"), high.alias("b")).where("a < b").distinct(), "links")
    found: DataFrame | None = None
    while not left.isEmpty():
        tree = written(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "hooks")
        while True:
            above = tree.select(F.col("node").alias("root"), F.col("root").alias("above"))
            tree = written(
                tree.join(above, "root", "left").select(
                    "node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")
                ),
                "jumps",
            )
            moved = not tree.where("moved").isEmpty()
            tree = tree.drop("moved")
            if not moved:
                break
        for side in ("a", "b"):
            to = tree.select(F.col("node").alias(side), F.col("root").alias("to"))
            left = left.join(to, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        left = written(left.select(low.alias("a"), high.alias("b")).where("a < b").distinct(), "links")
        if found is None:
            found = tree
        else:
            later = tree.select(F.col("node").alias("root"), F.col("root").alias("to"))
            found = found.join(later, "root", "left").select("node", F.coalesce("to", "root").alias("root")).union(tree)
            found = written(found, "trees")
    if found is None:
        return links.sparkSession.createDataFrame([], f"node {kind.simpleString()}, root {kind.simpleString()}")
    return found.union(found.select(F.col("root").alias("node"), "root").distinct().join(found.select("node"), "node", "left_anti"))
