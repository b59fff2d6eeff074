"""Connected components: roots hang on least neighbours with pointer jumping, as joins and aggregations, until the links fit one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import written

#: Links that one task unites at most; a parameter of memory (about 100 bytes a link), not of the result.
LINKS_PER_TASK = 500_000


def components(edges: DataFrame, i: str = "i", j: str = "j", links_per_task: int = LINKS_PER_TASK) -> DataFrame:
    """(``node``, ``component``): the least node of the component. Nodes without an edge do not occur.

    Each round hangs every root on its least smaller neighbour, jumps pointers until the trees are flat, and draws the
    edges together to edges between roots. A root that outlives two rounds has taken in a neighbour of its own in the first, so two rounds at
    least halve the roots that have edges: rounds are bounded by twice the logarithm of the nodes, whatever the order of the ids, and no limit is
    set. Once the edges that are left fit one task, union-find there ends the loop.
    """
    ends = edges.select(F.col(i).alias("a"), F.col(j).alias("b")).where("a is not null and b is not null")
    ends = written(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component"))
    links = ends.where("a <> b")
    while links.count() > links_per_task:
        tree = _flattened(links.groupBy("b").agg(F.min("a").alias("up")).withColumnRenamed("b", "root"))
        labels = written(_hung(labels, tree), "labels")
        ta, tb = (tree.select(F.col("root").alias(s), F.col("up").alias(f"_{s}")) for s in "ab")
        links = links.join(ta, "a", "left").join(tb, "b").select(F.coalesce("_a", "a").alias("_a"), "_b").where("_a <> _b")
        links = written(links.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
    kind = ends.schema["a"].dataType.simpleString()
    return _hung(labels, links.repartition(1).mapInPandas(_united, f"root {kind}, up {kind}"))


def _hung(labels: DataFrame, tree: DataFrame) -> DataFrame:
    return labels.join(tree, F.col("component") == F.col("root"), "left").select("node", F.coalesce("up", "component").alias("component"))


def _united(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over all links of a task: (root, up) for every node that is not the least of its tree."""
    got = list(frames)
    a, b = (np.concatenate([f[c].to_numpy() for f in got]) if got else np.zeros(0, np.int64) for c in "ab")
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in ends.reshape(2, -1).T.tolist():
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        parent[max(x, y)] = min(x, y)
    up = np.array(parent, dtype=np.int64)
    while len(up) and (up[up] != up).any():
        up = up[up]
    moved = np.flatnonzero(up != np.arange(len(up)))
    yield pd.DataFrame({"root": nodes[moved], "up": nodes[up[moved]]})


def _flattened(tree: DataFrame) -> DataFrame:
    """(``root``, ``up``) with every ``up`` at the top of its tree. ``up`` is less than ``root``, so there is no cycle and depths halve."""
    tree = written(tree, "trees")
    while True:
        above = tree.select(F.col("root").alias("up"), F.col("up").alias("_top"))
        tree = written(tree.join(above, "up", "left").select("root", F.coalesce("_top", "up").alias("up"), F.col("_top").isNotNull().alias("_moved")), "trees")
        moved = tree.where("_moved").limit(1).count()
        tree = tree.select("root", "up")
        if not moved:
            return tree


def with_singletons(nodes: DataFrame, comps: DataFrame, key: str) -> DataFrame:
    """Every node with its component; nodes without an edge are their own."""
    return nodes.join(comps.withColumnRenamed("node", key), key, "left").withColumn("component", F.coalesce("component", key))


def cluster_statistics(members: DataFrame, label: str) -> DataFrame:
    """One row over (``component``, label): share in clusters of two or more, such clusters, the largest, label-pure share."""
    g = members.groupBy("component").agg(F.count("*").alias("n"), F.countDistinct(label).alias("y"))
    multi = F.col("n") > 1
    return g.agg(
        F.round(100.0 * F.sum(F.when(multi, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("pct_in_cluster"),
        F.count_if(multi).alias("n_clusters"),
        F.max("n").alias("largest"),
        F.round(100.0 * F.try_divide(F.count_if(multi & (F.col("y") == 1)), F.count_if(multi)), 4).alias("pct_pure"),
    )
