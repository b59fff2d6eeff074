"""Problem 4: pairwise matches become groups.

Union-find runs inside bounded partitions of the links and keeps only a spanning forest of each
(stars to the least member). Nodes that appear in several forests tie their roots together; those ties
are the links of the next, smaller level, and so on until one bounded partition holds what is left. Where a level's
forests leave too many ties (long chains), its nodes are first drawn together with their least neighbours.
Labels then flow back down through the levels by joins. No step gathers the links, the forest or a
component on the driver, and none puts an unbounded number of links into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.blocks import hot_join, spread_join, with_blocks
from palimpsest.llm.names import same_file
from palimpsest.session import written

#: Links that one task unites at most. A parameter of memory (about 100 bytes a link), not of the result.
LINKS_PER_TASK = 1_000_000


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the links; (node, root) for every node, the root being the least of its tree."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    half = len(a)
    for x, y in zip(ends[:half].tolist(), ends[half:].tolist()):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    root = np.array(parent, dtype=np.int64)
    while True:
        up = root[root]
        if np.array_equal(up, root):
            break
        root = up
    return nodes, nodes[root]


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    a, b = [], []
    for f in frames:
        a.append(f["_a"].to_numpy(np.int64))
        b.append(f["_b"].to_numpy(np.int64))
    if a and sum(map(len, a)):
        node, root = spanning_forest(np.concatenate(a), np.concatenate(b))
        yield pd.DataFrame({"_node": node, "_root": root})


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(``_node``, ``_least``): of each node and its neighbours the one with the least hash. Hashes put the nodes in random order,
    so that chains shrink by a constant share however their ids run."""
    ends = edges.select(F.col("_a").alias("_node"), F.col("_b").alias("_other")).unionByName(edges.select(F.col("_b").alias("_node"), F.col("_a").alias("_other")))
    near = ends.groupBy("_node").agg(F.min(F.struct(F.xxhash64("_other").alias("h"), F.col("_other").alias("n"))).alias("_m"))
    return near.select("_node", F.when(F.col("_m.h") < F.xxhash64("_node"), F.col("_m.n")).otherwise(F.col("_node")).alias("_least"))


def _contracted(edges: DataFrame, up: DataFrame) -> DataFrame:
    ua, ub = (up.select(F.col("_node").alias(s), F.col("_least").alias(f"{s}l")) for s in ("_a", "_b"))
    e = spread_join(spread_join(edges, ua, ["_a"], F.col("_b")), ub, ["_b"], F.col("_a")).where("_al <> _bl")
    return e.select(F.least("_al", "_bl").alias("_a"), F.greatest("_al", "_bl").alias("_b"))


def link_groups(links: DataFrame, a: str, b: str, links_per_task: int = LINKS_PER_TASK, shrink: float = 0.5, sizes: list[int] | None = None) -> DataFrame:
    """(``node``, ``group``) for every node that occurs in ``links``; the group is its least node.

    Links with a null end are ignored; a node linked only with itself forms a group of one. Repeated
    and reversed links change nothing. An empty input gives an empty table. Other columns are ignored.

    A task unites the links of many first ends, half of ``links_per_task`` on average; a first end with more than a 32nd of
    them is spread over blocks. A level whose forests leave more than ``shrink`` of its links (long chains, whose
    links seldom meet) is also contracted to least neighbours, so the number of levels is logarithmic. ``sizes`` takes the links of each level.
    """
    edges = links.select(F.col(a).cast("long").alias("_a"), F.col(b).cast("long").alias("_b")).where("_a is not null and _b is not null")
    edges = edges.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b"))
    levels: list[DataFrame] = []
    before, renamed = None, False
    while True:
        edges = written(edges.distinct(), "links")
        n = edges.count()
        if sizes is not None:
            sizes.append(n)
        if n <= links_per_task:
            forest = edges.repartition(1).mapInPandas(_forest, "_node long, _root long")
            labels = forest.select(F.col("_node").alias("node"), F.col("_root").alias("group"))
            break
        if before is not None and n > shrink * before:
            up = written(_least_neighbour(edges), "least")
            levels.append(up)
            renamed, before = True, None
            edges = _contracted(edges, up)
            continue
        before = n
        rows = max(1, links_per_task // 32)
        counts = edges.groupBy("_a").agg(F.count("*").alias("n")).where(F.col("n") > rows)
        placed = with_blocks(edges, ["_a"], counts, rows, F.col("_b"))
        forest = placed.repartition(-(-2 * n // links_per_task), F.col("_a"), F.pmod(F.xxhash64("_b"), F.col("_blocks"))).select("_a", "_b")
        forest = written(forest.mapInPandas(_forest, "_node long, _root long"), "forest")
        # a node occurs once in each forest at most, so these groups are bounded by the number of tasks
        least = forest.groupBy("_node").agg(F.min("_root").alias("_least"))
        ties = forest.join(least, "_node").where("_root <> _least")
        levels.append(least)
        edges = ties.select(F.col("_least").alias("_a"), F.col("_root").alias("_b"))
    for least in reversed(levels):
        up = labels.select(F.col("node").alias("_least"), F.col("group").alias("_up"))
        labels = least.join(up, "_least", "left").select(F.col("_node").alias("node"), F.coalesce("_up", "_least").alias("group"))
    if renamed:
        # contraction goes by hashes: the group is renamed to its least node
        labels = written(labels, "labels")
        first = labels.groupBy("group").agg(F.min("node").alias("_first"))
        labels = spread_join(labels, first, ["group"], F.col("node")).select("node", F.col("_first").alias("group"))
    return labels


def linked_files(pairs: DataFrame, manifest: DataFrame, least_correlation: float = 0.99) -> DataFrame:
    """(``item_id``, ``group_item_id``) of every listed file linked with another one, directly or not.

    A pair counts if its correlation is at least ``least_correlation`` (null and NaN do not) and both
    paths are in the manifest. Two ids under one path are one file, which goes by its least id.
    """
    files = (
        manifest.select(same_file(F.col("path")).alias("_path"), F.col("item_id").alias("_id"))
        .where("_path is not null and _path <> '' and _id is not null")
        .groupBy("_path")
        .agg(F.min("_id").alias("_id"))
    )
    good = pairs.where((F.col("correlation") >= least_correlation) & ~F.isnan("correlation")).select(
        same_file(F.col("val_path")).alias("_va"), same_file(F.col("train_path")).alias("_tr")
    )
    good = written(good.where("_va is not null and _tr is not null and _va <> _tr").distinct(), "pairs")
    # a few files occur in very many pairs
    ends = hot_join(good, files.select(F.col("_path").alias("_va"), F.col("_id").alias("_i")), "_va", F.col("_tr"), good)
    ends = hot_join(ends, files.select(F.col("_path").alias("_tr"), F.col("_id").alias("_j")), "_tr", F.col("_va"), good)
    groups = link_groups(ends.where("_i <> _j"), "_i", "_j")
    return groups.select(F.col("node").alias("item_id"), F.col("group").alias("group_item_id"))


def refreshed_groups(clean: DataFrame, groups: DataFrame) -> DataFrame:
    """``item_id``, the old ``group_id`` and ``new_group_id``: the least linked item, or the item itself."""
    own = clean.select("item_id", "group_id").where("item_id is not null").distinct()
    return own.join(groups, "item_id", "left").select("item_id", "group_id", F.coalesce("group_item_id", "item_id").alias("new_group_id"))
