"""Problem 6: splits in which related records stay together.

Components (records of one group) are hashed into train, val and test by their share, then exchanged or
moved whole by annealing, so that rows and labels come near their targets. Heavy components, of which there can be only
a bounded number, are annealed among themselves against the global targets; the rest is annealed in parallel
blocks of bounded size by several chains against what they leave, and of each block the best chain is kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.names import part_of
from palimpsest.session import written

PARTS = ("train", "val", "test")
SHARES = (0.80, 0.12, 0.08)
#: A component of at least this share of all rows is heavy; there are at most 1 / HEAVY of them.
HEAVY = 0.002
#: Components of one annealing block.
BLOCK = 20_000
CHAINS = 4
STEPS = 20_000


def components(records: DataFrame, group: str, split: str, label: str | None = None) -> DataFrame:
    """One row for every non-null group: ``group_id``, ``n_rows``, ``n_positive`` (rows whose label is
    that of the first class) and ``n_train``, ``n_val``, ``n_test``, ``n_parts``: where its rows lie today.

    Rows with an unknown, dup, drop or null split lie in no part. Pre-aggregated on the map side, so a
    group of any size costs one row for each task.
    """
    p = part_of(F.col(split))
    positive = F.coalesce(F.col(label).cast("string").isin("parkinson", "1", "true"), F.lit(False)) if label else F.lit(False)
    out = (
        records.select(F.col(group).alias("group_id"), p.alias("_p"), positive.alias("_pos"))
        .where("group_id is not null")
        .groupBy("group_id")
        .agg(F.count("*").alias("n_rows"), F.sum(F.col("_pos").cast("long")).alias("n_positive"), *[F.coalesce(F.sum((F.col("_p") == x).cast("long")), F.lit(0)).alias(f"n_{x}") for x in PARTS])
    )
    return out.withColumn("n_parts", sum((F.col(f"n_{x}") > 0).cast("int") for x in PARTS))


def torn_groups(records: DataFrame, group: str = "group_id", split: str = "split_clean") -> DataFrame:
    """``group_id`` of every group whose rows lie in more than one part today."""
    return components(records, group, split).where("n_parts > 1").select("group_id")


def anneal(sizes: np.ndarray, start: np.ndarray, target: np.ndarray, seed: int, steps: int = STEPS) -> np.ndarray:
    """Move or exchange whole components until sizes and labels of the three parts are near ``target``.

    ``sizes`` is (n, 2): rows and positives; ``target`` is (3, 2). Returns the best assignment seen.
    """
    rng = np.random.default_rng(seed)
    n, now = len(sizes), start.copy()
    if n == 0:
        return now
    load = np.stack([sizes[now == p].sum(axis=0) if (now == p).any() else np.zeros(2) for p in range(3)]).astype(float)
    scale = np.maximum(target.sum(axis=0), 1.0)

    def cost(x: np.ndarray) -> float:
        return float((((x - target) / scale) ** 2).sum())

    c = best = cost(load)
    moves: list[tuple[int, int]] = []
    upto = 0
    who = rng.integers(0, n, (steps, 2))
    to = rng.integers(0, 3, steps)
    swap = rng.random(steps) < 0.5
    luck = rng.random(steps)
    heat = max(c, 1e-6) * 0.1
    for k in range(steps):
        i, j = who[k]
        t = heat * (1 - k / steps) ** 2 + 1e-15
        p = now[i]
        q = now[j] if swap[k] else to[k]
        if p == q:
            continue
        shift = sizes[i] - (sizes[j] if swap[k] else 0)
        load[p] -= shift
        load[q] += shift
        after = cost(load)
        if after <= c or luck[k] < np.exp((c - after) / t):
            now[i] = q
            moves.append((i, q))
            if swap[k]:
                now[j] = p
                moves.append((j, p))
            c = after
            if c < best:
                best, upto = c, len(moves)
                if best == 0:
                    break
        else:
            load[p] += shift
            load[q] -= shift
    kept = start.copy()
    for i, q in moves[:upto]:
        kept[i] = q
    return kept


def hashed_start(u: np.ndarray, shares: tuple[float, ...] = SHARES) -> np.ndarray:
    return np.searchsorted(np.cumsum(shares)[:-1], u, side="right").astype(np.int64)


def whole_group_splits(comps: DataFrame, shares: tuple[float, ...] = SHARES, chains: int = CHAINS, block: int = BLOCK, steps: int = STEPS, seed: int = 0) -> DataFrame:
    """(``group_id``, ``n_rows``, ``split_new``): a part for every component, near ``shares`` in rows and
    in labels. Every group lies in one part by construction. An empty input gives an empty table; a
    single component goes where it fits best (train). The result is the same for the same seed.
    """
    comps = written(comps.select("group_id", "n_rows", "n_positive"), "components")
    total = comps.agg(F.count("*").alias("n"), F.sum("n_rows").alias("r"), F.sum("n_positive").alias("p")).first()
    if not total["n"]:
        return comps.select("group_id", "n_rows", F.lit("train").alias("split_new"))
    goal = np.outer(shares, [total["r"], total["p"]]).astype(float)
    least = max(2.0, HEAVY * total["r"])
    heavy = comps.where(F.col("n_rows") >= least).orderBy(F.desc("n_rows"), "group_id").toPandas()  # at most 1 / HEAVY rows
    spark = comps.sparkSession
    load, placed = np.zeros((3, 2)), []
    if len(heavy):
        size = heavy[["n_rows", "n_positive"]].to_numpy(float)
        # from the heaviest on each to the part that lacks most of its rows, then moved and exchanged by rows and labels
        begin = np.zeros(len(size), np.int64)
        fill = np.zeros(3)
        for k, rows in enumerate(size[:, 0]):
            begin[k] = np.argmax((goal[:, 0] - fill - rows) / np.maximum(goal[:, 0], 1e-9))
            fill[begin[k]] += rows
        tried = [anneal(size, begin, goal * np.minimum(1.0, size.sum(axis=0) / np.maximum(goal.sum(axis=0), 1e-9)), seed * 1009 + c, steps) for c in range(chains)]
        # what is over its target in a part can't be mended by the rest, so that counts first
        over = [np.maximum(np.stack([size[t == p].sum(axis=0) for p in range(3)]) - goal, 0).sum() for t in [begin, *tried]]
        part = [begin, *tried][min(range(len(over)), key=lambda k: (over[k], -k))]
        load = np.stack([size[part == p].sum(axis=0) for p in range(3)]).astype(float)
        placed = [(g, int(n), PARTS[p]) for g, n, p in zip(heavy["group_id"], heavy["n_rows"], part)]
    rest = comps.where(F.col("n_rows") < least)
    left = np.maximum(goal - load, 0)
    left = left / np.maximum(left.sum(axis=0, keepdims=True), 1e-9)
    n_blocks = max(1, -(-total["n"] // block))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_u", "group_id"]).reset_index(drop=True)
        s = frame[["n_rows", "n_positive"]].to_numpy(float)
        target = left * s.sum(axis=0, keepdims=True)
        begin = hashed_start(frame["_u"].to_numpy(), tuple(left[:, 0] / max(left[:, 0].sum(), 1e-9)))
        c = int(frame["chain"].iloc[0])
        part = anneal(s, begin, target, seed * 1009 + c, steps)
        got = np.stack([s[part == p].sum(axis=0) for p in range(3)])
        cost = float((((got - target) / np.maximum(target.sum(axis=0), 1.0)) ** 2).sum())
        return pd.DataFrame({"group_id": frame["group_id"], "n_rows": frame["n_rows"], "chain": c, "part": part, "cost": cost, "_block": frame["_block"]})

    tries = (
        rest.select("group_id", "n_rows", "n_positive", _unit_hash(seed).alias("_u"), F.pmod(F.hash("group_id", F.lit(seed + 1)), F.lit(n_blocks)).alias("_block"))
        .withColumn("chain", F.explode(F.array(*[F.lit(c) for c in range(chains)])))
        .groupBy("_block", "chain")
        .applyInPandas(run, "group_id long, n_rows long, chain int, part int, cost double, _block int")
    )
    tries = written(tries, "chains")
    best = tries.groupBy("_block").agg(F.min(F.struct("cost", "chain")).alias("_m")).select("_block", F.col("_m.chain").alias("chain"))
    names = F.element_at(F.array(*[F.lit(p) for p in PARTS]), F.col("part") + 1)
    out = tries.join(best, ["_block", "chain"]).select("group_id", "n_rows", names.alias("split_new"))
    if placed:
        out = out.unionByName(spark.createDataFrame(placed, "group_id long, n_rows long, split_new string"))
    return out


def _unit_hash(seed: int) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("group_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def split_balance(comps: DataFrame, assignment: DataFrame, shares: tuple[float, ...] = SHARES, seed: int = 0) -> DataFrame:
    """A row for each part: ``split_new``, ``n_groups``, ``n_rows``, ``row_share`` against ``target_share``, ``label_share`` (of all positive rows),
    and ``hashed_row_share`` and ``hashed_label_share``: what hashing whole groups alone would give."""
    c = comps.select("group_id", "n_positive", _unit_hash(seed).alias("_u"), F.col("n_rows").alias("_rows"))
    cuts = np.cumsum(shares)
    hashed = F.when(F.col("_u") < float(cuts[0]), PARTS[0]).when(F.col("_u") < float(cuts[1]), PARTS[1]).otherwise(PARTS[2])
    j = assignment.select("group_id", "split_new").join(c, "group_id").withColumn("_h", hashed)
    total = j.agg(F.sum("_rows").alias("r"), F.sum("n_positive").alias("p"))
    new = j.groupBy("split_new").agg(F.count("*").alias("n_groups"), F.sum("_rows").alias("n_rows"), F.sum("n_positive").alias("_p"))
    old = j.groupBy(F.col("_h").alias("split_new")).agg(F.sum("_rows").alias("_hr"), F.sum("n_positive").alias("_hp"))
    target = F.element_at(F.create_map(*[F.lit(x) for kv in zip(PARTS, map(float, shares)) for x in kv]), F.col("split_new"))
    both = new.join(old, "split_new", "full").join(F.broadcast(total))  # a single row
    share = lambda n, of: F.round(F.coalesce(F.try_divide(F.col(n), F.col(of)), F.lit(0.0)), 6)
    return both.select("split_new", F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), share("n_rows", "r").alias("row_share"), target.alias("target_share"), share("_p", "p").alias("label_share"), share("_hr", "r").alias("hashed_row_share"), share("_hp", "p").alias("hashed_label_share"))


def assigned_records(records: DataFrame, assignment: DataFrame, group: str = "group_id") -> DataFrame:
    """Rows with their group's ``split_new``; rows without a group get a part of their own by hash of ``item_id``."""
    own = (F.pmod(F.xxhash64("item_id"), F.lit(10_000)) / 10_000.0).alias("_u")
    a = assignment.select(F.col("group_id").alias("_g"), "split_new")
    j = records.select("item_id", F.col(group).alias("group_id"), own).join(a, F.col("group_id") == F.col("_g"), "left")
    alone = F.when(F.col("_u") < SHARES[0], "train").when(F.col("_u") < SHARES[0] + SHARES[1], "val").otherwise("test")
    return j.select("item_id", "group_id", F.coalesce("split_new", alone).alias("split_new"))
