"""Leakage-aware fold assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.ranks import join_on, quantiles, ranked
from palimpsest.session import written

OFFSETS = (0.0, 0.2, 0.4, 0.6, 0.8)


def blocked_folds(df: DataFrame, strata: list[str], order: list[str], k: int = 5, offset: float = 0.0) -> DataFrame:
    """Adds ``fold``: the rows of a stratum in order, cut into k blocks of nearly equal size, shifted by ``offset`` blocks.

    ``order`` must be total. A row with a null stratum is an error, as it would get no fold.
    """
    if k < 2 or not 0 <= offset < k:
        raise ValueError("k must be at least 2 and the offset in [0, k)")
    none = F.lit(False)
    for s in strata:
        none = none | F.col(s).isNull()
    if df.where(none).limit(1).count():
        raise ValueError(f"null in the strata {strata}")
    return ranked(df, strata, order).withColumn("fold", _fold(k, F.lit(float(offset)))).drop("_rank", "_n")


def _fold(k: int, offset: F.Column) -> F.Column:
    return F.floor(F.pmod(F.col("_rank") * F.lit(float(k)) / F.col("_n") + offset, F.lit(float(k)))).cast("int")


def repeated_folds(df: DataFrame, strata: list[str], order: list[str], k: int = 5, offsets: tuple[float, ...] = OFFSETS) -> DataFrame:
    """Rows once for every offset, with ``repeat`` and ``fold``; one sort serves all repeats."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("repeat"), F.lit(float(o)).alias("offset")) for i, o in enumerate(offsets)]))
    return ranked(df, strata, order).withColumn("_o", each).withColumn("repeat", F.col("_o.repeat")).withColumn("fold", _fold(k, F.col("_o.offset"))).drop("_rank", "_n", "_o")


def tercile_groups(df: DataFrame, value: str, by: list[str] | None = None, out: str = "tercile") -> DataFrame:
    """Adds 0, 1 or 2 by the linear 1/3 and 2/3 quantiles; a value equal to a cut goes to the upper group, a null or NaN to none.

    Rows with null ``by`` form a group of their own."""
    j = join_on(df, quantiles(df, by or [], value, [1 / 3, 2 / 3]), by or [], "left")
    v = F.col(value)
    return j.withColumn(out, F.when(v.isNull() | F.isnan(v.cast("double")), F.lit(None)).when(v >= F.col("_q")[1], 2).when(v >= F.col("_q")[0], 1).otherwise(0)).drop("_q")


#: Groups of one slice of ``grouped_folds``; a parameter of memory and time of a task.
SLICE = 5_000


def _even(rows: np.ndarray, positives: np.ndarray, load: np.ndarray) -> np.ndarray:
    """Folds of groups in order: each to the fold after which rows and positives of all folds differ least. ``load`` (k, 2) is added to."""
    fold = np.empty(len(rows), np.int64)
    scale = np.maximum([rows.sum() + load[:, 0].sum(), positives.sum() + load[:, 1].sum()], 1e-9)
    for i, add in enumerate(np.stack([rows, positives], axis=1) / scale):
        if i == 0:
            load /= scale
        # the sum of squares grows least where the group adds to little
        fold[i] = ((2 * load + add) * add).sum(axis=1).argmin()
        load[fold[i]] += add
    if len(rows):
        load *= scale
    return fold


def grouped_folds(df: DataFrame, group: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """(group, ``fold``): groups stay whole, and rows and positives are spread evenly over k folds. Null groups and labels count as no group and no positive.

    Groups above a 1/200 of all rows (at most 200) are placed on the driver; the others fill up the folds in hashed slices of about ``SLICE`` groups, each
    of which evens out its share of what the heavy ones leave.
    """
    g = written(df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_n"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("_p")), "groups")
    total, count = g.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count("*")).first()
    limit = max(2, total / 200)
    heavy = g.where(F.col("_n") >= limit).orderBy(F.desc("_n"), F.desc("_p"), group).toPandas()
    load = np.zeros((k, 2))
    folds = _even(heavy["_n"].to_numpy(float), heavy["_p"].to_numpy(float), load)
    left = max(1, total - int(heavy["_n"].sum()))
    slices = max(1, -(-count // SLICE))

    def fill(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["_n", "_p", "_h"], ascending=[False, False, True])
        n, p = f["_n"].to_numpy(float), f["_p"].to_numpy(float)
        return f[[group]].assign(fold=_even(n, p, load * (n.sum() / left)))

    kind = df.schema[group].dataType.simpleString()
    light = g.where(F.col("_n") < limit).select(group, "_n", "_p", F.xxhash64(group, F.lit(seed)).alias("_h")).withColumn("_s", F.pmod("_h", F.lit(slices)))
    small = light.groupBy("_s").applyInPandas(fill, f"`{group}` {kind}, fold int")
    if not len(heavy):
        return small
    return small.unionByName(df.sparkSession.createDataFrame(list(zip(heavy[group].tolist(), folds.tolist())), f"`{group}` {kind}, fold int"))
