"""Ranks and joins that no group, however large, brings into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import shuffle_width, written


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet null keys; the keys of ``left`` stay. Without keys ``right`` must be a single row."""
    if not keys:
        return left.join(F.broadcast(right))
    r = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & left[k].eqNullSafe(r[f"_k{i}"])
    return left.join(r, on, how).drop(*[f"_k{i}" for i in range(len(keys))])


def ranked(df: DataFrame, strata: list[str], order: list[str]) -> DataFrame:
    """Adds ``_rank`` (from 0) of each row in its stratum and ``_n``, the stratum's rows.

    The rows are sorted by range once and written; ranks inside a range partition and the rows of the partitions before it,
    a few numbers for each partition, give the rank. ``order`` must be total for the ranks to be the same each time.
    """
    cut = [*strata, *order]
    d = written(df.repartitionByRange(shuffle_width(df.sparkSession), *cut).withColumn("_pid", F.spark_partition_id()), "ranges")
    sizes = d.groupBy(*strata, "_pid").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*strata)
    before = F.coalesce(F.sum("_c").over(w.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*strata, "_pid", before.alias("_before"), F.sum("_c").over(w).alias("_n"))
    within = d.withColumn("_rank", F.row_number().over(Window.partitionBy(*strata, "_pid").orderBy(*order)) - 1)
    return join_on(within, sizes, [*strata, "_pid"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_pid", "_before")


def quantiles(df: DataFrame, by: list[str], value: str, probs: list[float]) -> DataFrame:
    """``by`` and ``_q`` (array): exact linear quantiles of the values that are neither null nor NaN; groups without any are absent.

    Only the values next to a quantile's place leave the ranks.
    """
    v = ranked(df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)"), by, ["_v"])
    place = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    near = [(F.col("_rank") == F.floor(p)) | (F.col("_rank") == F.ceil(p)) for p in place]
    v = v.where(F.array_contains(F.array(*near), True))
    at = lambda r: F.max(F.when(F.col("_rank") == r, F.col("_v")))
    picked = v.groupBy(*by, "_n").agg(*[x for i, p in enumerate(place) for x in (at(F.floor(p)).alias(f"_lo{i}"), at(F.ceil(p)).alias(f"_hi{i}"))])
    out = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (p - F.floor(p)) for i, p in enumerate(place)]
    return picked.select(*by, F.array(*out).alias("_q"))


#: Rows of one piece of a group whose scores are worked through in order; a parameter of memory, not of the result.
PIECE_ROWS = 100_000


def pieces(df: DataFrame, by: list[str], score: str, rows: int = PIECE_ROWS) -> DataFrame:
    """Adds ``_piece``: pieces of a group in the order of the score, equal scores together.

    The range of a group's scores is cut evenly into as many pieces as the group has ``rows`` rows. Scores that bunch in a narrow part of
    the range share a piece.
    """
    s = F.col(score)
    span = df.groupBy(*by).agg(F.min(s).alias("_lo"), F.max(s).alias("_hi"), F.ceil(F.count("*") / rows).alias("_np"))
    at = F.floor((s - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_np"))
    piece = F.when(F.col("_hi") > F.col("_lo"), F.greatest(F.lit(0), F.least(F.col("_np") - 1, at))).otherwise(0).cast("int")
    return join_on(df, span, by).withColumn("_piece", piece).drop("_lo", "_hi", "_np")
