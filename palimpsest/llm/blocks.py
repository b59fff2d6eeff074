"""Hot keys cut into blocks, and members of groups spelled out as pairs: shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import written

#: Parts into which the rows of one key are spread while the number of its blocks is looked up.
SALTS = 16


def spread_join(df: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """``df`` joined with ``small``, which has each key once.

    The optimizer sends ``small`` to all tasks only if its size allows it; else both meet in a shuffle in which the rows of
    every key are spread over ``SALTS`` parts.
    """
    each = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_salt", F.pmod(F.xxhash64(spread, F.lit(3)), F.lit(SALTS)).cast("int")).join(each, [*keys, "_salt"], how).drop("_salt")


def with_blocks(df: DataFrame, keys: list[str], counts: DataFrame, rows: int, spread: Column) -> DataFrame:
    """Adds ``_blocks``: into how many blocks of about ``rows`` rows the key is cut; 1 for all but the hot ones.

    ``counts`` holds the keys and ``n``. The hot keys are written on their own, so that their size is known.
    """
    hot = written(counts.where(F.col("n") > rows).select(*keys, F.ceil(F.col("n") / rows).cast("int").alias("_cut_")), "hot")
    if not hot.limit(1).count():
        return df.withColumn("_blocks", F.lit(1))
    return spread_join(df, hot, keys, spread, "left").withColumn("_blocks", F.coalesce("_cut_", F.lit(1))).drop("_cut_")


def hot_join(df: DataFrame, table: DataFrame, key: str, spread: Column, counted: DataFrame | None = None, rows: int = 100_000) -> DataFrame:
    """Inner join of ``df`` with a ``table`` that has each key once; the rows of hot keys are cut into blocks of about ``rows`` rows.

    Keys are counted in ``counted``, if given: a table at hand of which ``df`` holds no more rows for any key.
    """
    counts = written((df if counted is None else counted).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > rows), "hot")
    if not counts.limit(1).count():
        return df.join(table, key)
    d = with_blocks(df, [key], counts, rows, spread).withColumn("_blk", F.pmod(F.xxhash64(spread), F.col("_blocks")).cast("int")).drop("_blocks")
    copies = counts.select(key, F.ceil(F.col("n") / rows).cast("int").alias("_cut_"))
    t = table.join(copies, key, "left").withColumn("_blk", F.explode(F.sequence(F.lit(0), F.coalesce("_cut_", F.lit(1)) - 1))).drop("_cut_")
    return d.join(t, [key, "_blk"]).drop("_blk")


def block_pairs(df: DataFrame, spread: Column) -> DataFrame:
    """Rows with ``_blocks`` once for every pair of blocks that holds their own: adds ``own``, ``b1`` <= ``b2``."""
    d = df.withColumn("own", F.pmod(F.xxhash64(spread), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return d.withColumn("b1", F.least("own", "_other")).withColumn("b2", F.greatest("own", "_other")).drop("_other", "_blocks")


def pairs_within(members: DataFrame, group: str, item: str, rows: int = 2_000) -> DataFrame:
    """(``_a``, ``_b``), _a < _b: all pairs of distinct items of a group, hot groups by pairs of blocks."""
    counts = written(members.groupBy(group).agg(F.count("*").alias("n")).where("n > 1"), "groups")
    d = members.join(counts.select(group), group, "left_semi").select(group, F.col(item).alias("_i"))
    if not counts.where(F.col("n") > rows).limit(1).count():
        return d.withColumnRenamed("_i", "_a").join(d.withColumnRenamed("_i", "_b"), group).where("_a < _b").select("_a", "_b")
    d = block_pairs(with_blocks(d, [group], counts, rows, F.col("_i")), F.col("_i"))
    left = d.select(group, "b1", "b2", F.col("own").alias("_oa"), F.col("_i").alias("_a"))
    right = d.select(group, "b1", "b2", F.col("own").alias("_ob"), F.col("_i").alias("_b"))
    # two blocks meet in their own pair only, one block within itself
    return left.join(right, [group, "b1", "b2"]).where("_a < _b and (b1 = b2 or _oa <> _ob)").select("_a", "_b")


def pairs_across(pairs: DataFrame, members: DataFrame, group: str, item: str, rows: int = 2_000) -> DataFrame:
    """(``_a``, ``_b``), the smaller first: every item of group ``a`` with every item of group ``b`` of each pair.

    Items of a hot group are spread over blocks, to which the pairs of the group are sent each.
    """
    counts = written(members.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > rows), "groups")
    if not counts.limit(1).count():
        ma, mb = (members.select(F.col(group).alias(s), F.col(item).alias(f"_{s}")) for s in "ab")
        both = pairs.select("a", "b").join(ma, "a").join(mb, "b").where("_a <> _b")
        return both.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b"))
    m = with_blocks(members.select(group, F.col(item).alias("_i")), [group], counts, rows, F.col("_i"))
    m = m.withColumn("_block", F.pmod(F.xxhash64("_i"), F.col("_blocks")).cast("int"))
    blocks = counts.select(group, F.ceil(F.col("n") / rows).cast("int").alias("_blocks"))
    out = pairs.select("a", "b")
    for side in "ab":
        own = blocks.select(F.col(group).alias(side), F.col("_blocks").alias("_n"))
        out = out.join(own, side, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
        out = out.join(m.select(F.col(group).alias(side), "_block", F.col("_i").alias(f"_{side}")), [side, "_block"]).drop("_block")
    return out.where("_a <> _b").select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b"))
