"""Rank and threshold metrics as grouped aggregations, weighted so that they also serve the bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.ranks import join_on, pieces


def confusion(df: DataFrame, by: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    n = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return df.groupBy(*by).agg(*[F.count_if((F.col(y) == a) & (F.col(pred) == b)).alias(name) for name, (a, b) in n.items()])


def rates(conf: DataFrame) -> DataFrame:
    """Accuracy, sensitivity, specificity and balanced accuracy; undefined ones are null and left out of the mean."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    sens, spec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    both = F.when(sens.isNull(), spec).when(spec.isNull(), sens).otherwise((sens + spec) / 2)
    return conf.select("*", F.try_divide(tp + tn, tn + fp + fn + tp).alias("accuracy"), sens.alias("sensitivity"), spec.alias("specificity"), both.alias("balanced_accuracy"))


def _by_score(df: DataFrame, by: list[str], y: str, score: str, weight: str | None) -> DataFrame:
    """Positive and negative weight at each distinct score: the window runs over scores, not rows."""
    w = F.col(weight) if weight else F.lit(1)
    return (
        df.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(y).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("_s"))
        .agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("_p"), F.sum(F.when(F.col(y) == 0, w).otherwise(0)).alias("_n"))
    )


def _in_order(df: DataFrame, by: list[str], y: str, score: str, weight: str | None) -> DataFrame:
    """Weights at each distinct score with ``_bp`` and ``_bn``, the weights of all smaller scores, and ``_tp``, ``_tn``, those of all.

    Windows run over pieces of a group and over the sums of the pieces, so that no group is sorted in one task.
    """
    d = pieces(_by_score(df, by, y, score, weight), by, "_s")
    sums = d.groupBy(*by, "_piece").agg(F.sum("_p").alias("_sp"), F.sum("_n").alias("_sn"))
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    sums = sums.select(*by, "_piece", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_0{c}") for c in ("_sp", "_sn")], F.sum("_sp").over(whole).alias("_tp"), F.sum("_sn").over(whole).alias("_tn"))
    inside = Window.partitionBy(*by, "_piece").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({"_ip": F.coalesce(F.sum("_p").over(inside), F.lit(0)), "_in": F.coalesce(F.sum("_n").over(inside), F.lit(0))})
    return join_on(d, sums, [*by, "_piece"]).withColumns({"_bp": F.col("_ip") + F.col("_0_sp"), "_bn": F.col("_in") + F.col("_0_sn")})


def auc_roc(df: DataFrame, by: list[str], y: str = "y", score: str = "score", weight: str | None = None) -> DataFrame:
    """``auc`` with average ties (Mann-Whitney) for each group of ``by``; null where a class is missing."""
    d = _in_order(df, by, y, score, weight).withColumn("_u", F.col("_p") * (F.col("_bn") + F.col("_n") / 2))
    return d.groupBy(*by).agg(F.try_divide(F.sum("_u"), (F.sum("_p") * F.sum("_n")).cast("double")).alias("auc"))


def average_precision(df: DataFrame, by: list[str], y: str = "y", score: str = "score", weight: str | None = None) -> DataFrame:
    """``ap``: precision summed over steps of recall, equal scores as one step; null without positives."""
    d = _in_order(df, by, y, score, weight)
    tp, fp = F.col("_tp") - F.col("_bp"), F.col("_tn") - F.col("_bn")
    d = d.withColumn("_a", F.try_divide(F.col("_p") * tp, (tp + fp).cast("double")))
    return d.groupBy(*by).agg(F.try_divide(F.sum("_a"), F.sum("_p").cast("double")).alias("ap"))


def folded(auc: DataFrame) -> DataFrame:
    """Direction and ``max(auc, 1 - auc)`` of single features."""
    return auc.withColumn("direction", F.when(F.col("auc") >= 0.5, "higher").otherwise("lower")).withColumn("folded_auc", F.greatest("auc", 1 - F.col("auc")))


def all_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, sensitivity, specificity, balanced accuracy, AUC and average precision for each group."""
    r = rates(confusion(df, by)).drop("tn", "fp", "fn", "tp")
    return join_on(join_on(r, auc_roc(df, by), by, "left"), average_precision(df, by), by, "left")
