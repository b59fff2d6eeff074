"""Every core query with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.plans import audits, evaluation, pixels, relational

PLANS = (relational, evaluation, pixels, audits)


def queries() -> dict:
    return {n: q for p in PLANS for n, q in p.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {n: q for p in PLANS for n, q in p.oracle_sql().items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1-NN scores against other folds and their AUC for each fold: scan, similarity join, model, metric."""
    return evaluation.knn_auc(spark, sf_dir)
