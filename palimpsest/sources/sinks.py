"""Writers: tables, capped pair lists, reports and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.ranks import join_on, ranked


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def top_pairs(pairs: DataFrame, n: int = 1_000) -> DataFrame:
    """The ``n`` pairs of highest correlation with four decimals; ties by the two paths. Null and NaN are left out."""
    p = pairs.where(F.col("correlation").isNotNull() & ~F.isnan("correlation"))
    return p.orderBy(F.desc("correlation"), "val_path", "train_path", "val_label", "train_label").limit(n).withColumn("correlation", F.round("correlation", 4))


def clusters_across_types(members: DataFrame, part: str = "drawing_type", comp: str = "component") -> DataFrame:
    """``cluster``: numbers from 0 that are unique across parts, by distributed ranks of the distinct clusters."""
    ids = ranked(members.select(part, comp).distinct(), [], [part, comp]).select(part, comp, F.col("_rank").alias("cluster"))
    return join_on(members, ids, [part, comp])


def markdown(df: DataFrame, title: str, most: int = 10_000) -> str:
    """A small result as a markdown table. A result of more than ``most`` rows is an error: a table for readers is never cut short."""
    cols = df.columns
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report; write them as a table")
    out = [f"# {title}", "", "| " + " | ".join(cols) + " |", "|" + " --- |" * len(cols)]
    out += ["| " + " | ".join("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
    return "\n".join(out) + "\n"


def _text_map(values: dict | None):
    return F.create_map(*[F.lit(str(x)) for kv in sorted(values.items()) for x in kv]) if values else F.lit(None).cast("map<string,string>")


def log_run(df: DataFrame, path: str, run: str, params: dict | None = None, tags: dict | None = None, artifacts: dict | None = None) -> None:
    """Append metrics (``metric``, ``value``) of a run with its parameters, tags and artifacts (name -> path) to the table of runs."""
    df.select(
        F.lit(run).alias("run"), F.current_timestamp().alias("logged_at"), "metric", F.col("value").cast("double").alias("value"), _text_map(params).alias("params"), _text_map(tags).alias("tags"), _text_map(artifacts).alias("artifacts")
    ).write.mode("append").parquet(path)
