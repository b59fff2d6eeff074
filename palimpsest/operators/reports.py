"""Markdown reports back into numbers, by windows and regular expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import metric_key

#: A number of a cell, alone or with an interval in brackets.
CELL = r"^\s*(-?[0-9]*\.?[0-9]+)\s*(?:\[\s*(-?[0-9.]+)\s*-\s*(-?[0-9.]+)\s*\])?\s*$"


def report_cells(reports: DataFrame) -> DataFrame:
    """``run, section, subset, metric, value, lo, hi`` of every numeric cell of the tables in (``run``, ``value``).

    The section is the nearest line above that begins with ``#``; lines that begin with ``|`` are rows, any other line ends a table. Of
    a table the first row that is no separator is the header; cells without a number are left out. ``lo`` and ``hi`` are null without brackets.
    """
    lines = reports.select("run", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    w = Window.partitionBy("run").orderBy("pos")
    heading = F.when(F.col("line").startswith("#"), F.trim(F.regexp_replace("line", r"^[# ]+", "")))
    row = F.col("line").startswith("|")
    d = lines.select("run", "pos", "line", row.alias("_row"), F.coalesce(F.last(heading, ignorenulls=True).over(w), F.lit("")).alias("section"), F.sum((~row).cast("int")).over(w).alias("_table"))
    d = d.where(F.col("_row") & ~F.col("line").rlike(r"^[|\s:-]*$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))
    d = d.withColumn("cells", cells)
    table = Window.partitionBy("run", "_table").orderBy("pos")
    d = d.withColumn("header", F.first("cells").over(table)).withColumn("_n", F.row_number().over(table)).where("_n > 1")
    each = d.select("run", "section", F.col("cells")[0].alias("subset"), F.posexplode(F.arrays_zip("header", "cells")).alias("_k", "_c")).where("_k > 0 and _c.header is not null")
    num = lambda i: F.regexp_extract(F.col("_c.cells"), CELL, i).try_cast("double")
    return each.where(F.col("_c.cells").rlike(CELL)).select("run", "section", "subset", metric_key(F.col("_c.header")).alias("metric"), num(1).alias("value"), num(2).alias("lo"), num(3).alias("hi"))


def flattened(cells: DataFrame) -> DataFrame:
    """``run_key`` (run, section and subset) with ``metric``, ``metric_ci_lo``, ``metric_ci_hi`` as rows of (``metric``, ``value``)."""
    key = F.concat_ws(" | ", "run", "section", "subset")
    rows = F.array(F.struct(F.col("metric").alias("metric"), F.col("value").alias("value")), F.struct(F.concat("metric", F.lit("_ci_lo")).alias("metric"), F.col("lo").alias("value")), F.struct(F.concat("metric", F.lit("_ci_hi")).alias("metric"), F.col("hi").alias("value")))
    return cells.select(key.alias("run_key"), F.inline(rows)).where("value is not null")
