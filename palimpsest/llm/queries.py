"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import abuse, families, leaks, links, neardup, neighbours, overlaps, splits, tokens
from palimpsest.session import table as t

Query = Callable[[SparkSession, str], DataFrame]


@lru_cache(maxsize=4)
def _model(session: str, d: str) -> abuse.NoisyOr:
    """Fitted once for each application and set of tables."""
    s = SparkSession.getActiveSession()
    return abuse.fitted(t(s, d, "documents"), t(s, d, "review_labels"))


def _scores(s: SparkSession, d: str) -> DataFrame:
    return abuse.scored(t(s, d, "documents"), _model(s.sparkContext.applicationId, d))


def _assignment(s: SparkSession, d: str) -> DataFrame:
    comps = splits.components(t(s, d, "yolo_full_manifest_clean"), "group_id", "split_clean", "diagnosis")
    return splits.whole_group_splits(comps)


def _balance(s: SparkSession, d: str) -> DataFrame:
    comps = splits.components(t(s, d, "yolo_full_manifest_clean"), "group_id", "split_clean", "diagnosis")
    return splits.split_balance(comps, splits.whole_group_splits(comps))


def _refreshed(s: SparkSession, d: str) -> DataFrame:
    groups = links.linked_files(t(s, d, "near_duplicates_pairs"), t(s, d, "yolo_full_manifest"))
    return links.refreshed_groups(t(s, d, "yolo_full_manifest_clean"), groups)


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: neardup.near_duplicates(t(s, d, "yolo_full_manifest"), t(s, d, "cnn_cache_128")),
        "p1_groups": lambda s, d: neardup.drawing_groups(t(s, d, "cnn_cache_128")),
        "p2_found": lambda s, d: neighbours.nearest_drawings(t(s, d, "cnn_cache_128"), "item_id % 20 = 3").select("item_id", "near_item_id"),
        "p2_neighbours": lambda s, d: neighbours.nearest_drawings(t(s, d, "cnn_cache_128"), "item_id % 100 = 0"),
        "p3_found": lambda s, d: families.cluster_members(t(s, d, "cnn_cache_128")),
        "p3_clusters": lambda s, d: families.cluster_summaries(t(s, d, "cnn_cache_128")),
        "p4_found": lambda s, d: links.linked_files(t(s, d, "near_duplicates_pairs"), t(s, d, "yolo_full_manifest")),
        "p4_refreshed_groups": _refreshed,
        "p5_found": lambda s, d: overlaps.name_overlaps(t(s, d, "yolo_full_manifest")),
        "p5_report": lambda s, d: overlaps.overlap_report(t(s, d, "yolo_full_manifest")),
        "p5_coverage": lambda s, d: overlaps.span_coverage(t(s, d, "yolo_full_manifest")),
        "p6_found": lambda s, d: splits.torn_groups(t(s, d, "yolo_full_manifest_clean")),
        "p6_assignment": _assignment,
        "p6_balance": _balance,
        "p6_records": lambda s, d: splits.assigned_records(t(s, d, "yolo_full_manifest_clean"), _assignment(s, d)),
        "p7_ids": lambda s, d: tokens.encoded(t(s, d, "documents")),
        "p7_counts": lambda s, d: tokens.token_counts(t(s, d, "documents")),
        "p8_found": lambda s, d: leaks.passage_leaks(t(s, d, "documents"), t(s, d, "eval_items")),
        "p9_found": lambda s, d: abuse.flagged(_scores(s, d)),
        "p9_scores": _scores,
        "p9_rates": lambda s, d: abuse.source_rates(_scores(s, d)),
    }


_PART = "CASE WHEN lower(trim({0})) IN ('train','training','tr') THEN 'train' WHEN lower(trim({0})) IN ('val','valid','validation','dev') THEN 'val' WHEN lower(trim({0})) IN ('test','testing','eval') THEN 'test' END"


def oracle_sql() -> dict[str, str]:
    part = _PART.format("split_clean")
    return {
        "p4_found": """
            WITH RECURSIVE f AS (
              SELECT replace(lower(trim(path)), chr(92), '/') AS p, min(item_id) AS id FROM yolo_full_manifest WHERE path IS NOT NULL GROUP BY 1
            ), e AS (
              SELECT DISTINCT a.id AS i, b.id AS j FROM near_duplicates_pairs n
              JOIN f a ON a.p = replace(lower(trim(n.val_path)), chr(92), '/')
              JOIN f b ON b.p = replace(lower(trim(n.train_path)), chr(92), '/')
              WHERE n.correlation >= 0.99 AND NOT isnan(n.correlation) AND a.id <> b.id
            ), s AS (SELECT i, j FROM e UNION SELECT j, i FROM e),
            r AS (SELECT i AS node, i AS reach FROM s UNION SELECT r.node, s.j FROM r JOIN s ON s.i = r.reach)
            SELECT node AS item_id, min(reach) AS group_item_id FROM r GROUP BY 1""",
        "p6_found": f"SELECT group_id FROM yolo_full_manifest_clean WHERE group_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {part}) > 1",
    }
