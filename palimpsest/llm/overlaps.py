"""Problem 5: the same or nearly the same records in evaluation and training splits.

The names of all records are laid out as texts and all their suffixes are put into one suffix array, partitioned by range and
sorted inside each partition. Of each suffix the longest common prefix with any suffix of another side (split) is that with
its nearest one of another side before or after it. Where that neighbour lies in another partition, the last and first
suffixes of the partitions, a few for each, tell its length. These prefixes are the shared spans: merged they give the
coverage of a record, and a span that holds the whole unit of a name (its words and number) makes it a candidate.

Suffixes are kept as their first ``KEY`` characters: a longer shared span shows as one of at least ``KEY`` characters at each
of its places, so the merged coverage stays exact and the array needs ``KEY`` characters for each character of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.blocks import pairs_across
from palimpsest.llm.names import named, part_of, with_cores
from palimpsest.session import shuffle_width, written

#: Characters of a suffix that are kept.
KEY = 64
#: Least length of a shared span.
LEAST = 8


def common_prefixes(keys: list[str]) -> np.ndarray:
    """Length of the common prefix of each key with the one before it (0 for the first)."""
    a = np.array(keys, dtype=np.str_)
    wide = a.view(np.uint32).reshape(len(a), -1)
    differs = wide[1:] != wide[:-1]
    length = np.where(differs.any(axis=1), differs.argmax(axis=1), wide.shape[1])
    own = np.char.str_len(a)
    return np.concatenate([[0], np.minimum(length, np.minimum(own[1:], own[:-1]))]).astype(np.int32)


def to_other_side(lcp: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix, open) for each suffix in order: the common prefix with the nearest suffix before it of another side; where all
    before it are of its own side (``open``), that with the first suffix."""
    n = len(lcp)
    start = np.concatenate([[True], side[1:] != side[:-1]])
    run = np.cumsum(start) - 1
    # least of the prefixes since the run began: later runs are moved below all earlier ones, so that one pass serves all
    big = int(lcp.max(initial=0)) + 1
    first = lcp.astype(np.int64).copy()
    first[0] = big - 1
    least = np.minimum.accumulate(first - run * big) + run * big
    return least.astype(np.int32), np.arange(n) < (np.flatnonzero(start)[1] if run[-1] else n)


def _array_of(sides: int):
    """Rows of one partition of the array in order -> spans (kind 0) and what other partitions need of this one (kinds 1 to 4)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lcps, sides_, rids, ats, offs, wanted = [], [], [], [], [], []
        last = ""
        first_of: dict[int, str] = {}
        last_of: dict[int, str] = {}
        head = pid = None
        for f in frames:
            if not len(f):
                continue
            keys, s = f["key"].tolist(), f["side"].to_numpy(np.int8)
            if head is None:
                head, pid = keys[0], int(f["pid"].iloc[0])
            lcps.append(common_prefixes([last, *keys])[1:])
            last = keys[-1]
            for v in np.unique(s):
                at = np.flatnonzero(s == v)
                first_of.setdefault(int(v), keys[at[0]])
                last_of[int(v)] = keys[at[-1]]
            sides_.append(s)
            rids.append(f["rid"].to_numpy(np.int64))
            ats.append(f["at"].to_numpy(np.int32))
            offs.append(f["off"].to_numpy(np.int32))
            wanted.append(f["wanted"].to_numpy(bool))
        if head is None:
            return
        lcp, side = np.concatenate(lcps), np.concatenate(sides_)
        before, open_b = to_other_side(lcp, side)
        back = np.concatenate([lcp[1:], [0]])[::-1]
        after, open_a = (x[::-1] for x in to_other_side(back, side[::-1]))
        off = np.concatenate(offs)
        # an open end reaches as far as the common prefix with the partition's first or last suffix, the whole key for that one itself
        keep = (np.maximum(before, after) - off >= LEAST) & np.concatenate(wanted)
        yield pd.DataFrame(
            {
                "kind": 0, "pid": pid, "rid": np.concatenate(rids)[keep], "at": np.concatenate(ats)[keep], "off": off[keep], "side": side[keep].astype(np.int32),
                "before": before[keep], "open_before": open_b[keep], "after": after[keep], "open_after": open_a[keep], "key": None,
            },
            columns=ROWS,
        )
        edges = [(1, -1, head), (2, -1, last), *((3, v, k) for v, k in first_of.items()), *((4, v, k) for v, k in last_of.items())]
        yield pd.DataFrame([(kind, pid, 0, 0, 0, v, 0, False, 0, False, key) for kind, v, key in edges], columns=ROWS)

    return run


ROWS = ["kind", "pid", "rid", "at", "off", "side", "before", "open_before", "after", "open_after", "key"]
ROW_TYPES = "kind int, pid int, rid long, at int, off int, side int, before int, open_before boolean, after int, open_after boolean, key string"


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def shared_spans(texts: DataFrame, sides: int) -> DataFrame:
    """(``rid``, ``at``, ``length``): places of the texts from which ``LEAST`` characters or more also stand in a text of another side.

    ``texts``: ``rid`` (one for each text and side), ``group`` (only texts of one group are compared), ``text`` and ``side`` (0 to
    ``sides`` - 1). ``length`` is the longest such span, ``KEY`` at most. Null and shorter texts have none. With a column ``only`` all
    suffixes make the array, but just the one at that place of each text is reported.
    """
    spark = texts.sparkSession
    only = F.col("only") if "only" in texts.columns else F.lit(None)
    rows = texts.where(F.length("text") >= LEAST).select("rid", "group", "text", "side", only.cast("int").alias("only"), (F.length("group") + 1).cast("int").alias("off"))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("text") - LEAST)))
    wanted = F.coalesce(F.col("at") == F.col("only"), F.lit(True)).alias("wanted")
    rows = rows.select(F.concat("group", F.lit("|"), F.expr(f"substring(text, at + 1, {KEY})")).alias("key"), "rid", "at", "off", F.col("side").cast("int").alias("side"), wanted)
    array = rows.repartitionByRange(shuffle_width(spark), "key", "rid").sortWithinPartitions("key", "rid", "at").withColumn("pid", F.spark_partition_id())
    got = written(array.mapInPandas(_array_of(sides), ROW_TYPES), "suffixes")
    # a few rows for each partition of the array, whatever the number of texts
    edges = got.where("kind > 0").select("kind", "pid", "side", "key").collect()
    of = {(e["kind"], e["pid"], e["side"]): e["key"] for e in edges}
    order = sorted({e["pid"] for e in edges})
    ends = []
    for step, mine, theirs in ((1, 1, 4), (-1, 2, 3)):
        seen: dict[int, str] = {}
        for pid in order[::step]:
            head = of[mine, pid, -1]
            for s in range(sides):
                near = [_prefix(head, k) for v, k in seen.items() if v != s]
                ends.append((pid, s, step, max(near, default=0)))
            seen |= {s: of[theirs, pid, s] for s in range(sides) if (theirs, pid, s) in of}
    reach = spark.createDataFrame(ends, "pid int, side int, step int, reach int")
    b, a = (reach.where(f"step = {step}").select("pid", "side", F.col("reach").alias(n)) for step, n in ((1, "_b"), (-1, "_a")))
    spans = got.where("kind = 0").join(F.broadcast(b), ["pid", "side"]).join(F.broadcast(a), ["pid", "side"])
    best = F.greatest(F.when(F.col("open_before"), F.least("before", "_b")).otherwise(F.col("before")), F.when(F.col("open_after"), F.least("after", "_a")).otherwise(F.col("after")))
    return spans.select("rid", "at", (best - F.col("off")).alias("length")).where(F.col("length") >= LEAST)


def name_overlaps(manifest: DataFrame) -> DataFrame:
    """(``item_a``, ``item_b``) with the smaller id first: one listed in training, the other in an evaluation
    split, whose names tell the same drawing of the same type. Unknown and null splits count for none.

    The texts are the spelled file names. A record goes on if the suffix array shows that its whole unit stands in a name of
    the other side; records with the same span are then compared in full (what follows the number, and the trial).
    """
    listed = written(named(manifest, part_of(F.col("split")).alias("part")), "names")
    items = listed.where("part is not null").withColumn("side", (F.col("part") != "train").cast("int"))
    texts = items.select("type", "stem", "side").distinct().withColumn("rid", F.xxhash64("type", "stem", "side"))
    known = written(texts.join(with_cores(listed.select("type", "stem").distinct()), ["type", "stem"]), "texts")
    spans = shared_spans(known.select("rid", F.col("type").alias("group"), F.concat("stem", F.lit("  ")).alias("text"), "side", F.col("lead").alias("only")), 2)
    whole = F.least(F.length("unit") + 1, F.lit(KEY))  # the blank that ends the unit stands in the other name too
    long = known.join(spans.select("rid", "length"), "rid").where(F.col("length") >= whole)
    short = known.where(F.length("unit") + 2 < LEAST)  # too short for the array
    bound = long.select("rid", "type", "unit", "rest", "trial", "side").unionByName(short.select("rid", "type", "unit", "rest", "trial", "side"))
    train, held = (bound.where(F.col("side") == s).select("type", "unit", "rest", "trial", F.col("rid").alias(n)) for s, n in ((0, "a"), (1, "b")))
    pairs = train.join(held, ["type", "unit", "rest", "trial"]).select("a", "b")
    members = items.select(F.xxhash64("type", "stem", "side").alias("rid"), "item_id").distinct()
    return pairs_across(pairs, members, "rid", "item_id").select(F.col("_a").alias("item_a"), F.col("_b").alias("item_b")).distinct()


def overlap_report(manifest: DataFrame) -> DataFrame:
    """Overlapping evaluation records for every part and source: ``part``, ``source``, ``n_items`` (listed),
    ``n_overlapping`` (whose drawing is in training too). Null sources are counted as ``(none)``.
    """
    pairs = name_overlaps(manifest)
    ends = pairs.select(F.explode(F.array("item_a", "item_b")).alias("_hit")).distinct()
    listed = (
        manifest.select("item_id", part_of(F.col("split")).alias("part"), F.coalesce("source", F.lit("(none)")).alias("source")).where("part in ('val', 'test')").distinct()
    )
    return (
        listed.join(ends, F.col("item_id") == F.col("_hit"), "left")
        .groupBy("part", "source")
        .agg(F.countDistinct("item_id").alias("n_items"), F.countDistinct(F.when(F.col("_hit").isNotNull(), F.col("item_id"))).alias("n_overlapping"))
    )


def span_coverage(manifest: DataFrame) -> DataFrame:
    """``item_id``, ``part``, ``length`` of its spelled name and ``covered``: characters of it in spans of ``LEAST`` or more
    that also occur in the name of a record of the same type and another part. Spans that overlap are merged.
    """
    items = written(named(manifest, part_of(F.col("split")).alias("part")).where("part is not null").withColumn("rid", F.xxhash64("type", "stem", "part")), "names")
    side = F.when(F.col("part") == "train", 0).when(F.col("part") == "val", 1).otherwise(2).alias("side")
    spans = shared_spans(items.select("rid", F.col("type").alias("group"), F.col("stem").alias("text"), side).distinct(), 3)
    crossing = spans.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("at", "length"))).alias("_s"))
    merged = F.expr(
        "aggregate(_s, named_struct('end', 0, 'sum', 0), (a, s) -> named_struct("
        "'end', greatest(a.end, s.at + s.length), 'sum', a.sum + greatest(0, s.at + s.length - greatest(a.end, s.at))), a -> a.sum)"
    )
    got = crossing.select("rid", merged.alias("_covered"))
    length = F.length("stem")
    return items.select("item_id", "part", "rid", length.alias("length")).distinct().join(got, "rid", "left").select("item_id", "part", "length", F.least("length", F.coalesce("_covered", F.lit(0))).alias("covered"))
