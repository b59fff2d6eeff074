"""Duplicates of drawings from the pixels up: exact and near links, their verification, groups, and matches between splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import graph
from palimpsest.operators.audit import group_rules
from palimpsest.operators.images import possibly_among
from palimpsest.operators.similarity import best_and_counted, best_elsewhere, hamming_pairs, similar_pairs
from palimpsest.session import written

#: Least correlation of two signatures, most mean difference, what counts as a different pixel and the most of them.
NEAR, MEAN_DIFFERENCE, PIXEL_STEP, PIXEL_SHARE = 0.99, 3.0, 40, 0.01


def content_digest(x: str = "x") -> Column:
    return F.sha1(F.array_join(F.col(x).cast("array<string>"), ",").cast("binary"))


def exact_links(items: DataFrame, kind: str, digest: str) -> DataFrame:
    """(``i``, ``j``): the first item of each kind and digest with every other one. Null digests link nothing."""
    d = items.where(F.col(digest).isNotNull()).select("item_id", kind, digest)
    first = d.groupBy(kind, digest).agg(F.min("item_id").alias("i"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return d.join(first, [kind, digest]).where("item_id <> i").select("i", F.col("item_id").alias("j"))


def _packed_pixels(pixels: DataFrame) -> DataFrame:
    """``item_id`` and the values of ``x`` as bytes: their number of bytes each (one where all are within 0..255, else two), then the values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column("x").offsets.to_numpy()
            values = batch.column("x").flatten()
            # a null value differs from all others
            flat = (values.fill_null(-32768) if values.null_count else values).to_numpy(zero_copy_only=False)
            cells = []
            for lo, hi in zip(ends[:-1] - ends[0], ends[1:] - ends[0]):
                x = flat[lo:hi]
                narrow = len(x) and x.min() >= 0 and x.max() < 256
                cells.append(b"\x01" + x.astype(np.uint8).tobytes() if narrow else b"\x02" + x.astype(np.int16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(cells, pa.binary())], names=["item_id", "x"])

    return pixels.where("x is not null").select("item_id", F.col("x").cast("array<smallint>").alias("x")).mapInArrow(run, "item_id long, x binary")


def _pixels(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, np.uint8 if cell[0] == 1 else np.int16, offset=1).astype(np.int32)


def pixel_differences(pairs: DataFrame, pixels: DataFrame, step: int = PIXEL_STEP) -> DataFrame:
    """(``i``, ``j``, ``mad``, ``share``): mean absolute difference and share of pixels that differ by more than ``step``. Pairs of unequal sizes are left out."""
    # of drawings in no pair the pixels stay where they are, however many pairs there are; repeated exports have equal values
    some = possibly_among(pixels.select("item_id", "x"), pairs.select(F.explode(F.array("i", "j")).alias("item_id")))
    x = _packed_pixels(some).dropDuplicates(["item_id"])
    # both joins read the shuffle that sets repeats aside
    a, b = (x.select(F.col("item_id").alias(s), F.col("x").alias(f"_{s}")) for s in "ij")
    both = pairs.select("i", "j").join(a, "i").join(b, "j").select("i", "j", "_i", "_j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for i, j, p, q in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "_i", "_j"))):
                left, right = _pixels(p), _pixels(q)
                if len(left) == len(right) and len(left):
                    d = np.abs(left - right)
                    got.append((i, j, d.mean(), (d > step).mean()))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["i", "j", "mad", "share"])

    return both.mapInArrow(run, "i long, j long, mad double, share double")


def near_links(vectors: DataFrame, pixels: DataFrame, kind: str, least: float = NEAR, rows: DataFrame | None = None) -> DataFrame:
    """(``i``, ``j``): pairs of one kind whose signatures (``item_id``, ``v``) correlate and whose pixels bear it out. ``rows``: the kinds of all rows, where they are at hand."""
    seen = pixel_differences(written(similar_pairs(vectors, least, [kind], rows=rows), "pairs"), pixels)
    return seen.where((F.col("mad") <= MEAN_DIFFERENCE) & (F.col("share") <= PIXEL_SHARE)).select("i", "j")


def kind_digests(rows: DataFrame, drawings: DataFrame, kind: str = "drawing_type") -> DataFrame:
    """(``item_id``, ``digest``, kind) of the ``rows`` with a drawing, once for each id, written."""
    own = drawings.select("item_id", F.unhex(content_digest()).alias("digest")).dropDuplicates(["item_id"])
    return written(own.join(rows.select("item_id", kind), "item_id"), "digests")


def grouped_manifest(rows: DataFrame, drawings: DataFrame, vectors: DataFrame | Callable[[DataFrame], DataFrame], kind: str = "drawing_type", least: float = NEAR, digests: DataFrame | None = None) -> DataFrame:
    """``rows`` (``item_id``, ``path``, ``split``, ``diagnosis``, ``name_number``, kind) with the groups their drawings form: ``group_id`` (the least item),
    ``group_size``, ``group_conflict``, ``role`` and ``split_clean``. ``drawings`` holds ``item_id`` and ``x``, ``vectors`` ``item_id`` and ``v``, or makes
    them of some of the ``drawings``; ``digests`` are those of ``kind_digests``, where they are at hand.

    Of exact copies only the first goes to the comparison of signatures, so copies cost a digest each. Rows without a drawing are left out.
    """
    digests = kind_digests(rows, drawings, kind) if digests is None else digests
    exact = written(exact_links(digests, kind, "digest"), "exact")
    alone = written(digests.select("item_id", kind).join(exact.select(F.col("j").alias("item_id")), "item_id", "left_anti"), "alone")
    v = vectors(possibly_among(drawings, alone)) if callable(vectors) else vectors
    # the join has brought repeats together
    v = v.select("item_id", "v").join(alone, "item_id").dropDuplicates(["item_id"])
    edges = exact.unionByName(near_links(v, drawings, kind, least, alone))
    groups = graph.with_singletons(digests.select("item_id"), graph.components(edges), "item_id").withColumnRenamed("component", "group_id")
    out = group_rules(rows.join(groups, "item_id"))
    return out.select("item_id", "path", "group_id", F.col("_size").alias("group_size"), F.col("_conflict").alias("group_conflict"), F.col("_role").alias("role"), F.col("_clean").alias("split_clean"))


def link_counts(digests: DataFrame, grouped: DataFrame, kind: str = "drawing_type") -> DataFrame:
    """One row: files, groups, exact links and near links. A link counts where it joins two groups, so links are files less groups."""
    n = digests.groupBy(kind, "digest").agg((F.count("*") - 1).alias("_l")).agg(F.coalesce(F.sum("_l"), F.lit(0)).alias("exact_links"))
    g = grouped.agg(F.count("*").alias("n_files"), F.countDistinct("group_id").alias("n_groups"))
    return g.join(F.broadcast(n)).select("n_files", "n_groups", "exact_links", (F.col("n_files") - F.col("n_groups") - F.col("exact_links")).alias("near_links"))  # single rows


def split_matches(nodes: DataFrame, kind: str, held: str = "val", reference: str = "train", least: float = -np.inf) -> DataFrame:
    """(``i``, ``j``, ``sim``): for each drawing (``item_id``, ``split``, ``v``) of the split ``held`` the most similar one of its kind in the split ``reference``, if
    it is as similar as ``least``."""
    side = nodes.where(F.col("split").isin(held, reference)).withColumn("_asks", F.col("split") == held)
    return best_elsewhere(side, "_asks", [kind], least=least)


def matches_and_pairs(nodes: DataFrame, kind: str, least: float, held: str = "val", reference: str = "train") -> tuple[DataFrame, DataFrame]:
    """``split_matches``, and (``i``, ``step``, ``n``): the pairs of ``least`` or more inside ``reference``, counted for the kind of the row ``i``, to be summed."""
    side = nodes.where(F.col("split").isin(held, reference)).withColumn("_asks", F.col("split") == held)
    return best_and_counted(side, "_asks", least, [kind])


def cross_split_duplicates(items: DataFrame, kind: str, digest: str, bits: str, split: str = "split", most: int = 0, test: str = "test", train: str = "train") -> DataFrame:
    """(``kind``, ``train``, ``test``, ``match``): items of the two splits and one kind with equal content (``exact``), else with hashes that differ
    in ``most`` bits at most (``near``). Hashes meet only where a segment of them is equal."""
    s = items.where(F.col(split).isin(train, test)).select("item_id", F.col(kind).alias("_kind"), F.col(digest).alias("_d"), F.col(bits).alias("bits"), F.col(split).alias("_s"))
    a = s.where(F.col("_s") == train).select(F.col("item_id").alias("train"), "_kind", "_d")
    b = s.where(F.col("_s") == test).select(F.col("item_id").alias("test"), "_kind", "_d")
    exact = a.join(b, ["_kind", "_d"]).select(F.col("_kind").alias("kind"), "train", "test")
    near = hamming_pairs(s, most, "_kind", across="_s").select("i", "j")
    of = s.select(F.col("item_id").alias("i"), F.col("_kind").alias("kind"), (F.col("_s") == train).alias("_t"))
    near = near.join(of, "i").select("kind", F.when(F.col("_t"), F.col("i")).otherwise(F.col("j")).alias("train"), F.when(F.col("_t"), F.col("j")).otherwise(F.col("i")).alias("test"))
    near = near.join(exact, ["kind", "train", "test"], "left_anti")
    return exact.withColumn("match", F.lit("exact")).unionByName(near.withColumn("match", F.lit("near")))
