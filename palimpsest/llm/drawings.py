"""What the operators on drawings share: usable rows, stacks from Arrow batches, exact checks of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.images import best_turned_cosine, centred, upright
from palimpsest.llm.names import known_type
from palimpsest.operators.images import possibly_among


def usable(cache: DataFrame, pixels: str = "x", varied: bool = True) -> DataFrame:
    """``item_id``, ``part`` (drawing type, or empty), ``height``, ``width``, ``x`` of the usable rows.

    Usable: height * width values that are not all equal. Null ids, sizes, ``x`` or values are not usable.
    Rows exported twice stay twice. Decided in the JVM by compiled expressions; only a null among the values is
    left to ``stacks``, which drops such rows, as looking for it here would run a lambda on every value. Without ``varied``
    the caller drops the rows whose values are all equal (see ``uneven``), which numpy finds in a fraction of the time.
    """
    x = F.col(pixels)
    rows = cache.select(
        F.col("item_id").cast("long").alias("item_id"),
        F.coalesce(known_type(F.col("drawing_type"), F.col("class_name")), F.lit("")).alias("part"),
        F.col("height").cast("int").alias("height"),
        F.col("width").cast("int").alias("width"),
        x.cast("array<smallint>").alias("x"),
    ).where("item_id is not null and height > 0 and width > 0 and size(x) = height * width")
    return rows.where("array_min(x) < array_max(x)") if varied else rows


def uneven(px: np.ndarray) -> np.ndarray:
    """Numbers of the rows of pixels (n, h*w) whose values are not all equal."""
    return np.flatnonzero(px.min(axis=1) < px.max(axis=1))


def whole_maps(cache: DataFrame) -> DataFrame:
    """``item_id``, ``height``, ``width``, ``x`` with as many values as the sizes say: enough for drawings known to be usable."""
    sizes = [F.col(c).cast("int").alias(c) for c in ("height", "width")]
    return cache.select(F.col("item_id").cast("long").alias("item_id"), *sizes, F.col("x").cast("array<smallint>").alias("x")).where("height > 0 and width > 0 and size(x) = height * width")


def stacks(batch: pa.RecordBatch, column: str = "x") -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(row numbers, pixels (n, h*w), h, w) for every shape in the batch, oblong ones laid on the long side; rows with a null value are left out."""
    h, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("height", "width"))
    values = batch.column(column).flatten()
    ends = np.concatenate([[0], np.cumsum(h.astype(np.int64) * w)])
    whole = np.ones(batch.num_rows, bool)
    if values.null_count:
        whole[np.searchsorted(ends, np.flatnonzero(values.is_null().to_numpy(zero_copy_only=False)), "right") - 1] = False
        values = values.fill_null(0)
    flat = values.to_numpy(zero_copy_only=False)
    for hh, ww in sorted(set(zip(h.tolist(), w.tolist()))):
        rows = np.flatnonzero((h == hh) & (w == ww) & whole)
        if not len(rows):
            continue
        if len(rows) == batch.num_rows:
            px = flat.reshape(-1, hh * ww)
        else:
            px = np.stack([flat[ends[r] : ends[r + 1]] for r in rows])
        yield rows, *upright(px, hh, ww)


def possibly_needed(drawings: DataFrame, pairs: DataFrame) -> DataFrame:
    """``drawings`` less most of those in no pair (``a``, ``b``), see ``possibly_among``."""
    return possibly_among(drawings, pairs.select(F.explode(F.array("a", "b")).alias("item_id")))


def alike_pairs(pairs: DataFrame, drawings: DataFrame, least: float) -> DataFrame:
    """Keep the pairs (``a``, ``b``) whose drawings have a turned cosine of at least ``least``; adds ``similarity``.

    ``drawings`` have height * width values; an id exported twice gives a pair several times, which counts once. Two joins on
    the id, which reuse one exchange; no drawing is sent anywhere but to its pairs.
    """
    d = possibly_needed(drawings.select("item_id", "height", "width", "x"), pairs)
    left = d.select(F.col("item_id").alias("a"), F.col("height").alias("ha"), F.col("width").alias("wa"), F.col("x").alias("xa"))
    right = d.select(F.col("item_id").alias("b"), F.col("height").alias("hb"), F.col("width").alias("wb"), F.col("x").alias("xb"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    joined = joined.where("least(ha, wa) = least(hb, wb) and greatest(ha, wa) = greatest(hb, wb)")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
        for batch in batches:
            a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in "ab")
            sim = np.zeros(batch.num_rows)
            sides = []
            for s in "ab":
                side = pa.RecordBatch.from_arrays([batch.column(f"h{s}"), batch.column(f"w{s}"), batch.column(f"x{s}")], names=["height", "width", "x"])
                at, px, shape = np.zeros((batch.num_rows, 2), np.int64), [], []
                for k, (rows, pixels, h, w) in enumerate(stacks(side)):
                    at[rows, 0], at[rows, 1] = k, np.arange(len(rows))
                    px.append(centred(pixels))
                    shape.append((h, w))
                sides.append((at, px, shape))
            (ta, pa_, sa), (tb, pb, _) = sides
            for ka in range(len(pa_)):
                for kb in range(len(pb)):
                    rows = np.flatnonzero((ta[:, 0] == ka) & (tb[:, 0] == kb))
                    for lo in range(0, len(rows), 2048):
                        r = rows[lo : lo + 2048]
                        sim[r] = best_turned_cosine(pa_[ka][ta[r, 1]], pb[kb][tb[r, 1]], *sa[ka])
            good = sim >= least - 1e-9
            yield pa.RecordBatch.from_arrays([pa.array(a[good], pa.int64()), pa.array(b[good], pa.int64()), pa.array(sim[good], pa.float64())], schema=schema)

    checked = joined.select("a", "b", "ha", "wa", "xa", "hb", "wb", "xb").mapInArrow(check, "a long, b long, similarity double")
    return checked.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
