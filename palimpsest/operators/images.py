"""Measures of cached drawings as DataFrame operators: one Arrow pass each, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import kernels
from palimpsest.operators.similarity import packed


def complete(cache: DataFrame, pixels: str = "x") -> DataFrame:
    """Rows with height * width values."""
    return cache.where((F.size(pixels) == F.col("height") * F.col("width")) & F.col("item_id").isNotNull())


def whole(cache: DataFrame, pixels: str = "x") -> DataFrame:
    """Complete rows, once for each id (exports repeat rows with equal values)."""
    return complete(cache, pixels).dropDuplicates(["item_id"])


def measured(df: DataFrame, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], names: list[str], keep: list[str] | None = None, pixels: str = "x") -> DataFrame:
    """``keep`` columns and a double for each name of what ``kernel`` gives for stacks (n, h, w). NaN becomes null."""
    keep = keep or ["item_id"]
    fields = [df.schema[k] for k in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{n}` double" for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_h", "_w"))
            flat = batch.column("_x").flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(h.astype(np.int64) * w)])
            out = {n: np.full(batch.num_rows, np.nan) for n in names}
            for hh, ww in sorted(set(zip(h.tolist(), w.tolist()))):
                rows = np.flatnonzero((h == hh) & (w == ww))
                x = np.stack([flat[ends[r] : ends[r + 1]] for r in rows]).reshape(-1, hh, ww)
                got = kernel(x)
                for n in names:
                    out[n][rows] = got[n]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(out[n], from_pandas=True) for n in names], names=[*keep, *names])

    return df.select(*keep, F.col("height").alias("_h"), F.col("width").alias("_w"), F.col(pixels).alias("_x")).mapInArrow(run, schema)


def transformed(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], pixels: str = "x", out_type: str = "smallint") -> DataFrame:
    """``item_id``, ``height``, ``width``, ``x`` of what ``kernel`` makes of stacks (n, h, w)."""
    kind = {"smallint": pa.int16(), "float": pa.float32(), "double": pa.float64()}[out_type]
    schema = pa.schema([("item_id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("x", pa.list_(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, h, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("item_id", "_h", "_w"))
            flat = batch.column("_x").flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(h.astype(np.int64) * w)])
            for hh, ww in sorted(set(zip(h.tolist(), w.tolist()))):
                rows = np.flatnonzero((h == hh) & (w == ww))
                got = kernel(np.stack([flat[ends[r] : ends[r + 1]] for r in rows]).reshape(-1, hh, ww))
                if got.ndim == 2:
                    got = got[:, None, :]
                n, oh, ow = got.shape
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * oh * ow + 1, oh * ow, dtype=np.int32)), pa.array(got.reshape(-1), kind))
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows], pa.int64()), pa.array(np.full(n, oh), pa.int32()), pa.array(np.full(n, ow), pa.int32()), lists], schema=schema)

    return df.select("item_id", F.col("height").alias("_h"), F.col("width").alias("_w"), F.col(pixels).alias("_x")).mapInArrow(run, f"item_id long, height int, width int, x array<{out_type}>")


#: Bits of the map that tells which ids occur: 1 MB, whatever the number of ids.
MAP_BITS = 1 << 23
MAP_PIECE = 1 << 15


def possibly_among(drawings: DataFrame, ids: DataFrame) -> DataFrame:
    """``drawings`` less most of those that ``ids`` (``item_id``) lacks: a map of hashed ids, of fixed size, is broadcast and looked up.

    With so many ids that the map fills up, more rows pass; none that is needed is ever dropped. The other drawings then
    stay where they are instead of going through the shuffle with their pixels.
    """
    slot = F.pmod(F.xxhash64("_id"), F.lit(MAP_BITS))
    ids = ids.select(F.col("item_id").alias("_id")).select(slot.alias("_slot"))
    # bytes of the map as one array for each piece; at most MAP_BITS / MAP_PIECE rows of MAP_PIECE / 64 longs
    words = ids.select((F.col("_slot") / MAP_PIECE).cast("int").alias("_piece"), F.pmod("_slot", F.lit(MAP_PIECE)).cast("int").alias("_bit"))
    words = words.groupBy("_piece", (F.shiftright("_bit", 6)).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, _bit & 63))").alias("_v"))
    table = words.groupBy("_piece").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_v"))).alias("_map"))
    d = drawings.withColumn("_id", F.col("item_id")).withColumn("_slot", slot).withColumn("_piece", (F.col("_slot") / MAP_PIECE).cast("int"))
    hit = F.expr("(_map[cast(shiftright(pmod(_slot, %d), 6) as int)] & shiftleft(1L, cast(_slot & 63 as int))) <> 0" % MAP_PIECE)
    return d.join(F.broadcast(table), "_piece").where(hit).drop("_id", "_slot", "_piece", "_map")


def levels(cache: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], keep: list[str] | None = None, once: bool = True) -> DataFrame:
    """``item_id``, ``keep`` and ``v``, once for each id: the packed rows (see ``similarity.packed``) that ``kernel`` makes of stacks (n, h, w).

    Repeated exports are set aside afterwards, so that no pixels go through the shuffle; without ``once`` they are left to the caller.
    """
    df = complete(cache)
    keep = keep or []
    schema = ", ".join(["item_id long", *[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep], "v binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_h", "_w"))
            flat = batch.column("_x").flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(h.astype(np.int64) * w)])
            for hh, ww in sorted(set(zip(h.tolist(), w.tolist()))):
                rows = np.flatnonzero((h == hh) & (w == ww))
                v = packed(kernel(np.stack([flat[ends[r] : ends[r + 1]] for r in rows]).reshape(-1, hh, ww)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(rows)) for k in ("item_id", *keep)), v], names=["item_id", *keep, "v"])

    rows = df.select("item_id", *keep, F.col("height").alias("_h"), F.col("width").alias("_w"), F.col("x").alias("_x")).mapInArrow(run, schema)
    return rows.dropDuplicates(["item_id"]) if once else rows


def ink_to_gray(x: np.ndarray) -> np.ndarray:
    """The cache holds ink maps; the page they stand for is white less the ink."""
    return 255 - np.clip(x, 0, 255)


def _with_id(keep: list[str] | None) -> tuple[list[str]]:
    return (list(dict.fromkeys(["item_id", *(keep or [])])),)


def _once(measures: DataFrame, keep: list[str] | None) -> DataFrame:
    """Measures once for each id: repeated exports are set aside after measuring, so that no pixels go through the shuffle."""
    once = measures.dropDuplicates(["item_id"])
    return once.drop("item_id") if keep and "item_id" not in keep else once


def stroke_table(cache: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The 15 stroke features of every cached drawing."""
    return _once(measured(complete(cache), lambda x: kernels.stroke_features(ink_to_gray(x)), list(kernels.STROKE_FEATURES), *_with_id(keep)), keep)


def background_table(cache: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return _once(measured(complete(cache), kernels.background_features, ["frame_mean", "speckle"], *_with_id(keep)), keep)


def stats_table(cache: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return _once(measured(complete(cache), lambda x: kernels.image_stats(ink_to_gray(x)), ["mean_gray", "median_gray", "p5_gray", "ink_frac"], *_with_id(keep)), keep)


def thumbnail_table(cache: DataFrame, size: int = 8) -> DataFrame:
    """``item_id``, ``v``: unit thumbnails for similarity joins."""
    return transformed(whole(cache), lambda x: kernels.thumbnails(x, size), out_type="double").select("item_id", F.col("x").alias("v"))
