"""Problem 1: near-duplicate records, by size-banded tiles with hashed bitmap signatures.

Every record is a sorted set of tokens. Records that share a tile key (a rare token, or a code of several
tokens) meet in the tile, ordered by the size of their sets: only neighbouring size bands are compared. A
hashed bitmap bounds the overlap of two sets from above by bit counts; what passes is intersected
exactly as sorted arrays. Tiles with many records are cut into blocks, and pairs of blocks are separate
tasks, so no key, however hot, becomes one task. Exact copies count as one record before that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.images import centred, turn_free_hash, turn_invariants
from palimpsest.llm.blocks import block_pairs, pairs_across, pairs_within, with_blocks
from palimpsest.llm.drawings import alike_pairs, stacks, usable, whole_maps
from palimpsest.llm.names import named, with_cores
from palimpsest.session import shuffle_width, written

#: Records of one block of a tile; a parameter of memory, not of the result.
TILE_ROWS = 2_000
#: Random directions whose clear signs are the tokens of a drawing, and how clear a sign must be.
DIRECTIONS, CLEAR = 128, 0.5
#: Codes of a drawing and signs of a code in a part of 2**16 drawings. Both grow with the logarithm of a part's drawings, see ``code_shape``.
CODES, SIGNS = 24, 11
#: How fast they grow, measured: a further sign leaves 0.59 of the pairs of any two drawings in a tile, so 1.31 signs
#: halve them; the least alike 1 % of near duplicates agree on a sign with a chance of 1 / 1.165.
SIGNS_PER_DOUBLING, CODES_PER_SIGN = 1.31, 1.165
#: Least similarity (Jaccard) of the token sets of two drawings that are compared exactly.
DRAWING_SETS = 0.55
#: Parts (type and shape) with so many different drawings at most are compared pair by pair.
SMALL_PART = 256


def _bitmap_words() -> list:
    """Four words of 64 bits: token t sets bit t mod 256, so that sets of hashed tokens spread evenly."""
    words = []
    for w in range(4):
        bit = f"CASE WHEN (t & 192) = {64 * w} THEN shiftleft(1L, cast(t & 63 AS int)) ELSE 0L END"
        words.append(F.expr(f"aggregate(tokens, 0L, (a, t) -> a | {bit})").alias(f"w{w}"))
    return words


def banded_pairs(tile: np.ndarray, own: np.ndarray, crossed: np.ndarray, size: np.ndarray, bits: np.ndarray, least: float, at_once: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of equal ``tile`` whose sizes and bitmaps leave a Jaccard of ``least`` possible.

    Rows come ordered by tile and size. Each row is held against the rows after it in its size band (sizes up
    to its own / ``least``); in tiles of two blocks (``crossed``) only against the other block.
    """
    n = len(tile)
    kept = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    slack = size - kept  # tokens that share a bit with another one of their set
    step = int(size.max(initial=0) / least) + 2
    key = tile * step + size
    upto = np.searchsorted(key, tile * step + np.floor(size / least + 1e-9).astype(np.int64), "right")
    follow = upto - np.arange(n) - 1
    ends = np.cumsum(follow)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + at_once, "right")))
        count = follow[lo:hi]
        i = np.repeat(np.arange(lo, hi), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        two = ~crossed[i] | (own[i] != own[j])
        i, j = i[two], j[two]
        shared = np.bitwise_count(bits[i] & bits[j]).sum(axis=1).astype(np.int64)
        bound = np.minimum(shared + np.minimum(slack[i], slack[j]), size[i])
        good = bound >= least / (1 + least) * (size[i] + size[j]) - 1e-9
        yield i[good], j[good]
        lo = hi


def _compare(least: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pairs(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
            names = ["key", "b1", "b2"]
            f = f.sort_values([*names, "size", "id"], ignore_index=True)
            new = (f[names].to_numpy()[1:] != f[names].to_numpy()[:-1]).any(axis=1)
            tile = np.concatenate([[0], np.cumsum(new)])
            ids = f["id"].to_numpy(np.int64)
            bits = f[["w0", "w1", "w2", "w3"]].to_numpy(np.int64).view(np.uint64)
            crossed = (f["b1"] != f["b2"]).to_numpy()
            for i, j in banded_pairs(tile, f["own"].to_numpy(), crossed, f["size"].to_numpy(np.int64), bits, least):
                yield pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j])}).query("a < b").drop_duplicates()

        rest: pd.DataFrame | None = None
        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            if not len(f):
                continue
            last = f.iloc[-1]
            open_ = ((f["key"] == last["key"]) & (f["b1"] == last["b1"]) & (f["b2"] == last["b2"])).to_numpy()
            rest = f[open_]
            if not open_.all():
                yield from pairs(f[~open_])
        if rest is not None and len(rest):
            yield from pairs(rest)

    return run


def _intersect(least: float):
    """Exact Jaccard of sorted token arrays, for all pairs of a batch at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            keys, sizes = [], []
            for c in ("ta", "tb"):
                col = batch.column(c)
                count = np.asarray(pa.compute.list_value_length(col))
                flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                keys.append((np.repeat(np.arange(n), count), flat))
                sizes.append(count)
            code = np.unique(np.concatenate([keys[0][1], keys[1][1]]), return_inverse=True)[1]
            m, width = len(keys[0][1]), int(code.max(initial=0)) + 1
            ka, kb = keys[0][0] * width + code[:m], keys[1][0] * width + code[m:]
            common = np.bincount(np.intersect1d(ka, kb, assume_unique=True) // width, minlength=n)
            good = common >= least * (sizes[0] + sizes[1] - common) - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def tile_join(records: DataFrame, least: float, rows: int = TILE_ROWS) -> DataFrame:
    """(``a``, ``b``), a < b, once each: records that share a tile key and whose sets have a Jaccard of ``least``.

    ``records``: ``id`` long, ``keys`` array<long>, ``tokens`` array of integers, sorted, without repeats.
    Null or empty key or token arrays pair with nothing; an id on several rows is one record. Only id, size and
    bitmap go to the tiles; the arrays meet just for pairs that pass the bound. Tiles of more than ``rows`` records
    are cut into pairs of blocks.
    """
    spark = records.sparkSession
    own = records.where("size(tokens) > 0").select("id", "keys", F.size("tokens").alias("size"), *_bitmap_words())
    keyed = own.select("id", "size", "w0", "w1", "w2", "w3", F.explode(F.array_distinct("keys")).alias("key"))
    counts = records.where("size(tokens) > 0").select(F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    placed = block_pairs(with_blocks(keyed, ["key"], counts, rows, F.col("id")), F.col("id"))
    placed = placed.select("key", "b1", "b2", "own", "id", "size", "w0", "w1", "w2", "w3")
    tiled = placed.repartition(shuffle_width(spark), "key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")
    maybe = tiled.mapInPandas(_compare(least), "a long, b long").distinct()
    once = records.select("id", "tokens").dropDuplicates(["id"])
    ta, tb = (once.select(F.col("id").alias(s), F.col("tokens").alias(f"t{s}")) for s in "ab")
    return maybe.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(_intersect(least), "a long, b long")


#: A token is common from this share of all tokens on, so that there are at most 20,000 common ones.
COMMON = 1 / 20_000


def with_rarest_keys(records: DataFrame, least: float) -> DataFrame:
    """Adds ``keys``: of the (``id``, ``tokens``) of each record as many of the rarest tokens as two sets with a Jaccard of
    ``least`` can't both do without, so that all such pairs share a key. Numbers are counted over all records.

    The common tokens (20,000 at most) are looked up where the records lie, so no token's rows meet in one task.
    """
    each = records.select("id", F.explode("tokens").alias("t"))
    counts = written(each.groupBy("t").agg(F.count("*").alias("n")), "tokens")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    common = F.col("n") > COMMON * total
    looked = written(each.join(F.broadcast(counts.where(common).withColumnRenamed("n", "_n")), "t", "left"), "looked")
    rare = looked.where("_n is null").select("id", "t").join(counts.where(~common), "t").select("id", "t", "n")
    rated = rare.unionByName(looked.where("_n is not null").select("id", "t", F.col("_n").alias("n")))
    order = F.array_sort(F.collect_list(F.struct("n", "t")))
    keep = F.col("_size") - F.ceil(least * F.col("_size") - 1e-9).cast("int") + 1
    keys = rated.groupBy("id").agg(order.alias("_o")).withColumn("_size", F.size("_o")).select("id", F.transform(F.slice("_o", 1, keep), lambda e: e["t"]).alias("keys"))
    return records.join(keys, "id")


# ---------------------------------------------------------------- drawings


def _directions(dims: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((dims, DIRECTIONS)).astype(np.float32)


def code_shape(n: int) -> tuple[int, int]:
    """(codes, signs) for a part of ``n`` drawings: the signs grow so that a tile keeps its size, the codes so that near
    duplicates keep their chance to share one. Comparisons for each drawing grow as the codes, as n ** 0.29."""
    signs = max(1, round(SIGNS + SIGNS_PER_DOUBLING * (np.log2(max(n, 2)) - 16)))
    return max(4, int(np.ceil(CODES * CODES_PER_SIGN ** (signs - SIGNS)))), min(signs, 60)


def _codes_of(codes: int, signs: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return np.stack([rng.choice(DIRECTIONS, signs, replace=False) for _ in range(codes)]), 1 << np.arange(signs, dtype=np.int64)


def drawing_views(drawings: DataFrame) -> DataFrame:
    """``item_id``, ``part`` (type and shape), ``copy`` (hash that turned exact copies share), ``view`` for usable rows.

    The view holds the products of the turn invariants with the directions, as bytes of half floats: their rounding is far
    below ``CLEAR``, and the centre of any set of drawings is the mean of their views.
    """
    schema = pa.schema([("item_id", pa.int64()), ("part", pa.string()), ("copy", pa.int64()), ("view", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").to_numpy(zero_copy_only=False)
            parts = np.array(batch.column("part").to_pylist(), dtype=object)
            for rows, px, h, w in stacks(batch):
                inv = turn_invariants(centred(px), h, w)
                view = np.ascontiguousarray(inv @ _directions(inv.shape[1]), dtype=np.float16)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[rows], pa.int64()),
                        pa.array([f"{p}|{h}x{w}" for p in parts[rows]], pa.string()),
                        pa.array(turn_free_hash(px, h, w), pa.int64()),
                        pa.array([v.tobytes() for v in view], pa.binary()),
                    ],
                    schema=schema,
                )

    return drawings.select("item_id", "part", "height", "width", "x").mapInArrow(run, "item_id long, part string, copy long, view binary")


def _views(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, DIRECTIONS).astype(np.float64)


def drawing_centres(classes: DataFrame) -> DataFrame:
    """``part``, ``n``, ``centre``: number and mean view of all rows (``part``, ``view``) of a part.

    Every batch is summed where it lies; only sums are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts, at = np.unique(np.array(batch.column("part").to_pylist(), dtype=object), return_inverse=True)
            sums = np.zeros((len(parts), DIRECTIONS))
            np.add.at(sums, at, _views(batch.column("view")))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(np.bincount(at), pa.int64()), pa.array(list(sums), pa.list_(pa.float64()))], names=["part", "n", "sums"])

    sums = classes.select("part", "view").mapInArrow(run, "part string, n long, sums array<double>")
    by_direction = sums.select("part", "n", F.posexplode("sums").alias("k", "v")).groupBy("part", "k").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("k", "v")))
    return by_direction.groupBy("part").agg(F.first("n").alias("n"), F.transform(ordered, lambda e: e["v"]).alias("v")).select("part", "n", F.transform("v", lambda e: e / F.col("n")).alias("centre"))


def drawing_sets(classes: DataFrame, small: int = SMALL_PART) -> DataFrame:
    """``item_id``, ``part``, ``codes``, ``tokens`` of (``item_id``, ``part``, ``view``), one row for each class of copies.

    In parts of ``small`` rows or fewer there is no centre to speak of: all have one code and one token in common, so
    that every pair is compared exactly.
    """
    schema = pa.schema([("item_id", pa.int64()), ("part", pa.string()), ("codes", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int16()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column("n").to_numpy(zero_copy_only=False)
            for n_part in np.unique(parts):
                rows = np.flatnonzero(parts == n_part)
                n = len(rows)
                some = batch.take(pa.array(rows))
                if n_part <= small:
                    codes, i, t = np.full((n, 1), -1, np.int64), np.arange(n), np.zeros(n, np.int16)
                else:
                    members, weight = _codes_of(*code_shape(int(n_part)))
                    z = _views(some.column("view")) - some.column("centre").flatten().to_numpy(zero_copy_only=False).reshape(n, DIRECTIONS)
                    z *= DIRECTIONS**0.5 / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
                    codes = np.stack([(z > 0)[:, m] @ weight for m in members], axis=1)
                    codes = codes * len(members) + np.arange(len(members), dtype=np.int64) if len(weight) <= 50 else codes ^ (np.arange(len(members), dtype=np.int64) << 52)
                    i, t = np.nonzero(np.hstack([z > CLEAR, z < -CLEAR]))
                ends = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=n))]).astype(np.int32)
                starts = np.arange(n + 1, dtype=np.int32) * codes.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("item_id"),
                        some.column("part"),
                        pa.ListArray.from_arrays(pa.array(starts), pa.array(codes.reshape(-1), pa.int64())),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(t.astype(np.int16))),
                    ],
                    schema=schema,
                )

    centres = written(drawing_centres(classes), "centres")
    return classes.select("item_id", "part", "view").join(centres, "part").mapInArrow(run, "item_id long, part string, codes array<long>, tokens array<smallint>")


def drawing_duplicates(cache: DataFrame, least: float = 0.90) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate drawings of one type: pairs of classes, and the classes of exact (turned) copies.

    Returns (``a``, ``b``, ``similarity``) between representatives and (``item_id``, ``rep``) for every usable
    item. The representative of a class is its least id. Two drawings are compared exactly if they share a code
    and their token sets are alike, or if their part is small; the exact cosine over all turns decides.
    """
    drawings = usable(cache)
    views = written(drawing_views(drawings), "views")
    classes = views.groupBy("part", "copy").agg(F.min("item_id").alias("rep"))
    members = written(views.select("item_id", "part", "copy").join(classes, ["part", "copy"]).select("item_id", "rep", "part").distinct(), "copies")
    reps = members.select("rep").distinct()
    own = written(views.select("item_id", "part", "view").join(reps, F.col("item_id") == F.col("rep"), "left_semi").dropDuplicates(["item_id"]), "classes")
    keyed = written(drawing_sets(own).select(F.col("item_id").alias("id"), F.expr("transform(codes, c -> xxhash64(part, c))").alias("keys"), "tokens"), "sets")
    candidates = written(tile_join(keyed, DRAWING_SETS), "candidates")
    return alike_pairs(candidates, whole_maps(cache), least), members.select("item_id", "rep")


# ---------------------------------------------------------------- paths

#: Least Jaccard of the token sets of two names that are compared word by word.
NAME_SETS = 0.8


def name_tokens(cores: DataFrame) -> DataFrame:
    """``id`` (of type and stem), ``name`` (hash of all that tells a drawing) and ``tokens`` of a name: its words, its number, the last
    word with the number, the number with the trial. Tokens are hashed with the type, so types don't mix."""
    words = F.split("unit", " ")
    last, before = F.element_at(words, -1), F.try_element_at(words, F.lit(-2))
    rest = F.filter(F.split("rest", " "), lambda w: w != "")
    of = lambda kind, text: F.xxhash64("type", F.lit(kind), text)
    tokens = F.concat(
        F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: of("word", w)),
        F.transform(rest, lambda w: of("rest", w)),
        F.array(of("number", last), of("both", F.concat_ws(" ", before, last)), of("trial", F.concat_ws(" ", last, "trial"))),
    )
    return cores.select(F.xxhash64("type", "stem").alias("id"), F.xxhash64("type", "unit", "rest", "trial").alias("name"), F.sort_array(F.array_distinct(tokens)).alias("tokens"))


def path_duplicates(manifest: DataFrame, least: float = NAME_SETS) -> DataFrame:
    """(``a``, ``b``): items of one type whose paths name the same drawing.

    Records are the different spelled file names of a type; their tiles are their rarest tokens, of which two alike names
    share one. What reaches a Jaccard of ``least`` is then compared in full: words, number, trial and what follows.
    Items with null paths, or without a type, pair with nothing; an item listed twice is one item, one listed under two
    names pairs by either. Items under one spelled name pair without a comparison.
    """
    items = written(named(manifest).withColumn("record", F.xxhash64("type", "stem")), "paths")
    records = written(name_tokens(with_cores(items.select("type", "stem").distinct())), "sets")
    pairs = tile_join(written(with_rarest_keys(records.select("id", "tokens"), least), "keyed"), least)
    na, nb = (records.select(F.col("id").alias(s), F.col("name").alias(f"_{s}")) for s in "ab")
    same = pairs.join(na, "a").join(nb, "b").where("_a = _b").select("a", "b")
    members = items.select("record", "item_id").distinct()
    out = pairs_across(same, members, "record", "item_id").unionByName(pairs_within(members, "record", "item_id"))
    return out.select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()


def near_duplicates(manifest: DataFrame, cache: DataFrame, least: float = 0.90) -> DataFrame:
    """(``field``, ``item_a``, ``item_b``) of both fields: every pair once, the smaller id first."""
    pairs, members = drawing_duplicates(cache, least)
    x = pairs_across(pairs, members, "rep", "item_id").unionByName(pairs_within(members, "rep", "item_id"))
    x = x.select(F.lit("x").alias("field"), F.col("_a").alias("item_a"), F.col("_b").alias("item_b"))
    p = path_duplicates(manifest).select(F.lit("path").alias("field"), F.col("a").alias("item_a"), F.col("b").alias("item_b"))
    return x.unionByName(p)


def drawing_groups(cache: DataFrame, least: float = 0.90) -> DataFrame:
    """One row for every usable drawing: ``item_id``, ``class_id`` (the least id of its exact copies), ``n_copies`` of
    that class and ``n_links`` from the class to near-duplicate classes. Copies are not spelled out as pairs."""
    pairs, members = drawing_duplicates(cache, least)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    sizes = members.groupBy(F.col("rep").alias("class_id")).agg(F.count("*").alias("n_copies"))
    out = members.select("item_id", F.col("rep").alias("class_id")).join(sizes, "class_id").join(ends, "class_id", "left")
    return out.select("item_id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
