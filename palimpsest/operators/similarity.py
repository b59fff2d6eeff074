"""Similarity joins over small vectors: tiles of matrix products in Arrow batches.

Vectors are packed to bytes and cut into blocks by hash; each pair of blocks is a task. The blocks are written to the shared folder once and
every task reads its two from there: a row goes through the shuffle once, however many blocks its part has, and nothing is broadcast, so
the number of rows is bounded by the cluster's disks and not by an executor's memory. The work stays quadratic inside a part (a drawing
type, a label): parts are what keeps it small. Products are made in single precision, and double precision decides; where only pairs above
a threshold count, fewer products are made: the leading components of the vectors and the length of the rest bound the product from above.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from palimpsest.functions.images import cosine_basis, dihedral_orders
from palimpsest.operators.ranks import join_on
from palimpsest.session import stored, written

#: Rows of a block: at least, and at most where the caller names no size. Parts are cut into ``COPIES`` blocks in between.
BLOCK, MOST, COPIES = 4_000, 32_000, 6
#: Tasks of a join at most; with more pairs of blocks a task takes several, one after the other.
TASKS = 10_000
#: Rows and columns of a tile of products, which stays in a processor's cache.
TILE = 512, 2_048
#: What products in single precision may be off, for vectors of unit length.
SLACK = 2e-5


def packed(v: np.ndarray) -> pa.Array:
    """Rows as bytes: a byte that tells the kind, then the values. Whole numbers (one byte each where that is enough, else four) are levels that
    are centred and scaled to unit length when they are read; doubles are read as they are."""
    if v.dtype.kind == "f":
        v = np.ascontiguousarray(v, np.float64)
    else:
        v = np.ascontiguousarray(v, np.uint8 if not v.size or (v.min() >= 0 and v.max() < 256) else np.int32)
    rows = np.empty((len(v), 1 + v.shape[1] * v.itemsize), np.uint8)
    rows[:, 0] = v.itemsize
    rows[:, 1:] = v.view(np.uint8).reshape(len(v), -1)
    ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    """The values of ``packed``: levels as they are where all rows have one kind, else doubles."""
    cells = pa.concat_arrays([c for c in column.chunks if len(c)]) if column.num_chunks > 1 else column.chunk(0)
    ends = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64)
    raw = np.frombuffer(cells.buffers()[2], np.uint8)
    kinds, long = raw[ends[:-1]], np.diff(ends)
    of = {1: np.uint8, 4: np.int32, 8: np.float64}

    def values(at: np.ndarray) -> np.ndarray:
        width = int(long[at[0]])
        whole = len(at) == len(kinds)
        rows = raw[ends[0] : ends[-1]].reshape(-1, width) if whole else np.stack([raw[ends[i] : ends[i + 1]] for i in at])
        return np.ascontiguousarray(rows[:, 1:]).view(of[int(kinds[at[0]])])

    if (kinds == kinds[0]).all():
        return values(np.arange(len(kinds)))
    pieces = [(at, values(at)) for at in (np.flatnonzero(kinds == k) for k in np.unique(kinds))]
    out = np.empty((len(kinds), pieces[0][1].shape[1]))
    for at, v in pieces:
        out[at] = units(v)
    return out


def units(v: np.ndarray) -> np.ndarray:
    """Doubles; levels are centred and brought to unit length where there is anything to scale."""
    if v.dtype.kind == "f":
        return v
    c = v - v.mean(axis=1, keepdims=True, dtype=np.float64)
    norm = np.linalg.norm(c, axis=1, keepdims=True)
    return c / np.where(norm > 1e-6, norm, 1)


def _single(v: np.ndarray) -> np.ndarray:
    return _by_pieces(v, lambda x: units(x).astype(np.float32))


def _by_pieces(v: np.ndarray, make: Callable[[np.ndarray], np.ndarray], step: int = 4_096) -> np.ndarray:
    """``make`` of all rows, a few at a time."""
    first = make(v[:step])
    out = np.empty((len(v), *first.shape[1:]), first.dtype)
    out[:step] = first
    for lo in range(step, len(v), step):
        out[lo : lo + step] = make(v[lo : lo + step])
    return out


def _bytes_of(df: DataFrame) -> DataFrame:
    """``df`` with ``v`` packed."""
    if isinstance(df.schema["v"].dataType, BinaryType):
        return df
    rest = [c for c in df.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), packed(flat.reshape(batch.num_rows, -1))], names=[*rest, "v"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return df.select(*rest, "v").mapInArrow(run, f"{kinds}, v binary")


def _paired_blocks(df: DataFrame, part: list[str], block: int | None, n: DataFrame | None = None) -> DataFrame:
    """Every row once, with the number ``_own`` of its block and the ``_file`` that its block lies in."""
    d = join_on(_bytes_of(df), _parts(df, part, block) if n is None else n, part)
    d = d.withColumn("_own", F.pmod(F.xxhash64("item_id"), F.col("_blocks")).cast("int"))
    return d.withColumn("_file", F.coalesce("_bundle", _file_of("_own"))).drop("_blocks", "_bundle")


def _file_of(own: str) -> Column:
    return F.concat(F.lit("p"), F.col("_part"), F.lit("b"), F.col(own))


def _parts(df: DataFrame, part: list[str], block: int | None) -> DataFrame:
    """Parts with their number ``_part``, their ``_blocks`` and, where that is one, the ``_bundle`` of small parts that they are written to."""
    n = df.groupBy(*part).agg(F.count("*").alias("_n")) if part else df.agg(F.count("*").alias("_n"))
    size = F.lit(block) if block else F.greatest(F.lit(BLOCK), F.least(F.lit(MOST), F.ceil(F.col("_n") / COPIES)))
    # written, so that each part keeps its number
    n = written(n.where("_n > 0").withColumn("_blocks", F.ceil(F.col("_n") / size).cast("int")).withColumn("_part", F.monotonically_increasing_id()), "parts")
    small = n.where("_blocks = 1").agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    bundle = F.when(F.col("_blocks") == 1, F.concat(F.lit("s"), F.pmod(F.xxhash64("_part"), F.lit(max(1, small // BLOCK)))))
    return n.withColumn("_bundle", bundle).drop("_n")


class _Sides:
    """The rows of a task in the order of their ids: ``ids``, ``v`` as packed, places of the rows of both blocks."""

    def __init__(self, table: pa.Table, b1: int, b2: int):
        order = np.argsort(table.column("item_id").to_numpy(), kind="stable")
        self.table, self.order = table, order
        self.ids, self.v = self.column("item_id").astype(np.int64), _unpacked(table.column("v"))[order]
        own = self.column("_own")
        self.same = b1 == b2
        self.left, self.right = np.flatnonzero(own == b1), np.flatnonzero(own == b2)
        # longest vector: what single precision is off grows with it
        self.slack = SLACK if self.v.dtype.kind != "f" else SLACK * max(1.0, float(np.einsum("ij,ij->i", self.v, self.v).max(initial=0.0)))

    def column(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()[self.order]

    def products(self, i: np.ndarray, j: np.ndarray, turns: bool = False) -> np.ndarray:
        out = np.empty(len(i))
        for lo in range(0, len(i), 4_096):
            out[lo : lo + 4_096] = _row_products(units(self.v[i[lo : lo + 4_096]]), units(self.v[j[lo : lo + 4_096]]), turns)
        return out


def _read(at: str, name: str) -> list[pa.Table]:
    """The rows of a block or bundle that ``stored`` has written under ``at``; none where the hash has left a block empty."""
    files, path = (LocalFileSystem(), at.removeprefix("file:")) if at.startswith(("file:", "/")) else FileSystem.from_uri(at)
    found = files.get_file_info(FileSelector(f"{path}/_file={name}", allow_not_found=True))
    # a block is read by its own schema, not with the columns that its folder's name would add
    return [pq.ParquetFile(files.open_input_file(f.path)).read() for f in found if f.is_file and not f.base_name.startswith(("_", "."))]


def _joined(df: DataFrame, part: list[str], block: int | None, run: Callable[[_Sides], list[tuple]], schema: pa.Schema, rows: DataFrame | None = None) -> DataFrame:
    """What ``run`` finds in each pair of blocks of a part, as arrays in the order of the schema.

    ``rows``: the parts of all rows, where they are at hand. The vectors then are made once and each task writes its rows of every block, so that they
    don't go through a shuffle for that.
    """
    n = _parts(df if rows is None else rows, part, block)
    blocks = _paired_blocks(df, part, block, n)
    at = stored(blocks.repartition("_file") if rows is None else blocks, "blocks", "_file")
    large = n.where("_bundle is null").select("_part", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_b1"), "_blocks")
    large = large.select("_part", "_b1", F.explode(F.sequence("_b1", F.col("_blocks") - 1)).alias("_b2"))
    tasks = large.select("_b1", "_b2", _file_of("_b1").alias("_f1"), _file_of("_b2").alias("_f2"))
    tasks = written(tasks.unionByName(n.where("_bundle is not null").select(F.lit(0).alias("_b1"), F.lit(0).alias("_b2"), F.col("_bundle").alias("_f1"), F.col("_bundle").alias("_f2")).distinct()), "tasks")

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in (t for batch in batches for t in batch.to_pylist()):
            tables = [x for name in dict.fromkeys([task["_f1"], task["_f2"]]) for x in _read(at, name)]
            table = pa.concat_tables(tables) if tables else None
            for k in pc.unique(table["_part"]) if tables else []:
                own = table.filter(pc.equal(table["_part"], k)) if task["_f1"].startswith("s") else table
                for got in run(_Sides(own, task["_b1"], task["_b2"])):
                    if len(got[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(got, schema)], schema=schema)

    kinds = ", ".join(f"{f.name} {'double' if f.type == pa.float64() else 'int' if f.type == pa.int32() else 'long'}" for f in schema)
    # one row is a pair of blocks: dealt out in turn, so that every core has the same number of them
    return tasks.coalesce(1).repartition(max(1, min(tasks.count(), TASKS))).mapInArrow(group, kinds)


_PAIR = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("sim", pa.float64())])


def _products(a: np.ndarray, b: np.ndarray, turns: bool, out: np.ndarray | None = None) -> np.ndarray:
    if not turns:
        return np.matmul(a, b.T, out=out)
    side = int(round(a.shape[1] ** 0.5))
    best = None
    for order in dihedral_orders(side, side):
        s = a @ np.take(b, order, axis=1).T
        best = s if best is None else np.maximum(best, s, out=best)
    return best


def _row_products(a: np.ndarray, b: np.ndarray, turns: bool) -> np.ndarray:
    """Product of each row with the same row of the other, the largest over all turns if asked."""
    if not turns:
        return np.einsum("ij,ij->i", a, b)
    side = int(round(a.shape[1] ** 0.5))
    return np.max([np.einsum("ij,ij->i", a, np.take(b, o, axis=1)) for o in dihedral_orders(side, side)], axis=0) if len(a) else np.zeros(0)


def _frequencies(v: np.ndarray) -> np.ndarray:
    """Cosine frequencies (n, side, side) of square vectors. Turns swap the two frequencies or the signs of the odd ones."""
    side = int(round(v.shape[1] ** 0.5))
    c = cosine_basis(side)
    return c @ v.reshape(-1, side, side) @ c.T


def turn_free(f: np.ndarray) -> np.ndarray:
    """Numbers of the frequencies ``f`` that no turn changes, of the same length as the vector. The product of two rows is at least the product
    of the vectors in any orientation: what turns keep stays, what they give another sign loses it, what they mix becomes a length."""
    out = []
    for p in range(f.shape[1]):
        for q in range(p, f.shape[1]):
            a, b = f[:, p, q], f[:, q, p]
            if p == q:
                out.append(np.abs(a) if p % 2 else a)
            elif p % 2 == q % 2:
                x = (a + b) / np.float32(2**0.5)
                out += [np.abs(x) if p % 2 else x, np.abs(a - b) / np.float32(2**0.5)]
            else:
                out.append(np.hypot(a, b))
    return np.ascontiguousarray(np.stack(out, axis=1), np.float32)


def _turned_best(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Largest product over the turns of each row of frequencies with the same row of the other: eight sums of products with signs."""
    n, side = len(a), a.shape[1]
    odd = np.arange(side) % 2
    kind = (2 * odd[:, None] + odd).reshape(-1)
    of = np.zeros((side * side, 4), np.float32)
    of[np.arange(side * side), kind] = 1
    signs = np.array([[1, y, x, x * y] for x in (1, -1) for y in (1, -1)], np.float32)
    straight, swapped = (a * b).reshape(n, -1) @ of, (a * b.transpose(0, 2, 1)).reshape(n, -1) @ of
    return np.maximum((straight @ signs.T).max(axis=1), (swapped @ signs.T).max(axis=1))


def _bounds(x: np.ndarray, least: float, check: float) -> np.ndarray:
    """Rows whose products are at least those of ``x``: the leading components and the length of the rest, as many of them as cost least.

    ``check`` is what a pair that may reach ``least`` costs, in multiples of a product's component.
    """
    n, d = x.shape
    rng = np.random.default_rng(7)
    some = x[rng.choice(n, min(n, 4_000), replace=False)]
    values, axes = np.linalg.eigh((some.T @ some).astype(np.float64))
    axes = axes[:, ::-1].astype(np.float32)
    whole = some @ axes
    length = np.einsum("ij,ij->i", whole, whole)
    best, cost = d, np.inf
    for k in (k for k in (12, 16, 24, 32, 48, 64, 96, 128, 192) if k < d):
        low = np.hstack([whole[:, :k], np.sqrt(np.maximum(length - np.einsum("ij,ij->i", whole[:, :k], whole[:, :k]), 0))[:, None]])
        c = k + 8 + check * float((low[:200] @ low.T >= least).mean())
        if c < cost:
            best, cost = k, c
    if cost > d + 8 + check * float((some[:200] @ some.T >= least).mean()):
        return x
    out = np.empty((n, best + 1), np.float32)
    for lo in range(0, n, 4_096):
        y = x[lo : lo + 4_096] @ axes
        out[lo : lo + 4_096, :best] = y[:, :best]
        out[lo : lo + 4_096, best] = np.sqrt(np.einsum("ij,ij->i", y[:, best:], y[:, best:]))
    return out


def _reaching(x: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of both sides with a product of ``least`` or more, tile by tile; of one and the same side i < j."""
    a, b = np.ascontiguousarray(x[left]), np.ascontiguousarray(x[right])
    hold = np.empty(TILE[0] * TILE[1], np.float32)
    for lo in range(0, len(a), TILE[0]):
        m = min(TILE[0], len(a) - lo)
        for at in range(lo // TILE[1] * TILE[1] if same else 0, len(b), TILE[1]):
            k = min(TILE[1], len(b) - at)
            s = _products(a[lo : lo + m], b[at : at + k], False, hold[: m * k].reshape(m, k))
            r, c = np.divmod(np.flatnonzero(s >= least), k)
            if same:
                later = lo + r < at + c
                r, c = r[later], c[later]
            if len(r):
                yield left[lo + r], right[at + c]


def similar_pairs(df: DataFrame, least: float, part: list[str] | None = None, turns: bool = False, block: int | None = None, rows: DataFrame | None = None) -> DataFrame:
    """(``i``, ``j``, ``sim``), i < j: rows of (``item_id``, ``v``) with a product of ``least`` or more, over all turns if asked. ``rows``: see ``_joined``."""
    part = part or []

    def run(f: _Sides) -> list[tuple]:
        least_single = least - f.slack
        x = _by_pieces(f.v, lambda v: _frequencies(units(v).astype(np.float32))) if turns else _single(f.v)
        bound = _bounds(_by_pieces(x, turn_free) if turns else x, least_single, 8_000 if turns else 3_000)
        out = []
        for i, j in _reaching(bound, f.left, f.right, f.same, least_single):
            for lo in range(0, len(i), 4_096):
                a, b = i[lo : lo + 4_096], j[lo : lo + 4_096]
                near = (_turned_best(x[a], x[b]) if turns else np.einsum("ij,ij->i", x[a], x[b])) >= least_single
                a, b = a[near], b[near]
                s = f.products(a, b, turns)
                good = (s >= least) & (f.ids[a] != f.ids[b])
                p, q = f.ids[a[good]], f.ids[b[good]]
                out.append((np.minimum(p, q), np.maximum(p, q), s[good]))
        return out

    return _joined(df.select("item_id", "v", *part), part, block, run, _PAIR, rows)


#: Pairs a task holds before it cuts them to a spanning forest; a parameter of memory, not of the result.
PAIRS_HELD = 200_000
#: A link has n = 0; a count has a row of the part as ``i`` and ``j``, and the step as ``sim``.
_FOUND = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("sim", pa.float64()), ("n", pa.int64())])


class _Forest:
    """Counts of weighted pairs at each step, and a maximum spanning forest of the pairs: at every step it joins what the pairs join."""

    def __init__(self, steps: list[float]):
        self.steps, self.counts, self.held, self.size = sorted(steps), np.zeros(len(steps), np.int64), [], 0

    def count(self, s: np.ndarray, weight: np.ndarray) -> None:
        """``weight``: how many pairs of rows such a pair stands for."""
        self.counts += np.array([weight[s >= x].sum() for x in self.steps], np.int64)

    def link(self, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> None:
        self.held.append((i, j, s))
        self.size += len(i)
        if self.size > PAIRS_HELD:
            self.held = [self.links()]
            # what is left is no more than the rows; twice that is held before the next cut
            self.size = -len(self.held[0][0])

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        i, j, s = (np.concatenate(x) for x in zip(*self.held))
        order = np.argsort(-s, kind="stable")
        up: dict[int, int] = {}
        keep = []
        for k, x, y in zip(order.tolist(), i[order].tolist(), j[order].tolist()):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            while up.setdefault(y, y) != y:
                up[y] = y = up[up[y]]
            if x != y:
                up[max(x, y)] = min(x, y)
                keep.append(k)
        return i[keep], j[keep], s[keep]


def _equal_rows(f: _Sides, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each set of equal vectors, number in ``rows`` of the first that stands for each of ``rows``). Vectors that are not scaled when they are read stand for themselves."""
    if f.v.dtype.kind == "f" or not len(rows):
        return rows, np.arange(len(rows))
    raw = np.ascontiguousarray(f.v[rows]).view(np.uint8).reshape(len(rows), -1)
    _, first, of = np.unique(raw.view(f"V{raw.shape[1]}").reshape(-1), return_index=True, return_inverse=True)
    return rows[first], of.reshape(-1)


def _counted(f: _Sides, left: np.ndarray, right: np.ndarray, steps: list[float], turns: bool) -> _Forest:
    """The pairs of both sides (of a side with itself where these are the same block) at the least step or above. Equal vectors are compared once."""
    forest, least = _Forest(steps), min(steps)
    low = least - f.slack
    a, a_of = _equal_rows(f, left)
    b, b_of = (a, a_of) if f.same else _equal_rows(f, right)
    na, nb = np.bincount(a_of, minlength=len(a)), np.bincount(b_of, minlength=len(b))
    if not len(a) or not len(b):
        return forest
    rows, many = (a, na) if f.same else (np.concatenate([a, b]), np.concatenate([na, nb]))
    v = f.v[rows]
    x = _by_pieces(v, lambda y: _frequencies(units(y).astype(np.float32))) if turns else _single(v)
    bound = _bounds(_by_pieces(x, turn_free) if turns else x, low, 8_000 if turns else 3_000)
    at_b = np.arange(len(a)) if f.same else np.arange(len(a), len(rows))
    for i, j in _reaching(bound, np.arange(len(a)), at_b, f.same, low):
        for lo in range(0, len(i), 4_096):
            p, q = i[lo : lo + 4_096], j[lo : lo + 4_096]
            near = (_turned_best(x[p], x[q]) if turns else np.einsum("ij,ij->i", x[p], x[q])) >= low
            p, q = p[near], q[near]
            s = f.products(rows[p], rows[q], turns)
            good = (s >= least) & (f.ids[rows[p]] != f.ids[rows[q]])
            p, q = p[good], q[good]
            forest.count(s[good], many[p] * many[q])
            forest.link(f.ids[rows[p]], f.ids[rows[q]], s[good])
    if f.same:
        # equal vectors among themselves
        s = f.products(a, a, turns)
        p = np.flatnonzero((na > 1) & (s >= least))
        forest.count(s[p], na[p] * (na[p] - 1) // 2)
        other = np.flatnonzero((left != a[a_of]) & (s[a_of] >= least))
        forest.link(f.ids[a[a_of[other]]], f.ids[left[other]], s[a_of[other]])
    return forest


def _reported(f: _Sides, forest: _Forest, links: bool) -> list[tuple]:
    out = []
    if links:
        i, j, s = forest.links()
        out.append((np.minimum(i, j), np.maximum(i, j), s, np.zeros(len(i), np.int64)))
    some = forest.counts > 0
    own = np.full(int(some.sum()), f.ids[0])
    return [*out, (own, own, np.array(forest.steps)[some], forest.counts[some])]


def counted_links(df: DataFrame, steps: list[float], part: list[str] | None = None, turns: bool = False, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Of the pairs of rows (``item_id``, ``v``; each id once) with a product of the least of ``steps`` or more, over all turns if asked: links (``i``, ``j``, ``sim``) that
    join at every step what the pairs of that product or more join, and counts (``i``, ``step``, ``n``), to be summed: how many pairs reach it in the part of the row ``i``.

    No list of pairs is made: a task gives no more links than it has rows. Equal vectors are compared once for all of them.
    """
    part = part or []
    found = written(_joined(df.select("item_id", "v", *part), part, block, lambda f: _reported(f, _counted(f, f.left, f.right, steps, turns), True), _FOUND), "links")
    return found.where("n = 0").select("i", "j", "sim"), found.where("n > 0").select("i", F.col("sim").alias("step"), "n")


def best_and_counted(df: DataFrame, asks: str, least: float, part: list[str] | None = None, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``best_elsewhere``, and the counts (``i``, ``step``, ``n``) of ``counted_links`` among the rows that do not ask; both from the same blocks."""
    part = part or []

    def run(f: _Sides) -> list[tuple]:
        q, none = f.column(asks).astype(bool), np.zeros(len(f.ids), np.int64)
        got = []
        for x, y in [(f.left, f.right)] if f.same else [(f.left, f.right), (f.right, f.left)]:
            got += _nearest(f, x[q[x]], y[~q[y]], None, none, 1, False, False)
        best = [(f.ids[i], f.ids[j], s, np.zeros(len(i), np.int64)) for i, _, j, s in got]
        return best + _reported(f, _counted(f, f.left[~q[f.left]], f.right[~q[f.right]], [least], False), False)

    found = written(_joined(df.select("item_id", "v", asks, *part), part, block, run, _FOUND), "found")
    return _best_of_blocks(found.where("n = 0").select("i", "j", "sim")), found.where("n > 0").select("i", F.col("sim").alias("step"), "n")


def _cuts(of: np.ndarray, step: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``step`` rows with one value of ``of``, which is sorted."""
    for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))(np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]]))):
        for at in range(lo, hi, step):
            yield at, min(at + step, hi)


class _Best:
    """The greatest products of the rows of a side so far, for each class of the other side, and the pairs that may be them."""

    def __init__(self, rows: int, classes: int, slack: float):
        self.top = np.full((classes, rows), -np.inf, np.float32)
        self.slack, self.found = slack, []

    def see(self, s: np.ndarray, row0: int, col0: int, kind: int) -> None:
        top = self.top[kind, row0 : row0 + len(s)]
        here = s.max(axis=1)
        np.maximum(top, here, out=top)
        rows = np.flatnonzero((here >= top - self.slack) & (here > -np.inf))
        if len(rows):
            r, c = np.nonzero(s[rows] >= top[rows, None] - self.slack)
            self.found.append((np.full(len(r), kind, np.int32), row0 + rows[r], col0 + c, s[rows[r], c]))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, row, column) of the pairs within the error of single precision of the greatest."""
        if not self.found:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind, r, c, s = (np.concatenate(x) for x in zip(*self.found))
        last = s >= self.top[kind, r] - self.slack
        return kind[last], r[last], c[last]


def _nearest(f: _Sides, left: np.ndarray, right: np.ndarray, group: np.ndarray | None, kind: np.ndarray, classes: int, turns: bool, both: bool, least: float = -np.inf) -> list[tuple]:
    """[(rows, class, near rows, product)]: for each row of the left side (and, if ``both``, of the right side) the greatest product to each class ``kind`` among rows of
    the other side and another group; of products equal to twelve digits the one with the least row. Each tile of products serves both sides.

    Equal vectors of one class and group stand for the first of them, so that copies cost nothing.
    """
    code = np.unique(group, return_inverse=True)[1].reshape(-1) if group is not None else np.zeros(len(f.ids), np.int64)

    def side(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First rows of equal vectors by class and group, and which of them stands for each row."""
        raw = np.ascontiguousarray(f.v[rows]).view(np.uint8).reshape(len(rows), -1)
        raw = np.hstack([kind[rows].astype(">i8").view(np.uint8).reshape(-1, 8), code[rows].astype(">i8").view(np.uint8).reshape(-1, 8), raw])
        _, first, inverse = np.unique(np.ascontiguousarray(raw).view(f"V{raw.shape[1]}").reshape(-1), return_index=True, return_inverse=True)
        return rows[first], inverse.reshape(-1), rows

    out = []
    if not len(left) or not len(right):
        return out
    (a, a_of, a_rows), (b, b_of, b_rows) = side(left), side(right)
    x, y = _single(f.v[a]), _single(f.v[b])
    empty_a, empty_b = ~x.any(axis=1), ~y.any(axis=1)
    if least > -np.inf and not turns:
        raise_to = least - 1e-12 - f.slack
        z = _bounds(np.concatenate([x, y]), raise_to, 3_000)
        n = len(a)
        got = [(i, j - n) for i, j in _reaching(z, np.arange(n), np.arange(n, n + len(b)), False, raise_to)]
        i, j = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in (0, 1))
        other = code[a[i]] != code[b[j]] if group is not None else np.ones(len(i), bool)
        tasks = [(a, a_of, a_rows, kind[b[j[other]]].astype(np.int32), i[other], b, j[other])]
        if both:
            tasks.append((b, b_of, b_rows, kind[a[i[other]]].astype(np.int32), j[other], a, i[other]))
    else:
        one, two = _Best(len(a), classes, f.slack), _Best(len(b), classes, f.slack)
        hold = np.empty(TILE[0] * TILE[1], np.float32)
        for lo, hi in _cuts(kind[a], TILE[0]):
            for at, to in _cuts(kind[b], TILE[1]):
                ga, gb = code[a[lo:hi]], code[b[at:to]]
                if group is not None and ga[0] == ga[-1] == gb[0] == gb[-1]:
                    continue
                s = _products(x[lo:hi], y[at:to], turns, hold[: (hi - lo) * (to - at)].reshape(hi - lo, to - at))
                if group is not None and ga[0] <= gb[-1] and gb[0] <= ga[-1]:
                    s[ga[:, None] == gb[None]] = -np.inf
                # rows without any value have the same product with all and are looked after below
                none_a, none_b = empty_a[lo:hi], empty_b[at:to]
                one.see(np.where(none_a[:, None], -np.inf, s) if none_a.any() else s, lo, at, int(kind[b[at]]))
                if both:
                    two.see(np.where(none_b[:, None], -np.inf, s.T) if none_b.any() else s.T, at, lo, int(kind[a[lo]]))
        ka, ra, ca = one.pairs()
        tasks = [(a, a_of, a_rows, *_with_empty(ka, ra, ca, empty_a, a, b, kind, code, group is not None, classes))]
        tasks[0] = (*tasks[0][:5], b, tasks[0][5])
        if both:
            kb, rb, cb = two.pairs()
            got = _with_empty(kb, rb, cb, empty_b, b, a, kind, code, group is not None, classes)
            tasks.append((b, b_of, b_rows, got[0], got[1], a, got[2]))
    for own, of, rows, k, r, others, c in tasks:
        if not len(r):
            continue
        s = np.round(f.products(own[r], others[c], turns), 12)
        order = np.lexsort((others[c], -s, k, r))
        r, k, c, s = r[order], k[order], c[order], s[order]
        first = np.concatenate([[True], (np.diff(r) != 0) | (np.diff(k) != 0)])
        r, k, c, s = r[first], k[first], c[first], s[first]
        # every row that the first of its equals stands for
        members = np.argsort(of, kind="stable")
        start = np.searchsorted(of[members], np.arange(len(own) + 1))
        count = start[r + 1] - start[r]
        at = np.repeat(np.arange(len(r)), count)
        member = rows[members[start[r][at] + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)]]
        out.append((member, k[at], others[c][at], s[at]))
    return out


def _with_empty(k: np.ndarray, r: np.ndarray, c: np.ndarray, empty: np.ndarray, own: np.ndarray, others: np.ndarray, kind: np.ndarray, code: np.ndarray, grouped: bool, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adds for rows without any value, whose products are all zero, the least row of each class and another group."""
    add = []
    for g in np.unique(code[own[empty]]) if empty.any() else []:
        mine = np.flatnonzero(empty & (code[own] == g))
        for value in range(classes):
            at = np.flatnonzero((kind[others] == value) & ((code[others] != g) | (not grouped)))
            if len(at):
                add.append((np.full(len(mine), value, np.int32), mine, np.full(len(mine), at[others[at].argmin()])))
    if not add:
        return k, r, c
    return tuple(np.concatenate([x, *more]) for x, more in zip((k, r, c), zip(*add)))


def _best_of_blocks(found: DataFrame) -> DataFrame:
    return found.groupBy("i").agg(F.max_by(F.struct("j", "sim"), F.struct("sim", -F.col("j"))).alias("m")).select("i", "m.j", "m.sim")


def nearest_elsewhere(df: DataFrame, group: str, part: list[str] | None = None, turns: bool = False, block: int | None = None) -> DataFrame:
    """(``i``, ``j``, ``sim``): for each row the most similar row of another group; ties go to the least id.

    Rows whose part holds one group only have no neighbour and do not occur.
    """
    part = part or []

    def run(f: _Sides) -> list[tuple]:
        g = pd.factorize(f.column(group))[0]
        got = _nearest(f, f.left, f.right, g, np.zeros(len(g), np.int64), 1, turns, not f.same)
        return [(f.ids[i], f.ids[j], s) for i, _, j, s in got]

    return _best_of_blocks(_joined(df.select("item_id", "v", group, *[p for p in part if p != group]), part, block, run, _PAIR))


def best_elsewhere(df: DataFrame, asks: str, part: list[str] | None = None, block: int | None = None, least: float = -np.inf) -> DataFrame:
    """(``i``, ``j``, ``sim``): for each row that asks (a boolean column) the most similar row that does not; ties go to the least id.

    Only products of asking with other rows are made. Askers whose part holds no other row do not occur, nor do those whose best is below ``least``.
    """
    part = part or []

    def run(f: _Sides) -> list[tuple]:
        q, none = f.column(asks).astype(bool), np.zeros(len(f.ids), np.int64)
        got = []
        for x, y in [(f.left, f.right)] if f.same else [(f.left, f.right), (f.right, f.left)]:
            got += _nearest(f, x[q[x]], y[~q[y]], None, none, 1, False, False, least)
        return [(f.ids[i], f.ids[j], s) for i, _, j, s in got]

    best = _best_of_blocks(_joined(df.select("item_id", "v", asks, *part), part, block, run, _PAIR))
    return best.where(F.col("sim") >= least) if least > -np.inf else best


def class_maxima(df: DataFrame, group: str, label: str, block: int | None = None, part: list[str] | None = None) -> DataFrame:
    """(``i``, ``label``, ``sim``): for each row the greatest similarity to each label among rows of other groups."""
    labelled = nearest_by_label(df, group, label, block, part or [])
    return labelled.groupBy("i", "label").agg(F.max("sim").alias("sim"))


def nearest_by_label(df: DataFrame, group: str, label: str, block: int | None, part: list[str]) -> DataFrame:
    def run(f: _Sides) -> list[tuple]:
        g, y = pd.factorize(f.column(group))[0], f.column(label).astype(np.float64)
        # rows without one of the labels are asked for theirs, and are nobody's neighbour
        kind = np.where(y == 1, 1, np.where(y == 0, 0, 2))
        got = _nearest(f, f.left, f.right, g, kind, 3, False, not f.same)
        return [(f.ids[i][k < 2], k[k < 2], s[k < 2]) for i, k, _, s in got]

    cols = list(dict.fromkeys(["item_id", "v", group, label, *part]))
    schema = pa.schema([("i", pa.int64()), ("label", pa.int32()), ("sim", pa.float64())])
    return _joined(df.select(*cols), part, block, run, schema)


def knn_scores(df: DataFrame, group: str, label: str, block: int | None = None) -> DataFrame:
    """1-NN scores of (``item_id``, ``v``) against the rows of other groups: best positive less best negative."""
    m = class_maxima(df, group, label, block)
    w = m.groupBy("i").agg(F.max(F.when(F.col("label") == 1, F.col("sim"))).alias("_p"), F.max(F.when(F.col("label") == 0, F.col("sim"))).alias("_n"))
    return w.select(F.col("i").alias("item_id"), (F.col("_p") - F.col("_n")).alias("score"))


def pair_statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row over (i, j): edges, and the shares with equal label ``y``, with different ``fold`` and, where nodes have one, with different ``group``."""
    pct = lambda c: F.round(100 * F.avg(c.cast("double")), 4)
    more = ["group"] if "group" in nodes.columns else []
    a, b = (nodes.select(F.col("item_id").alias(s), *[F.col(c).alias(f"_{c}{s}") for c in ["y", "fold", *more]]) for s in "ij")
    e = edges.join(a, "i").join(b, "j")
    groups = [pct(F.col("_groupi") != F.col("_groupj")).alias("pct_diff_group")] if more else []
    return e.agg(F.count("*").alias("n"), pct(F.col("_yi") == F.col("_yj")).alias("pct_same_label"), pct(F.col("_foldi") != F.col("_foldj")).alias("pct_diff_fold"), *groups)


def average_hash(df: DataFrame, key: str, v: str) -> DataFrame:
    mean = F.expr(f"aggregate({v}, 0D, (a, x) -> a + cast(x as double)) / size({v})")
    d = df.select(key, F.col(v).alias("_v"), mean.alias("_mean"))
    return d.select(key, F.expr("array_join(transform(_v, x -> CASE WHEN cast(x as double) > _mean THEN '1' ELSE '0' END), '')").alias("bits"))


def hamming_pairs(hashes: DataFrame, most: int, part: str, key: str = "item_id", across: str | None = None) -> DataFrame:
    """(``i``, ``j``, ``distance``), i < j, of one part with at most ``most`` differing bits; with ``across`` only of rows that differ in that column.

    The 64 bits are cut into exactly ``most`` + 1 segments whose widths differ by one at most. Two hashes at distance
    ``most`` or less agree on one of them: rows meet only where a segment is equal, then the whole distance decides.
    """
    cuts = [64 * s // (most + 1) for s in range(most + 2)]
    segs = F.array(*[F.concat(F.lit(f"{s}:"), F.substring("bits", lo + 1, hi - lo)) for s, (lo, hi) in enumerate(zip(cuts, cuts[1:]))])
    half = lambda at: F.conv(F.substring("bits", at, 32), 2, 10).cast("long")
    signed = F.shiftleft(half(1), 32).bitwiseOR(half(33))
    side = F.col(across) if across else F.lit(None).cast("string")
    h = hashes.select(F.col(key).alias("_k"), F.col(part).alias("_part"), signed.alias("_h"), side.alias("_side"), F.explode(segs).alias("_s"))
    a, b = (h.select(F.col("_k").alias(n), "_part", "_s", F.col("_h").alias(f"h{s}"), F.col("_side").alias(f"s{s}")) for n, s in (("i", "a"), ("j", "b")))
    d = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    return a.join(b, ["_part", "_s"]).where("i < j" + (" and sa <> sb" if across else "")).select("i", "j", d.alias("distance")).where(F.col("distance") <= most).distinct()
