"""Blocks and tiles of the similarity joins: what travels, and that bounds and copies lose nothing."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.functions.images import dihedral_orders
from palimpsest.operators import similarity


def levels(spark, x, **more):
    """Packed rows of whole numbers with columns from functions of the row's number."""
    cells = similarity.packed(x).to_pylist()
    rows = [(i, bytearray(c), *(f(i) for f in more.values())) for i, c in enumerate(cells)]
    return spark.createDataFrame(rows, "item_id long, v binary" + "".join(f", {k} int" for k in more))


def drawings():
    """Small squares with exact, near and turned copies, and three without anything."""
    rng = np.random.default_rng(70)
    x = rng.integers(0, 40, (90, 16, 16)) * (rng.random((90, 16, 16)) < 0.3)
    for i in range(30):
        x[60 + i] = np.rot90(x[i], i % 4)[:, :: 1 if i % 3 else -1]
    x[75:85] += rng.integers(0, 4, (10, 16, 16))
    x[[7, 40, 66]] = 5
    x[[8, 41]], x[[10, 25]] = x[9], x[11]
    return x.reshape(90, -1)


def test_rows_travel_packed_and_a_bounded_number_of_times(spark):
    """A part of 100,000 rows: 12 copies of a row at most, and a vector of bytes stays one."""
    df = spark.range(100_000).select(F.col("id").alias("item_id"), F.unhex(F.lit("0101")).alias("v"), F.lit("k").alias("kind"))
    sent = similarity._paired_blocks(df, ["kind"], None)
    assert sent.count() <= similarity.COPIES * 100_000 and dict(sent.dtypes)["v"] == "binary"
    assert len(similarity.packed(np.ones((1, 256), np.int64))[0].as_py()) == 257


@pytest.mark.parametrize("turns", [False, True])
def test_bounds_lose_no_pair(spark, turns):
    x = drawings()
    u = similarity.units(x)
    orders = dihedral_orders(16, 16) if turns else [np.arange(256)]
    s = np.max([u @ u[:, o].T for o in orders], axis=0)
    for least in (0.2, 0.8, 0.99):
        want = {(i, j) for i in range(90) for j in range(i + 1, 90) if s[i, j] >= least}
        for block in (25, None):
            got = {(r.i, r.j): r.sim for r in similarity.similar_pairs(levels(spark, x), least, turns=turns, block=block).collect()}
            assert set(got) == want and all(abs(v - s[p]) < 1e-12 for p, v in got.items())


def test_turn_free_numbers_bound_the_products():
    x = similarity.units(drawings()).astype(np.float32)
    f = similarity._frequencies(x)
    p = similarity.turn_free(f)
    best = np.max([x @ x[:, o].T for o in dihedral_orders(16, 16)], axis=0)
    assert (p @ p.T >= best - 1e-5).all()
    i, j = np.divmod(np.arange(90 * 90), 90)
    assert np.abs(similarity._turned_best(f[i], f[j]).reshape(90, 90) - best).max() < 1e-5
    for least in (0.3, 0.8, 0.95):
        b = similarity._bounds(p, least, 8_000)
        assert (b @ b.T >= best - 1e-5).all()


@pytest.mark.parametrize("block", [25, None])
def test_nearest_of_copies_and_of_nothing(spark, block):
    x = drawings()
    u = similarity.units(x)
    s = np.round(u @ u.T, 12)
    df = levels(spark, x, grp=lambda i: i % 5, y=lambda i: i // 3 % 2)
    key = lambda i: lambda j: (s[i, j], -j)
    want = {i: max((j for j in range(90) if j % 5 != i % 5), key=key(i)) for i in range(90)}
    assert {r.i: r.j for r in similarity.nearest_elsewhere(df, "grp", block=block).collect()} == want
    asks = df.withColumn("q", F.col("grp") == 0)
    want = {i: max((j for j in range(90) if j % 5), key=key(i)) for i in range(0, 90, 5)}
    assert {r.i: r.j for r in similarity.best_elsewhere(asks, "q", block=block).collect()} == want
    high = {i: j for i, j in want.items() if s[i, j] >= 0.9}
    assert {r.i: r.j for r in similarity.best_elsewhere(asks, "q", block=block, least=0.9).collect()} == high and 0 < len(high) < len(want)
    want = {(i, y): max(s[i, j] for j in range(90) if j % 5 != i % 5 and j // 3 % 2 == y) for i in range(90) for y in (0, 1)}
    got = {(r.i, r.label): r.sim for r in similarity.class_maxima(df, "grp", "y", block).collect()}
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-11 for k, v in want.items())


def test_rows_of_several_widths_unpack_alike():
    small, large = np.array([[1, 2, 3, 250]]), np.array([[1, 2, 3, 1000]])
    both = pa.chunked_array([similarity.packed(small), similarity.packed(large)])
    assert np.allclose(similarity._unpacked(both), similarity.units(np.vstack([small, large])))


def test_blocks_are_sent_and_written_once(spark):
    """Whatever the number of blocks, a vector goes through the shuffle once; what is found does not depend on them."""
    df = spark.range(3_000).select(F.col("id").alias("item_id"), F.unhex(F.lit("0101")).alias("v"), (F.col("id") % 3).alias("kind"))
    for block in (100, 1_000):
        sent = similarity._paired_blocks(df, ["kind"], block)
        assert sent.count() == 3_000 and sent.select("_file").distinct().count() == (30 if block == 100 else 1)


def test_parts_of_every_size_and_without_a_name(spark):
    """A large part in several blocks, small ones that share a file, and one whose name is null."""
    x = drawings()
    u = similarity.units(x)
    s = u @ u.T
    kind = [0] * 60 + [None if i % 4 == 0 else i % 4 for i in range(30)]
    df = levels(spark, x).join(spark.createDataFrame(list(enumerate(kind)), "item_id long, kind int"), "item_id")
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if s[i, j] >= 0.2 and kind[i] == kind[j]}
    got = [(r.i, r.j) for r in similarity.similar_pairs(df, 0.2, ["kind"], block=20).collect()]
    assert len(got) == len(want) and set(got) == want


def test_links_and_counts_stand_for_all_pairs(spark, monkeypatch):
    """At every step the links join what the pairs join and the counts are theirs, whatever the blocks and the pairs held; a task gives fewer links than it has rows."""
    monkeypatch.setattr(similarity, "PAIRS_HELD", 20)
    x = np.concatenate([drawings(), np.repeat(drawings()[12:14], 40, axis=0)])
    n = len(x)
    u = similarity.units(x)
    steps = [0.2, 0.8, 0.95]

    def joined(pairs):
        of = list(range(n))
        for i, j in pairs:
            a, b = of[i], of[j]
            of = [min(a, b) if k in (a, b) else k for k in of]
        return of

    for turns in (False, True):
        s = np.max([u @ u[:, o].T for o in (dihedral_orders(16, 16) if turns else [np.arange(256)])], axis=0)
        for block in (45, None):
            links, counts = similarity.counted_links(levels(spark, x), steps, turns=turns, block=block)
            links = links.collect()
            got = {r.step: r.n for r in counts.groupBy("step").agg(F.sum("n").alias("n")).collect()}
            for step in steps:
                want = [(i, j) for i in range(n) for j in range(i + 1, n) if s[i, j] >= step]
                assert got.get(step, 0) == len(want) and joined((r.i, r.j) for r in links if r.sim >= step) == joined(want)
            assert len(links) < (n if block is None else 12 * n) and all(r.i < r.j and abs(r.sim - s[r.i, r.j]) < 1e-12 for r in links)


def test_matches_and_pairs_from_the_same_blocks(spark):
    x = drawings()
    u = similarity.units(x)
    s = u @ u.T
    df = levels(spark, x, q=lambda i: int(i % 4 == 0)).withColumn("q", F.col("q") == 1)
    want = sum(s[i, j] >= 0.8 for i in range(90) for j in range(i + 1, 90) if i % 4 and j % 4)
    for block in (25, None):
        best, inside = similarity.best_and_counted(df, "q", 0.8, block=block)
        assert sorted(map(tuple, best.collect())) == sorted(map(tuple, similarity.best_elsewhere(df, "q", block=block).collect()))
        assert inside.agg(F.sum("n")).first()[0] == want > 0
