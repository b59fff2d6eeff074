from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import abuse, blocks, drawings, leaks, links, neardup, neighbours, overlaps, splits


def test_pairs_of_hot_groups(spark):
    """Blocks of three rows give the same pairs as one block, within groups and across them."""
    rows = [(0, i) for i in range(17)] + [(1, 100), (2, 200), (2, 201), (1, 3)]
    m = spark.createDataFrame(rows, "g long, item long")
    groups = {g: {i for h, i in rows if h == g} for g in (0, 1, 2)}
    within = {p for s in groups.values() for p in combinations(sorted(s), 2)}
    pairs = spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
    across = {(min(x, y), max(x, y)) for a, b in ((0, 1), (1, 2)) for x in groups[a] for y in groups[b] if x != y}
    for size in (3, 1000):
        got = [tuple(r) for r in blocks.pairs_within(m, "g", "item", size).collect()]
        assert set(got) == within and len(got) == len(within)
        assert {tuple(r) for r in blocks.pairs_across(pairs, m, "g", "item", size).collect()} == across


def test_hot_keys_of_a_join(spark):
    df = spark.createDataFrame([(k % 3 and 7, k) for k in range(60)] + [(None, 99)], "k long, v long")
    table = spark.createDataFrame([(7, "x"), (0, "y"), (5, "z")], "k long, name string")
    want = {(r.k, r.v, r.name) for r in df.join(table, "k").collect()}
    for rows in (4, 1000):
        assert {(r.k, r.v, r.name) for r in blocks.hot_join(df, table, "k", F.col("v"), rows=rows).collect()} == want


@pytest.mark.parametrize("shuffled", [False, True])
def test_long_chains_take_few_levels_and_bounded_tasks(spark, monkeypatch, shuffled):
    """A chain and a hub of thousands of links with 400 a task: levels stay few, no task gets more than its bound."""
    rng = np.random.default_rng(3)
    ids = rng.permutation(6_000) if shuffled else np.arange(6_000)
    edges = [(int(a), int(b)) for a, b in zip(ids, ids[1:])] + [(10_000, 10_001 + i) for i in range(3_000)]
    sizes: list[int] = []
    seen = spark.sparkContext.accumulator(0)
    real = links._forest

    def counted(frames):
        frames = list(frames)
        if sum(map(len, frames)) > 400:
            seen.add(1)
        yield from real(iter(frames))

    monkeypatch.setattr(links, "_forest", counted)
    got = {r["node"]: r["group"] for r in links.link_groups(spark.createDataFrame(edges, "a long, b long"), "a", "b", 400, sizes=sizes).collect()}
    first = int(ids.min())
    assert set(got.values()) == {first, 10_000} and len(got) == 9_001 and sum(v == first for v in got.values()) == 6_000
    assert len(sizes) <= 12 and sizes[-1] <= 400 and seen.value == 0


def brute_spans(texts):
    """(rid, at) -> longest prefix of the suffix that stands in a text of another side of the group."""
    out = {}
    for rid, group, text, side in texts:
        for at in range(len(text)):
            others = [t for r, g, t, s in texts if g == group and s != side]
            best = max((n for n in range(len(text) - at, 0, -1) if any(text[at : at + n] in o for o in others)), default=0)
            if best >= overlaps.LEAST:
                out[rid, at] = min(best, overlaps.KEY)
    return out


@pytest.mark.parametrize("width", ["1", "5"])
def test_shared_spans_against_brute_force(spark, width):
    rng = np.random.default_rng(7)
    words = ["alpha", "beta", "gamma", "delta 7", "epsilon zeta", "x" * 70]
    texts = [(i, ["g", "h"][i % 5 == 0], " ".join(rng.choice(words, rng.integers(1, 5))), int(rng.integers(3))) for i in range(40)]
    texts += [(100, "g", "same text here", 0), (101, "g", "same text here", 1), (102, "g", "short", 0), (103, "g", "", 1), (104, "h", None, 1)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        got = overlaps.shared_spans(spark.createDataFrame(texts, "rid long, group string, text string, side int"), 3).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    found = {(r.rid, r.at): min(r.length, overlaps.KEY) for r in got}
    want = brute_spans([t for t in texts if t[2]])
    # the array leaves out suffixes too short to hold a span
    assert found == want and len(found) == len(got)


def test_nearest_of_another_side():
    lcp, side = np.array([0, 5, 3, 4, 1, 6]), np.array([0, 0, 1, 1, 0, 0])
    before, open_ = overlaps.to_other_side(lcp, side)
    assert before[2:].tolist() == [3, 3, 1, 1] and open_.tolist() == [True, True, False, False, False, False]
    assert overlaps.common_prefixes(["abc", "abd", "abd", "", "zz"]).tolist() == [0, 2, 3, 0, 0]


def test_names_that_need_more_than_the_kept_characters(spark):
    rows = [(1, "/a/" + "q" * 90 + "_5.png", "train"), (2, "/b/" + "q" * 90 + "_5_copy1.png", "val"), (3, "/b/" + "q" * 90 + "_6.png", "val"), (4, "/c/ab1.png", "test"), (5, "/c/AB_01.png", "train")]
    df = spark.createDataFrame([(i, p, s, "x wave", "wave", "s") for i, p, s in rows], "item_id long, path string, split string, class_name string, drawing_type string, source string")
    assert {tuple(r) for r in overlaps.name_overlaps(df).collect()} == {(1, 2), (4, 5)}


def test_rarest_keys_are_shared_by_alike_sets(spark):
    rng = np.random.default_rng(9)
    sets = [sorted(set(rng.integers(0, 30, 6).tolist()) | {99}) for _ in range(60)]
    sets += [s[:-1] + [98] for s in sets[:10]] + sets[:5]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id long, tokens array<long>")
    keys = {r.id: set(r["keys"]) for r in neardup.with_rarest_keys(df, 0.7).collect()}
    for (i, a), (j, b) in combinations(enumerate(map(set, sets)), 2):
        if len(a & b) >= 0.7 * len(a | b):
            assert keys[i] & keys[j]
    got = {(r.a, r.b) for r in neardup.tile_join(neardup.with_rarest_keys(df, 0.7), 0.7, 5).collect()}
    assert got == {(i, j) for (i, a), (j, b) in combinations(enumerate(map(set, sets)), 2) if len(a & b) >= 0.7 * len(a | b) - 1e-9}


def test_codes_grow_so_that_tiles_keep_their_size():
    shapes = [neardup.code_shape(1 << k) for k in range(8, 36)]
    assert all(a[1] <= b[1] and a[0] <= b[0] for a, b in zip(shapes, shapes[1:]))
    assert neardup.code_shape(1 << 16) == (neardup.CODES, neardup.SIGNS)
    mates = [codes * (1 << k) * 0.59**signs for k, (codes, signs) in zip(range(8, 36), shapes)]
    # the drawings met for each drawing grow by the codes alone, not with the drawings
    assert max(m / c for m, (c, _) in zip(mates, shapes)) / min(m / c for m, (c, _) in zip(mates, shapes)) < 2.5


def test_a_null_among_the_values_is_not_usable(spark):
    rows = [(1, 4, 4, list(range(16))), (2, 4, 4, [*range(15), None]), (3, 4, 4, list(range(16))), (4, 4, 4, [300, *range(15)])]
    df = spark.createDataFrame(rows, "item_id long, height int, width int, x array<smallint>").selectExpr("*", "'wave' as drawing_type", "'x' as class_name")
    assert {r.item_id for r in neardup.drawing_groups(df).collect()} == {1, 3, 4}
    near = {(r.item_id, r.near_item_id) for r in neighbours.nearest_drawings(df, "true").collect()}
    assert near == {(1, 3), (3, 1), (1, 4), (4, 1), (3, 4), (4, 3)}
    assert {r.item_id for r in drawings.whole_maps(df).collect()} == {1, 2, 3, 4}


def test_balance_is_better_than_hashing(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), s, ["healthy", "parkinson"][rng.random() < (0.7 if g % 3 else 0.2)]) for g, s in zip(rng.zipf(1.5, 5_000) % 900, rng.choice(["train", "val", "test"], 5_000))]
    comps = splits.components(spark.createDataFrame(rows, "g long, s string, d string"), "g", "s", "d")
    a = splits.whole_group_splits(comps, steps=4_000)
    b = splits.split_balance(comps, a).toPandas()
    assert a.groupBy("group_id").count().where("count > 1").count() == 0 and b["n_rows"].sum() == 5_000
    off = lambda c: (b[c] - b["target_share"]).abs().max()
    assert off("row_share") < 0.01 and off("label_share") < 0.02 and off("row_share") + off("label_share") < off("hashed_row_share") + off("hashed_label_share")


def test_windows_in_several_rounds_and_long_markup(spark, monkeypatch):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    items = spark.createDataFrame([(1, " ".join(words[:20])), (2, " ".join(words[30:45])), (3, None), (4, "too short")], "eval_id long, passage string")
    tag = '<a href="' + "z" * 900 + '">'
    texts = [(10, "before " + " ".join(words[5:12]) + tag + " ".join(words[12:16]) + " after"), (11, " ".join(words[30:40])), (12, " ".join(words[30:39])), (13, None), (14, "<!-- " + "c " * 700 + "-->" + " ".join(words[0:10]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = {(10, 1), (11, 2), (14, 1)}
    for size in (1 << 20, 300):
        monkeypatch.setattr(leaks, "ROUND_BYTES", size)
        assert {tuple(r) for r in leaks.passage_leaks(docs, items).collect()} == want


def test_errors_of_raters(spark):
    """Raters that err three times as often as assumed, in the assumed proportion; a category without a second rater, or in which raters always agree, keeps what is assumed."""
    rng = np.random.default_rng(8)
    rows = []
    for d in range(6_000):
        truth = rng.random() < 0.3
        for r in "ab":
            said = truth != (rng.random() < 3 * (abuse.WRONG_NO if truth else abuse.WRONG_YES))
            rows.append((d, r, int(said), None if r == "b" else 0, int(truth)))
    w = abuse.rater_errors(spark.createDataFrame(rows, "doc_id long, rater string, abusive int, hateful int, sexual int"))
    assert abs(w[1, 0] - 3 * abuse.WRONG_NO) < 0.02 and abs(w[0, 0] - 3 * abuse.WRONG_YES) < 0.01
    assert w[:, 1].tolist() == w[:, 2].tolist() == [abuse.WRONG_YES, abuse.WRONG_NO]


def test_markup_of_any_length_parts_no_sentence():
    long = "<span class='" + "k" * 3_000 + "'>"
    assert abuse.sentences(f"you are {long}fine.")[0] == "you are  fine"
    inside = "<you said " + "really " * 60 + "that>"
    assert any("you said" in s for s in abuse.sentences(f"well {inside} ok."))
    assert abuse.sentences("a <!-- " + "x" * 800 + " --> b.")[0].split() == ["a", "b"]
