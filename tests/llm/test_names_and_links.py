import re
from collections import namedtuple
from itertools import combinations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import links, neardup, overlaps, splits
from palimpsest.llm.names import known_type, part_of, spelled, with_cores

QUIET = dict(deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
MANIFEST = "item_id long, path string, split string, class_name string, drawing_type string, source string"


def test_one_drawing_under_many_names(spark):
    same = [
        ["/a/healthy_00375.png", "C:\\b\\HEALTHY375.JPG", "/c/copy_of_healthy 0375_aug3_aug1.jpeg", "/d/Healthy375.rf.21e798850587501c.png", "healthy-375 - copy (2).bmp ", "dup_healthy_375_512x512.png", "/x/final_healthy_375_rot15.png"],
        ["V53PA000014_t2.png", "v53pa_14_t2_aug5.jpeg", "Copy of V53PA-014_t2 (3).bmp"],
        ["V53PA000014.png", "V53PA14_edit.png"],
        ["scan_vxcgdx_0306.png", "SCAN_VXCGDX-306-crop.bmp"],
        ["spiral-h-020.jpg", "spiral-h 0000020 (2).png", "SPIRAL-H020.png"],
        ["tremor_test 0042.png", "copy of tremor-test42_final.jpg"],
        ["nameless.png"],
    ]
    rows = [(p, k, "wave") for k, g in enumerate(same) for p in g]
    stems = spark.createDataFrame(rows, "path string, k int, type string").withColumn("stem", spelled(F.col("path")))
    got = with_cores(stems).join(stems.select("stem", "k"), "stem").collect()
    keys = [{(r.unit, r.rest, r.trial) for r in got if r.k == k} for k in range(len(same))]
    assert all(len(k) == 1 for k in keys), keys
    assert len(set.union(*keys)) == len(same)
    none = spark.createDataFrame([(None,), ("",), ("/a/",)], "path string").select(spelled(F.col("path")).alias("s")).collect()
    assert [r.s for r in none] == [None, None, None]


def test_words_of_a_name_are_not_taken_for_added_ones(spark):
    """Nothing lists ``arm 7`` alone, so left and right stay parts of the name; a very long name is read too."""
    names = ["arm_7_left", "arm_7_right", "arm_8_left", "leg 1", "leg_1_copy3", "leg_2_copy1", "leg_2", "copy of leg 2", "a " * 3000 + "5", "0" * 5000]
    cores = {r.stem: (r.unit, r.rest, r.trial) for r in with_cores(spark.createDataFrame([(n, "t") for n in names], "p string, type string").select("type", spelled(F.col("p")).alias("stem"))).collect()}
    assert cores["arm 7 left"] != cores["arm 7 right"] and cores["leg 1 copy 3"] == cores["leg 1"] and cores["copy of leg 2"] == cores["leg 2"] == cores["leg 2 copy 1"]
    assert len(cores) == len(names)


def test_types_and_parts(spark):
    df = spark.createDataFrame([("Spiral ", "x wave", " TRAIN"), (None, "healthy_wave", "validation"), (None, None, "?"), ("", "parkinson spiral", None)], "t string, c string, s string")
    got = [tuple(r) for r in df.select(known_type(F.col("t"), F.col("c")), part_of(F.col("s"))).collect()]
    assert got == [("spiral", "train"), ("wave", "val"), (None, None), ("spiral", None)]


def forest(edges):
    p = {}

    def root(a):
        while p.setdefault(a, a) != a:
            a = p[a]
        return a

    for a, b in edges:
        a, b = root(a), root(b)
        p[max(a, b)] = min(a, b)
    return {a: root(a) for a in p}


@settings(max_examples=6, **QUIET)
@given(st.lists(st.tuples(st.integers(-5, 15), st.integers(-5, 15)), min_size=1, max_size=25), st.sampled_from([1, 4, 100]))
def test_link_groups(spark, edges, per_task):
    got = links.link_groups(spark.createDataFrame(edges, "a long, b long"), "a", "b", per_task)
    assert {r["node"]: r["group"] for r in got.collect()} == forest(edges)


def test_chain_and_hub_over_many_levels(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(300)]
    df = spark.createDataFrame(edges, "a long, b long").withColumn("node", F.lit("clash")).withColumn("_a", F.lit(1))
    got = {r["node"]: r["group"] for r in links.link_groups(df, "a", "b", 40).collect()}
    assert got == forest(edges)


def test_links_of_nothing(spark):
    empty = spark.createDataFrame([(None, 1)], "a long, b long")
    assert links.link_groups(empty, "a", "b").count() == 0


def test_linked_files(spark):
    m = spark.createDataFrame([(1, "/A/x.png"), (2, "\\a\\Y.png "), (2, "/a/y.png"), (3, "/a/z.png"), (4, "/a/q.png"), (5, None)], "item_id long, path string")
    nan = float("nan")
    pairs = [(0.995, "/a/X.png", "\\A\\y.PNG"), (0.99, "/a/y.png", "/a/z.png"), (0.98, "/a/z.png", "/a/q.png"), (nan, "/a/z.png", "/a/q.png"), (None, "/a/z.png", "/a/q.png"), (1.0, "/a/q.png", "/a/q.png"), (1.0, "/a/q.png", "/lost.png"), (1.0, None, "/a/q.png")]
    p = spark.createDataFrame(pairs, "correlation double, val_path string, train_path string")
    assert {tuple(r) for r in links.linked_files(p, m).collect()} == {(1, 1), (2, 1), (3, 1)}


def manifest(spark, rows):
    return spark.createDataFrame(rows, MANIFEST)


def test_paths_and_overlaps_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        style, n = ["healthy_{:05d}", "V12HE{:06d}", "spiral-h-{:03d}", "scan_abcdef_{:04d}"][rng.integers(4)], int(rng.integers(40))
        tail = ["", "_aug3", " (2)", "_t2", "_copy1", ".rf.0011223344556677"][rng.integers(6)]
        t = [("wave", "x wave"), ("spiral", "x spiral"), (None, "healthy_spiral"), (None, None)][rng.integers(4)]
        s = ["train", "Train", "val", "valid", "testing", "?", None][rng.integers(7)]
        rows.append((int(rng.integers(300)), "/d/" + style.format(n) + tail + ".png", s, t[1], t[0], "s"))
    rows += [(9000, None, "train", "x wave", "wave", None), (None, "/d/healthy_1.png", "val", "x wave", "wave", "s")]
    df = manifest(spark, rows)
    # the drawing of each name as it was made up: what the operators have to find out from the names alone
    key = lambda p: re.sub(r"(_aug3| \(2\)|_copy1|\.rf\.0011223344556677)?\.png$", "", p)
    Row = namedtuple("Row", "item_id t p key")
    kind = lambda t, c: t or ("spiral" if c and c.endswith("spiral") else "wave" if c and c.endswith("wave") else None)
    part = {"train": "train", "Train": "train", "val": "val", "valid": "val", "testing": "test"}
    spell = lambda p: re.sub(r"0*(\d+)", r"\1", key(p))
    good = [Row(i, kind(t, c), part.get(s), spell(p)) for i, p, s, c, t, _ in rows if i is not None and p and kind(t, c)]
    want = {(a.item_id, b.item_id) for a in good for b in good if a.item_id < b.item_id and a.t == b.t and a.key == b.key}
    assert {tuple(r) for r in neardup.path_duplicates(df).collect()} == want
    cross = {(min(a.item_id, b.item_id), max(a.item_id, b.item_id)) for a in good for b in good if a.item_id != b.item_id and a.t == b.t and a.key == b.key and a.p == "train" and b.p in ("val", "test")}
    got = overlaps.name_overlaps(df).collect()
    assert {tuple(r) for r in got} == cross and len(got) == len(cross)
    report = overlaps.overlap_report(df).toPandas()
    assert (report["n_overlapping"] <= report["n_items"]).all()
    cover = overlaps.span_coverage(df).toPandas()
    assert (cover["covered"] <= cover["length"]).all() and cover["covered"].max() > 0


def test_nothing_overlaps_in_an_empty_manifest(spark):
    df = manifest(spark, [])
    assert overlaps.name_overlaps(df).count() == 0 and neardup.path_duplicates(df).count() == 0
    assert overlaps.span_coverage(df).count() == 0


@settings(max_examples=5, **QUIET)
@given(st.lists(st.sets(st.integers(0, 400), min_size=0, max_size=12), min_size=2, max_size=14), st.sampled_from([0.5, 0.8, 1.0]), st.sampled_from([2, 2000]))
def test_tiles_against_brute_force(spark, sets, least, rows):
    data = [(i, sorted(s), sorted(s)) for i, s in enumerate(sets)] + [(50, None, None)]
    got = neardup.tile_join(spark.createDataFrame(data, "id long, keys array<long>, tokens array<int>"), least, rows).collect()
    want = {(i, j) for (i, a), (j, b) in combinations(enumerate(sets), 2) if a and b and len(a & b) >= max(1, least * len(a | b) - 1e-9)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_torn_groups_and_whole_splits(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), ["train", "Val", "TESTING", "dup", None, "drop"][rng.integers(6)], ["healthy", "parkinson", None][rng.integers(3)], i) for i, g in enumerate(rng.zipf(1.3, 3000) % 400)]
    rows += [(None, "train", "healthy", 5000), (777, "train", "healthy", 5001), (777, "dup", "healthy", 5002), (778, "train", "x", 5003), (778, " test ", "x", 5004)]
    df = spark.createDataFrame(rows, "group_id long, split_clean string, diagnosis string, item_id long")
    torn = {r.group_id for r in splits.torn_groups(df).collect()}
    seen: dict = {}
    for g, s, _, _ in rows:
        p = {"train": 0, "val": 1, "testing": 2, "test": 2}.get((s or "").strip().lower())
        if g is not None and p is not None:
            seen.setdefault(g, set()).add(p)
    assert torn == {g for g, p in seen.items() if len(p) > 1} and 778 in torn and 777 not in torn
    a = splits.whole_group_splits(splits.components(df, "group_id", "split_clean", "diagnosis"), steps=3000).toPandas()
    assert a["group_id"].is_unique and set(a["group_id"]) == {g for g, *_ in rows if g is not None}
    share = a.groupby("split_new")["n_rows"].sum() / a["n_rows"].sum()
    biggest = a["n_rows"].max() / a["n_rows"].sum()
    assert biggest > 0.2 and abs(share["train"] - 0.80) < 0.01 and abs(share["val"] - 0.12) < 0.01 and abs(share["test"] - 0.08) < 0.01
    r = splits.assigned_records(df, spark.createDataFrame(a)).toPandas()
    assert len(r) == len(df.toPandas()) and (r.dropna(subset=["group_id"]).groupby("group_id")["split_new"].nunique() == 1).all()


def test_splits_of_nothing_and_of_one_group(spark):
    df = spark.createDataFrame([(None, "train")], "group_id long, split_clean string")
    assert splits.whole_group_splits(splits.components(df, "group_id", "split_clean")).count() == 0
    one = spark.createDataFrame([(1, "train")] * 5, "group_id long, split_clean string")
    assert splits.whole_group_splits(splits.components(one, "group_id", "split_clean")).first().split_new == "train"


def test_annealing_improves():
    rng = np.random.default_rng(2)
    s = np.stack([rng.integers(1, 30, 300), np.zeros(300)], axis=1).astype(float)
    s[:, 1] = np.floor(s[:, 0] * rng.random(300))
    goal = np.outer(splits.SHARES, s.sum(axis=0))
    start = splits.hashed_start(rng.random(300))
    cost = lambda a: sum((((s[a == p].sum(axis=0) - goal[p]) / s.sum(axis=0)) ** 2).sum() for p in range(3))
    assert cost(splits.anneal(s, start, goal, 0, 5000)) < cost(start) / 10
    assert len(splits.anneal(s[:0], start[:0], goal, 0)) == 0
    with pytest.raises(IndexError):
        splits.PARTS[3]
