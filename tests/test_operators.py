import os
import struct
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import kernels
from palimpsest.operators import audit, duplicates, graph, images, metrics, reports, similarity
from palimpsest.sources import ingest, sinks
from palimpsest.streaming import incremental

QUIET = dict(deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def union_find(edges):
    p = {}

    def root(a):
        while p.setdefault(a, a) != a:
            a = p[a]
        return a

    for a, b in edges:
        a, b = root(a), root(b)
        p[max(a, b)] = min(a, b)
    return {a: root(a) for a in p}


@settings(max_examples=5, **QUIET)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=14), st.sampled_from([0, 3, 1000]))
def test_components(spark, edges, in_one_task):
    got = graph.components(spark.createDataFrame(edges, "i long, j long"), links_per_task=in_one_task)
    assert {r.node: r.component for r in got.collect()} == union_find(edges)


def test_components_of_nothing_and_of_a_long_chain(spark):
    assert graph.components(spark.createDataFrame([], "i long, j long")).count() == 0
    chain = [(i, i + 1) for i in range(40)]
    assert {r.component for r in graph.components(spark.createDataFrame(chain, "i long, j long")).collect()} == {0}


def test_components_of_long_chains_in_random_order(spark):
    rng = np.random.default_rng(8)
    edges = []
    for first, n in ((0, 3000), (10_000, 1000), (20_000, 1)):
        ids = (first + rng.permutation(n)).tolist()
        edges += list(zip(ids, ids[1:])) or [(first, first)]
    for in_one_task in (0, 1_000_000):
        got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "i long, j long"), links_per_task=in_one_task).collect()}
        assert got == union_find(edges) and len(got) == 4001 and set(got.values()) == {0, 10_000, 20_000}


def test_group_rules(spark):
    rows = [
        (1, "a", "val", "healthy", 5, 1), (2, "b", "train", "healthy", 3, 1), (3, "c", "test", "healthy", 3, 1),
        (4, "d", "val", "healthy", 1, 2), (5, "e", "test", "parkinson", 2, 2), (6, "f", "val", "healthy", 9, 3), (7, "g", "test", "healthy", 9, 4), (8, "h", "val", "healthy", 9, 4),
    ]
    got = {r.item_id: (r._role, r._clean) for r in audit.group_rules(spark.createDataFrame(rows, "item_id long, path string, split string, diagnosis string, name_number int, group_id long")).collect()}
    assert got == {1: ("dup", "dup"), 2: ("rep", "train"), 3: ("dup", "dup"), 4: ("rep", "drop"), 5: ("dup", "drop"), 6: ("rep", "val"), 7: ("rep", "test"), 8: ("dup", "dup")}


def test_unique_keys_and_missing_features(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None)], "k long, v double")
    b = spark.createDataFrame([(1, 3.0), (1, 4.0)], "k long, w double")
    with pytest.raises(ValueError):
        audit.one_to_one(a, b, ["k"])
    with pytest.raises(ValueError):
        audit.whole_or_none(a, ["v"])
    assert audit.one_to_one(a, b.limit(1), ["k"]).count() == 2


def test_nan_is_missing_for_the_median(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, float("nan"), 3.0, 5.0, None])], "i long, v double")
    assert [r.v for r in audit.imputed(df, ["v"]).orderBy("i").collect()] == [1, 3, 3, 5, 3]


def vectors(spark, v, extra=None):
    return spark.createDataFrame([(int(i), [float(x) for x in r], int(i) % 3, int(i) % 2) for i, r in enumerate(v)], "item_id long, v array<double>, grp int, y int")


def test_blocks_do_not_change_the_pairs(spark):
    v = np.random.default_rng(0).normal(0, 1, (60, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = vectors(spark, v)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if v[i] @ v[j] >= 0.3}
    for block in (7, 1000):
        assert {(r.i, r.j) for r in similarity.similar_pairs(df, 0.3, block=block).collect()} == want


def test_turned_twin_and_ties(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 255, (1, 8, 8))
    v = kernels.thumbnails(np.concatenate([a, np.rot90(a, 1, (1, 2)), a[:, :, ::-1], rng.integers(0, 255, (2, 8, 8))]), 8)
    df = vectors(spark, v)
    assert {(r.i, r.j) for r in similarity.similar_pairs(df, 0.95, turns=True).collect()} == {(0, 1), (0, 2), (1, 2)}
    assert similarity.similar_pairs(df, 0.95).count() == 0
    same = vectors(spark, np.ones((6, 4)) / 2)
    near = {r.i: r.j for r in similarity.nearest_elsewhere(same, "grp", block=2).collect()}
    assert near == {0: 1, 1: 0, 2: 0, 3: 1, 4: 0, 5: 0}
    alone = similarity.nearest_elsewhere(same.withColumn("grp", F.lit(1)), "grp")
    assert alone.count() == 0


def test_leaking_copies_flatter_the_neighbour(spark):
    """Six copies of each prototype: folds that split copies give a high AUC, folds that keep them whole do not."""
    rng = np.random.default_rng(0)
    proto = rng.normal(0, 1, (40, 64))
    label = rng.integers(0, 2, 40)
    v = np.repeat(proto, 6, axis=0) + rng.normal(0, 0.1, (240, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in v[i]], int(label[i // 6]), i % 5, (i // 6) % 5) for i in range(240)]
    df = spark.createDataFrame(rows, "item_id long, v array<double>, y int, leaky int, clean int")
    auc = {}
    for g in ("leaky", "clean"):
        s = similarity.knn_scores(df, g, "y").join(df.select("item_id", "y", F.lit("x").alias("g")), "item_id")
        auc[g] = metrics.auc_roc(s, ["g"]).first().auc
    assert auc["leaky"] > 0.8 and 0.3 < auc["clean"] < 0.7


@pytest.mark.parametrize("most", [0, 6, 20, 31, 63])
def test_hamming_pairs_at_the_bound(spark, most):
    """Flipped bits spread over as many segments as can be, whatever the cut: every other bit, every fourth, or a run."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2, 64)
    spots = [np.arange(0, 64, 4), np.arange(0, 64, 3), np.arange(64), *(rng.permutation(64) for _ in range(6))]
    rows = [(0, "".join(map(str, base)), "k")]
    for i, at in enumerate(spots):
        b = base.copy()
        b[np.concatenate([at, np.setdiff1d(np.arange(64), at)])[:most]] ^= 1
        rows.append((i + 1, "".join(map(str, b)), "k"))
    got = {(r.i, r.j): r.distance for r in similarity.hamming_pairs(spark.createDataFrame(rows, "item_id long, bits string, part string"), most, "part").collect()}
    want = {(a[0], b[0]): d for a in rows for b in rows if a[0] < b[0] and (d := sum(x != y for x, y in zip(a[1], b[1]))) <= most}
    assert got == want and len(want) >= 9


def test_hamming_pairs_find_all(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2, 64)
    rows = []
    for i in range(30):
        b = base.copy()
        b[rng.choice(64, rng.integers(0, 9), replace=False)] ^= 1
        rows.append((i, "".join(map(str, b)), "k"))
    got = {(r.i, r.j): r.distance for r in similarity.hamming_pairs(spark.createDataFrame(rows, "item_id long, bits string, part string"), 6, "part").collect()}
    want = {(a[0], b[0]): d for a in rows for b in rows if a[0] < b[0] and (d := sum(x != y for x, y in zip(a[1], b[1]))) <= 6}
    assert got == want


def test_report_cells(spark):
    text = "#Top\n## First\n|:--|--|\n| m | Some-Score | n |\n|---|---|---|\n| x | 3.25 [1.5-4] | abc |\n| y | .5 | -7 |\n | not a row | 1 | 2 |\n| m | b |\n|---|---|\n| z | 2 |\n"
    got = {(r.section, r.subset, r.metric): (r.value, r.lo, r.hi) for r in reports.report_cells(spark.createDataFrame([("r", text)], "run string, value string")).collect()}
    assert got == {("First", "x", "some_score"): (3.25, 1.5, 4.0), ("First", "y", "some_score"): (0.5, None, None), ("First", "y", "n"): (-7.0, None, None), ("First", "z", "b"): (2.0, None, None)}


def test_pixels_decide_on_near_links(spark):
    """Signatures alike to 0.99: one pair equal but for a few faint values, one with a blot, and an exact copy of each kind."""
    rng = np.random.default_rng(61)
    a = rng.integers(0, 200, 256)
    faint, blot = a + rng.integers(0, 3, 256), a.copy()
    blot[:8] += 50
    rows = [(1, a, "spiral"), (2, faint, "spiral"), (3, blot, "spiral"), (4, a, "spiral"), (5, a, "wave"), (6, blot, "spiral")]
    pix = spark.createDataFrame([(i, [int(v) for v in x]) for i, x, _ in rows], "item_id long, x array<smallint>")
    unit = lambda x: [float(v) for v in (x - x.mean()) / np.linalg.norm(x - x.mean())]
    vec = spark.createDataFrame([(i, unit(x)) for i, x, _ in rows], "item_id long, v array<double>")
    man = spark.createDataFrame([(i, f"p{i}", ["train", "val"][i % 2], "healthy", i, k) for i, _, k in rows], "item_id long, path string, split string, diagnosis string, name_number int, drawing_type string")
    assert float(np.dot(unit(a), unit(blot))) > 0.97
    got = {r.item_id: (r.group_id, r.role, r.split_clean) for r in duplicates.grouped_manifest(man, pix, vec, least=0.97).collect()}
    assert {i: g for i, (g, *_) in got.items()} == {1: 1, 2: 1, 4: 1, 3: 3, 6: 3, 5: 5}
    assert got[1] == (1, "rep", "train") and got[3] == (3, "rep", "train") and got[5] == (5, "rep", "val") and got[2][1:] == ("dup", "dup")
    digests = pix.select("item_id", duplicates.content_digest().alias("digest")).join(man.select("item_id", "drawing_type"), "item_id")
    n = duplicates.link_counts(digests, duplicates.grouped_manifest(man, pix, vec, least=0.97)).first()
    assert (n.n_files, n.n_groups, n.exact_links, n.near_links) == (6, 3, 2, 1)


def test_pixels_of_drawings_in_no_pair_stay_where_they_are(spark):
    """Also where the ids in pairs are too many for a broadcast; values beyond a byte, nulls and unequal sizes."""
    x = np.random.default_rng(63).integers(0, 256, (600, 1024)).astype(int)
    x[1] = x[0]
    x[1, :16] += 64
    rows = [(i, [int(v) for v in r]) for i, r in enumerate(x)]
    rows += [rows[1], (600, rows[0][1][:-1]), (601, None), (602, [None, *rows[0][1][1:]])]
    pix = spark.createDataFrame(rows, "item_id long, x array<smallint>").repartition(4).localCheckpoint()
    pairs = spark.createDataFrame([(0, 1), (0, 600), (0, 601), (0, 602), (2, 3)], "i long, j long").localCheckpoint()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    sc = spark.sparkContext
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        sc.setJobGroup("pixels", "")
        got = {(r.i, r.j): (r.mad, r.share) for r in duplicates.pixel_differences(pairs, pix).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got[0, 1] == (1.0, 16 / 1024) and set(got) == {(0, 1), (0, 602), (2, 3)} and got[0, 602][0] > 16
    d = np.abs(x[2] - x[3])
    assert got[2, 3] == pytest.approx((d.mean(), (d > 40).mean()))
    stages = {k for j in sc.statusTracker().getJobIdsForGroup("pixels") for k in sc.statusTracker().getJobInfo(j).stageIds}
    store = sc._jsc.sc().statusStore()
    assert 0 < sum(store.lastStageAttempt(k).shuffleWriteBytes() for k in stages if sc.statusTracker().getStageInfo(k).numCompletedTasks) < x.size / 4


def test_best_matches_go_one_way(spark):
    v = np.random.default_rng(62).normal(0, 1, (40, 8))
    v[5] = v[9]
    df = spark.createDataFrame([(i, [float(x) for x in r], "a" if i % 2 else "b", "val" if i % 5 == 0 else "train") for i, r in enumerate(v)], "item_id long, v array<double>, k string, split string")
    for block in (7, 1000):
        got = {r.i: r.j for r in similarity.best_elsewhere(df.withColumn("q", F.col("split") == "val"), "q", ["k"], block).collect()}
        want = {i: max((j for j in range(40) if j % 5 and (i - j) % 2 == 0), key=lambda j: (round(v[i] @ v[j], 12), -j)) for i in range(0, 40, 5)}
        assert got == want
    assert {r.i for r in duplicates.split_matches(df, "k").collect()} == set(range(0, 40, 5))


def test_duplicates_across_splits(spark):
    rows = [(1, "k", "d1", "0" * 64, "train"), (2, "k", "d1", "0" * 64, "test"), (3, "k", "d3", "0" * 63 + "1", "test"), (4, "k", "d4", "1" * 64, "test"), (5, "other", "d1", "0" * 64, "test"), (6, "k", "d1", "0" * 64, "val")]
    df = spark.createDataFrame(rows, "item_id long, kind string, digest string, bits string, split string")
    got = lambda most: {(r.train, r.test, r.match) for r in duplicates.cross_split_duplicates(df, "kind", "digest", "bits", most=most).collect()}
    assert got(0) == {(1, 2, "exact")} and got(1) == {(1, 2, "exact"), (1, 3, "near")}


def test_samples_and_score_checks(spark):
    df = spark.range(500).withColumnRenamed("id", "item_id")
    a, b, c = ({r.item_id for r in audit.seeded_sample(df.repartition(n), "item_id", 30, s).collect()} for n, s in ((1, 4), (7, 4), (3, 5)))
    assert a == b and len(a) == 30 and a != c
    scores = spark.createDataFrame([(i, r, 0.5) for i in range(4) for r in range(2) if (i, r) != (3, 1)] + [(0, 0, 0.1), (9, 0, float("nan"))], "item_id long, repeat int, score double")
    r = audit.score_checks(scores, spark.range(4).withColumnRenamed("id", "item_id"), 2).first()
    assert (r.n_items, r.n_missing, r.n_unknown, r.n_repeated, r.n_bad, r.ok) == (4, 1, 1, 1, 1, False)
    good = spark.createDataFrame([(i, r, 0.5) for i in range(4) for r in range(2)], "item_id long, repeat int, score double")
    assert audit.score_checks(good, spark.range(4).withColumnRenamed("id", "item_id"), 2).first().ok


def test_written_tables_can_be_released(spark):
    import palimpsest.session as session

    before = len(session._WRITTEN)
    df = session.written(spark.range(5), "t")
    at = session._WRITTEN[-1].removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(at)
    assert session.release(spark, before) == before and not os.path.isdir(at)


def test_reports_are_not_cut_short(spark):
    assert sinks.markdown(spark.range(300), "t").count("\n") >= 303
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(30), "t", most=29)


def png(path, pixels):
    h, w = pixels.shape
    raw = b"".join(b"\0" + r.tobytes() for r in pixels.astype(np.uint8))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_tree_of_images(spark, tmp_path):
    rng = np.random.default_rng(0)
    pix = rng.integers(0, 256, (12, 10))
    for split in ("train", "valid"):
        for kind in ("images", "labels"):
            os.makedirs(tmp_path / "set" / split / kind)
    for split, name, label in [("train", "healthy_01", "0 .5 .5 .9 .9"), ("train", "healthy_01_aug2", "0 1 1 1 1"), ("valid", "Parkinson7", "1"), ("valid", "lost3", None)]:
        png(tmp_path / "set" / split / "images" / f"{name}.png", pix)
        if label:
            (tmp_path / "set" / split / "labels" / f"{name}.txt").write_text(label)
    (tmp_path / "set" / "data.yaml").write_text("names: ['healthy spiral', 'parkinson wave']\n")
    manifest, problems = ingest.build_manifest(spark, str(tmp_path / "set"))
    got = {(r.split, r.class_name, r.drawing_type, r.name_prefix, r.name_number) for r in manifest.collect()}
    assert got == {("train", "healthy spiral", "spiral", "healthy", 1), ("val", "parkinson wave", "wave", "Parkinson", 7)}
    assert problems.first().asDict() == {"augmented": 1, "without_label": 1, "unreadable_label": 0, "prefix_disagrees": 1}
    gray = ingest.read_gray(spark, str(tmp_path / "set")).collect()
    assert len(gray) == 4 and gray[0].height == 12 and list(gray[0].x) == pix.reshape(-1).tolist()
    facts = {(r.width, r.height, r.mode, r.is_rgba) for r in ingest.image_facts(spark, str(tmp_path / "set")).collect()}
    assert facts == {(10, 12, "L", 0)} and ingest.image_facts(spark, str(tmp_path / "set")).where("filesize > 50").count() == 4
    assert ingest.tree_summary(spark, str(tmp_path / "set")).where("augmented").first().n == 1
    assert ingest.list_images(spark, str(tmp_path)).count() == 4


def test_odd_trees(spark, tmp_path):
    """A root called test decides no split; a class id beyond the names goes by its number; an unreadable label is counted; the first list counts."""
    root = tmp_path / "test" / "data"
    for kind in ("images", "labels"):
        os.makedirs(root / "a" / kind)
    for name, label in [("left_3", "7 .1 .1 .2 .2"), ("b.rf.0123456789abcdef", " \n1.0 0 0 1 1"), ("c", "none"), ("d_aug1", "0")]:
        png(root / "a" / "images" / f"{name}.png", np.zeros((4, 4)))
        (root / "a" / "labels" / f"{name}.txt").write_text(label)
    (root / "b.yml").write_text("names: [left wave, right wave]\n")
    (root / "z.yaml").write_text("names: [x, y]\n")
    manifest, problems = ingest.build_manifest(spark, str(root))
    got = {(r.split, r.class_id, r.class_name, r.diagnosis, r.drawing_type, r.name_number) for r in manifest.collect()}
    assert got == {("?", 7, "7", "7", "", 3), ("?", 1, "right wave", "right", "wave", -1)}
    assert problems.first().asDict() == {"augmented": 1, "without_label": 0, "unreadable_label": 1, "prefix_disagrees": 2}
    many = spark.createDataFrame([(f"names: [{', '.join(f'c{i}' for i in range(1500))}]",)], "value string")
    assert ingest.class_names(many).count() == 1500


def test_caches_reports_and_runs(spark, tmp_path):
    np.savez_compressed(tmp_path / "c.npz", X=np.arange(32, dtype=np.uint8).reshape(2, 4, 4), class_name=np.array(["a", "b"]))
    rows = ingest.read_npz(spark, str(tmp_path / "c.npz")).orderBy("item_id").collect()
    assert [r.meta["class_name"] for r in rows] == ["a", "b"] and list(rows[1].x) == list(range(16, 32))
    (tmp_path / "r1.md").write_text("## S\n| m | x |\n|---|---|\n| k | 1 |\n\n## T\n| m | y |\n|---|---|\n| k | 2 |\n")
    cells = reports.report_cells(ingest.read_reports(spark, str(tmp_path / "*.md")))
    assert {tuple(r)[:5] for r in cells.collect()} == {("r1", "S", "k", "x", 1.0), ("r1", "T", "k", "y", 2.0)}
    sinks.log_run(reports.flattened(cells), str(tmp_path / "runs"), "one")
    sinks.log_run(reports.flattened(cells), str(tmp_path / "runs"), "two", {"c": 1.0}, {"kind": "test"}, {"table": "/t"})
    runs = {r.run: r for r in spark.read.parquet(str(tmp_path / "runs")).collect()}
    assert len(runs) == 2 and spark.read.parquet(str(tmp_path / "runs")).count() == 4 and runs["two"].params == {"c": "1.0"} and runs["one"].params is None and runs["two"].artifacts == {"table": "/t"}
    sinks.write_csv(cells, str(tmp_path / "csv"))
    assert "| k |" in sinks.markdown(cells.select("subset", "value"), "t")


def test_measures_skip_unusable_rows(spark):
    rows = [(1, 2, 2, [1, 2, 3, 4]), (1, 2, 2, [1, 2, 3, 4]), (2, 2, 2, None), (3, 2, 2, [1]), (4, 4, 1, [9, 9, 9, 9])]
    df = spark.createDataFrame(rows, "item_id long, height int, width int, x array<smallint>")
    got = {r.item_id: r.mean_gray for r in images.stats_table(df).collect()}
    assert got == {1: 252.5, 4: 246.0}


def test_stream_of_duplicates(spark, tmp_path):
    spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:10:00"), (3, "b", "2024-01-01 00:20:00")], "id long, body string, at string").selectExpr("id", "body", "cast(at as timestamp) at").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, body string, at timestamp").parquet(str(tmp_path / "in"))
    q = incremental.first_of_content(stream, "body", "at").writeStream.format("memory").queryName("firsts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == 2
