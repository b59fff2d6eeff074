import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.operators import bootstrap, folds, metrics, models, ranks


def frame(spark, y, score, pred=None, g="a"):
    return spark.createDataFrame([(i, g, int(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(y, score, pred or [0] * len(y)))], "item_id long, g string, y int, score double, pred int")


def test_confusion_and_rates(spark):
    y, pred = [1] * 10 + [0] * 30, [1] * 7 + [0] * 3 + [1] * 6 + [0] * 24
    c = metrics.confusion(frame(spark, y, range(40), pred), ["g"])
    assert (c.first().tp, c.first().fn, c.first().fp, c.first().tn) == (7, 3, 6, 24)
    r = metrics.rates(c).first()
    assert (r.sensitivity, r.specificity, r.accuracy) == (pytest.approx(0.7), pytest.approx(0.8), pytest.approx(31 / 40))
    alone = metrics.rates(metrics.confusion(frame(spark, [0] * 5, [0] * 5, [1, 0, 0, 0, 0]), ["g"])).first()
    assert alone.sensitivity is None and alone.balanced_accuracy == pytest.approx(0.8)


@pytest.mark.parametrize("low,high,auc", [((1, 2, 3), (4, 5), 1.0), ((4, 5, 6), (1, 2), 0.0), ((7, 7, 7), (7, 7), 0.5), ((1, 2, 3), (2, 3), 4.0 / 6)])
def test_auc(spark, low, high, auc):
    y = [0] * len(low) + [1] * len(high)
    assert metrics.auc_roc(frame(spark, y, [*low, *high]), ["g"]).first().auc == pytest.approx(auc)


def test_pieces_do_not_change_ranks(spark, monkeypatch):
    """A group cut into many pieces by score gives what one piece gives; infinite scores and null groups are ranked too."""
    rng = np.random.default_rng(31)
    rows = [(i, None if i % 3 == 0 else "b", int(rng.random() < 0.3), float(np.round(rng.normal(), 2)), int(rng.random() < 0.5)) for i in range(400)]
    rows += [(900, "b", 1, float("inf"), 1), (901, "b", 0, float("-inf"), 0)]
    df = spark.createDataFrame(rows, "item_id long, g string, y int, score double, pred int")
    read = lambda: {r.g: (r.auc, r.ap) for r in metrics.all_metrics(df, ["g"]).collect()}
    whole = read()
    monkeypatch.setattr(ranks.pieces, "__defaults__", (7,))
    cut = read()
    assert set(whole) == {None, "b"} and all(cut[g] == pytest.approx(whole[g]) for g in whole)


def test_one_class_gives_null(spark):
    assert metrics.auc_roc(frame(spark, [1, 1], [0.1, 0.2]), ["g"]).first().auc is None
    assert metrics.average_precision(frame(spark, [0, 0], [0.1, 0.2]), ["g"]).first().ap is None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 4)), min_size=2, max_size=30))
def test_ranks_against_brute_force(spark, rows):
    y, s = [a for a, _ in rows], [b for _, b in rows]
    pos, neg = [b for a, b in rows if a], [b for a, b in rows if not a]
    df = frame(spark, y, s)
    want = None if not pos or not neg else np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])
    got = metrics.auc_roc(df, ["g"]).first().auc
    assert got == (None if want is None else pytest.approx(want))
    if pos:
        ap, tp, seen = 0.0, 0, 0
        for v in sorted(set(s), reverse=True):
            hit = sum(1 for a, b in rows if a and b == v)
            tp, seen = tp + hit, seen + sum(1 for _, b in rows if b == v)
            ap += hit / len(pos) * tp / seen
        assert metrics.average_precision(df, ["g"]).first().ap == pytest.approx(ap)


def test_blocked_folds_are_even_and_contiguous(spark):
    df = spark.createDataFrame([("a", i) for i in range(53)] + [("b", i) for i in range(41)], "s string, k long")
    for off in folds.OFFSETS:
        got = folds.blocked_folds(df, ["s"], ["k"], 5, off).toPandas().sort_values(["s", "k"])
        for _, g in got.groupby("s"):
            n = g.groupby("fold").size()
            assert len(n) == 5 and n.max() - n.min() <= 1
            assert (np.diff(g["fold"].to_numpy()) != 0).sum() <= 5
    with pytest.raises(ValueError):
        folds.blocked_folds(df, ["s"], ["k"], 1)
    with pytest.raises(ValueError):
        folds.blocked_folds(df, ["s"], ["k"], 5, 5)
    with pytest.raises(ValueError):
        folds.blocked_folds(spark.createDataFrame([(None, 1)], "s string, k long"), ["s"], ["k"])


def test_terciles_put_a_cut_into_the_upper_group(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7]], "v double")
    got = {r.v: r.tercile for r in folds.tercile_groups(df, "v").collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 2, 7: 2}


def test_grouped_folds_keep_groups_whole(spark):
    rows = [(g, int(g % 3 == 0)) for g in range(60) for _ in range(1 + g % 5)] + [(99, 1)] * 60
    df = spark.createDataFrame(rows, "g long, y int")
    got = folds.grouped_folds(df, "g", "y").toPandas()
    assert got["g"].is_unique and set(got["fold"]) == set(range(5)) and len(got) == 61


def test_grouped_folds_spread_rows_and_labels(spark):
    rng = np.random.default_rng(51)
    rows = [(g, int(rng.random() < (0.8 if g % 4 == 0 else 0.1))) for g in range(700) for _ in range(rng.integers(1, 7))]
    df = spark.createDataFrame(rows, "g long, y int")
    f = df.join(folds.grouped_folds(df, "g", "y"), "g").toPandas().groupby("fold")["y"].agg(["size", "mean"])
    assert len(f) == 5 and f["size"].max() / f["size"].min() < 1.25 and f["mean"].max() - f["mean"].min() < 0.06


def test_ranks_and_quantiles_over_many_partitions(spark):
    rng = np.random.default_rng(52)
    rows = [(None if i % 7 == 0 else f"s{i % 2}", int(k)) for i, k in enumerate(rng.permutation(500))]
    df = spark.createDataFrame(rows, "s string, k long").repartition(9)
    got = ranks.ranked(df, ["s"], ["k"]).toPandas()
    for _, g in got.groupby("s", dropna=False):
        assert (g.sort_values("k")["_rank"].to_numpy() == np.arange(len(g))).all() and (g["_n"] == len(g)).all()
    q = {r.s: r._q for r in ranks.quantiles(df, ["s"], "k", [0.05, 1 / 3, 0.5, 1.0]).collect()}
    for s, g in got.groupby("s", dropna=False):
        assert q[s if isinstance(s, str) else None] == pytest.approx(np.quantile(g["k"], [0.05, 1 / 3, 0.5, 1.0]).tolist())


def test_groups_without_a_name_are_kept(spark):
    df = spark.createDataFrame([(i, None if i < 6 else "a", float(i) if i % 3 else None) for i in range(12)], "i long, g string, v double")
    assert folds.tercile_groups(df, "v", ["g"]).count() == 12
    from palimpsest.operators import audit

    got = {r.i: r.v for r in audit.imputed(df, ["v"], ["g"]).collect()}
    assert len(got) == 12 and got[0] == 3.0 and got[6] == 9.0


def scored(spark, n=160, seed=41, shift=0.8):
    rng = np.random.default_rng(seed)
    y = (np.arange(n) % 4 == 0).astype(int)
    score = np.round(rng.normal(shift * y, 1), 2)
    return y, score, frame(spark, y, score, (score > 0.5).astype(int).tolist())


def test_bootstrap_equals_resampling_by_hand(spark):
    """Weights of every draw applied in numpy, class by class, give the same six metrics and intervals."""
    y, score, df = scored(spark)
    w = bootstrap.poisson_weights(np.arange(len(y)), 2, 60).astype(float).T
    pred = (score > 0.5).astype(int)

    def six(w):
        w = w / np.where(y == 1, w[y == 1].sum() / (y == 1).sum(), w[y == 0].sum() / (y == 0).sum())
        p, n = w[y == 1].sum(), w[y == 0].sum()
        sens, spec = w[(y == 1) & (pred == 1)].sum() / p, w[(y == 0) & (pred == 0)].sum() / n
        auc = sum(w[i] * (w[(y == 0) & (score < score[i])].sum() + w[(y == 0) & (score == score[i])].sum() / 2) for i in np.flatnonzero(y)) / p / n
        ap = sum(w[i] / p * w[(y == 1) & (score >= score[i])].sum() / max(w[score >= score[i]].sum(), 1e-300) for i in np.flatnonzero(y))
        return dict(zip(bootstrap.METRICS, ((sens * p + spec * n) / (p + n), sens, spec, (sens + spec) / 2, auc, ap)))

    point, drawn = six(np.ones(len(y))), [six(x) for x in w]
    for rows in (10_000, 20):
        for r in bootstrap.bootstrap_metrics(df, ["g"], "item_id", 60, 2, piece=rows).collect():
            v = [x[r.metric] for x in drawn]
            assert r.n_draws == 60 and (r.value, r.lo, r.hi) == pytest.approx((point[r.metric], np.percentile(v, 2.5), np.percentile(v, 97.5)))


def test_bootstrap_weights_average_to_one_and_repeats_are_averaged(spark):
    w = bootstrap.poisson_weights(np.arange(3_000), 9, 20)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and (w == bootstrap.poisson_weights(np.arange(3_000), 9, 20)).all()
    _, _, one = scored(spark)
    both = one.selectExpr("*", "0 as rep").unionByName(one.selectExpr("item_id", "g", "y", "-score as score", "1 - pred as pred", "1 as rep"))
    got = {r.metric: r.value for r in bootstrap.bootstrap_metrics(both, ["g"], "item_id", 10, 0, True, "rep").collect()}
    assert got["auc"] == pytest.approx(0.5) and got["sensitivity"] == pytest.approx(0.5) and got["accuracy"] == pytest.approx(0.5)


def test_repeats_share_the_weights_of_a_piece(spark):
    """Rows of all repeats meet where the weights of their items are made; each repeat still has its own ranks."""
    rng = np.random.default_rng(5)
    y, scores = np.tile([0, 1], 30), np.round(rng.random((3, 60)), 2)
    each = [frame(spark, y.tolist(), s.tolist(), (s > 0.5).astype(int).tolist()).withColumn("rep", F.lit(k)) for k, s in enumerate(scores)]
    table = bootstrap.bootstrap_metrics(each[0].unionByName(each[1]).unionByName(each[2]), ["g"], "item_id", 40, 0, True, "rep", piece=20)
    keys = re.search(r"FlatMapGroupsInPandas \[([^\]]*)\], counts\(", table._jdf.queryExecution().analyzed().toString()).group(1)
    assert "_piece" in keys and "_rep" not in keys
    got = {r.metric: r for r in table.collect()}
    alone = [{r.metric: r.value for r in bootstrap.bootstrap_metrics(d, ["g"], "item_id", 40, 0, True).collect()} for d in each]
    assert all(abs(got[m].value - np.mean([a[m] for a in alone])) < 1e-12 and got[m].lo <= got[m].value <= got[m].hi for m in bootstrap.METRICS)


def test_bootstrap_of_one_class_has_no_interval(spark):
    got = {r.metric: r for r in bootstrap.bootstrap_metrics(frame(spark, [1, 1, 1], [0.1, 0.2, 0.3], [1, 0, 1]), ["g"], "item_id", 10).collect()}
    assert got["auc"].value is None and got["auc"].lo is None and got["auc"].n_draws == 0 and got["sensitivity"].value == pytest.approx(2 / 3)


def test_clusters_widen_the_interval(spark):
    rng = np.random.default_rng(1)
    score, y = np.repeat(rng.normal(0, 1, 30), 8), np.repeat(np.arange(30) % 2, 8)
    df = frame(spark, y, score + 0.0).selectExpr("*", "item_id div 8 as cluster")
    row, group = (bootstrap.bootstrap_interval(df, ["g"], u, 100).first() for u in ("item_id", "cluster"))
    assert group.hi - group.lo > row.hi - row.lo


def tabular(spark, signal):
    rng = np.random.default_rng(3)
    y = np.arange(240) % 2
    x = rng.normal(0, 1, (240, 2))
    x[:, 0] += signal * y
    rows = [(int(i), int(y[i]), float(x[i, 0]), float(x[i, 1]), 1.0, i % 5, "t") for i in range(240)]
    return spark.createDataFrame(rows, "item_id long, y int, f1 double, f2 double, flat double, fold int, t string")


def test_logistic_learns_signal_only(spark):
    good, none = (metrics.auc_roc(models.logistic_oof(tabular(spark, s), ["f1", "f2", "flat"], ["t"]), ["t"]).first().auc for s in (2.0, 0.0))
    assert good > 0.85 and 0.35 < none < 0.65


def test_mllib_and_newton_agree(spark):
    df = tabular(spark, 1.0)
    f = ["f1", "f2", "flat"]
    a = models.oof(df, models.logistic(f), 5).toPandas().set_index("item_id").sort_index()
    b = models.logistic_oof(df, f, ["t"]).toPandas().set_index("item_id").sort_index()
    assert np.abs(a["score"] - b["score"]).max() < 1e-4 and (a["pred"] == b["pred"]).all()


def test_majority(spark):
    df = tabular(spark, 0)
    got = models.majority_oof(df, ["t"])
    direct = models.oof(df, models.majority, 5)
    assert got.join(direct.withColumnRenamed("score", "s2"), "item_id").where("abs(score - s2) > 1e-12").count() == 0
