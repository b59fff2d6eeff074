"""Queries of folds, metrics, intervals, models and similarity, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions.images import dihedral_orders
from palimpsest.operators import audit, bootstrap, evaluate, folds, graph, images, metrics, models, similarity
from palimpsest.operators.bootstrap import STEPS
from palimpsest.operators.ranks import join_on, ranked
from palimpsest.session import table as t
from palimpsest.session import written
from palimpsest.sources.sinks import clusters_across_types

TAU, TAU_EDGES = 0.45, 0.40


def _orders(s, d):
    return t(s, d, "orders")


def blocked_folds(s, d):
    return folds.blocked_folds(_orders(s, d), ["o_orderstatus", "o_orderpriority"], ["o_orderkey"], 5, 0.4).select("o_orderkey", "fold")


def fold_sizes(s, d):
    r = folds.repeated_folds(_orders(s, d).select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], ["o_orderkey"])
    return r.groupBy("repeat", "o_orderstatus", "fold").agg(F.count("*").alias("n"))


def terciles(s, d):
    return folds.tercile_groups(t(s, d, "events"), "value", ["event_type"]).select("event_id", F.col("tercile").cast("int").alias("tercile"))


def tercile_table(s, d):
    o = folds.tercile_groups(_orders(s, d).select("o_custkey", "o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("y")), "o_totalprice").withColumnRenamed("o_custkey", "score")
    g = o.groupBy("tercile").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("true_rate"), F.round(F.avg("score"), 6).alias("mean_score"))
    a = metrics.auc_roc(o, ["tercile"]).select("tercile", F.round("auc", 6).alias("auc"))
    return g.join(a, "tercile").withColumn("tercile", F.col("tercile").cast("int"))


def _lines(s, d):
    return t(s, d, "lineitem").select("l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") >= 25).cast("int").alias("pred"), F.col("l_discount").alias("score"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def confusion(s, d):
    return metrics.confusion(_lines(s, d), ["l_linestatus"])


def rates(s, d):
    r = metrics.rates(metrics.confusion(_lines(s, d), ["l_linestatus"]))
    return r.select("l_linestatus", *[F.round(c, 6).alias(c) for c in ("accuracy", "sensitivity", "specificity", "balanced_accuracy")])


def auc_roc(s, d):
    return metrics.auc_roc(_lines(s, d), ["l_linestatus"]).select("l_linestatus", F.round("auc", 9).alias("auc"))


def average_precision(s, d):
    return metrics.average_precision(_lines(s, d), ["l_linestatus"]).select("l_linestatus", F.round("ap", 9).alias("ap"))


def folded_auc(s, d):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    long = _lines(s, d).select("y", *names).unpivot("y", names, "feature", "score")
    return metrics.folded(metrics.auc_roc(long, ["feature"])).select("feature", F.round("auc", 9).alias("auc"), "direction", F.round("folded_auc", 9).alias("folded_auc"))


def _items(s, d):
    m = t(s, d, "yolo_full_manifest").where("diagnosis is not null and drawing_type is not null")
    return m.groupBy("item_id").agg(F.min("diagnosis").alias("diagnosis"), F.min("drawing_type").alias("drawing_type"), F.min("name_number").alias("name_number")).withColumn("y", (F.col("diagnosis") == "parkinson").cast("int"))


def majority_oof(s, d):
    f = folds.blocked_folds(_items(s, d), ["diagnosis", "drawing_type"], ["name_number", "item_id"])
    return models.majority_oof(f, ["drawing_type"]).select("item_id", "fold", F.round("score", 9).alias("score"), "pred")


def majority_metrics(s, d):
    f = folds.blocked_folds(_items(s, d), ["diagnosis", "drawing_type"], ["name_number", "item_id"])
    m = metrics.all_metrics(models.majority_oof(f, ["drawing_type"]), ["drawing_type"])
    return m.select("drawing_type", *[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "auc", "ap")])


def mean_over_repeats(s, d):
    r = folds.repeated_folds(_items(s, d), ["diagnosis", "drawing_type"], ["name_number", "item_id"])
    m = models.majority_oof(r, ["drawing_type", "repeat"])
    return m.groupBy("item_id").agg(F.round(F.avg("score"), 9).alias("score"), F.count("*").alias("n_repeats"))


def cluster_sizes(s, d):
    g = t(s, d, "yolo_full_manifest_clean").where("group_id is not null").groupBy("group_id").agg(F.count("*").alias("size"))
    return g.groupBy("size").agg(F.count("*").alias("n_clusters"))


def _emb(s, d):
    e = t(s, d, "embeddings").where("size(embedding) = 64")
    return e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"), (F.col("label") >= 5).cast("int").alias("y"), (F.col("vec_id") % 5).cast("int").alias("fold"), "label")


def _boot(s, d):
    return _emb(s, d).select("item_id", "y", F.col("v")[0].cast("double").alias("score"), (F.col("item_id") / 4).cast("long").alias("cluster"), F.lit(1).alias("one"))


def bootstrap_auc(s, d):
    return bootstrap.bootstrap_interval(_boot(s, d), ["one"], "item_id", 1000, 7).select(F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), "n_draws")


def cluster_bootstrap(s, d):
    return bootstrap.bootstrap_interval(_boot(s, d), ["one"], "cluster", 500, 7).select(F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), "n_draws")


def bootstrap_table(s, d):
    """All six metrics of two repeats of scores for even and odd vectors, with intervals over 200 draws that keep the classes' totals."""
    e = _emb(s, d).select("item_id", "y", (F.col("item_id") % 2).cast("int").alias("half"), F.posexplode(F.slice("v", 1, 2)).alias("rep", "_v"))
    e = e.select("item_id", "y", "half", "rep", F.round(F.col("_v").cast("double"), 4).alias("score")).withColumn("pred", (F.col("score") > 0).cast("int"))
    t_ = bootstrap.bootstrap_metrics(e, ["half"], "item_id", 200, 3, True, "rep")
    return t_.select("half", "metric", *[F.round(c, 8).alias(c) for c in ("value", "lo", "hi")], "n_draws")


def ahash_bits(s, d):
    return similarity.average_hash(t(s, d, "embeddings"), "vec_id", "embedding")


def hamming_pairs(s, d):
    h = similarity.average_hash(_emb(s, d).withColumn("part", F.col("label")), "item_id", "v")
    return similarity.hamming_pairs(h.join(_emb(s, d).select("item_id", "label"), "item_id"), 20, "label").select("i", "j", F.col("distance").cast("int").alias("distance"))


def dihedral_edges(s, d):
    return similarity.similar_pairs(_emb(s, d), TAU_EDGES, turns=True).select("i", "j", F.round("sim", 6).alias("sim"))


def plain_edges(s, d):
    return similarity.similar_pairs(_emb(s, d), 0.3, ["label"]).select("i", "j", F.round("sim", 6).alias("sim"))


def _twins(s, d):
    edges = similarity.similar_pairs(_emb(s, d), TAU, turns=True)
    return graph.with_singletons(_emb(s, d).select("item_id", "y", "label"), graph.components(edges), "item_id")


def twin_components(s, d):
    return _twins(s, d).select("item_id", "component")


def twin_numbers(s, d):
    m = _twins(s, d).withColumn("kind", F.col("y"))
    return clusters_across_types(m, "kind", "component").select("item_id", F.col("cluster").cast("long").alias("cluster"))


def twin_statistics(s, d):
    return graph.cluster_statistics(_twins(s, d), "y")


def edge_statistics(s, d):
    return similarity.pair_statistics(similarity.similar_pairs(_emb(s, d), TAU_EDGES, turns=True), _emb(s, d).withColumn("group", F.col("item_id") % 7))


def nearest_other_fold(s, d):
    return similarity.nearest_elsewhere(_emb(s, d), "fold").select("i", "j", F.round("sim", 6).alias("sim"))


def nearest_other_fold_turned(s, d):
    return similarity.nearest_elsewhere(_emb(s, d), "fold", turns=True).select("i", "j", F.round("sim", 6).alias("sim"))


def nearest_label_accuracy(s, d):
    y = _emb(s, d).select("item_id", "y", F.col("v")[0].cast("double").alias("x"))
    nn = similarity.nearest_elsewhere(_emb(s, d), "fold")
    j = nn.join(y.select(F.col("item_id").alias("i"), F.col("y").alias("yi"), "x"), "i").join(y.select(F.col("item_id").alias("j"), F.col("y").alias("yj")), "j")
    return folds.tercile_groups(j, "x").groupBy(F.col("tercile").cast("int").alias("tercile")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("yi") == F.col("yj")).cast("double")), 6).alias("accuracy"))


def top_similarities(s, d):
    nn = similarity.nearest_elsewhere(_emb(s, d), "fold").select("i", "j", F.round("sim", 9).alias("sim"))
    q = nn.agg(F.percentile("sim", F.lit(0.95)).alias("_q"))
    return nn.join(F.broadcast(q)).where("sim >= _q").select("i", "j", F.round("sim", 6).alias("sim"))


def best_match_ladder(s, d):
    best = similarity.best_elsewhere(_emb(s, d).withColumn("asks", F.col("item_id") % 5 == 0), "asks")
    return audit.ladder(best.select(F.round("sim", 9).alias("correlation")), steps=(0.5, 0.4, 0.3, 0.2))


def knn_scores(s, d):
    return similarity.knn_scores(_emb(s, d), "fold", "y").select("item_id", F.round("score", 6).alias("score"), (F.round("score", 6) > 0).cast("int").alias("pred"))


def knn_auc(s, d):
    k = similarity.knn_scores(_emb(s, d), "fold", "y").withColumn("score", F.round("score", 6))
    return metrics.auc_roc(k.join(_emb(s, d).select("item_id", "y", "fold"), "item_id"), ["fold"]).select("fold", F.round("auc", 9).alias("auc"))


def _strokes(s, d):
    """Stroke features with folds: features imputed over the table, as the audit does."""
    x = images.stroke_table(t(s, d, "cnn_cache_128"), ["item_id", "diagnosis", "drawing_type", "name_number"]).where("diagnosis is not null")
    f = audit.imputed(x, list(images.kernels.STROKE_FEATURES)).withColumn("y", (F.col("diagnosis") == "parkinson").cast("int"))
    return folds.blocked_folds(f, ["diagnosis", "drawing_type"], ["name_number", "item_id"])


def logistic_oof(s, d):
    return models.logistic_oof(_strokes(s, d), list(images.kernels.GEOMETRY), ["drawing_type"])


def logistic_metrics(s, d):
    return evaluate.metric_table(written(logistic_oof(s, d), "oof"), ["drawing_type"])


def shuffled_labels(s, d):
    """The control: labels exchanged among the items of a type by a seeded digest, everything else as in ``logistic_oof``; AUC near one half."""
    x = _strokes(s, d)
    digest = F.sha1(F.concat(F.lit("5|"), F.col("item_id").cast("string")).cast("binary"))
    place = ranked(x.select("item_id", "drawing_type", digest.alias("_d")), ["drawing_type"], ["_d", "item_id"]).select("item_id", "drawing_type", "_rank")
    label = ranked(x.select("item_id", "drawing_type", "y"), ["drawing_type"], ["item_id"]).select("drawing_type", "_rank", "y")
    y = join_on(place, label, ["drawing_type", "_rank"]).select("item_id", "y")
    oof = models.logistic_oof(x.drop("y").join(y, "item_id"), list(images.kernels.GEOMETRY), ["drawing_type"])
    return metrics.auc_roc(oof, ["drawing_type"])


def feature_importance(s, d):
    """For each type and stroke feature: AUC, its direction, and the coefficient of the model on all rows, the strongest first."""
    x = written(_strokes(s, d), "strokes")
    names = list(images.kernels.STROKE_FEATURES)
    long = x.select("drawing_type", "y", *names).unpivot(["drawing_type", "y"], names, "feature", "score")
    auc = metrics.folded(metrics.auc_roc(long, ["drawing_type", "feature"]))
    coef = models.full_data_coefficients(x, names, ["drawing_type"])
    return join_on(auc, coef, ["drawing_type", "feature"]).orderBy("drawing_type", F.desc("folded_auc"), "feature")


def score_file_checks(s, d):
    """Whether the out-of-fold scores of five repeats cover every item once: scores of the majority with a repeat of some rows left out."""
    it = _items(s, d).where("drawing_type = 'spiral'")
    r = folds.repeated_folds(it, ["diagnosis"], ["name_number", "item_id"])
    scores = models.majority_oof(r, ["drawing_type", "repeat"]).where("not (repeat = 2 and item_id % 10 = 0)")
    return audit.score_checks(scores.select("item_id", "repeat", "score"), it, 5).select(*[F.col(c).cast("long").alias(c) for c in ("n_items", "n_missing", "n_unknown", "n_repeated", "n_bad", "n_repeats")], "ok")


def logistic_coefficients(s, d):
    return models.full_data_coefficients(_strokes(s, d), list(images.kernels.STROKE_FEATURES), ["drawing_type"])


def grouped_folds(s, d):
    g = t(s, d, "yolo_full_manifest_clean").where("group_id is not null and diagnosis is not null").withColumn("y", (F.col("diagnosis") == "parkinson").cast("int"))
    return folds.grouped_folds(g, "group_id", "y")


def group_holdout_auc(s, d):
    """Terciles of the background as hold-out groups, 1-NN on thumbnails against the other groups."""
    cache = t(s, d, "cnn_cache_128")
    b = folds.tercile_groups(images.background_table(cache, ["item_id", "diagnosis", "drawing_type"]).where("diagnosis is not null and drawing_type is not null"), "frame_mean", ["drawing_type"])
    v = images.levels(cache, lambda x: images.kernels.block_sums(x, 8)).join(b.select("item_id", "drawing_type", F.col("tercile").alias("grp"), (F.col("diagnosis") == "parkinson").cast("int").alias("y")), "item_id")
    v = written(v, "thumbs")
    near = similarity.class_maxima(v, "grp", "y", part=["drawing_type"])
    best = lambda y: F.max(F.when(F.col("label") == y, F.col("sim")))
    score = near.groupBy("i").agg(F.round(best(1) - best(0), 8).alias("score"))
    auc = metrics.auc_roc(score.join(v.select(F.col("item_id").alias("i"), "drawing_type", F.col("grp").cast("int").alias("grp"), "y"), "i"), ["drawing_type", "grp"])
    return auc.select("drawing_type", "grp", F.round("auc", 6).alias("auc"))


_SQL_NAMES = """blocked_folds fold_sizes terciles tercile_table confusion rates auc_roc average_precision folded_auc majority_oof majority_metrics mean_over_repeats
cluster_sizes bootstrap_auc cluster_bootstrap ahash_bits hamming_pairs dihedral_edges plain_edges twin_components twin_numbers twin_statistics edge_statistics
nearest_other_fold nearest_other_fold_turned nearest_label_accuracy top_similarities best_match_ladder knn_scores knn_auc bootstrap_table score_file_checks group_holdout_auc""".split()
_ROWS_ONLY = "logistic_oof logistic_metrics logistic_coefficients grouped_folds shuffled_labels feature_importance".split()


def queries():
    return {n: globals()[n] for n in _SQL_NAMES + _ROWS_ONLY}


_FOLD = "floor((((row_number() OVER (PARTITION BY {s} ORDER BY {o})-1)*5.0::DOUBLE/count(*) OVER (PARTITION BY {s}) + {off}::DOUBLE) % 5.0::DOUBLE))::INT"
_L = "(SELECT l_linestatus, CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS y, CASE WHEN l_quantity>=25 THEN 1 ELSE 0 END AS pred, l_discount AS score, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)"
_E = "e AS (SELECT vec_id AS item_id, list_transform(embedding, lambda v: v::DOUBLE) AS v, CASE WHEN label>=5 THEN 1 ELSE 0 END AS y, (vec_id%5)::INT AS fold, label FROM embeddings)"
_ORDERS = dihedral_orders(8, 8)
_TURNS = "t AS (SELECT item_id, list_transform(p, lambda k: v[k]) AS u FROM e, (VALUES " + ",".join(f"([{','.join(str(int(i) + 1) for i in o)}])" for o in _ORDERS) + ") perms(p))"
_TURNED = f"{_E}, {_TURNS}, pr AS (SELECT a.item_id AS i, t.item_id AS j, max(list_dot_product(a.v, t.u)) AS sim FROM e a JOIN t ON a.item_id < t.item_id GROUP BY 1,2)"
_NN = f"WITH {_E}, nn AS (SELECT a.item_id AS i, b.item_id AS j, round(list_dot_product(a.v,b.v),12) AS sim, row_number() OVER (PARTITION BY a.item_id ORDER BY round(list_dot_product(a.v,b.v),12) DESC, b.item_id) AS rn FROM e a JOIN e b ON a.fold<>b.fold)"
_TWINS = f"WITH RECURSIVE {_TURNED}, x AS (SELECT i, j FROM pr WHERE sim>={TAU} UNION ALL SELECT j, i FROM pr WHERE sim>={TAU}), r AS (SELECT item_id AS node, item_id AS reach FROM e UNION SELECT r.node, x.j FROM r JOIN x ON x.i=r.reach), c AS (SELECT node AS item_id, min(reach) AS component FROM r GROUP BY 1)"


def _auc(rows: str, by: str, w: str = "1") -> str:
    """Average ties by ranks for unit weights, by cumulative weights else."""
    return f"""(SELECT {by}, sum(p*(coalesce(below,0)+n/2.0))/nullif(sum(p)*sum(n),0) AS auc FROM (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
        FROM (SELECT {by}, score, sum(CASE WHEN y=1 THEN {w} ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN y=0 THEN {w} ELSE 0 END)::DOUBLE AS n FROM {rows} WHERE score IS NOT NULL GROUP BY {by}, score)) GROUP BY {by})"""


def _ap(rows: str, by: str) -> str:
    return f"""(SELECT {by}, sum(p*tp/(tp+fp))/nullif(sum(p),0) AS ap FROM (SELECT {by}, p, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM (SELECT {by}, score, sum(y)::DOUBLE AS p, sum(1-y)::DOUBLE AS n FROM {rows} GROUP BY {by}, score)
        WINDOW w AS (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY {by})"""


_IT = "it AS (SELECT item_id, min(diagnosis) AS diagnosis, min(drawing_type) AS drawing_type, min(name_number) AS name_number, CASE WHEN min(diagnosis)='parkinson' THEN 1 ELSE 0 END AS y FROM yolo_full_manifest WHERE diagnosis IS NOT NULL AND drawing_type IS NOT NULL GROUP BY 1)"
_MAJ = f"{_IT}, f AS (SELECT *, {_FOLD.format(s='diagnosis, drawing_type', o='name_number, item_id', off=0)} AS fold FROM it), m AS (SELECT f.*, (tp-fp)/nullif(tn-fn,0) AS score FROM f JOIN (SELECT drawing_type, fold, count(*) fn, sum(y)::DOUBLE fp FROM f GROUP BY 1,2) USING(drawing_type, fold) JOIN (SELECT drawing_type, count(*) tn, sum(y)::DOUBLE tp FROM f GROUP BY 1) USING(drawing_type)), mp AS (SELECT *, CASE WHEN score>=0.5 THEN 1 ELSE 0 END AS pred FROM m)"
_RATES = "count(*) FILTER (y=1 AND pred=1)/nullif(count(*) FILTER (y=1),0)"
_SPEC = "count(*) FILTER (y=0 AND pred=0)/nullif(count(*) FILTER (y=0),0)"


_STEP = "+".join(f"CASE WHEN u>={s} THEN 1 ELSE 0 END" for s in STEPS)


def _draw(seed: int, unit: str) -> str:
    """28 bits of the digest that serves five draws."""
    return f"('0x'||substr(sha1('{seed}|'||(draw//5)||'|'||{unit}),1+8*(draw%5),7))::BIGINT"


def _boot_sql(unit: str, n_boot: int) -> str:
    rows = f"(SELECT draw, y, score, w FROM (SELECT *, ({_STEP}) AS w FROM (SELECT draw::INT AS draw, y, score, {_draw(7, unit)} AS u FROM (SELECT vec_id AS item_id, vec_id//4 AS cluster, CASE WHEN label>=5 THEN 1 ELSE 0 END AS y, embedding[1]::DOUBLE AS score FROM embeddings), (SELECT unnest(range({n_boot})) AS draw) d)) WHERE w>0)"
    return f"SELECT round(quantile_cont(auc,0.025),9) AS lo, round(quantile_cont(auc,0.975),9) AS hi, count(*) AS n_draws FROM {_auc(rows, 'draw', 'w')} WHERE auc IS NOT NULL"


def _boot_table_sql() -> str:
    """Draw -1 is the data itself; precision sees the classes scaled back to their totals."""
    return f"""WITH e AS (SELECT vec_id AS item_id, (vec_id%2)::INT AS half, CASE WHEN label>=5 THEN 1 ELSE 0 END AS y, unnest([0,1]) AS rep, unnest([embedding[1],embedding[2]]) AS v FROM embeddings),
        r AS (SELECT item_id, half, y, rep, round(v::DOUBLE,4) AS score, CASE WHEN round(v::DOUBLE,4)>0 THEN 1 ELSE 0 END AS pred FROM e),
        w AS (SELECT item_id, draw, ({_STEP})::DOUBLE AS w FROM (SELECT item_id, draw, {_draw(3, 'item_id')} AS u FROM (SELECT DISTINCT item_id FROM r), (SELECT unnest(range(200)) AS draw) d) UNION ALL SELECT DISTINCT item_id, -1, 1.0 FROM r),
        x AS (SELECT r.*, draw, w FROM r JOIN w USING(item_id)),
        c AS (SELECT half, rep, draw, sum(w*y) AS p, sum(w*(1-y)) AS n, sum(w*y*pred) AS tp, sum(w*(1-y)*(1-pred)) AS tn FROM x GROUP BY 1,2,3),
        z AS (SELECT c.*, b.p AS p0, b.n AS n0 FROM c JOIN c b ON b.half=c.half AND b.rep=c.rep AND b.draw=-1),
        g AS (SELECT half, rep, draw, score, sum(w*y) AS sp, sum(w*(1-y)) AS sn FROM x GROUP BY 1,2,3,4),
        o AS (SELECT *, coalesce(sum(sn) OVER (PARTITION BY half, rep, draw ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below, sum(sp) OVER q AS atp, sum(sn) OVER q AS afp FROM g WINDOW q AS (PARTITION BY half, rep, draw ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
        k AS (SELECT o.half, o.rep, o.draw, sum(sp*(below+sn/2)) AS u, sum(CASE WHEN sp>0 THEN sp*atp/(atp+afp*(n0/n)/(p0/p)) ELSE 0 END) AS a FROM o JOIN z USING(half, rep, draw) GROUP BY 1,2,3),
        m AS (SELECT half, rep, draw, (tp/p*p0+tn/n*n0)/(p0+n0) AS accuracy, tp/p AS sensitivity, tn/n AS specificity, (tp/p+tn/n)/2 AS balanced_accuracy, u/(p*n) AS auc, a/p AS ap FROM z JOIN k USING(half, rep, draw) WHERE p>0 AND n>0),
        d AS (SELECT half, draw, avg(accuracy) AS accuracy, avg(sensitivity) AS sensitivity, avg(specificity) AS specificity, avg(balanced_accuracy) AS balanced_accuracy, avg(auc) AS auc, avg(ap) AS ap FROM m GROUP BY 1,2),
        l AS (UNPIVOT d ON accuracy, sensitivity, specificity, balanced_accuracy, auc, ap INTO NAME metric VALUE v)
        SELECT half, metric, round(max(v) FILTER (draw=-1),8) AS value, round(quantile_cont(v,0.025) FILTER (draw>=0),8) AS lo, round(quantile_cont(v,0.975) FILTER (draw>=0),8) AS hi, count(*) FILTER (draw>=0) AS n_draws FROM l GROUP BY 1,2"""


def _holdout_sql() -> str:
    return f"""WITH b AS (SELECT item_id, any_value(height) AS h, any_value(width) AS w, any_value(x) AS x, any_value(diagnosis) AS diagnosis, any_value(drawing_type) AS drawing_type FROM cnn_cache_128 WHERE len(x)=height*width GROUP BY 1),
        px AS (SELECT item_id, h, w, unnest(range(h*w)) AS i, unnest(x) AS v FROM b), f AS (SELECT item_id, avg(v) FILTER (i//w<3 OR i//w>=h-3 OR i%w<3 OR i%w>=w-3) AS frame FROM px GROUP BY 1),
        a AS (SELECT b.item_id, drawing_type, frame, CASE WHEN diagnosis='parkinson' THEN 1 ELSE 0 END AS y FROM b JOIN f USING(item_id) WHERE diagnosis IS NOT NULL AND drawing_type IS NOT NULL),
        q AS (SELECT drawing_type, quantile_cont(frame,1/3.0::DOUBLE) q1, quantile_cont(frame,2/3.0::DOUBLE) q2 FROM a GROUP BY 1),
        g AS (SELECT a.*, CASE WHEN frame>=q2 THEN 2 WHEN frame>=q1 THEN 1 ELSE 0 END::INT AS grp FROM a JOIN q USING(drawing_type)),
        t AS (SELECT item_id, list_transform(range(64), lambda j: list_avg(list_transform(range(16), lambda k: x[((j//8)*4+k//4)*w+(j%8)*4+k%4+1]))) AS v FROM b),
        c AS (SELECT item_id, list_transform(v, lambda e: e-list_avg(v)) AS v FROM t), u AS (SELECT item_id, list_transform(v, lambda e: e/greatest(sqrt(list_dot_product(v,v)),1e-8)) AS v FROM c),
        n AS (SELECT g.*, u.v FROM g JOIN u USING(item_id)),
        s AS (SELECT a.item_id, any_value(a.drawing_type) AS drawing_type, any_value(a.grp) AS grp, any_value(a.y) AS y, round(max(list_dot_product(a.v,b.v)) FILTER (b.y=1)-max(list_dot_product(a.v,b.v)) FILTER (b.y=0),8) AS score FROM n a JOIN n b ON a.drawing_type=b.drawing_type AND a.grp<>b.grp GROUP BY 1)
        SELECT drawing_type, grp, round(auc,6) AS auc FROM {_auc('s', 'drawing_type, grp')}"""


def oracle_sql():
    orders = "(SELECT o_custkey::DOUBLE AS score, o_totalprice, CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END AS y, CASE WHEN o_totalprice>=q2 THEN 2 WHEN o_totalprice>=q1 THEN 1 ELSE 0 END AS tercile FROM orders, (SELECT quantile_cont(o_totalprice,1/3.0::DOUBLE) q1, quantile_cont(o_totalprice,2/3.0::DOUBLE) q2 FROM orders))"
    feats = f"(SELECT y, feature, score FROM (UNPIVOT (SELECT y, l_quantity, l_extendedprice, l_discount, l_tax FROM {_L}) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE score))"
    knn = f"{_E}, k AS (SELECT a.item_id, any_value(a.y) AS y, any_value(a.fold) AS fold, round(max(CASE WHEN b.y=1 THEN list_dot_product(a.v,b.v) END)-max(CASE WHEN b.y=0 THEN list_dot_product(a.v,b.v) END),6) AS score FROM e a JOIN e b ON a.fold<>b.fold GROUP BY 1)"
    return {
        "blocked_folds": f"SELECT o_orderkey, {_FOLD.format(s='o_orderstatus, o_orderpriority', o='o_orderkey', off=0.4)} AS fold FROM orders",
        "fold_sizes": " UNION ALL ".join(f"SELECT {i}::INT AS repeat, o_orderstatus, fold, count(*) AS n FROM (SELECT o_orderstatus, {_FOLD.format(s='o_orderstatus', o='o_orderkey', off=o)} AS fold FROM orders) GROUP BY 1,2,3" for i, o in enumerate(folds.OFFSETS)),
        "terciles": "SELECT event_id, CASE WHEN value>=q2 THEN 2 WHEN value>=q1 THEN 1 WHEN value IS NOT NULL THEN 0 END::INT AS tercile FROM events JOIN (SELECT event_type, quantile_cont(value,1/3.0::DOUBLE) q1, quantile_cont(value,2/3.0::DOUBLE) q2 FROM events GROUP BY 1) USING(event_type)",
        "tercile_table": f"SELECT tercile::INT AS tercile, lo, hi, n, true_rate, mean_score, round(auc,6) AS auc FROM (SELECT tercile, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n, round(avg(y),6) AS true_rate, round(avg(score),6) AS mean_score FROM {orders} GROUP BY 1) JOIN {_auc(orders, 'tercile')} USING(tercile)",
        "confusion": f"SELECT l_linestatus, count(*) FILTER (y=0 AND pred=0) AS tn, count(*) FILTER (y=0 AND pred=1) AS fp, count(*) FILTER (y=1 AND pred=0) AS fn, count(*) FILTER (y=1 AND pred=1) AS tp FROM {_L} GROUP BY 1",
        "rates": f"SELECT l_linestatus, round(count(*) FILTER (y=pred)/count(*),6) AS accuracy, round({_RATES},6) AS sensitivity, round({_SPEC},6) AS specificity, round(({_RATES}+{_SPEC})/2,6) AS balanced_accuracy FROM {_L} GROUP BY 1",
        "auc_roc": f"SELECT l_linestatus, round(auc,9) AS auc FROM {_auc(_L, 'l_linestatus')}",
        "average_precision": f"SELECT l_linestatus, round(ap,9) AS ap FROM {_ap(_L, 'l_linestatus')}",
        "folded_auc": f"SELECT feature, round(auc,9) AS auc, CASE WHEN auc>=0.5 THEN 'higher' ELSE 'lower' END AS direction, round(greatest(auc,1-auc),9) AS folded_auc FROM {_auc(feats, 'feature')}",
        "majority_oof": f"WITH {_MAJ} SELECT item_id, fold, round(score,9) AS score, pred FROM mp",
        "majority_metrics": f"WITH {_MAJ} SELECT drawing_type, accuracy, balanced_accuracy, round(auc,6) AS auc, round(ap,6) AS ap FROM (SELECT drawing_type, round(count(*) FILTER (y=pred)/count(*),6) AS accuracy, round(({_RATES}+{_SPEC})/2,6) AS balanced_accuracy FROM mp GROUP BY 1) JOIN {_auc('mp', 'drawing_type')} USING(drawing_type) JOIN {_ap('mp', 'drawing_type')} USING(drawing_type)",
        "mean_over_repeats": f"WITH {_IT}, f AS ({' UNION ALL '.join(f'SELECT *, {i} AS rep, ' + _FOLD.format(s='diagnosis, drawing_type', o='name_number, item_id', off=o) + ' AS fold FROM it' for i, o in enumerate(folds.OFFSETS))}), m AS (SELECT item_id, (tp-fp)/nullif(tn-fn,0) AS score FROM f JOIN (SELECT rep, drawing_type, fold, count(*) fn, sum(y)::DOUBLE fp FROM f GROUP BY 1,2,3) USING(rep, drawing_type, fold) JOIN (SELECT rep, drawing_type, count(*) tn, sum(y)::DOUBLE tp FROM f GROUP BY 1,2) USING(rep, drawing_type)) SELECT item_id, round(avg(score),9) AS score, count(*) AS n_repeats FROM m GROUP BY 1",
        "cluster_sizes": "SELECT size, count(*) AS n_clusters FROM (SELECT group_id, count(*) AS size FROM yolo_full_manifest_clean WHERE group_id IS NOT NULL GROUP BY 1) GROUP BY 1",
        "bootstrap_auc": _boot_sql("item_id", 1000),
        "cluster_bootstrap": _boot_sql("cluster", 500),
        "bootstrap_table": _boot_table_sql(),
        "group_holdout_auc": _holdout_sql(),
        "score_file_checks": "WITH i AS (SELECT item_id FROM yolo_full_manifest WHERE diagnosis IS NOT NULL AND drawing_type IS NOT NULL GROUP BY 1 HAVING min(drawing_type)='spiral') SELECT count(*) AS n_items, count(*) FILTER (item_id%10=0) AS n_missing, 0::BIGINT AS n_unknown, 0::BIGINT AS n_repeated, 0::BIGINT AS n_bad, 5::BIGINT AS n_repeats, count(*) FILTER (item_id%10=0)=0 AS ok FROM i",
        "ahash_bits": "SELECT vec_id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x::DOUBLE > list_sum(list_transform(embedding, lambda q: q::DOUBLE))/len(embedding) THEN '1' ELSE '0' END),'string_agg','') AS bits FROM embeddings",
        "hamming_pairs": "WITH h AS (SELECT vec_id, label, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x::DOUBLE > list_sum(list_transform(embedding, lambda q: q::DOUBLE))/len(embedding) THEN '1' ELSE '0' END),'string_agg','') AS bits FROM embeddings) SELECT a.vec_id AS i, b.vec_id AS j, hamming(a.bits,b.bits)::INT AS distance FROM h a JOIN h b ON a.label=b.label AND a.vec_id<b.vec_id WHERE hamming(a.bits,b.bits)<=20",
        "dihedral_edges": f"WITH {_TURNED} SELECT i, j, round(sim,6) AS sim FROM pr WHERE sim>={TAU_EDGES}",
        "plain_edges": f"WITH {_E} SELECT a.item_id AS i, b.item_id AS j, round(list_dot_product(a.v,b.v),6) AS sim FROM e a JOIN e b ON a.label=b.label AND a.item_id<b.item_id WHERE list_dot_product(a.v,b.v)>=0.3",
        "twin_components": f"{_TWINS} SELECT item_id, component FROM c",
        "twin_numbers": f"{_TWINS} SELECT item_id, dense_rank() OVER (ORDER BY y, component)-1 AS cluster FROM c JOIN e USING(item_id)",
        "twin_statistics": f"{_TWINS}, g AS (SELECT component, count(*) n, count(DISTINCT y) k FROM c JOIN e USING(item_id) GROUP BY 1) SELECT round(100.0*sum(CASE WHEN n>1 THEN n ELSE 0 END)/sum(n),4) AS pct_in_cluster, count(*) FILTER (n>1) AS n_clusters, max(n) AS largest, round(100.0*count(*) FILTER (n>1 AND k=1)/nullif(count(*) FILTER (n>1),0),4) AS pct_pure FROM g",
        "edge_statistics": f"WITH {_TURNED} SELECT count(*) AS n, round(100*avg(CASE WHEN a.y=b.y THEN 1.0 ELSE 0 END),4) AS pct_same_label, round(100*avg(CASE WHEN a.fold<>b.fold THEN 1.0 ELSE 0 END),4) AS pct_diff_fold, round(100*avg(CASE WHEN a.item_id%7<>b.item_id%7 THEN 1.0 ELSE 0 END),4) AS pct_diff_group FROM pr JOIN e a ON a.item_id=i JOIN e b ON b.item_id=j WHERE sim>={TAU_EDGES}",
        "nearest_other_fold": f"{_NN} SELECT i, j, round(sim,6) AS sim FROM nn WHERE rn=1",
        "nearest_other_fold_turned": f"WITH {_E}, {_TURNS}, pr AS (SELECT a.item_id AS i, t.item_id AS j, round(max(list_dot_product(a.v,t.u)),12) AS sim FROM e a JOIN t ON a.item_id%5 <> t.item_id%5 GROUP BY 1,2) SELECT i, arg_max(j, (sim, -j)) AS j, round(max(sim),6) AS sim FROM pr GROUP BY 1",
        "nearest_label_accuracy": f"{_NN}, x AS (SELECT a.v[1] AS x, a.y=b.y AS ok FROM nn JOIN e a ON a.item_id=i JOIN e b ON b.item_id=j WHERE rn=1), q AS (SELECT quantile_cont(x,1/3.0::DOUBLE) q1, quantile_cont(x,2/3.0::DOUBLE) q2 FROM x) SELECT CASE WHEN x>=q2 THEN 2 WHEN x>=q1 THEN 1 ELSE 0 END::INT AS tercile, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0 END),6) AS accuracy FROM x, q GROUP BY 1",
        "top_similarities": f"{_NN}, x AS (SELECT i, j, round(sim,9) AS sim FROM nn WHERE rn=1) SELECT i, j, round(sim,6) AS sim FROM x WHERE sim>=(SELECT quantile_cont(sim,0.95) FROM x)",
        "best_match_ladder": f"WITH {_E}, m AS (SELECT a.item_id, round(max(list_dot_product(a.v,b.v)),9) AS s FROM e a JOIN e b ON a.fold=0 AND b.fold<>0 GROUP BY 1) SELECT t.threshold, count(*) FILTER (s>=t.threshold) AS n_pairs FROM m, (VALUES (0.5::DOUBLE),(0.4::DOUBLE),(0.3::DOUBLE),(0.2::DOUBLE)) t(threshold) GROUP BY 1",
        "knn_scores": f"WITH {knn} SELECT item_id, score, CASE WHEN score>0 THEN 1 ELSE 0 END AS pred FROM k",
        "knn_auc": f"WITH {knn} SELECT fold, round(auc,9) AS auc FROM {_auc('k', 'fold')}",
    }
