"""The audits as whole reports: each is a composition of operators and gives one table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from palimpsest.functions import kernels
from palimpsest.functions.images import dihedral_orders
from palimpsest.functions.text import known_split
from palimpsest.operators import audit, duplicates, evaluate, folds, graph, images, metrics, models, similarity
from palimpsest.operators.ranks import quantiles
from palimpsest.plans.pixels import _HALF
from palimpsest.session import table as t
from palimpsest.session import written

TWIN_STEPS = (0.80, 0.90, 0.95)


def _cache(s, d):
    return t(s, d, "cnn_cache_128").where("diagnosis is not null and drawing_type is not null")


def _thumbs(s, d, name="binary", size=16):
    """Thumbnails of the (binarised) drawings, packed: what copies are looked for in."""
    # sums of the lit pixels: the same after scaling, and small numbers
    v = images.levels(_cache(s, d), lambda x: kernels.block_sums(kernels.ablated(x.clip(0, 255).astype("uint8"), name) // np.uint8(255 if name.startswith("binary") else 1), size), ["drawing_type", "name_number", "diagnosis"])
    return v.select("item_id", "v", "drawing_type", "name_number", (F.col("diagnosis") == "parkinson").cast("int").alias("y"))


def twin_audit(s, d):
    """For each drawing type and threshold: share of drawings in a copy cluster, clusters, the largest, label-pure share, pairs."""
    nodes = written(_thumbs(s, d), "thumbs")
    edges, counts = similarity.counted_links(nodes, list(TWIN_STEPS), ["drawing_type"], turns=True)
    counts = written(counts.join(nodes.select(F.col("item_id").alias("i"), "drawing_type"), "i").groupBy("drawing_type", "step").agg(F.sum("n").alias("n_pairs")), "counts")
    out = None
    for tau in TWIN_STEPS:
        e = edges.where(F.col("sim") >= tau)
        m = graph.with_singletons(nodes.select("item_id", "drawing_type", "y"), graph.components(e), "item_id")
        n = counts.where(F.col("step") == tau).select("drawing_type", "n_pairs")
        g = m.groupBy("drawing_type", "component").agg(F.count("*").alias("n"), F.countDistinct("y").alias("k"))
        multi = F.col("n") > 1
        row = g.groupBy("drawing_type").agg(
            F.round(100 * F.sum(F.when(multi, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("pct_in_cluster"),
            F.count_if(multi).alias("n_clusters"),
            F.max("n").alias("largest"),
            F.round(100 * F.try_divide(F.count_if(multi & (F.col("k") == 1)), F.count_if(multi)), 4).alias("pct_pure"),
        )
        row = row.join(n, "drawing_type", "left").select(F.lit(tau).alias("tau"), "*").fillna(0, ["n_pairs"])
        out = row if out is None else out.unionByName(row)
    return out


def _features(s, d):
    cache = _cache(s, d)
    x = images.stroke_table(cache, ["item_id", "diagnosis", "drawing_type", "name_number"]).join(images.background_table(cache), "item_id")
    names = [*kernels.STROKE_FEATURES, "frame_mean", "speckle"]
    return audit.imputed(x, names).withColumn("y", (F.col("diagnosis") == "parkinson").cast("int"))


def copy_grouped_validation(s, d):
    """All metrics of each feature set with copy clusters kept whole in the folds, with intervals that draw whole clusters."""
    nodes = written(_thumbs(s, d), "thumbs")
    comps = graph.components(similarity.counted_links(nodes, [0.90], ["drawing_type"], turns=True)[0])
    clusters = written(graph.with_singletons(nodes.select("item_id", "y"), comps, "item_id"), "clusters")
    f = folds.grouped_folds(clusters, "component", "y")
    x = written(_features(s, d).join(clusters.select("item_id", "component"), "item_id").join(f, "component"), "features")
    oof = written(models.logistic_oof(x, evaluate.FEATURE_SETS, ["drawing_type"]), "oof").join(x.select("item_id", "component"), "item_id")
    return evaluate.metric_table(oof, ["model", "drawing_type"], "component", 500)


BASELINES = {
    "brightness and ink": ["mean_gray", "median_gray", "p5_gray", "stats_ink"],
    "stroke geometry": list(kernels.GEOMETRY),
    "geometry, contrast and noise": list(kernels.STROKE_FEATURES),
    "contrast and noise": list(kernels.CONTRAST_NOISE),
}


def baseline_tables(s, d):
    """Logistic baselines on measures of the image and of the strokes, for each type and both pooled: blocked 5-fold validation in five
    repeats, all metrics with intervals. The models of all subsets, repeats and folds of a feature set are fitted together."""
    stats = images.stats_table(_cache(s, d)).withColumnRenamed("ink_frac", "stats_ink")
    names = list(dict.fromkeys(f for c in BASELINES.values() for f in c))
    x = audit.imputed(_features(s, d).join(stats, "item_id"), names).withColumn("is_wave", (F.col("drawing_type") == "wave").cast("double"))
    x = x.withColumn("subset", F.explode(F.array("drawing_type", F.lit("pooled"))))
    x = written(folds.repeated_folds(x, ["subset", "diagnosis", "drawing_type"], ["name_number", "item_id"]), "repeats")
    oof = models.logistic_oof(x, {name: [*columns, "is_wave"] for name, columns in BASELINES.items()}, ["subset", "repeat"])
    return evaluate.metric_table(written(oof, "oof"), ["model", "subset"], "item_id", 500, repeat="repeat")


def background_hold_out(s, d):
    """Terciles of the background as hold-out groups: in-group AUC of each feature set, fitted on the other two."""
    x = folds.tercile_groups(_features(s, d), "frame_mean", ["drawing_type"], out="fold").withColumn("fold", F.col("fold").cast("int"))
    x = written(x, "features")
    return metrics.auc_roc(models.logistic_oof(x, evaluate.FEATURE_SETS, ["drawing_type"]), ["model", "drawing_type", "fold"])


def neighbour_audit(s, d):
    """For each tercile of the nearest neighbour's similarity: rows, the similarity's quantiles, how often the label is the same."""
    nodes = written(folds.blocked_folds(_thumbs(s, d), ["drawing_type"], ["name_number", "item_id"]), "thumbs")
    nn = similarity.nearest_elsewhere(nodes, "fold", ["drawing_type"])
    y = nodes.select("item_id", "drawing_type", "y")
    j = nn.join(y.select(F.col("item_id").alias("i"), "drawing_type", F.col("y").alias("yi")), "i").join(y.select(F.col("item_id").alias("j"), F.col("y").alias("yj")), "j")
    q = F.percentile("sim", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    g = folds.tercile_groups(j, "sim", ["drawing_type"]).groupBy("drawing_type", F.col("tercile").cast("int").alias("tercile"))
    g = g.agg(F.count("*").alias("n"), q.alias("q"), F.avg((F.col("yi") == F.col("yj")).cast("double")).alias("same_label"))
    return g.select("drawing_type", "tercile", "n", *[F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(["p10", "p50", "p90"])], F.round("same_label", 6).alias("same_label"))


def background_correlation(s, d):
    """How the out-of-fold scores of the stroke model go with the background, and with the label, for each type."""
    x = written(folds.blocked_folds(_features(s, d), ["diagnosis", "drawing_type"], ["name_number", "item_id"]), "features")
    oof = models.logistic_oof(x, list(kernels.GEOMETRY), ["drawing_type"]).join(x.select("item_id", "frame_mean", "speckle"), "item_id")
    return oof.groupBy("drawing_type").agg(*[F.round(F.corr("score", c), 6).alias(f"corr_{c}") for c in ("frame_mean", "speckle", "y")])


def _listed(s, d):
    """One row for each listed item with a type: least path, split, diagnosis, class name and number."""
    m = t(s, d, "yolo_full_manifest").where("item_id is not null and drawing_type is not null and path is not null")
    split = F.coalesce(known_split(F.col("split")), F.lit("?"))
    least = [F.min(c).alias(n) for c, n in ((F.col("path"), "path"), (split, "split"), (F.col("diagnosis"), "diagnosis"), (F.col("class_name"), "class_name"), (F.col("drawing_type"), "drawing_type"), (F.col("name_number"), "name_number"))]
    return m.groupBy("item_id").agg(*least)


def _signatures(cache, once=True):
    """Packed signatures of 16 x 16 (the cached drawings are smaller than the 48 x 48 of full images)."""
    return images.levels(cache, lambda x: kernels.darkness(images.ink_to_gray(x), 16), once=once)


def _built(s, d):
    """Digests of the drawings, and the clean manifest. Signatures are made where the drawings lie and go through one shuffle."""
    rows, drawings = written(_listed(s, d), "listed"), images.complete(t(s, d, "cnn_cache_128")).select("item_id", "height", "width", "x")
    digests = duplicates.kind_digests(rows, drawings)
    return digests, duplicates.grouped_manifest(rows, drawings, lambda some: _signatures(some, once=False), digests=digests)


def built_manifest(s, d):
    """The clean manifest from scratch: exact and near links of the drawings, verified by pixels, their components, and the rules for groups."""
    return _built(s, d)[1]


def built_links(s, d):
    return duplicates.link_counts(*_built(s, d))


def _matches(s, d):
    rows = written(_listed(s, d), "listed")
    # joined where the signatures lie after their repeats are set aside: they go through one shuffle for both
    nodes = _signatures(t(s, d, "cnn_cache_128")).join(rows.where("split in ('val', 'train')").select("item_id", "split", "drawing_type"), "item_id")
    return rows, written(nodes, "nodes")


def split_matches(s, d):
    """The best training match of every validation drawing of its type, those of 0.98 or more, the 1,000 best first."""
    rows, nodes = _matches(s, d)
    best = duplicates.split_matches(nodes, "drawing_type", least=0.98)
    own = lambda k, n: rows.select(F.col("item_id").alias(k), F.col("path").alias(f"{n}_path"), F.col("class_name").alias(f"{n}_label"))
    top = best.join(own("i", "val"), "i").join(own("j", "train"), "j").orderBy(F.desc("sim"), "i", "j").limit(1000)
    return top.select(F.round("sim", 4).alias("correlation"), "val_path", "train_path", "val_label", "train_label")


def split_match_ladder(s, d):
    """For each type: validation drawings, how many have a training match at each step, the median of the best, and near pairs inside training."""
    rows, nodes = _matches(s, d)
    best, inside = duplicates.matches_and_pairs(nodes, "drawing_type", 0.99)
    best = best.join(rows.select(F.col("item_id").alias("i"), "drawing_type"), "i")
    steps = [F.count_if(F.col("sim") >= x).alias(f"at_{str(x)[2:]}") for x in audit.LADDER]
    table = best.groupBy("drawing_type").agg(F.count("*").alias("n_val"), *steps)
    median = quantiles(best, ["drawing_type"], "sim", [0.5]).select("drawing_type", F.round(F.col("_q")[0], 6).alias("median_best"))
    inside = inside.join(rows.select(F.col("item_id").alias("i"), "drawing_type"), "i").groupBy("drawing_type").agg(F.sum("n").alias("n_in_train"))
    out = table.join(median, "drawing_type").join(inside, "drawing_type", "left")
    return out.withColumn("n_in_train", F.coalesce("n_in_train", F.lit(0)))


def cross_split_drawings(s, d):
    """Training and test drawings of one type with equal content, else with equal average hashes."""
    drawings = images.whole(t(s, d, "cnn_cache_128"))
    bits = lambda x: np.unpackbits(kernels.average_hashes(images.ink_to_gray(x)).astype(">i8").view(np.uint8).reshape(len(x), 8), axis=1).astype(np.int16)
    h = images.transformed(drawings, bits).select("item_id", F.array_join(F.col("x").cast("array<string>"), "").alias("bits"))
    items = drawings.select("item_id", duplicates.content_digest().alias("digest")).join(h, "item_id").join(_listed(s, d).select("item_id", "split", "drawing_type"), "item_id")
    return duplicates.cross_split_duplicates(written(items, "hashed"), "drawing_type", "digest", "bits")


_NAMES = "baseline_tables built_manifest built_links split_matches split_match_ladder cross_split_drawings twin_audit copy_grouped_validation background_hold_out neighbour_audit background_correlation".split()


def queries():
    return {n: globals()[n] for n in _NAMES}


_PART = "CASE WHEN lower(trim(split)) IN ('train','training') THEN 'train' WHEN lower(trim(split)) IN ('val','valid','validation') THEN 'val' WHEN lower(trim(split)) IN ('test','testing') THEN 'test' END"
_L = f"""l AS (SELECT item_id, min(path) AS path, min(coalesce({_PART},'?')) AS split, min(diagnosis) AS diagnosis, min(class_name) AS class_name, min(drawing_type) AS drawing_type, min(name_number) AS name_number
    FROM yolo_full_manifest WHERE item_id IS NOT NULL AND drawing_type IS NOT NULL AND path IS NOT NULL GROUP BY 1)"""
_S = f"""b0 AS (SELECT item_id, any_value(width) AS w, any_value(x) AS x FROM cnn_cache_128 WHERE len(x)=height*width GROUP BY 1),
    b AS (SELECT item_id, w, x, list_transform(x, lambda e: 255-e) AS g FROM b0), s AS (SELECT item_id, list_transform({_HALF.format(v='g')}, lambda e: 255-e) AS v FROM b),
    c AS (SELECT item_id, list_transform(v, lambda e: e-list_avg(v)) AS v FROM s), u AS (SELECT item_id, list_transform(v, lambda e: e/CASE WHEN sqrt(list_dot_product(v,v))>1e-6 THEN sqrt(list_dot_product(v,v)) ELSE 1 END) AS v FROM c),
    n AS (SELECT l.*, b.x, u.v FROM l JOIN b USING(item_id) JOIN u USING(item_id))"""
_EDGES = """p AS (SELECT a.item_id AS i, b.item_id AS j, a.x AS xa, b.x AS xb FROM n a JOIN n b ON a.drawing_type=b.drawing_type AND a.item_id<b.item_id WHERE list_dot_product(a.v,b.v)>=0.99),
    d AS (SELECT i, j, list_transform(range(len(xa)), lambda k: abs(xa[k+1]-xb[k+1])) AS d FROM p WHERE len(xa)=len(xb)),
    e0 AS (SELECT i, j FROM d WHERE list_avg(d)<=3 AND len(list_filter(d, lambda k: k>40))/len(d)<=0.01 UNION SELECT a.item_id, b.item_id FROM n a JOIN n b ON a.drawing_type=b.drawing_type AND a.item_id<b.item_id AND a.x=b.x),
    e AS (SELECT i, j FROM e0 UNION SELECT j, i FROM e0), r AS (SELECT item_id AS node, item_id AS reach FROM n UNION SELECT r.node, e.j FROM r JOIN e ON e.i=r.reach),
    m AS (SELECT node AS item_id, min(reach) AS group_id FROM r GROUP BY 1), k AS (SELECT n.*, m.group_id FROM n JOIN m USING(item_id))"""
_BEST = "q AS (SELECT a.item_id AS i, b.item_id AS j, a.drawing_type, round(list_dot_product(a.v,b.v),12) AS sim, row_number() OVER (PARTITION BY a.item_id ORDER BY round(list_dot_product(a.v,b.v),12) DESC, b.item_id) AS rn FROM n a JOIN n b ON a.drawing_type=b.drawing_type AND a.split='val' AND b.split='train')"

_T = """b0 AS (SELECT item_id, any_value(height) AS h, any_value(width) AS w, any_value(x) AS x, any_value(drawing_type) AS drawing_type, any_value(name_number) AS name_number, any_value(CASE WHEN diagnosis='parkinson' THEN 1 ELSE 0 END) AS y
      FROM cnn_cache_128 WHERE len(x)=height*width AND diagnosis IS NOT NULL AND drawing_type IS NOT NULL GROUP BY 1),
    b1 AS (SELECT *, list_transform(x, lambda e: CASE WHEN e > greatest(0.35::DOUBLE*list_max(x), 32) THEN 255 ELSE 0 END) AS k FROM b0),
    b2 AS (SELECT *, list_transform(range(256), lambda j: (k[(j//16)*2*w+(j%16)*2+1]+k[(j//16)*2*w+(j%16)*2+2]+k[((j//16)*2+1)*w+(j%16)*2+1]+k[((j//16)*2+1)*w+(j%16)*2+2])/4.0::DOUBLE) AS m FROM b1),
    b3 AS (SELECT *, list_transform(m, lambda e: e-list_avg(m)) AS c FROM b2),
    n AS (SELECT item_id, drawing_type, name_number, y, list_transform(c, lambda e: e/greatest(sqrt(list_dot_product(c,c)),1e-8)) AS v FROM b3)"""


def _twin_sql() -> str:
    turns = ",".join(f"([{','.join(str(int(i) + 1) for i in o)}])" for o in dihedral_orders(16, 16))
    taus = ",".join(f"({x}::DOUBLE)" for x in TWIN_STEPS)
    return f"""WITH RECURSIVE {_T}, t AS (SELECT item_id, drawing_type, list_transform(p, lambda k: v[k]) AS u FROM n, (VALUES {turns}) perms(p)),
        pr AS (SELECT a.drawing_type, a.item_id AS i, t.item_id AS j, max(list_dot_product(a.v,t.u)) AS sim FROM n a JOIN t ON a.drawing_type=t.drawing_type AND a.item_id<t.item_id GROUP BY 1,2,3),
        e AS (SELECT tau, drawing_type, i, j FROM pr, (VALUES {taus}) s(tau) WHERE sim>=tau), x AS (SELECT tau, i, j FROM e UNION ALL SELECT tau, j, i FROM e),
        r AS (SELECT tau, item_id AS node, item_id AS reach FROM n, (VALUES {taus}) s(tau) UNION SELECT r.tau, r.node, x.j FROM r JOIN x ON x.tau=r.tau AND x.i=r.reach),
        c AS (SELECT tau, node, min(reach) AS comp FROM r GROUP BY 1,2), g AS (SELECT tau, drawing_type, comp, count(*) AS k, count(DISTINCT y) AS d FROM c JOIN n ON n.item_id=c.node GROUP BY 1,2,3),
        q AS (SELECT tau, drawing_type, count(*) AS n_pairs FROM e GROUP BY 1,2)
        SELECT g.tau, g.drawing_type, round(100.0*sum(CASE WHEN k>1 THEN k ELSE 0 END)/sum(k),4) AS pct_in_cluster, count(*) FILTER (k>1) AS n_clusters, max(k) AS largest, round(100.0*count(*) FILTER (k>1 AND d=1)/nullif(count(*) FILTER (k>1),0),4) AS pct_pure, coalesce(any_value(n_pairs),0) AS n_pairs
        FROM g LEFT JOIN q USING(tau, drawing_type) GROUP BY 1,2"""


def _neighbour_sql() -> str:
    return f"""WITH {_T}, f AS (SELECT *, floor((((row_number() OVER (PARTITION BY drawing_type ORDER BY name_number, item_id)-1)*5.0::DOUBLE/count(*) OVER (PARTITION BY drawing_type)) % 5.0::DOUBLE))::INT AS fold FROM n),
        nn AS (SELECT a.item_id AS i, a.drawing_type, a.y=b.y AS same, round(list_dot_product(a.v,b.v),12) AS sim, row_number() OVER (PARTITION BY a.item_id ORDER BY round(list_dot_product(a.v,b.v),12) DESC, b.item_id) AS rn FROM f a JOIN f b ON a.drawing_type=b.drawing_type AND a.fold<>b.fold),
        x AS (SELECT * FROM nn WHERE rn=1), q AS (SELECT drawing_type, quantile_cont(sim,1/3.0::DOUBLE) q1, quantile_cont(sim,2/3.0::DOUBLE) q2 FROM x GROUP BY 1)
        SELECT drawing_type, CASE WHEN sim>=q2 THEN 2 WHEN sim>=q1 THEN 1 ELSE 0 END::INT AS tercile, count(*) AS n, round(quantile_cont(sim,0.1),6) AS p10, round(quantile_cont(sim,0.5),6) AS p50, round(quantile_cont(sim,0.9),6) AS p90, round(avg(CASE WHEN same THEN 1.0 ELSE 0 END),6) AS same_label
        FROM x JOIN q USING(drawing_type) GROUP BY 1,2"""


def oracle_sql():
    from palimpsest.plans import pixels

    hashes = pixels.oracle_sql()["drawing_hashes"]
    return {
        "twin_audit": _twin_sql(),
        "neighbour_audit": _neighbour_sql(),
        "built_manifest": f"""WITH RECURSIVE {_L}, {_S}, {_EDGES}, g AS (SELECT group_id, count(*)::INT AS sz, count(DISTINCT diagnosis)>1 AS cf, max(CASE WHEN split='train' THEN 1 ELSE 0 END) AS tr, min(split) AS least FROM k GROUP BY 1),
            o AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY name_number, item_id, path) AS rn FROM k)
            SELECT item_id, path, o.group_id, sz AS group_size, cf AS group_conflict, CASE WHEN rn=1 THEN 'rep' ELSE 'dup' END AS role, CASE WHEN cf THEN 'drop' WHEN rn>1 THEN 'dup' WHEN tr=1 THEN 'train' ELSE least END AS split_clean FROM o JOIN g USING(group_id)""",
        "built_links": f"WITH RECURSIVE {_L}, {_S}, {_EDGES}, x AS (SELECT sum(c-1)::BIGINT AS ex FROM (SELECT count(*) AS c FROM n GROUP BY drawing_type, x)) SELECT count(*) AS n_files, count(DISTINCT group_id) AS n_groups, any_value(ex) AS exact_links, count(*)-count(DISTINCT group_id)-any_value(ex) AS near_links FROM k, x",
        "split_matches": f"WITH {_L}, {_S}, {_BEST} SELECT round(sim,4) AS correlation, a.path AS val_path, c.path AS train_path, a.class_name AS val_label, c.class_name AS train_label FROM q JOIN l a ON a.item_id=i JOIN l c ON c.item_id=j WHERE rn=1 AND sim>=0.98 ORDER BY sim DESC, i, j LIMIT 1000",
        "split_match_ladder": f"""WITH {_L}, {_S}, {_BEST}, y AS (SELECT a.drawing_type, count(*) AS c FROM n a JOIN n b ON a.drawing_type=b.drawing_type AND a.item_id<b.item_id AND a.split='train' AND b.split='train' WHERE list_dot_product(a.v,b.v)>=0.99 GROUP BY 1)
            SELECT q.drawing_type, count(*) AS n_val, count(*) FILTER (sim>=0.995) AS at_995, count(*) FILTER (sim>=0.99) AS at_99, count(*) FILTER (sim>=0.98) AS at_98, count(*) FILTER (sim>=0.95) AS at_95, round(median(sim),6) AS median_best, coalesce(any_value(c),0) AS n_in_train FROM q LEFT JOIN y USING(drawing_type) WHERE rn=1 GROUP BY 1""",
        "cross_split_drawings": f"""WITH {_L}, h AS ({hashes}), b AS (SELECT item_id, any_value(x) AS x FROM cnn_cache_128 WHERE len(x)=height*width GROUP BY 1), n AS (SELECT l.item_id, split, drawing_type, x, bits FROM l JOIN b USING(item_id) JOIN h USING(item_id))
            SELECT a.drawing_type AS kind, a.item_id AS train, c.item_id AS test, CASE WHEN a.x=c.x THEN 'exact' ELSE 'near' END AS match FROM n a JOIN n c ON a.drawing_type=c.drawing_type AND a.split='train' AND c.split='test' AND (a.x=c.x OR a.bits=c.bits)""",
    }
