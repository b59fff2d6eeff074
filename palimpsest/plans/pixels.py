"""Queries of the measures and transforms of cached drawings, and their SQL over unnested pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from palimpsest.functions import kernels
from palimpsest.operators import images
from palimpsest.session import table as t


def _cache(s, d):
    return t(s, d, "cnn_cache_128")


def _rounded(df, key="item_id", digits=6):
    # the small shift keeps values that lie on a rounding edge on one side, whatever the order of the sums
    return df.select(key, *[F.round(F.col(c) + 1e-9, digits).alias(c) for c in df.columns if c != key])


def image_stats(s, d):
    return _rounded(images.stats_table(_cache(s, d)))


def stroke_features(s, d):
    return _rounded(images.stroke_table(_cache(s, d)))


def stroke_medians(s, d):
    from palimpsest.operators.audit import medians_by

    f = images.stroke_table(_cache(s, d), ["item_id", "class_name"]).drop("item_id")
    m = medians_by(f, "class_name", list(kernels.STROKE_FEATURES))
    return m.select("class_name", "feature", F.round(F.col("median_value") + 1e-9, 5).alias("median_value"))


def background(s, d):
    return _rounded(images.background_table(_cache(s, d)))


def _digest(df, scale=None):
    """``item_id``, the size and a digest of ALL values, so that no cell goes unchecked; floats as whole multiples of 1 / ``scale``."""
    cells = F.col("x") if scale is None else F.transform("x", lambda v: F.floor(v.cast("double") * scale + 0.5 + 1e-6).cast("bigint"))
    return df.select("item_id", "height", "width", F.md5(F.array_join(cells.cast("array<string>"), ",").cast("binary")).alias("digest"))


def binarized(s, d):
    return _digest(images.transformed(images.whole(_cache(s, d)), lambda x: kernels.binarize(x).astype(np.int16)))


def thumbnail_pool(s, d):
    return _digest(images.transformed(images.whole(_cache(s, d)), lambda x: kernels.thumbnails(x, 8), out_type="double"), 1e6).select("item_id", "digest")


def border_median(s, d):
    return images.measured(images.whole(_cache(s, d)), lambda x: {"border": kernels.border_medians(x).astype(float)}, ["border"])


def frame_crop(s, d):
    return _digest(images.transformed(images.whole(_cache(s, d)), lambda x: x[:, 4:-4, 4:-4]))


def model_input(s, d):
    return _digest(images.transformed(images.whole(_cache(s, d)), lambda x: kernels.model_input(x)[:, 0], out_type="float"), 1e4)


def reduced_ink(s, d):
    return _digest(images.transformed(images.whole(_cache(s, d)), lambda x: kernels.ink_image(images.ink_to_gray(x), 16).astype(np.int16)))


def pair_difference(s, d):
    """Mean absolute difference and share above 40 of each drawing and the one with the next id, inside the JVM."""
    c = images.whole(_cache(s, d)).select("item_id", "x")
    j = c.alias("a").join(c.select((F.col("item_id") - 1).alias("item_id"), F.col("x").alias("y")), "item_id").where("size(x) = size(y)")
    diff = F.zip_with("x", "y", lambda a, b: F.abs(a - b).cast("int"))
    j = j.select("item_id", diff.alias("d"))
    return j.select("item_id", F.round(F.aggregate("d", F.lit(0).cast("bigint"), lambda a, v: a + v) / F.size("d"), 6).alias("mad"), F.round(F.size(F.filter("d", lambda v: v > 40)) / F.size("d"), 6).alias("share"))


def logits(s, d):
    from palimpsest.functions.text import sigmoid

    e = t(s, d, "embeddings").select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("logit"))
    return e.select("vec_id", "logit", F.round(sigmoid(F.col("logit")), 6).alias("prob"))


def cropped_ink(s, d):
    return images.transformed(images.whole(_cache(s, d)), lambda x: kernels.ablated(np.clip(x, 0, 255), "binary_crop").astype(np.int16))


def signatures(s, d):
    return _digest(images.transformed(images.whole(_cache(s, d)), lambda x: kernels.signatures(images.ink_to_gray(x), 16), out_type="double"), 1e6).select("item_id", "digest")


def drawing_hashes(s, d):
    """All 64 bits, as text from the first pixel on."""
    bits = lambda x: np.unpackbits(kernels.average_hashes(images.ink_to_gray(x)).astype(">i8").view(np.uint8).reshape(len(x), 8), axis=1).astype(np.int16)
    return images.transformed(images.whole(_cache(s, d)), bits).select("item_id", F.array_join(F.col("x").cast("array<string>"), "").alias("bits"))


def padded(s, d):
    return images.transformed(images.whole(_cache(s, d)), lambda x: kernels.on_square(images.ink_to_gray(x).astype(np.uint8), 48).astype(np.int16))


def ink_heat(s, d):
    k = lambda x: kernels.heat_statistics(x.astype(float), x > 100, 3, 4)
    return _rounded(images.measured(images.whole(_cache(s, d)), k, ["enrichment", "border_share"]))


def augmented(s, d):
    return images.transformed(images.whole(_cache(s, d)), lambda x: kernels.random_affine(np.clip(x, 0, 255).astype(np.int16), np.random.default_rng(0)))


_SQL_NAMES = "image_stats stroke_features stroke_medians background binarized thumbnail_pool border_median frame_crop model_input reduced_ink pair_difference logits ink_heat signatures drawing_hashes".split()
_ROWS_ONLY = "cropped_ink padded augmented".split()


def queries():
    return {n: globals()[n] for n in _SQL_NAMES + _ROWS_ONLY}


_B = "b AS (SELECT item_id, any_value(height) AS h, any_value(width) AS w, any_value(x) AS x, any_value(class_name) AS class_name FROM cnn_cache_128 WHERE len(x)=height*width GROUP BY 1), g AS (SELECT *, list_transform(x, lambda v: 255-v) AS g FROM b), s AS (SELECT *, list_aggregate(g,'median') AS med FROM g), m0 AS (SELECT *, list_transform(g, lambda v: CASE WHEN v < med-40 THEN 1 ELSE 0 END) AS m FROM s)"


_HALF = "list_transform(range(256), lambda j: floor(({v}[(j//16)*2*w+(j%16)*2+1]+{v}[(j//16)*2*w+(j%16)*2+2]+{v}[((j//16)*2+1)*w+(j%16)*2+1]+{v}[((j//16)*2+1)*w+(j%16)*2+2])/4.0+0.5))"


def _md5(cells: str) -> str:
    return f"md5(array_to_string({cells}, ','))"


def _erode(m: str) -> str:
    return f"list_transform(range(h*w), lambda i: CASE WHEN {m}[i+1]=1 AND i>=w AND i<(h-1)*w AND i%w>0 AND i%w<w-1 AND {m}[i+1-w]=1 AND {m}[i+1+w]=1 AND {m}[i]=1 AND {m}[i+2]=1 THEN 1 ELSE 0 END)"


def _strokes() -> str:
    steps, last = [], "m0"
    for k in range(1, 11):
        steps.append(f"e{k} AS (SELECT *, {_erode('m' if k == 1 else f'm{k - 1}')} AS m{k} FROM {last})")
        last = f"e{k}"
    thick = "+".join(f"list_sum(m{k})" for k in range(1, 11))
    return f"""WITH {_B}, {', '.join(steps)},
      q AS (SELECT *, list_sum(m)::DOUBLE AS area, 1+({thick})/nullif(list_sum(m),0)::DOUBLE AS thickness, list_transform(m, lambda v: 1-v) AS paper FROM e10),
      q2 AS (SELECT *, {_erode('paper')} AS p1 FROM q), q3 AS (SELECT *, {_erode('p1')} AS p2 FROM q2),
      px AS (SELECT item_id, w, h, unnest(range(h*w)) AS i, unnest(m) AS m, unnest(m1) AS m1, unnest(p2) AS p2, unnest(g)::DOUBLE AS g FROM q3),
      c AS (SELECT item_id, avg(i%w) FILTER (m=1) AS mx, avg(i//w) FILTER (m=1) AS my FROM px GROUP BY 1),
      f AS (SELECT item_id, (max(i%w) FILTER (m=1)-min(i%w) FILTER (m=1)+1)/any_value(w)::DOUBLE AS bbox_w, (max(i//w) FILTER (m=1)-min(i//w) FILTER (m=1)+1)/any_value(h)::DOUBLE AS bbox_h,
        any_value(mx)/any_value(w) AS cx, any_value(my)/any_value(h) AS cy, stddev_pop(i%w) FILTER (m=1)/any_value(w) AS sx, stddev_pop(i//w) FILTER (m=1)/any_value(h) AS sy,
        avg(sqrt((i%w-mx)**2+(i//w-my)**2)/(0.5*w)) FILTER (m=1) AS r_mean, stddev_pop(sqrt((i%w-mx)**2+(i//w-my)**2)/(0.5*w)) FILTER (m=1) AS r_std,
        avg(g) FILTER (m=1) AS ink, count(*) FILTER (p2=1) AS quiet, stddev_pop(g) FILTER (p2=1) AS noise, count(*) FILTER (m=1 AND m1=0) AS edge
        FROM px JOIN c USING(item_id) GROUP BY 1),
      z AS (SELECT q3.*, f.* EXCLUDE (item_id),
        list_sum(list_transform(range(h*w), lambda i: CASE WHEN i%w>0 AND m[i+1]=1 AND m[i]=0 THEN 1 ELSE 0 END))/h::DOUBLE AS cross_h,
        list_sum(list_transform(range(h*w), lambda i: CASE WHEN i>=w AND m[i+1]=1 AND m[i+1-w]=0 THEN 1 ELSE 0 END))/w::DOUBLE AS cross_v FROM q3 JOIN f USING(item_id))
      SELECT item_id, class_name, """ + ", ".join(
        f"CASE WHEN area>=50 THEN {e} END AS {n}"
        for n, e in [
            ("ink_frac", "area/(h*w)"), ("thickness_idx", "thickness"), ("roughness", "edge*thickness/area"), ("bbox_w", "bbox_w"), ("bbox_h", "bbox_h"), ("cx", "cx"), ("cy", "cy"), ("sx", "sx"), ("sy", "sy"),
            ("r_mean", "r_mean"), ("r_std", "r_std"), ("cross_h", "cross_h"), ("cross_v", "cross_v"), ("ink_contrast", "med-ink"), ("paper_noise", "CASE WHEN quiet>100 THEN noise END"),
        ]
    ) + " FROM z"


def oracle_sql():
    names = kernels.STROKE_FEATURES
    strokes = _strokes()
    return {
        "image_stats": f"WITH {_B} SELECT item_id, round(list_avg(g)+1e-9,6) AS mean_gray, round(med+1e-9,6) AS median_gray, round(list_aggregate(g,'quantile_cont',0.05)+1e-9,6) AS p5_gray, round(list_avg(m)+1e-9,6) AS ink_frac FROM m0",
        "stroke_features": f"SELECT item_id, {', '.join(f'round({n}+1e-9,6) AS {n}' for n in names)} FROM ({strokes})",
        "stroke_medians": f"SELECT class_name, feature, round(median(v)+1e-9,5) AS median_value FROM ((SELECT * EXCLUDE (item_id) FROM ({strokes})) UNPIVOT INCLUDE NULLS (v FOR feature IN ({', '.join(names)}))) GROUP BY 1,2",
        "background": f"WITH {_B}, px AS (SELECT item_id, h, w, unnest(range(h*w)) AS i, unnest(x) AS v FROM b) SELECT item_id, round(avg(v) FILTER (i//w<3 OR i//w>=h-3 OR i%w<3 OR i%w>=w-3)+1e-9,6) AS frame_mean, round(avg(CASE WHEN v BETWEEN 1 AND 10 THEN 1.0 ELSE 0 END) FILTER (i//w>=6 AND i//w<h-6 AND i%w>=6 AND i%w<w-6)+1e-9,6) AS speckle FROM px GROUP BY 1",
        "binarized": f"WITH {_B} SELECT item_id, h::INT AS height, w::INT AS width, {_md5('list_transform(x, lambda v: CASE WHEN v > greatest(0.35::DOUBLE*list_max(x), 32) THEN 255 ELSE 0 END)')} AS digest FROM b",
        "thumbnail_pool": f"""WITH {_B}, t AS (SELECT item_id, list_transform(range(64), lambda j: list_avg(list_transform(range(16), lambda k: x[((j//8)*4+k//4)*w+(j%8)*4+k%4+1]))) AS v FROM b),
            c AS (SELECT item_id, list_transform(v, lambda a: a-list_avg(v)) AS v FROM t), n AS (SELECT item_id, v, greatest(sqrt(list_dot_product(v,v)),1e-8) AS n FROM c)
            SELECT item_id, {_md5('list_transform(v, lambda a: floor(a/n*1e6+0.5+1e-6)::BIGINT)')} AS digest FROM n""",
        "border_median": f"WITH {_B} SELECT item_id, floor(list_aggregate(list_concat(list_concat(x[1:w], x[(h-1)*w+1:h*w]), list_concat(list_transform(range(h), lambda r: x[r*w+1]), list_transform(range(h), lambda r: x[r*w+w]))),'median'))::DOUBLE AS border FROM b",
        "frame_crop": f"WITH {_B} SELECT item_id, (h-8)::INT AS height, (w-8)::INT AS width, {_md5('list_transform(list_filter(range(h*w), lambda i: i//w BETWEEN 4 AND h-5 AND i%w BETWEEN 4 AND w-5), lambda i: x[i+1])')} AS digest FROM b",
        "model_input": f"WITH {_B} SELECT item_id, h::INT AS height, w::INT AS width, {_md5('list_transform(x, lambda v: floor((v::FLOAT/255::FLOAT)::DOUBLE*1e4+0.5+1e-6)::BIGINT)')} AS digest FROM b",
        "reduced_ink": f"WITH {_B}, k AS (SELECT item_id, w, list_transform(g, lambda v: greatest(0, least(255, trunc(med-v)))) AS k FROM s) SELECT item_id, 16::INT AS height, 16::INT AS width, {_md5(f'list_transform({_HALF.format(v="k")}, lambda v: v::BIGINT)')} AS digest FROM k",
        "pair_difference": f"WITH {_B} SELECT a.item_id, round(list_avg(list_transform(range(len(a.x)), lambda i: abs(a.x[i+1]-c.x[i+1]))),6) AS mad, round(len(list_filter(range(len(a.x)), lambda i: abs(a.x[i+1]-c.x[i+1])>40))/len(a.x),6) AS share FROM b a JOIN b c ON c.item_id=a.item_id+1 AND len(a.x)=len(c.x)",
        "logits": "SELECT vec_id, round(embedding[1]::DOUBLE,6) AS logit, round(1/(1+exp(-round(embedding[1]::DOUBLE,6))),6) AS prob FROM embeddings",
        "ink_heat": f"""WITH {_B}, px AS (SELECT item_id, h, w, unnest(range(h*w)) AS i, unnest(x)::DOUBLE AS v FROM b), o AS (SELECT item_id, i//w AS r, i%w AS c FROM px WHERE v>100),
            n AS (SELECT DISTINCT o.item_id, o.r+dr AS r, o.c+dc AS c FROM o, range(-3,4) a(dr), range(-3,4) d(dc)),
            j AS (SELECT px.*, n.item_id IS NOT NULL AS near FROM px LEFT JOIN n ON n.item_id=px.item_id AND n.r=i//w AND n.c=i%w)
            SELECT item_id, round((coalesce(sum(v) FILTER (near),0)/greatest(sum(v),1e-12))/greatest(avg(CASE WHEN near THEN 1.0 ELSE 0 END),1e-12)+1e-9,6) AS enrichment, round(1-sum(v) FILTER (i//w BETWEEN 4 AND h-5 AND i%w BETWEEN 4 AND w-5)/greatest(sum(v),1e-12)+1e-9,6) AS border_share FROM j GROUP BY 1""",
        "signatures": f"""WITH {_B}, r AS (SELECT item_id, list_transform({_HALF.format(v='g')}, lambda v: 255-v) AS k FROM g), c AS (SELECT item_id, list_transform(k, lambda v: v-list_avg(k)) AS v FROM r),
            n AS (SELECT item_id, v, CASE WHEN sqrt(list_dot_product(v,v))>1e-6 THEN sqrt(list_dot_product(v,v)) ELSE 1 END AS n FROM c)
            SELECT item_id, {_md5('list_transform(v, lambda a: floor(a/n*1e6+0.5+1e-6)::BIGINT)')} AS digest FROM n""",
        "drawing_hashes": f"""WITH {_B}, px AS (SELECT item_id, unnest(range(1024)) AS i, unnest(g)::DOUBLE AS v FROM g WHERE h=32 AND w=32),
            t AS (SELECT o.o, i.i, (i.i+0.5-(o.o+0.5)*4)/4.0::DOUBLE AS t FROM range(8) o(o), range(32) i(i)),
            u AS (SELECT o, i, CASE WHEN abs(t)>3 THEN 0 WHEN abs(t)<1e-12 THEN 1 ELSE sin(pi()*t)/(pi()*t)*sin(pi()*t/3)/(pi()*t/3) END AS q FROM t),
            l AS (SELECT o, i, q/sum(q) OVER (PARTITION BY o) AS q FROM u), l2 AS (SELECT * FROM l WHERE q<>0),
            rows_ AS (SELECT item_id, l2.o AS r, px.i%32 AS c, sum(v*l2.q) AS v FROM px JOIN l2 ON l2.i=px.i//32 GROUP BY 1,2,3),
            small AS (SELECT item_id, r, l2.o AS c, greatest(0,least(255,floor(sum(v*l2.q)+0.5))) AS v FROM rows_ JOIN l2 ON l2.i=rows_.c GROUP BY 1,2,3),
            m AS (SELECT *, avg(v) OVER (PARTITION BY item_id) AS mean FROM small)
            SELECT item_id, string_agg(CASE WHEN v>mean THEN '1' ELSE '0' END, '' ORDER BY r, c) AS bits FROM m GROUP BY 1""",
    }
