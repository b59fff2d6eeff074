"""Queries of the audit's relational part, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import audit, reports
from palimpsest.session import table as t
from palimpsest.sources import ingest, sinks

ALIAS = "CASE lower(p) WHEN 'train' THEN 'train' WHEN 'val' THEN 'val' WHEN 'valid' THEN 'val' WHEN 'validation' THEN 'val' WHEN 'test' THEN 'test'{} END"
MORE = " WHEN 'training' THEN 'train' WHEN 'testing' THEN 'test'"


def _alias(path: str, more: bool = False) -> str:
    a = ALIAS.format(MORE if more else "")
    return f"coalesce(list_extract(list_filter(list_transform(string_split(replace(lower({path}), chr(92), '/'), '/'), lambda p: {a}), lambda q: q IS NOT NULL), 1), '?')"


STEM = r"regexp_replace(regexp_extract(path, '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1')"
BASE = rf"CASE WHEN regexp_matches(st, '(_aug\d+)+$') THEN regexp_replace(st, '(_aug\d+)+$', '') WHEN regexp_matches(st, '\.rf\.[0-9a-fA-F]{{8,}}$') THEN regexp_replace(st, '\.rf\.[0-9a-fA-F]{{8,}}$', '') ELSE st END"
AUG = r"(regexp_matches(st, '(_aug\d+)+$') OR regexp_matches(st, '\.rf\.[0-9a-fA-F]{8,}$'))"
BASES = f"SELECT item_id, {_alias('path')} AS split, {BASE} AS base, {AUG} AS augmented FROM (SELECT *, {STEM} AS st FROM yolo_full_manifest)"


def _man(s, d):
    return t(s, d, "yolo_full_manifest")


def _clean(s, d):
    return t(s, d, "yolo_full_manifest_clean")


def _pairs(s, d):
    return t(s, d, "near_duplicates_pairs")


def _part(c):
    return F.when(F.lower(F.trim(c)).isin("train", "training"), "train").when(F.lower(F.trim(c)).isin("val", "valid", "validation"), "val").when(F.lower(F.trim(c)).isin("test", "testing"), "test")


PART = "CASE WHEN lower(trim(split)) IN ('train','training') THEN 'train' WHEN lower(trim(split)) IN ('val','valid','validation') THEN 'val' WHEN lower(trim(split)) IN ('test','testing') THEN 'test' END"


def usable_rows(s, d):
    return audit.usable_rows(_clean(s, d)).select("item_id", "path", "split_clean")


def split_class_counts(s, d):
    return _man(s, d).groupBy("split", "class_name").agg(F.count("*").alias("n"))


def label_share(s, d):
    m = _man(s, d).where("diagnosis is not null and drawing_type is not null")
    return m.groupBy("drawing_type").agg(F.count("*").alias("n"), F.round(100 * F.avg(X.positive(F.col("diagnosis"))), 6).alias("pct_parkinson"))


def number_ranges(s, d):
    return audit.number_ranges(_man(s, d), "class_name").withColumn("density", F.round("density", 6))


def range_interleave(s, d):
    return audit.interleaved(_man(s, d), "class_name", _part(F.col("split")))


def class_partition(s, d):
    a, b = X.class_parts(F.col("class_name"))
    return _man(s, d).select("item_id", a.alias("first_part"), b.alias("rest"))


def stem_number(s, d):
    a, b = X.name_and_number(X.stem(F.col("path")))
    return _man(s, d).select("item_id", a.alias("prefix"), b.alias("number"))


def augmented_stem(s, d):
    a, b = X.augmented_base(X.stem(F.col("path")))
    return _man(s, d).select("item_id", a.alias("base"), b.alias("augmented"))


def split_alias(s, d):
    return _man(s, d).select("item_id", X.split_of_path(F.col("path")).alias("by_manifest"), X.split_of_path(F.col("path"), X.INSPECTION_SPLITS).alias("by_inspection"))


def subject_id(s, d):
    return _man(s, d).select("item_id", X.subject_of(X.stem(F.col("path"))).alias("subject"))


def label_path(s, d):
    return _man(s, d).select("item_id", X.label_path(F.col("path")).alias("label"))


def slugs(s, d):
    return t(s, d, "documents").select("doc_id", X.slug(F.col("item")).alias("slug"), X.metric_key(F.col("item")).alias("key"))


def interval_cells(s, d):
    g = t(s, d, "events").groupBy("event_type").agg(F.avg("value").alias("v"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return g.select("event_type", X.interval_text(F.round("v", 6), F.round("lo", 6), F.round("hi", 6)).alias("cell"))


def indicators(s, d):
    return _man(s, d).select("item_id", X.positive(F.col("diagnosis")).alias("y"), (F.col("drawing_type") == "wave").cast("int").alias("is_wave"))


def contamination(s, d):
    return audit.contamination(_man(s, d))


def multi_split_bases(s, d):
    return audit.multi_split_bases(_man(s, d))


def distinct_originals(s, d):
    base, aug = X.augmented_base(X.stem(F.col("path")))
    m = _man(s, d).select("source", X.split_of_path(F.col("path")).alias("split"), aug.alias("augmented"), base.alias("base"))
    return m.groupBy("source", "split", "augmented").agg(F.count("*").alias("n"), F.countDistinct("base").alias("n_bases"))


def exact_dup_groups(s, d):
    return audit.exact_groups(t(s, d, "documents"), "lang", "text").select("lang", "sha1", "n", "links")


def cross_split_dups(s, d):
    docs = t(s, d, "documents").where("text <> ''")
    split = F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")
    return audit.cross_split_pairs(docs, "source", "text", split, "doc_id")


def clean_manifest(s, d):
    rows = _clean(s, d).where("group_id is not null").withColumn("split", F.coalesce(_part(F.col("split")), F.lit("?")))
    rows = rows.select("item_id", "path", "split", "diagnosis", "name_number", "group_id").distinct()
    return audit.group_rules(rows).select("item_id", "path", "group_id", F.col("_size").alias("group_size"), F.col("_conflict").alias("group_conflict"), F.col("_role").alias("role"), F.col("_clean").alias("split_clean"))


def group_statistics(s, d):
    return audit.group_statistics(_clean(s, d))


def group_mates_in_train(s, d):
    from pyspark.sql import Window

    r = _clean(s, d).select("item_id", "group_id", _part(F.col("split")).alias("p")).where("group_id is not null")
    has = F.max((F.col("p") == "train").cast("int")).over(Window.partitionBy("group_id"))
    return r.withColumn("h", has).where("p = 'val'").agg(F.count("*").alias("n_val"), F.count_if(F.col("h") == 1).alias("n_with_mate"))


def pair_summary(s, d):
    return audit.pair_summary(_pairs(s, d))


def sampled_items(s, d):
    m = _man(s, d).where("item_id is not null").select("item_id", "source").groupBy("item_id").agg(F.min("source").alias("source"))
    return audit.seeded_sample(m, "item_id", 40, 11)


def pair_ladder(s, d):
    return audit.ladder(_pairs(s, d))


def top_pairs(s, d):
    return sinks.top_pairs(_pairs(s, d).distinct(), 1000)


def label_pairs(s, d):
    return _pairs(s, d).groupBy("val_label", "train_label").agg(F.count("*").alias("n"))


def evenly_spaced(s, d):
    """Six of the pairs whose labels agree, evenly from the least to the greatest correlation."""
    p = _pairs(s, d).where("val_label = train_label and correlation is not null and not isnan(correlation) and val_path is not null and train_path is not null")
    p = p.select("correlation", "val_path", "train_path").distinct()
    return audit.every_nth(p, ["correlation", "val_path", "train_path"])


def one_to_one_join(s, d):
    m = _man(s, d).groupBy("item_id").agg(F.min("source").alias("source"))
    x = t(s, d, "cnn_cache_128").groupBy("item_id").agg(F.max("height").alias("height"))
    return audit.one_to_one(m, x, ["item_id"])


def missing_rows(s, d):
    m = _man(s, d).select("item_id", "source").distinct()
    x = t(s, d, "cnn_cache_128").select("item_id").distinct().withColumn("hit", F.lit(1))
    return m.join(x, "item_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("hit").isNull()).alias("n_missing"))


def mode_share(s, d):
    return audit.mode_share(t(s, d, "lineitem"), ["l_quantity", "l_discount"])


def column_medians(s, d):
    return t(s, d, "lineitem").groupBy("l_returnflag").agg(F.min("l_extendedprice").alias("lo"), F.round(F.median("l_extendedprice"), 4).alias("median_price"), F.max("l_extendedprice").alias("hi"), F.round(F.percentile("l_extendedprice", F.lit(0.05)), 4).alias("p5"))


def medians_unpivot(s, d):
    m = audit.medians_by(t(s, d, "lineitem"), "l_linestatus", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return m.withColumn("median_value", F.round("median_value", 6))


def median_impute(s, d):
    e = t(s, d, "events").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return audit.imputed(e.select("event_id", "event_type", "value"), ["value"]).select("event_id", F.round("value", 6).alias("value"))


def median_impute_by_type(s, d):
    e = t(s, d, "events").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return audit.imputed(e.select("event_id", "event_type", "value"), ["value"], ["event_type"]).select("event_id", F.round("value", 6).alias("value"))


def null_rows(s, d):
    return _man(s, d).agg(F.count_if(F.col("split").isNull() | F.col("diagnosis").isNull() | F.col("drawing_type").isNull() | F.col("class_id").isNull()).alias("n_with_null"), F.count("*").alias("n"))


def correlations(s, d):
    return t(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


def quantile_summary(s, d):
    q = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    g = t(s, d, "events").groupBy("event_type").agg(q.alias("q"), F.max("value").alias("hi"), F.avg((F.col("value") >= 50).cast("double")).alias("sh"))
    return g.select("event_type", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(["p10", "p50", "p90"])], "hi", F.round("sh", 6).alias("share"))


def pooled_rollup(s, d):
    return audit.pooled_share(_man(s, d))


def survivors(s, d):
    return audit.survivors(_clean(s, d))


def unlisted_items(s, d):
    return _man(s, d).select("item_id").exceptAll(_clean(s, d).select("item_id")).distinct()


def _reports(s, d):
    """Markdown reports written from the line items: a file for each year of shipping, a section for each return flag, a row for each line status."""
    g = t(s, d, "lineitem").groupBy(F.year("l_shipdate").cast("string").alias("run"), "l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("q"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.count("*").alias("n"), F.avg("l_discount").alias("dc"))
    row = F.format_string("| %s | %.3f [%.3f-%.3f] | %.4f | %d | text |", "l_linestatus", F.col("q").cast("double"), F.col("lo").cast("double"), F.col("hi").cast("double"), F.col("dc").cast("double"), "n")
    rows = g.groupBy("run", "l_returnflag").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    section = F.concat(F.lit("## flag "), "l_returnflag", F.lit("\n\nwords | between\n| status | Mean-Quantity | disc_avg | n | note |\n| --- | ---: |:---|---|---|\n"), "rows", F.lit("\n"))
    return rows.groupBy("run").agg(F.concat(F.lit("# report\n\n"), F.array_join(F.array_sort(F.collect_list(section)), "\n")).alias("value"))


def report_cells(s, d):
    return reports.report_cells(_reports(s, d))


def report_metrics(s, d):
    return reports.flattened(report_cells(s, d))


def yaml_names(s, d):
    """The class names of the manifest, written as a YAML list and read again."""
    names = _man(s, d).where("class_name is not null").select("class_name").distinct().agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("'"), "class_name", F.lit("'")))), ", ").alias("n"))
    return ingest.class_names(names.select(F.concat(F.lit("path: x\nnames: ["), "n", F.lit("]\nnc: 4")).alias("value")))


def label_lines(s, d):
    """Label lines written from the line items and read again; every fifth line lacks its box, every seventh its number."""
    l = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    line = F.when(F.col("l_orderkey") % 7 == 0, F.lit("x 1 2 3 4")).when(F.col("l_orderkey") % 5 == 0, F.concat(F.lit(" "), F.col("l_linenumber").cast("string"), F.lit(".0")))
    line = line.otherwise(F.format_string("%d  0.5 0.5 %.2f %.2f 9", F.col("l_linenumber").cast("int"), F.col("l_discount").cast("double"), F.col("l_tax").cast("double")))
    return ingest.label_lines(l.select("l_orderkey", "l_linenumber", line.alias("value"))).select("l_orderkey", "l_linenumber", "class_id", "w", "h")


def box_shares(s, d):
    return audit.box_shares(label_lines(s, d), 0.05)


def order_status_counts(s, d):
    return t(s, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_customers"))


_NAMES = """usable_rows split_class_counts label_share number_ranges range_interleave class_partition stem_number augmented_stem split_alias subject_id
label_path slugs interval_cells indicators contamination multi_split_bases distinct_originals exact_dup_groups cross_split_dups clean_manifest group_statistics
group_mates_in_train pair_summary pair_ladder top_pairs label_pairs evenly_spaced one_to_one_join missing_rows mode_share column_medians medians_unpivot
sampled_items box_shares
median_impute median_impute_by_type null_rows correlations quantile_summary pooled_rollup survivors unlisted_items report_cells report_metrics yaml_names
label_lines order_status_counts""".split()


def queries():
    return {n: globals()[n] for n in _NAMES}


_AGG = "(SELECT year(l_shipdate)::VARCHAR AS run, 'flag '||l_returnflag AS section, l_linestatus AS subset, avg(l_quantity)::DOUBLE AS q, min(l_quantity)::DOUBLE AS lo, max(l_quantity)::DOUBLE AS hi, count(*)::DOUBLE AS n, avg(l_discount)::DOUBLE AS dc FROM lineitem GROUP BY year(l_shipdate), l_returnflag, l_linestatus)"
_CELLS = f"(SELECT run, section, subset, 'mean_quantity' AS metric, round(q,3) AS value, round(lo,3) AS lo, round(hi,3) AS hi FROM {_AGG} UNION ALL SELECT run, section, subset, 'disc_avg', round(dc,4), NULL, NULL FROM {_AGG} UNION ALL SELECT run, section, subset, 'n', n, NULL, NULL FROM {_AGG})"
_LABEL = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey%7=0 THEN NULL ELSE l_linenumber END::INT AS class_id, CASE WHEN l_orderkey%7=0 THEN 3.0 WHEN l_orderkey%5=0 THEN NULL ELSE round(l_discount::DOUBLE,2) END::DOUBLE AS w, CASE WHEN l_orderkey%7=0 THEN 4.0 WHEN l_orderkey%5=0 THEN NULL ELSE round(l_tax::DOUBLE,2) END::DOUBLE AS h FROM lineitem)"
_EV = "(SELECT event_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"


def oracle_sql():
    return {
        "usable_rows": "SELECT item_id, path, split_clean FROM yolo_full_manifest_clean WHERE split_clean IN ('train','val')",
        "split_class_counts": "SELECT split, class_name, count(*) AS n FROM yolo_full_manifest GROUP BY 1,2",
        "label_share": "SELECT drawing_type, count(*) AS n, round(100*avg(CASE WHEN diagnosis='parkinson' THEN 1.0 ELSE 0 END),6) AS pct_parkinson FROM yolo_full_manifest WHERE diagnosis IS NOT NULL AND drawing_type IS NOT NULL GROUP BY 1",
        "number_ranges": "SELECT class_name, min(name_number) AS lo, max(name_number) AS hi, count(*) AS n, round(count(*)/(max(name_number)-min(name_number)+1),6) AS density FROM yolo_full_manifest WHERE name_number>=0 GROUP BY 1",
        "range_interleave": f"WITH s AS (SELECT class_name, name_number, {PART} AS p FROM yolo_full_manifest WHERE name_number>=0), l AS (SELECT class_name, min(name_number) lo, max(name_number) hi FROM s WHERE p='train' GROUP BY 1) SELECT s.class_name, count(*)::BIGINT AS n_val, sum(CASE WHEN name_number BETWEEN lo AND hi THEN 1 ELSE 0 END)::BIGINT AS n_inside FROM s LEFT JOIN l USING(class_name) WHERE p='val' GROUP BY 1",
        "class_partition": "SELECT item_id, CASE WHEN instr(class_name,' ')>0 THEN substr(class_name,1,instr(class_name,' ')-1) ELSE class_name END AS first_part, CASE WHEN instr(class_name,' ')>0 THEN substr(class_name,instr(class_name,' ')+1) ELSE '' END AS rest FROM yolo_full_manifest",
        "stem_number": rf"SELECT item_id, CASE WHEN regexp_matches(st,'^(.*?)_?(\d+)$') THEN regexp_extract(st,'^(.*?)_?(\d+)$',1) ELSE st END AS prefix, coalesce(try_cast(nullif(regexp_extract(st,'^(.*?)_?(\d+)$',2),'') AS INT), CASE WHEN NOT regexp_matches(st,'^(.*?)_?(\d+)$') THEN -1 END) AS number FROM (SELECT *, {STEM} AS st FROM yolo_full_manifest)",
        "augmented_stem": f"SELECT item_id, base, augmented FROM ({BASES})",
        "split_alias": f"SELECT item_id, {_alias('path')} AS by_manifest, {_alias('path', True)} AS by_inspection FROM yolo_full_manifest",
        "subject_id": rf"SELECT item_id, coalesce(nullif(regexp_extract(st,'(?i)(?:^|[_\-\s])(?:p|pt|pac|paciente|subj|subject|sujeito)[_\-]?(\d+)',1),''), nullif(regexp_extract(st,'^(\d+)[_\-]',1),'')) AS subject FROM (SELECT *, {STEM} AS st FROM yolo_full_manifest)",
        "label_path": r"SELECT item_id, regexp_replace(regexp_replace(path,'(?i)^(.*[/\\])images([/\\].*)$','\1labels\2'),'\.[^./\\]*$','.txt') AS label FROM yolo_full_manifest",
        "slugs": r"SELECT doc_id, substr(regexp_replace(regexp_replace(item,'[^A-Za-z0-9_]+','_','g'),'^_+|_+$','','g'),1,24) AS slug, regexp_replace(regexp_replace(lower(trim(item)),'[^a-z0-9_]+','_','g'),'^_+|_+$','','g') AS key FROM documents",
        "interval_cells": "SELECT event_type, format('{:.3f} [{:.3f}-{:.3f}]', round(avg(value),6), round(min(value),6), round(max(value),6)) AS cell FROM events GROUP BY 1",
        "indicators": "SELECT item_id, CASE WHEN diagnosis='parkinson' THEN 1 WHEN diagnosis IS NOT NULL THEN 0 END::INT AS y, CASE WHEN drawing_type='wave' THEN 1 WHEN drawing_type IS NOT NULL THEN 0 END::INT AS is_wave FROM yolo_full_manifest",
        "contamination": f"WITH b AS ({BASES}), tr AS (SELECT DISTINCT base FROM b WHERE split='train') SELECT b.split, count(*) AS n, count(tr.base) AS n_in_train, round(100.0*count(tr.base)/count(*),4) AS pct FROM b LEFT JOIN tr USING(base) WHERE b.split IN ('val','test') GROUP BY 1",
        "multi_split_bases": f"SELECT base, count(DISTINCT split) AS n_splits FROM ({BASES}) WHERE NOT augmented GROUP BY 1 HAVING count(DISTINCT split)>1",
        "distinct_originals": f"WITH b AS ({BASES.replace('item_id,', 'source, item_id,')}) SELECT source, split, augmented, count(*) AS n, count(DISTINCT base) AS n_bases FROM b GROUP BY 1,2,3",
        "exact_dup_groups": "SELECT lang, sha1(text) AS sha1, count(*) AS n, count(*)-1 AS links FROM documents WHERE text IS NOT NULL GROUP BY 1,2 HAVING count(*)>1",
        "cross_split_dups": "SELECT a.source AS kind, a.doc_id AS train, b.doc_id AS test, 'exact' AS match FROM documents a JOIN documents b ON a.source=b.source AND a.text=b.text WHERE a.text<>'' AND a.doc_id%5<>0 AND b.doc_id%5=0",
        "clean_manifest": f"""WITH r AS (SELECT DISTINCT item_id, path, coalesce({PART},'?') AS split, diagnosis, name_number, group_id FROM yolo_full_manifest_clean WHERE group_id IS NOT NULL),
            g AS (SELECT group_id, count(*) AS n, count(DISTINCT diagnosis)>1 AS c, max(CASE WHEN split='train' THEN 1 ELSE 0 END) AS tr, min(split) AS least FROM r GROUP BY 1),
            o AS (SELECT r.*, row_number() OVER (PARTITION BY group_id ORDER BY name_number, item_id, path) AS rn FROM r)
            SELECT item_id, path, o.group_id, n::INT AS group_size, c AS group_conflict, CASE WHEN rn=1 THEN 'rep' ELSE 'dup' END AS role,
            CASE WHEN c THEN 'drop' WHEN rn>1 THEN 'dup' WHEN tr=1 THEN 'train' ELSE least END AS split_clean FROM o JOIN g USING(group_id)""",
        "group_statistics": "WITH g AS (SELECT group_id, count(*) n, count(DISTINCT split) s, count(DISTINCT diagnosis) d FROM yolo_full_manifest_clean WHERE group_id IS NOT NULL GROUP BY 1) SELECT count(*) AS n_groups, count(*) FILTER (n>1) AS n_multi, coalesce(sum(n) FILTER (n>1),0)::BIGINT AS rows_in_multi, count(*) FILTER (s>1) AS cross_split, count(*) FILTER (d>1) AS conflicts FROM g",
        "group_mates_in_train": f"WITH r AS (SELECT group_id, {PART} AS p FROM yolo_full_manifest_clean WHERE group_id IS NOT NULL) SELECT count(*) AS n_val, count(*) FILTER (group_id IN (SELECT group_id FROM r WHERE p='train')) AS n_with_mate FROM r WHERE p='val'",
        "pair_summary": "WITH c AS (SELECT list_extract(regexp_split_to_array(trim(val_label),'[ _]+'),-1) AS drawing_type, coalesce(val_label<>train_label,false) AS conflict, CASE WHEN NOT isnan(correlation) THEN correlation END AS c FROM near_duplicates_pairs) SELECT drawing_type, conflict, count(*) AS n, sum(CASE WHEN c>=0.995 THEN 1 WHEN c IS NOT NULL THEN 0 END)::BIGINT AS n_high, round(median(c),6) AS median_corr FROM c GROUP BY 1,2",
        "sampled_items": "SELECT item_id, min(source) AS source FROM yolo_full_manifest WHERE item_id IS NOT NULL GROUP BY 1 ORDER BY sha1('11|'||item_id), item_id LIMIT 40",
        "box_shares": f"SELECT class_id, count(*) AS n, round(100*avg(CASE WHEN w>=0.05 AND h>=0.05 THEN 1.0 ELSE 0 END),4) AS pct_full, round(avg(w),6) AS mean_w, round(avg(h),6) AS mean_h FROM {_LABEL} WHERE class_id IS NOT NULL AND w IS NOT NULL GROUP BY 1",
        "pair_ladder": "SELECT t.threshold, count(*) FILTER (NOT isnan(correlation) AND correlation>=t.threshold) AS n_pairs FROM near_duplicates_pairs, (VALUES (0.995::DOUBLE),(0.99::DOUBLE),(0.98::DOUBLE),(0.95::DOUBLE)) t(threshold) GROUP BY 1",
        "top_pairs": "SELECT round(correlation,4) AS correlation, val_path, train_path, val_label, train_label FROM (SELECT DISTINCT * FROM near_duplicates_pairs) WHERE correlation IS NOT NULL AND NOT isnan(correlation) ORDER BY near_duplicates_pairs.correlation DESC, val_path NULLS FIRST, train_path NULLS FIRST, val_label NULLS FIRST, train_label NULLS FIRST LIMIT 1000".replace("near_duplicates_pairs.correlation DESC", "1 DESC"),
        "label_pairs": "SELECT val_label, train_label, count(*) AS n FROM near_duplicates_pairs GROUP BY 1,2",
        "evenly_spaced": "WITH m AS (SELECT DISTINCT correlation, val_path, train_path FROM near_duplicates_pairs WHERE val_label=train_label AND correlation IS NOT NULL AND NOT isnan(correlation) AND val_path IS NOT NULL AND train_path IS NOT NULL), r AS (SELECT *, row_number() OVER (ORDER BY correlation, val_path, train_path)-1 AS rn, greatest(1,(count(*) OVER ())//6) AS st FROM m) SELECT correlation, val_path, train_path FROM r WHERE rn%st=0 AND rn//st<6",
        "one_to_one_join": "SELECT m.item_id, m.source, x.height FROM (SELECT item_id, min(source) AS source FROM yolo_full_manifest GROUP BY 1) m LEFT JOIN (SELECT item_id, max(height) AS height FROM cnn_cache_128 GROUP BY 1) x USING(item_id)",
        "missing_rows": "SELECT m.source, count(*) AS n, count(*) FILTER (x.item_id IS NULL) AS n_missing FROM (SELECT DISTINCT item_id, source FROM yolo_full_manifest) m LEFT JOIN (SELECT DISTINCT item_id FROM cnn_cache_128) x USING(item_id) GROUP BY 1",
        "mode_share": "WITH g AS (SELECT l_quantity, l_discount, count(*) n FROM lineitem GROUP BY 1,2), t AS (SELECT sum(n) t, count(*) k FROM g) SELECT l_quantity, l_discount, round(n/t,6) AS share, k AS n_distinct FROM g, t ORDER BY n DESC, l_quantity, l_discount LIMIT 1",
        "column_medians": "SELECT l_returnflag, min(l_extendedprice) AS lo, round(median(l_extendedprice),4) AS median_price, max(l_extendedprice) AS hi, round(quantile_cont(l_extendedprice,0.05),4) AS p5 FROM lineitem GROUP BY 1",
        "medians_unpivot": "SELECT l_linestatus, feature, round(median(v),6) AS median_value FROM (UNPIVOT (SELECT l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE v) GROUP BY 1,2",
        "median_impute": f"SELECT event_id, round(coalesce(value,(SELECT median(value) FROM {_EV})),6) AS value FROM {_EV}",
        "median_impute_by_type": f"SELECT e.event_id, round(coalesce(e.value,m.m),6) AS value FROM {_EV} e JOIN (SELECT event_type, median(value) AS m FROM {_EV} GROUP BY 1) m USING(event_type)",
        "null_rows": "SELECT count(*) FILTER (split IS NULL OR diagnosis IS NULL OR drawing_type IS NULL OR class_id IS NULL) AS n_with_null, count(*) AS n FROM yolo_full_manifest",
        "correlations": "SELECT l_returnflag, round(corr(l_quantity,l_extendedprice),6) AS r FROM lineitem GROUP BY 1",
        "quantile_summary": "SELECT event_type, round(quantile_cont(value,0.1),6) AS p10, round(quantile_cont(value,0.5),6) AS p50, round(quantile_cont(value,0.9),6) AS p90, max(value) AS hi, round(avg(CASE WHEN value>=50 THEN 1.0 ELSE 0 END),6) AS share FROM events GROUP BY 1",
        "pooled_rollup": "SELECT coalesce(drawing_type,'pooled') AS subset, count(*) AS n, sum(CASE WHEN diagnosis='parkinson' THEN 1 WHEN diagnosis IS NOT NULL THEN 0 END)::BIGINT AS n_positive FROM yolo_full_manifest WHERE drawing_type IS NOT NULL GROUP BY ROLLUP(drawing_type)",
        "survivors": "SELECT group_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY name_number, item_id) rn FROM yolo_full_manifest_clean WHERE group_id IS NOT NULL) WHERE rn=1",
        "unlisted_items": "SELECT DISTINCT item_id FROM (SELECT item_id FROM yolo_full_manifest EXCEPT ALL SELECT item_id FROM yolo_full_manifest_clean)",
        "report_cells": f"SELECT run, section, subset, metric, value::DOUBLE AS value, lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM {_CELLS}",
        "report_metrics": f"SELECT run||' | '||section||' | '||subset AS run_key, metric, value::DOUBLE AS value FROM {_CELLS} UNION ALL SELECT run||' | '||section||' | '||subset, metric||'_ci_lo', lo::DOUBLE FROM {_CELLS} WHERE lo IS NOT NULL UNION ALL SELECT run||' | '||section||' | '||subset, metric||'_ci_hi', hi::DOUBLE FROM {_CELLS} WHERE hi IS NOT NULL",
        "yaml_names": "SELECT (row_number() OVER (ORDER BY class_name)-1)::INT AS class_id, class_name FROM (SELECT DISTINCT class_name FROM yolo_full_manifest WHERE class_name IS NOT NULL)",
        "label_lines": f"SELECT * FROM {_LABEL}",
        "order_status_counts": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY 1,2",
    }
