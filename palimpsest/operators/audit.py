"""Counts, shares and joins of the dataset audit. All of it is declared; Catalyst picks the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import augmented_base, positive, split_of_path, stem
from palimpsest.operators.ranks import join_on, quantiles, ranked

USABLE = ("train", "val")


def usable_rows(clean: DataFrame) -> DataFrame:
    """Rows whose ``split_clean`` is exactly train or val."""
    return clean.where(F.col("split_clean").isin(*USABLE))


def number_ranges(df: DataFrame, key: str, number: str = "name_number") -> DataFrame:
    """Least, greatest and count of the numbers for each key, and how densely they fill the range. -1 is no number."""
    g = df.where(F.col(number) >= 0).groupBy(key).agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.count("*").alias("n"))
    return g.withColumn("density", F.col("n") / (F.col("hi") - F.col("lo") + 1))


def interleaved(df: DataFrame, key: str, split: Column, number: str = "name_number") -> DataFrame:
    """For each key: validation rows, and those whose number lies inside the training numbers' range.

    Two aggregations and a join of their few rows instead of a self-join of the table.
    """
    s = df.where(F.col(number) >= 0).select(key, number, split.alias("_s"))
    lo = s.where("_s = 'train'").groupBy(key).agg(F.min(number).alias("_lo"), F.max(number).alias("_hi"))
    v = s.where("_s = 'val'").groupBy(key, number).agg(F.count("*").alias("_n"))
    j = v.join(lo, key, "left")
    inside = F.sum(F.when(F.col(number).between(F.col("_lo"), F.col("_hi")), F.col("_n")).otherwise(0))
    return j.groupBy(key).agg(F.sum("_n").alias("n_val"), inside.alias("n_inside"))


def _bases(manifest: DataFrame) -> DataFrame:
    base, augmented = augmented_base(stem(F.col("path")))
    return manifest.select("item_id", split_of_path(F.col("path")).alias("split"), base.alias("base"), augmented.alias("augmented"))


def contamination(manifest: DataFrame) -> DataFrame:
    """Validation and test rows, and how many have their base name in training (a left-semi flag)."""
    b = _bases(manifest)
    train = b.where("split = 'train'").select("base").distinct().withColumn("_hit", F.lit(1))
    return (
        b.where("split in ('val', 'test')")
        .join(train, "base", "left")
        .groupBy("split")
        .agg(F.count("*").alias("n"), F.count("_hit").alias("n_in_train"), F.round(100.0 * F.count("_hit") / F.count("*"), 4).alias("pct"))
    )


def multi_split_bases(manifest: DataFrame) -> DataFrame:
    """Base names whose unaugmented files lie in more than one split."""
    return _bases(manifest).where("not augmented").groupBy("base").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def exact_groups(df: DataFrame, kind: str, content: str) -> DataFrame:
    """Groups of equal content inside a kind, by SHA-1: size and links (size - 1). Null contents form no group."""
    return (
        df.where(F.col(content).isNotNull())
        .groupBy(kind, F.sha1(F.col(content).cast("binary")).alias("sha1"))
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .withColumn("links", F.col("n") - 1)
    )


def cross_split_pairs(df: DataFrame, kind: str, content: str, split: Column, key: str) -> DataFrame:
    """Exact (test, train) pairs with equal content inside a kind; the digest, not the content, is shuffled."""
    h = df.where(F.col(content).isNotNull()).select(F.col(kind).alias("kind"), F.sha1(F.col(content).cast("binary")).alias("_h"), F.col(key).alias("_k"), split.alias("_s"))
    train = h.where("_s = 'train'").select("kind", "_h", F.col("_k").alias("train"))
    test = h.where("_s = 'test'").select("kind", "_h", F.col("_k").alias("test"))
    return train.join(test, ["kind", "_h"]).select("kind", "train", "test", F.lit("exact").alias("match"))


def group_rules(df: DataFrame, group: str = "group_id") -> DataFrame:
    """Conflict, role and clean split of every row of a grouped manifest.

    More than one diagnosis in a group drops all of it. Else the representative, the row of the least number (then
    id and path), goes to train if any member is there, else keeps the alphabetically least split; the others are dup. The rows of a
    dropped group keep their roles. All about a group comes from one pre-aggregation; no group is gathered.
    """
    first = F.struct("name_number", "item_id", "path")
    g = df.groupBy(group).agg(
        F.count("*").cast("int").alias("_size"),
        (F.countDistinct("diagnosis") > 1).alias("_conflict"),
        F.min(first).alias("_first"),
        F.coalesce(F.max((F.col("split") == "train").cast("int")), F.lit(0)).alias("_train"),
        F.min("split").alias("_least"),
    )
    out = join_on(df, g, [group]).withColumn("_role", F.when(first == F.col("_first"), "rep").otherwise("dup")).drop("_first")
    clean = F.when(F.col("_conflict"), "drop").when(F.col("_role") == "dup", "dup").when(F.col("_train") == 1, "train").otherwise(F.col("_least"))
    return out.withColumn("_clean", clean)


def group_statistics(df: DataFrame, group: str = "group_id", split: str = "split") -> DataFrame:
    """One row: groups, groups of several, rows in them, groups over several splits, groups of several diagnoses."""
    g = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(split).alias("s"), F.countDistinct("diagnosis").alias("d"))
    return g.agg(
        F.count("*").alias("n_groups"),
        F.count_if(F.col("n") > 1).alias("n_multi"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_multi"),
        F.count_if(F.col("s") > 1).alias("cross_split"),
        F.count_if(F.col("d") > 1).alias("conflicts"),
    )


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Pairs by drawing type (the last word of the validation label) and agreement of the two labels: count, high correlations and
    their median. NaN counts as missing."""
    kind = F.element_at(F.split(F.trim("val_label"), "[ _]+"), -1)
    p = pairs.select(kind.alias("drawing_type"), F.coalesce(F.col("val_label") != F.col("train_label"), F.lit(False)).alias("conflict"), F.when(~F.isnan("correlation"), F.col("correlation")).alias("c"))
    by = ["drawing_type", "conflict"]
    n = p.groupBy(*by).agg(F.count("*").alias("n"), F.sum((F.col("c") >= 0.995).cast("long")).alias("n_high"))
    return join_on(n, quantiles(p, by, "c", [0.5]), by, "left").select(*by, "n", "n_high", F.round(F.col("_q")[0], 6).alias("median_corr"))


def box_shares(labels: DataFrame, full: float = 0.9) -> DataFrame:
    """For each class of label lines with a box (``class_id``, ``w``, ``h``): how many, the share whose box is at least ``full`` wide and high, and the mean sizes."""
    b = labels.where("class_id is not null and w is not null")
    whole = ((F.col("w") >= full) & (F.col("h") >= full)).cast("double")
    return b.groupBy("class_id").agg(F.count("*").alias("n"), F.round(100 * F.avg(whole), 4).alias("pct_full"), F.round(F.avg("w"), 6).alias("mean_w"), F.round(F.avg("h"), 6).alias("mean_h"))


LADDER = (0.995, 0.99, 0.98, 0.95)


def ladder(pairs: DataFrame, value: str = "correlation", steps: tuple[float, ...] = LADDER) -> DataFrame:
    """How many pairs reach each threshold: one pass, one row of partial counts for each task."""
    v = F.when(~F.isnan(value), F.col(value))
    counts = pairs.agg(*[F.count_if(v >= s).alias(str(i)) for i, s in enumerate(steps)])
    rows = F.array(*[F.struct(F.lit(float(s)).alias("threshold"), F.col(str(i)).alias("n_pairs")) for i, s in enumerate(steps)])
    return counts.select(F.inline(rows))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that raises unless the keys are unique on both sides (null keys aside)."""
    for name, side in (("left", left), ("right", right)):
        if side.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").limit(1).count():
            raise ValueError(f"keys {keys} are not unique on the {name} side")
    return left.join(right, keys, "left")


def whole_or_none(df: DataFrame, columns: list[str]) -> DataFrame:
    """Raise if some row misses all of the columns."""
    missing = F.lit(True)
    for c in columns:
        missing = missing & F.col(c).isNull()
    if df.where(missing).limit(1).count():
        raise ValueError("a row has none of its features")
    return df


def medians_of(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """``by``, ``feature``, ``median_value``: exact medians of the values that are neither null nor NaN, by distributed ranks; null where there are none."""
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(by, columns, "feature", "_x")
    found = quantiles(long, [*by, "feature"], "_x", [0.5]).select(*by, "feature", F.col("_q")[0].alias("median_value"))
    every = df.select(*by).distinct().withColumn("feature", F.explode(F.array(*[F.lit(c) for c in columns]))) if by else found
    return join_on(every, found, [*by, "feature"], "left") if by else found


def imputed(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Nulls and NaNs become the median of their column over the table, or over each group of ``by`` (null keys are a group too).

    A column without any value in a group stays null there.
    """
    by = by or []
    m = medians_of(df, columns, by).groupBy(*by).agg(*[F.max(F.when(F.col("feature") == c, F.col("median_value"))).alias(f"_m_{c}") for c in columns])
    keep = [c for c in df.columns if c not in columns]
    clean = df.select(*keep, *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c)).alias(f"_{c}") for c in columns])
    return join_on(clean, m, by, "left").select(*keep, *[F.coalesce(F.col(f"_{c}"), F.col(f"_m_{c}")).alias(c) for c in columns])


def mode_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """The commonest combination of the columns, its share, and how many there are."""
    g = df.groupBy(*columns).agg(F.count("*").alias("n"))
    best = F.max_by(F.struct(*columns, "n"), F.struct("n", *[-F.col(c) for c in columns]))
    return g.agg(best.alias("m"), F.sum("n").alias("t"), F.count("*").alias("n_distinct")).select(*[F.col(f"m.{c}") for c in columns], F.round(F.col("m.n") / F.col("t"), 6).alias("share"), "n_distinct")


def medians_by(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Exact medians of many columns for each key, one row for each key and column."""
    return medians_of(df, columns, [key])


def survivors(df: DataFrame, group: str = "group_id") -> DataFrame:
    """The row of the least number in each group, least id on ties: a map-side minimum, no sort."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(F.struct("name_number", "item_id")).alias("_r")).select(group, F.col("_r.item_id").alias("item_id"))


def pooled_share(df: DataFrame) -> DataFrame:
    """Rows and positives for each drawing type and for all together, by grouping sets."""
    return (
        df.select("drawing_type", positive(F.col("diagnosis")).alias("_y"))
        .where("drawing_type is not null")
        .rollup("drawing_type")
        .agg(F.count("*").alias("n"), F.sum("_y").alias("n_positive"))
        .select(F.coalesce("drawing_type", F.lit("pooled")).alias("subset"), "n", "n_positive")
    )


def every_nth(df: DataFrame, order: list[str], take: int = 6) -> DataFrame:
    """``take`` rows spread evenly over the order: every floor(n / take)-th, at least each."""
    r = ranked(df, [], order)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / take))
    return r.where((F.pmod("_rank", step) == 0) & (F.floor(F.col("_rank") / step) < take)).drop("_rank", "_n")


def seeded_sample(df: DataFrame, key: str, take: int, seed: int = 0) -> DataFrame:
    """``take`` rows drawn without replacement: those whose keys have the least digest with the seed. The same for the same seed."""
    digest = F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return df.orderBy(digest, key).limit(take)


def score_checks(scores: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """One row that tells whether a table of out-of-fold scores (``item_id``, ``repeat``, ``score``) can be used with the items it
    should cover: ``n_items``, ``n_missing`` (item and repeat without a score), ``n_unknown``, ``n_repeated``, ``n_bad`` (null or NaN) and ``ok``."""
    want = nodes.select("item_id").distinct()
    repeats = scores.select("repeat").where("repeat is not null").distinct()
    got = scores.groupBy("item_id", "repeat").agg(F.count("*").alias("_c"), F.count_if(F.col("score").isNull() | F.isnan("score")).alias("_b"), F.lit(True).alias("_there"))
    all_ = want.withColumn("_want", F.lit(True)).join(repeats).join(got, ["item_id", "repeat"], "full")
    c = all_.agg(
        F.countDistinct(F.when(F.col("_want"), F.col("item_id"))).alias("n_items"),
        F.count_if(F.col("_want") & F.col("_there").isNull()).alias("n_missing"),
        F.count_if(F.col("_want").isNull()).alias("n_unknown"),
        F.count_if(F.col("_c") > 1).alias("n_repeated"),
        F.coalesce(F.sum("_b"), F.lit(0)).alias("n_bad"),
        F.countDistinct(F.when(F.col("_there"), F.col("repeat"))).alias("n_repeats"),
    )
    return c.withColumn("ok", (F.col("n_missing") + F.col("n_unknown") + F.col("n_repeated") + F.col("n_bad") == 0) & (F.col("n_repeats") == k))
