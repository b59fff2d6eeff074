"""Names of drawings: file paths, drawing types and split labels in one spelling (JVM expressions only).

What copying, exporting or editing puts around a name is not listed anywhere: it is learned from the names. If names
that begin or end with the same words still name a listed file once these words are taken away, the words were added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import written

#: Least share of the names with some words around them that must be listed without these words as well: files are copied from
#: listed ones more often than not, while hardly any name is another one with a word of its own left out.
ADDED_SHARE = 0.05
#: Words without a digit run of their own, then the number: the first number that a word stands before. Possessive, so linear.
_UNIT, END = r"^(?:\d++ )*+(?:(?!\d++(?: |$))[^ ]++ )++\d++", r"(?= |$)"
#: The same with the trial that may follow.
_WHOLE = _UNIT + r"(?: t \d++)?" + END


def same_file(path: Column) -> Column:
    """One spelling for paths that differ only in slash direction, letter case or outer blanks."""
    return F.translate(F.lower(F.trim(path)), "\\", "/")


def spelled(path: Column) -> Column:
    """The file name as words and numbers with single blanks, in lower case: without folders, extension, separators and
    leading zeros, a number set off from the letters before it. ``V07PA002062.jpeg`` becomes ``v07pa 2062``. Null stays null."""
    last = F.substring_index(F.translate(F.lower(path), "\\", "/"), "/", -1)
    bare = F.regexp_replace(F.rtrim(last), r"\.(?:png|jpe?g|bmp|gif|tiff?|webp)$", "")
    words = F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))
    apart = F.regexp_replace(words, r"(?<=\p{L})(?=\d++(?: |$))", " ")
    return F.nullif(F.regexp_replace(apart, r"(?<![^ ])0+(?=\d)", ""), F.lit(""))


def _pattern(words: Column) -> Column:
    return F.regexp_replace(words, r"\d+", "#")


def _added(candidates: DataFrame, listed: DataFrame) -> DataFrame:
    """``words`` that were added to names: of (``type``, ``words``, ``without``), enough of ``without`` are listed names."""
    known = listed.select("type", F.col("name").alias("without"), F.lit(1).alias("_hit"))
    counts = candidates.join(known, ["type", "without"], "left").groupBy("words").agg(F.count("*").alias("n"), F.count("_hit").alias("hits"))
    return written(counts.where(F.col("hits") >= ADDED_SHARE * F.col("n")).select("words"), "added")


def with_cores(names: DataFrame) -> DataFrame:
    """Distinct (``type``, ``stem``) with ``lead`` (added words before the name, as a length in characters), ``unit`` (its words and
    number), ``rest`` (what follows and was not added) and ``trial`` (1 where none is named).

    ``stem`` is spelled as by ``spelled``. A repeat trial (``t 2`` behind the number) is part of the name. A name
    without a number is its words. Of several added beginnings the longest counts. The work on a name of k words is
    at most quadratic in k, which a file system's limit on names bounds.
    """
    listed = written(names.select("type", F.col("stem").alias("name")).distinct(), "names")
    words = F.split("name", " ")
    size = F.size("_w")
    cut = listed.withColumn("_w", words).where(size >= 3).withColumn("_j", F.explode(F.sequence(F.lit(1), size - 2)))
    begun = cut.select("type", "name", "_j", _pattern(F.array_join(F.slice("_w", 1, F.col("_j")), " ")).alias("words"), F.array_join(F.slice("_w", F.col("_j") + 1, size - F.col("_j")), " ").alias("after"))
    begun = written(begun, "beginnings")
    before = _added(begun.select("type", "words", F.coalesce(F.regexp_substr("after", F.lit(_WHOLE)), F.col("after")).alias("without")), listed)
    longest = begun.join(before, "words").groupBy("type", "name").agg(F.max(F.struct("_j", "after")).alias("_m")).select("type", "name", "_m.after")
    s = listed.join(longest, ["type", "name"], "left").select("type", F.col("name").alias("stem"), F.coalesce("after", "name").alias("name"))
    unit = F.coalesce(F.regexp_substr("name", F.lit(_UNIT + END)), F.col("name"))
    s = s.select("type", "stem", "name", unit.alias("unit")).withColumn("_tail", F.trim(F.expr("substring(name, length(unit) + 1)")))
    trial = F.nullif(F.regexp_extract("_tail", r"^t (\d++)(?= |$)", 1), F.lit(""))
    s = s.withColumn("_trial", trial).withColumn("_tail", F.regexp_replace("_tail", r"^t \d++(?: |$)", ""))
    s = written(s.withColumn("words", F.nullif(_pattern(F.substring_index("_tail", " ", 1)), F.lit(""))), "parted")
    whole = F.concat_ws(" ", "unit", F.when(F.col("_trial").isNotNull(), F.concat(F.lit("t "), "_trial")))
    after = _added(s.where("words is not null").select("type", "words", whole.alias("without")), s.select("type", "name").distinct())
    out = s.join(after.withColumn("_known", F.lit(True)), "words", "left")
    return out.select(
        "type",
        "stem",
        (F.length("stem") - F.length("name")).alias("lead"),
        "unit",
        F.when(F.col("_known"), F.lit("")).otherwise(F.col("_tail")).alias("rest"),
        F.coalesce("_trial", F.lit("1")).alias("trial"),
    )


def named(manifest: DataFrame, *keep: Column | str) -> DataFrame:
    """``item_id``, ``type``, ``stem`` (and ``keep``) of rows that have all three; equal rows count once."""
    own = manifest.select(F.col("item_id").cast("long").alias("item_id"), known_type(F.col("drawing_type"), F.col("class_name")).alias("type"), spelled(F.col("path")).alias("stem"), *keep)
    return own.where("item_id is not null and type is not null and stem is not null").distinct()


def known_type(drawing_type: Column, class_name: Column) -> Column:
    """``drawing_type`` in lower case; where it is null the last word of ``class_name``; else null."""
    own = F.nullif(F.lower(F.trim(drawing_type)), F.lit(""))
    word = F.nullif(F.regexp_extract(F.lower(F.trim(class_name)), r"([a-z]+)$", 1), F.lit(""))
    return F.coalesce(own, word)


def part_of(split: Column) -> Column:
    """``train``, ``val`` or ``test`` whatever the spelling; null for anything else."""
    s = F.lower(F.trim(split))
    return (
        F.when(s.isin("train", "training", "tr"), F.lit("train"))
        .when(s.isin("val", "valid", "validation", "dev"), F.lit("val"))
        .when(s.isin("test", "testing", "eval"), F.lit("test"))
    )
