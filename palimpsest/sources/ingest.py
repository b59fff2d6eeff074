"""Readers: image trees, label files, class lists, manifests, pixel caches and reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import kernels
from palimpsest.functions.text import augmented_base, class_parts, file_name, label_path, name_and_number, split_of_path, stem

#: Extensions of images, in lower case.
EXTENSIONS = ("png", "jpg", "jpeg", "bmp")

MANIFEST = T.StructType(
    [T.StructField(n, t) for n, t in [("path", T.StringType()), ("split", T.StringType()), ("class_id", T.IntegerType()), ("class_name", T.StringType()), ("diagnosis", T.StringType()), ("drawing_type", T.StringType()), ("name_prefix", T.StringType()), ("name_number", T.IntegerType())]]
)
CLEAN = T.StructType(MANIFEST.fields + [T.StructField("group_id", T.LongType()), T.StructField("group_size", T.IntegerType()), T.StructField("group_conflict", T.BooleanType()), T.StructField("role", T.StringType()), T.StructField("split_clean", T.StringType())])
PAIRS = T.StructType([T.StructField("correlation", T.DoubleType())] + [T.StructField(n, T.StringType()) for n in ("val_path", "train_path", "val_label", "train_label")])


def file_paths(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path`` and ``bytes`` of all files under a root. Contents are not read: the column is pruned from the scan."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", F.col("length").alias("bytes"))


def is_image(path: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)).isin(*EXTENSIONS)


def _below(root: str, path: F.Column) -> F.Column:
    """Path parts below the root."""
    bare = root.rstrip("/").split("://")[-1].removeprefix("file:")
    return F.split(F.regexp_replace(path, rf"^(?:\w+:)?/*{bare.lstrip('/')}/+", ""), "/")


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """category/split/label/file trees of exactly four levels: ``category, split, label, filename, path``."""
    f = file_paths(spark, root).where(is_image(F.col("path"))).withColumn("_p", _below(root, F.col("path"))).where("size(_p) = 4")
    return f.select(*[F.col("_p")[i].alias(n) for i, n in enumerate(["category", "split", "label", "filename"])], "path")


def class_names(lines: DataFrame, order: str | None = None) -> DataFrame:
    """``class_id``, ``class_name`` from texts that hold ``names: [a, b]`` (YAML files read whole as ``value``).

    Of several such texts that with the least ``order`` (a path) counts, else the least text. Empty names are left out.
    """
    inner = F.regexp_extract("value", r"names:\s*\[([^\]]*)\]", 1)
    found = lines.select(inner.alias("_n"), F.col(order or "value").alias("_o")).where("_n <> ''").agg(F.min_by("_n", F.struct("_o", "_n")).alias("_n"))
    bare = F.transform(F.split("_n", ","), lambda c: F.trim(F.regexp_replace(c, "^\\s*['\"]|['\"]\\s*$", "")))
    return found.select(F.posexplode(F.filter(bare, lambda c: c != "")).alias("class_id", "class_name"))


def label_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """``class_id`` and, from five tokens on, box width and height ``w``, ``h`` of a label line; null where it does not parse."""
    t = F.split(F.trim(F.col(line)), r"\s+")
    num = lambda i: F.get(t, F.lit(i)).try_cast("double")
    five = F.size(t) >= 5
    return df.select("*", F.floor(num(0)).cast("int").alias("class_id"), F.when(five, num(3)).alias("w"), F.when(five, num(4)).alias("h"))


#: A name ends so where a file is an augmented copy.
AUGMENTED = r"_aug\d+$"


def build_manifest(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The manifest of a tree of images and labels, and counts of what was left out or looks odd.

    The split is told by the folders below the root; a class id without a name goes by its number. Counts: ``augmented``, ``without_label``,
    ``unreadable_label`` (all left out) and ``prefix_disagrees`` (kept: the name begins otherwise than the label's diagnosis).
    """
    whole = lambda glob: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    names = class_names(whole("*.y*ml").select("value", F.col("_metadata.file_path").alias("path")), "path")
    files = file_paths(spark, root).where(is_image(F.col("path"))).select("path")
    below = _below(root, F.col("path"))
    s = stem(F.col("path"))
    folders = F.concat_ws("/", F.slice(below, 1, F.greatest(F.size(below) - 1, F.lit(0))))
    files = files.select("path", split_of_path(folders).alias("split"), s.alias("_stem"), s.rlike(AUGMENTED).alias("_aug"), label_path(F.col("path")).alias("_label"))
    labels = label_lines(
        whole("*.txt").select(F.col("_metadata.file_path").alias("_label"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("value"))
    ).select(_plain("_label").alias("_label"), "class_id", F.lit(True).alias("_found"))
    j = files.withColumn("_label", _plain("_label")).join(labels, "_label", "left").join(names, "class_id", "left")
    prefix, number = name_and_number(F.col("_stem"))
    j = j.withColumn("class_name", F.coalesce("class_name", F.col("class_id").cast("string")))
    diagnosis, kind = class_parts(F.col("class_name"))
    own, found, read = ~F.col("_aug"), F.col("_found").isNotNull(), F.col("class_id").isNotNull()
    problems = j.agg(
        F.count_if("_aug").alias("augmented"),
        F.count_if(own & ~found).alias("without_label"),
        F.count_if(own & found & ~read).alias("unreadable_label"),
        F.count_if(own & read & (prefix != "") & (prefix != diagnosis)).alias("prefix_disagrees"),
    )
    rows = j.where(own & read)
    return rows.select("path", "split", "class_id", "class_name", diagnosis.alias("diagnosis"), kind.alias("drawing_type"), prefix.alias("name_prefix"), number.alias("name_number")), problems


def _plain(c: str) -> F.Column:
    return F.regexp_replace(c, r"^\w+:/+", "/")


def read_csv(spark: SparkSession, path: str, schema: T.StructType = MANIFEST) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_gray(spark: SparkSession, root: str) -> DataFrame:
    """``path, height, width, x`` (grey, row-major) of all images that the JVM can decode; alpha is dropped."""
    img = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(root).select("image.*")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for d, h, w, c in zip(f["data"], f["height"], f["width"], f["nChannels"]):
                a = np.frombuffer(d, np.uint8).reshape(h, w, c)
                out.append((a[:, :, 0] if c == 1 else kernels.luma(a[:, :, 2::-1])).reshape(-1).astype(np.int16))
            yield pd.DataFrame({"path": f["origin"], "height": f["height"], "width": f["width"], "x": out})

    return img.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, "path string, height int, width int, x array<smallint>")


def image_facts(spark: SparkSession, root: str) -> DataFrame:
    """``path, width, height, mode`` (L, RGB or RGBA), ``is_rgba`` and ``filesize`` of all images that the JVM can decode. Pixels are not brought along."""
    i = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(root).select("image.origin", "image.width", "image.height", "image.nChannels")
    mode = F.when(F.col("nChannels") == 1, "L").when(F.col("nChannels") == 3, "RGB").when(F.col("nChannels") == 4, "RGBA")
    sizes = file_paths(spark, root).select(_plain("path").alias("_p"), F.col("bytes").alias("filesize"))
    j = i.withColumn("_p", _plain("origin")).join(sizes, "_p", "left")
    return j.select(F.col("origin").alias("path"), "width", "height", mode.alias("mode"), (F.col("nChannels") == 4).cast("int").alias("is_rgba"), "filesize")


def read_npz(spark: SparkSession, path: str, key: str = "X") -> DataFrame:
    """Pixel caches kept as NPZ files: ``file, item_id`` (position), ``height, width, x`` and the parallel string arrays as a map."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for f in frames:
            for p, content in zip(f["path"], f["content"]):
                z = np.load(io.BytesIO(content), allow_pickle=False)
                x = z[key]
                other = [k for k in z.files if k != key and z[k].shape[:1] == x.shape[:1] and z[k].ndim == 1]
                for lo in range(0, len(x), 1_000):
                    part = x[lo : lo + 1_000]
                    yield pd.DataFrame(
                        {"file": p, "item_id": np.arange(lo, lo + len(part)), "height": x.shape[1], "width": x.shape[2], "x": list(part.reshape(len(part), -1).astype(np.int16)), "meta": [{k: str(z[k][lo + i]) for k in other} for i in range(len(part))]}
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, item_id long, height int, width int, x array<smallint>, meta map<string,string>")


def read_reports(spark: SparkSession, glob: str) -> DataFrame:
    """``run`` (file stem) and ``value`` (whole text) of markdown reports."""
    r = spark.read.text(glob, wholetext=True)
    return r.select(stem(F.col("_metadata.file_path")).alias("run"), "value")


def tree_summary(spark: SparkSession, root: str) -> DataFrame:
    """Images of all top folders by top folder, split and whether augmented."""
    f = file_paths(spark, root).where(is_image(F.col("path")))
    base, aug = augmented_base(stem(F.col("path")))
    return f.select(_below(root, F.col("path"))[0].alias("top"), split_of_path(F.col("path")).alias("split"), aug.alias("augmented"), base.alias("base"), file_name(F.col("path")).alias("file")).groupBy("top", "split", "augmented").agg(
        F.count("*").alias("n"), F.countDistinct("base").alias("n_bases")
    )
