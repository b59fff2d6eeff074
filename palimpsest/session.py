"""Session helpers: building a local session, the shared folder, written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Where ``written`` has put its tables in this process.
_WRITTEN: list[str] = []


def local_session(cores: str | int = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("palimpsest")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.extraJavaOptions", "-Xss8m")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent (tests, a laptop) a folder of this machine is made and
    remembered in the session.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        own = spark.conf.get("palimpsest.shared", None)
        if not own:
            own = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
            spark.conf.set("palimpsest.shared", own)
        at = own
    return at.rstrip("/")


def stored(df: DataFrame, name: str, *partition_by: str) -> str:
    """Write ``df`` to the shared folder, where it lives until the driver's JVM ends or ``release`` is called, and give its path."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(at)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    _WRITTEN.append(at)
    return at


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again.

    The table lives outside the executors, so a lost executor costs a task and no table. It is
    registered for deletion when the driver's JVM ends.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name, *partition_by))


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables that ``written`` has made in this process from number ``since`` on, and give how many there are left.

    For long sessions that run many queries: call it when the results of a query are stored. DataFrames that still read such a
    table can't be used afterwards; without a call the tables go when the driver ends.
    """
    jvm = spark._jvm
    for at in _WRITTEN[since:]:
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _WRITTEN[since:]
    return len(_WRITTEN)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
