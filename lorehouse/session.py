"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"

RUNTIME_SETTINGS = {
    # created_at::date style casts must not depend on the machine
    "spark.sql.session.timeZone": "UTC",
    # runtime re-planning: small sides become broadcast joins by measured size,
    # partitions of a hot key are split
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on; static settings stay the caller's."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str, cpus: int | str = "*", **extra: str) -> SparkSession:
    """Local session for tests and the benchmark; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a table read from too few splits; others pass unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is computed in one place.

    The optimizer copies plain expressions into filters and branches that use
    them; it does not copy the output of a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="lorehouse-")


def shared_folder(spark: SparkSession) -> str:
    """Folder for lineage cuts: the one the session names, else (local mode only) one of this process."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a shared folder")
    return _local_folder()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A written table survives lost executors, is computed once even when read
    several times, and gives later joins true sizes.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
