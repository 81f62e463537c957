"""Session helpers: builder for tests, lineage cutting, size checks and salted joins."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that begin in here leave no shuffle files behind when they have ended.

    Without it the files of a step stay until the driver happens to collect its garbage, although its result is stored. Should they be
    asked for again, Spark makes them anew.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_step(df: DataFrame, path: str, **options) -> DataFrame:
    """Write ``df`` as Parquet and read it again, without what the step shuffled."""
    spark = df.sparkSession
    with freed_shuffles(spark):
        df.write.options(**options).parquet(path)
    return spark.read.parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder shared by the cluster; what the step shuffled goes.

    The folder is ``spark.checkpoint.dir`` of the session. Only a local session without that
    setting gets a folder of its own; on a cluster a missing setting is an error, because a
    machine-local folder would be lost with its executor.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        sc.setCheckpointDir(folder)
    with freed_shuffles(df.sparkSession):
        return df.select("*").checkpoint()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder (or /tmp for a local session)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if base:
        return os.path.join(base, f"{name}-{sc.applicationId}-{os.urandom(6).hex()}")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    return os.path.join(tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp"), name)


def has_at_most(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has no more than ``rows`` rows; reads only until the bound is passed."""
    return df.limit(rows + 1).count() <= rows


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Give a table that is read by fewer tasks than there are cores one part per core.

    A large table already has more parts than cores and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def salted_join(big: DataFrame, small: DataFrame, key: str, spread_by: str, salts: int = 16,
                how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` when a few keys hold a large share of ``big``.

    ``big`` gets a salt from ``spread_by`` and ``small`` is repeated once per salt, so the rows
    of one hot key go to ``salts`` tasks. ``small`` has one row per key (or few).
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")
