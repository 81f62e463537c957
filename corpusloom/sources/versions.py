"""Stores that change as a whole or by keys, while others read them.

A store is a folder with ``parts`` (one folder of Parquet files for each time a bucket was written) and ``commits``. A commit is one
small JSON file that Spark's writer moves into place by a single rename, with a row (version, bucket, folder) for every bucket
of the store. Readers take the rows of the largest version that is there, so they see the store before or after a change and
nothing between; parts that no commit names do not exist for them.

A replaced store writes new parts and then the commit. An upsert reads and writes the buckets that hold keys of the batch and no
others; the other buckets keep the folders they had. So a reader opens one folder per bucket, however many batches there were.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from ..session import cut_lineage, has_at_most

COMMIT = "version long, bucket int, folder string, batch long, stream string"


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(COMMIT).json(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def current(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """The largest committed version (-1 for none) and its folder per bucket, '' for an empty bucket."""
    found = _commits(spark, path)
    last = found.agg(F.max("version")).first()[0] if found is not None else None
    if last is None:
        return -1, {}
    return last, {r["bucket"]: r["folder"] for r in found.where(F.col("version") == last).collect()}  # one row per bucket


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _commit(spark: SparkSession, path: str, version: int, folders: dict[int, str], batch: int | None = None, stream: str | None = None) -> None:
    rows = [(version, b, f, batch, stream) for b, f in sorted(folders.items())]
    spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("append").json(f"{path}/commits")


def _write(rows: DataFrame, path: str, key: str, buckets: int, touched: list[int], version: int) -> dict[int, str]:
    """Write rows as new parts; returns the folder of every touched bucket."""
    folder = f"parts/v{version:08d}-{os.urandom(4).hex()}"
    rows.withColumn("_bucket", _bucket(key, buckets)).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    filled = {r[0] for r in rows.sparkSession.read.parquet(f"{path}/{folder}").select("_bucket").distinct().collect()} if not rows.isEmpty() else set()
    return {b: f"{folder}/_bucket={b}" if b in filled else "" for b in touched}


def replace_store(df: DataFrame, path: str, key: str = "chunk_id", buckets: int = 16) -> int:
    """Replace the whole store; readers go from the old rows to the new ones at the commit. Returns the version."""
    spark = df.sparkSession
    version = current(spark, path)[0] + 1
    folders = _write(cut_lineage(df), path, key, buckets, list(range(buckets)), version)
    _commit(spark, path, version, folders)
    return version


def read_store(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """The rows of the current version (or of an older one, for as long as its parts are kept)."""
    if version is None:
        folders = current(spark, path)[1]
    else:
        folders = {r["bucket"]: r["folder"] for r in _commits(spark, path).where(F.col("version") == version).collect()}
    full = [f"{path}/{f}" for f in folders.values() if f]
    return spark.read.schema(schema).parquet(*full) if full else spark.createDataFrame([], schema)


def upsert_store(batch: DataFrame, path: str, key: str = "chunk_id", order: str | None = None, buckets: int = 16, batch_id: int | None = None,
                 stream: str | None = None) -> int:
    """Insert or replace rows by key; only buckets that hold keys of the batch are read and written. Returns the version.

    Of several rows of a key in the batch the one of largest ``order`` stays, and of equal ones (or without an order) the largest row. With
    a ``batch_id`` and the name of its ``stream`` a batch that is committed already is left out, so a repeated batch counts once. One writer at a time.
    """
    spark = batch.sparkSession
    found = _commits(spark, path)
    version, folders = current(spark, path)
    if found is not None and batch_id is not None and found.where((F.col("batch") == batch_id) & F.col("stream").eqNullSafe(F.lit(stream))).limit(1).count():
        return version
    buckets = len(folders) or buckets
    columns = [c for c in batch.columns if c != key]
    row = F.struct(*columns)
    latest = batch.groupBy(key).agg(F.max_by(row, F.struct(order, row) if order else row).alias("r")).select(key, "r.*").select(*batch.columns)
    latest = cut_lineage(latest)
    touched = sorted(r[0] for r in latest.select(_bucket(key, buckets).alias("b")).distinct().collect())  # at most the number of buckets
    old = [f"{path}/{folders[b]}" for b in touched if folders.get(b)]
    rows = latest
    if old:
        keys = latest.select(key)
        rest = spark.read.schema(batch.schema).parquet(*old).join(F.broadcast(keys) if has_at_most(keys, 100_000) else keys, key, "left_anti")
        rows = latest.unionByName(rest)
    made = _write(rows, path, key, buckets, touched, version + 1) if touched else {}
    _commit(spark, path, version + 1, {b: made.get(b, folders.get(b, "")) for b in range(buckets)}, batch_id, stream)
    return version + 1


def upsert_writer(path: str, key: str = "chunk_id", order: str | None = None, buckets: int = 16, stream: str = "stream") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch is one commit."""
    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_store(batch, path, key, order, buckets, batch_id, stream)
    return write
