"""Shared helpers: word rules, Arrow buffers as numpy arrays, bounded samples, table reading."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusloom.session import cut_lineage, has_at_most, scratch_folder

#: A word is a run of bytes that are neither a space nor one of the five ASCII control spaces.
SPACES = "\x20\x09-\x0D"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else, whatever the locale."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row limits (n + 1) of a string array without copying; nulls are empty rows."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    _, at, data = array.buffers()
    limits = np.frombuffer(at, np.int64 if wide else np.int32)[array.offset:array.offset + len(array) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = int(limits[0]) if len(limits) else 0
    return whole[first:int(limits[-1])], limits - first


def row_blocks(limits: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay below ``most``; a longer row is a range of its own."""
    n, start = len(limits) - 1, 0
    while start < n:
        end = int(np.searchsorted(limits, limits[start] + most, side="right")) - 1
        end = min(n, max(start + 1, end))
        yield start, end
        start = end


def gather_ragged(values: np.ndarray, limits: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate rows ``wanted`` of the ragged array (values, limits); returns the values and their limits."""
    sizes = limits[wanted + 1] - limits[wanted]
    ends = np.cumsum(sizes)
    out_limits = np.concatenate([[0], ends])
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(limits[wanted] - out_limits[:-1], sizes)
    return values[at], out_limits


def bounded_sample(labelled: DataFrame, label: str, text: str, key: str, per_label: int, most_labels: int,
                   seed: int) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by a hash of the key and never more than twice that many.

    The labels are counted first over the narrow columns, so texts of rows outside the sample are
    dropped in the task that read them. More than ``most_labels`` labels are an error.
    """
    counts = labelled.groupBy(label).count().limit(most_labels + 1).collect()
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    share = F.lit(0.0)
    for row in counts:
        share = F.when(F.col(label) == row[0], F.lit(min(1.0, per_label / row[1]))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return labelled.where(draw < share).limit(2 * per_label * max(1, len(counts)))


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it again: cuts lineage, survives lost executors."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds ``pos`` (from 0, by ``order`` inside ``group``) and ``total`` (rows of the group); no task holds a whole group.

    Two passes: rows are range-partitioned and sorted, each part's rows per group are counted, and the running
    sums of these counts (one row per part and group) give every part its offset. Rows equal in ``order`` are told
    apart by the place at which they were read, so a group of equal rows spreads as well.
    """
    tied = stored(rows.withColumn("_tie", F.monotonically_increasing_id()), f"{name}-rows")
    line = [F.col(c).asc_nulls_first() for c in (group, *order, "_tie")]
    lined = stored(tied.repartitionByRange(*line).sortWithinPartitions(*line).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), f"{name}-lined")
    lined = lined.withColumn("_part", F.shiftright("_at", 33))
    own = Window.partitionBy("_g")
    counts = (lined.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
              .withColumn("_offset", F.sum("_n").over(own.orderBy("_p")) - F.col("_n")).withColumn("total", F.sum("_n").over(own)))
    return (lined.join(counts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
            .withColumn("pos", F.col("_at") - F.col("_first") + F.col("_offset")).drop("_at", "_part", "_g", "_p", "_first", "_n", "_offset"))


#: Rows of one key above which a join spreads it, and the tasks it is spread over.
HOT_ROWS = 20_000
SALTS = 64


def join_hot(big: DataFrame, small: DataFrame, on: str, spread: Column) -> DataFrame:
    """Inner equi-join where ``small`` has one row per key and a few keys may hold a large share of ``big``.

    Keys are counted first (folded before the shuffle). Only rows of keys above ``HOT_ROWS`` get a salt from ``spread``, and
    only their row of ``small`` is repeated. Columns of ``small`` besides the key must be new.
    """
    hot = cut_lineage(big.groupBy(on).agg(F.count("*").alias("_rows")).where(F.col("_rows") > HOT_ROWS).select(on, F.lit(True).alias("_hot")))
    if hot.isEmpty():
        return big.join(small, on)
    hot = F.broadcast(hot) if has_at_most(hot, 100_000) else hot
    left = big.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(small.join(hot, on, "left").withColumn("_salt", F.explode(salts)).drop("_hot"), [on, "_salt"]).drop("_salt")
