"""Numeric Column functions: vector arithmetic, ranking, distribution helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage


def round6(c: Column) -> Column:
    """Six digits by plain arithmetic, for ratios of rounded numbers, where exact halves are common."""
    return F.floor(c * 1e6 + 0.5) / 1e6


def as_doubles(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = l2_norm(a) * l2_norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    n = l2_norm(a)
    return F.transform(as_doubles(a), lambda x: F.when(n > 0, x / n).otherwise(0.0))


def array_mean(a: Column) -> Column:
    return F.aggregate(as_doubles(a), F.lit(0.0), lambda acc, x: acc + x) / F.size(a)


def array_var_pop(a: Column) -> Column:
    m = array_mean(a)
    return F.aggregate(as_doubles(a), F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / F.size(a)


def top_k(df: DataFrame, k: int | Column, by: str | list[str] = "query_id", score: str = "score",
          tie: str = "chunk_id", descending: bool = True, rank: str = "rank") -> DataFrame:
    """The best ``k`` rows of each ``by``, ranked by score, then ``tie`` ascending.

    The filter on row_number lets Spark drop rows beyond ``k`` in each map task, before the shuffle.
    """
    keys = [by] if isinstance(by, str) else by
    order = F.desc(score) if descending else F.asc(score)
    w = Window.partitionBy(*keys).orderBy(order, F.asc(tie))
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def upper_median(df: DataFrame, keys: list[str], value: str, to: str) -> DataFrame:
    """Per key the element at position n // 2 of the ascending order.

    Counts equal values first, so the window works on the histogram and not on the rows; pass
    values from a bounded domain (sizes, scores rounded to six digits).
    """
    hist = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*keys).orderBy(value)
    every = Window.partitionBy(*keys)
    at = (hist.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_n", F.sum("_c").over(every))
          .filter(F.col("_upto") > F.floor(F.col("_n") / 2)))
    return at.groupBy(*keys).agg(F.min(value).alias(to))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key meets a null key; the columns of ``left`` stay and those of ``right`` beyond the keys follow."""
    renamed = right.select(*[F.col(k).alias(f"_right_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_right_{i}")) for i, k in enumerate(keys)]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return left.join(renamed, condition, how).drop(*[f"_right_{i}" for i in range(len(keys))])


def numbered(df: DataFrame, order: str, slices: Column, to: str = "seq", keys: tuple[str, ...] = ()) -> DataFrame:
    """1, 2, 3 ... in ``order`` (per ``keys``), without one task holding a whole key.

    ``slices`` is a value that grows with ``order`` (a day, a bucket of ids). Each slice counts its
    own rows and starts after the slices before it; only the slice counts go through one window.
    Rows with a null key are one key, rows with a null order come first.
    """
    df = df.withColumn("_slice", slices)
    counts = df.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_slice", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(order)
    return (join_null_safe(df, starts, [*keys, "_slice"])
            .withColumn(to, F.col("_start") + F.row_number().over(inside)).drop("_start", "_slice"))


def with_range_parts(df: DataFrame, *order: str, to: str = "_part") -> DataFrame:
    """Stored: rows with the number of the range part in which they lie by ``order``, to number or compare neighbours part by part.

    Parts are ranges of about equal size, whatever the key, so one hot session or a day with most rows lies in many.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return cut_lineage(df.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order]).withColumn(to, F.spark_partition_id()))


def previous(df: DataFrame, keys: list[str], order: str, value: str, slices: Column, to: str) -> DataFrame:
    """Value of the row before in ``order`` per key, without one task holding a whole key.

    Inside a slice it is ``lag``; the first row of a slice takes the last value of the slice before.
    """
    df = df.withColumn("_slice", slices)
    lasts = df.groupBy(*keys, "_slice").agg(F.max_by(value, order).alias("_last"))
    w = Window.partitionBy(*keys).orderBy("_slice")
    before = lasts.select(*keys, "_slice", F.lag("_last").over(w).alias("_before"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(order)
    return (join_null_safe(df.withColumn("_lag", F.lag(value).over(inside)), before, [*keys, "_slice"])
            .withColumn(to, F.coalesce("_lag", "_before")).drop("_lag", "_before", "_slice"))


def rolling_mean(df: DataFrame, seq: str, value: str, rows: int, to: str, block: int = 10_000) -> DataFrame:
    """Mean of ``value`` over the last ``rows`` rows of one order, ``seq`` being 1, 2, 3 ...

    Blocks of consecutive rows are windows of their own; the last ``rows - 1`` rows of a block are
    repeated at the start of the next one, so every frame is whole and no task sees the whole order.
    """
    own = F.floor((F.col(seq) - 1) / block)
    tail = (F.col(seq) - 1) % block >= block - (rows - 1)
    both = df.withColumn("_block", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy("_block").orderBy(seq).rowsBetween(-(rows - 1), Window.currentRow)
    return (both.withColumn(to, F.avg(value).over(w)).filter(F.col("_block") == own).drop("_block"))


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp with or without time zone."""
    return F.unix_micros(ts.cast("timestamp"))
