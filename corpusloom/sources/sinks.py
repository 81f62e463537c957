"""Writers: chunk stores, logs and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException


def save_chunk_store(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replace a store. The old files are removed before the new ones are committed: a run that fails in
    between leaves no store, so write to a new path and switch readers where that matters."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def dimension(vectors: DataFrame) -> int | None:
    """The one dimension of all vectors; None for an empty frame; an error if they differ."""
    row = vectors.agg(F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi"),
                      F.count_if(F.col("embedding").isNull() | F.col("text").isNull()).alias("gaps")
                      if "text" in vectors.columns else F.count_if(F.col("embedding").isNull()).alias("gaps")).first()
    if row["gaps"]:
        raise ValueError(f"{row['gaps']} rows have a text without a vector or a vector without a text")
    if row["lo"] != row["hi"]:
        raise ValueError(f"vectors have {row['lo']} to {row['hi']} dimensions")
    return row["lo"]


def stored_dimension(spark: SparkSession, path: str) -> int | None:
    """The dimension of a store, from one of its rows; None if there is no store at the path.

    Anything else that cannot be read (other columns, broken files) is an error and not an empty store.
    """
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    if "embedding" not in stored.columns:
        raise ValueError(f"{path} holds columns {stored.columns} and no embedding; it is left as it is")
    row = stored.select(F.size("embedding").alias("n")).where("embedding IS NOT NULL").first()
    return row["n"] if row else None


def update_store(spark: SparkSession, path: str, new: DataFrame, append: bool = True) -> str:
    """Append to or replace a store; vectors of another dimension replace it. Returns what was done."""
    dims = dimension(new)
    old = stored_dimension(spark, path)
    mode = "append" if append and old is not None and old == dims else "overwrite"
    new.write.mode(mode).parquet(path)
    return mode


def write_jsonl_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
