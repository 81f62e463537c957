"""Structured Streaming forms of ingestion, search and log statistics.

Each function takes a streaming frame and returns a streaming frame or a writer; ``run_once`` works
off what has arrived and stops. State is keyed and bounded by watermarks; progress is in the
checkpoint folder, so a restarted stream continues where it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.utils import AnalysisException

from ..functions import text as T
from ..operators import chunking, lexical


def table_stream(spark: SparkSession, folder: str, file_glob: str, schema) -> DataFrame:
    """New parquet files of a folder as a stream; every file is read once."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file_glob).parquet(folder)


def run_once(writer: DataStreamWriter, checkpoint: str):
    """Process all available data, then stop; returns the finished query."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def ingest(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Documents to valid chunks: prepare, chunk, filter. No state and no shuffle."""
    ready = docs.select("doc_id", "source", T.prepare_text(T.text_of("text")).alias("text"))
    chunks = chunking.filter_valid_chunks(chunking.chunk_fixed(ready, size, overlap))
    return chunks.withColumn("chunk_id", F.concat_ws("-", "doc_id", "chunk_index"))


def dedup(docs: DataFrame, horizon: str = "24 hours") -> DataFrame:
    """One document per content within the horizon. Needs a ``ts`` column."""
    hashed = docs.withColumn("content_hash", T.content_hash(T.normalize_text(T.text_of("text"))))
    return hashed.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["content_hash"])


def query_metrics(log: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Per window and engine: entries, mean latency, zero hits. Later rows than ``late`` are dropped; Spark
    counts them in the progress as numRowsDroppedByWatermark."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (log.withWatermark("ts", late).groupBy(window.alias("w"), "engine")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency"), 6).alias("avg_latency"),
                 F.count_if(F.col("hit_count") == 0).alias("zero_hits"))
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "engine", "n", "avg_latency", "zero_hits"))


def feedback_rate(feedback: DataFrame, width: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Positive share per sliding window, for update mode."""
    return (feedback.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("type") == "positive").alias("positive"))
            .select(F.col("w.start").alias("start"), "n", "positive",
                    F.round(F.col("positive") / F.col("n"), 6).alias("rate")))


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return (log.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "session_id")
            .agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("latency"), 6).alias("avg_latency"))
            .select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "queries", "avg_latency"))


# --- upserts ------------------------------------------------------------------------------------
# A store of upserts is a folder with one part per batch. A batch that is run again after a failure
# replaces its own part and nothing else, so it counts once. Readers take the row of the latest batch.

def next_batch(spark: SparkSession, path: str) -> int:
    """One more than the largest batch of a store (0 for a new one): the ``first`` of a stream with a new checkpoint."""
    try:
        rows = spark.read.option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return 0
        raise
    return int(rows.agg(F.max("batch")).first()[0]) + 1


def upsert_batch(path: str, key: str = "chunk_id", order: str | None = None, first: int = 0) -> Callable[[DataFrame, int], None]:
    """Writer of one part per batch, with one row per key.

    Of several rows of a key in one batch the one of largest ``order`` stays, and of equal ones (or without an
    order) the largest row, so the result does not depend on the order of arrival. A stream that starts with a
    new checkpoint counts batches from 0 again and must pass ``first=next_batch(...)``, which keeps older parts.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        columns = [c for c in batch.columns if c != key]
        row = F.struct(*columns)
        by = F.struct(order, row) if order else row
        latest = batch.groupBy(key).agg(F.max_by(row, by).alias("r")).select(key, "r.*")
        latest.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={first + batch_id}")
    return write


def read_upserted(spark: SparkSession, path: str, key: str = "chunk_id") -> DataFrame:
    """The latest row of every key. Rows fold in each map task before they are shuffled."""
    rows = spark.read.option("basePath", path).parquet(path)
    columns = [c for c in rows.columns if c not in (key, "batch")]
    return (rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("r")).select(key, "r.*"))


def compact(spark: SparkSession, path: str, to: str, key: str = "chunk_id") -> None:
    """Write the current rows as the first batch of a new folder."""
    read_upserted(spark, path, key).write.mode("overwrite").parquet(f"{to}/batch=-1")


def match_batch(index: lexical.TermIndex, path: str, k: int) -> Callable[[DataFrame, int], None]:
    """Search each batch of arriving queries in a stored index; a batch writes its own part."""
    def write(batch: DataFrame, batch_id: int) -> None:
        lexical.bm25_search(batch, index, k).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write
