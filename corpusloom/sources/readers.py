"""Readers for text files, pages, logs, question files and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import scores as S, text as T
from .files import list_folder, read_folder


def read_text_files(spark: SparkSession, path: str, glob: str = "*.txt", recursive: bool = True
                    ) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): one row per file; empty files go to the rejects."""
    files = (spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=recursive)
             .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("source"),
                     F.col("value").alias("text")))
    docs = files.filter(F.length("text") > 0).withColumn("n_chars", F.length("text"))
    return docs, list_folder(spark, path, glob, recursive).filter("size = 0").select("path", F.lit("empty file").alias("reason"))


def read_corpus(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of a document table; rows without text are rejected."""
    blank = T.strip(T.text_of("text")) == ""
    good = docs.filter(~blank).select("doc_id", "lang", "source", "text", F.length("text").cast("long").alias("n_chars"))
    return good, docs.filter(blank).select("doc_id", F.lit("empty text").alias("reason"))


def pages_to_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", T.page_to_text(T.text_of("html")).alias("text"))


def list_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, name, size, modified) of all files, empty ones too; contents are not read."""
    return list_folder(spark, path, glob, recursive)


def file_manifest(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, name, extension, size, modified, sha256) of every file."""
    return read_folder(spark, path, glob, recursive).select(
        "path", "name", F.lower(F.regexp_extract("name", r"(\.[^./]+)$", 1)).alias("extension"), "size", "modified", F.sha2("content", 256).alias("sha256"))


def document_manifest(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, sha256, size, chunk_count) of a document table."""
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return (docs.select("doc_id", T.content_hash(T.text_of("text")).alias("sha256"),
                        F.octet_length(T.text_of("text")).cast("long").alias("size"))
            .join(counts, "doc_id", "left")
            .withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))))


def read_jsonl_log(spark: SparkSession, path: str, schema=schemas.QUERY_LOG) -> DataFrame:
    """Log entries of any of the log schemas; lines that are no JSON or hold none of the schema's plain fields are
    skipped, and so are routing events (with an event_type) where the schema has them."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    plain = [F.col(f.name).cast("string") for f in rows.schema.fields if f.dataType.typeName() not in ("struct", "array", "map") and f.name != "event_type"]
    rows = rows.filter(F.coalesce(*plain).isNotNull())
    return rows.filter("event_type IS NULL").drop("event_type") if "event_type" in rows.columns else rows


def read_feedback_log(spark: SparkSession, path: str) -> DataFrame:
    """Feedback entries of a JSON-lines log."""
    return read_jsonl_log(spark, path, schemas.FEEDBACK)


def read_qa(spark: SparkSession, paths: dict[str, str], multi_line: bool = True) -> DataFrame:
    """(source, question, answer) from JSON arrays, one folder or file per source."""
    parts = [spark.read.schema(schemas.QA).option("multiLine", multi_line).json(path)
             .select(F.lit(source).alias("source"), "question", "answer") for source, path in paths.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def qa_from_conversations(turns: DataFrame) -> DataFrame:
    """A user turn followed by an assistant turn is a question with its answer.

    The follower is found by the position in the conversation, so a conversation of any length is
    spread over tasks: numbered slices of turns, then an equi-join on (conversation, next position).
    """
    numbered = S.numbered(turns.select("conv_id", "turn", "role", "text"), "turn",
                          F.floor(F.col("turn") / 1000), keys=("conv_id",))
    asked = numbered.filter("role = 'user'").select(
        "conv_id", "turn", (F.col("seq") + 1).alias("seq"), F.col("text").alias("question"))
    replied = numbered.filter("role = 'assistant'").select("conv_id", "seq", F.col("text").alias("answer"))
    return asked.join(replied, ["conv_id", "seq"]).select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("query_id"), "question", "answer")


def load_chunk_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
