"""Chunking: two splitters, chunk rows, filters, merging and checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import udtf

from ..functions import fixed_values as V, text as T

MIN_CHUNK = 50


def clamp_chunk_params(size: Column, overlap: Column) -> tuple[Column, Column]:
    """Chunk size and overlap brought into their limits, for parameters that are columns."""
    s = (F.when(size < V.MIN_CHUNK_SIZE, V.MIN_CHUNK_SIZE)
         .when(size > V.MAX_CHUNK_SIZE, V.CAPPED_CHUNK_SIZE).otherwise(size))
    quarter = F.floor(s / 4).cast("int")
    o = (F.when(overlap < V.MIN_OVERLAP, V.RAISED_OVERLAP)
         .when(overlap >= F.floor(s / 2),
               F.when(s < 500, F.least(overlap, quarter)).otherwise(quarter))
         .otherwise(overlap))
    return s.cast("int"), o.cast("int")


def chunk_fixed(docs: DataFrame, size: int, overlap: int, text: str = "text") -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap``; adds chunk_index, replaces text.

    One narrow stage: each document becomes its chunks in the same task. The text is cut into steps in
    one pass and a chunk is a step with the start of the next one, so long documents cost linear time
    and no chunk row carries its whole document.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    others = [c for c in docs.columns if c != text]
    if overlap <= step:
        steps = F.regexp_extract_all(F.col(text), F.lit(f"(?s)(.{{1,{step}}})"), F.lit(1))
        chunks = T.let(steps, lambda p: F.transform(p, lambda s, i: F.concat(
            s, F.left(F.coalesce(F.get(p, i + 1), F.lit("")), F.lit(overlap)))))
    else:
        starts = F.filter(F.sequence(F.lit(0), F.length(text), F.lit(step)), lambda i: i < F.length(text))
        chunks = F.transform(starts, lambda i: F.substring(F.col(text), i + 1, F.lit(size)))
    return docs.select(*others, F.posexplode(chunks).alias("chunk_index", text))


def _pieces(text: str, separator: str, keep: bool) -> list[str]:
    if separator == "":
        return list(text)
    parts = text.split(separator)
    if not keep:
        return [p for p in parts if p]
    return [p for p in [parts[0]] + [separator + q for q in parts[1:]] if p]


def _pack(pieces: list[str], size: int, overlap: int, glue: str) -> Iterator[str]:
    """Fill chunks up to ``size`` and start each next one with the last pieces up to ``overlap``."""
    window: list[str] = []
    length = 0
    for piece in pieces:
        extra = len(piece) + (len(glue) if window else 0)
        if window and length + extra > size:
            yield glue.join(window)
            while window and (length > overlap or length + len(piece) + len(glue) > size):
                length -= len(window[0]) + (len(glue) if len(window) > 1 else 0)
                window.pop(0)
        length += len(piece) + (len(glue) if window else 0)
        window.append(piece)
    if window:
        yield glue.join(window)


def split_recursive(text: str, size: int, overlap: int, separators: list[str], keep: bool) -> list[str]:
    """Cut at the coarsest separator present; pieces still too long are cut at finer ones."""
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    glue = "" if keep else separators[at]
    out: list[str] = []
    short: list[str] = []
    for piece in _pieces(text, separators[at], keep):
        if len(piece) < size:
            short.append(piece)
            continue
        out.extend(_pack(short, size, overlap, glue))
        short = []
        finer = separators[at + 1:]
        out.extend(split_recursive(piece, size, overlap, finer, keep) if finer else [piece])
    out.extend(_pack(short, size, overlap, glue))
    return [c for c in (o.strip() for o in out) if c]


def chunk_text(docs: DataFrame, size: int, overlap: int, enhanced: bool = True) -> DataFrame:
    """Recursive splitter, one document in, many chunks out: (doc_id, source, chunk_index, text).

    The splitter is the only part that Spark has no expression for. ``enhanced`` also cuts after
    sentences and keeps the separators.
    """
    separators = V.SEPARATORS if enhanced else V.BASIC_SEPARATORS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for docs_pdf in batches:
            for doc_id, source, text in docs_pdf.itertuples(index=False):
                chunks = split_recursive(text, size, overlap, separators, enhanced)
                if chunks:
                    yield pd.DataFrame({"doc_id": doc_id, "source": source,
                                        "chunk_index": range(len(chunks)), "text": chunks})

    return (docs.select("doc_id", "source", T.text_of("text").alias("text"))
            .mapInPandas(run, "doc_id long, source string, chunk_index int, text string"))


@udtf(returnType="chunk_index int, chunk string")
class ChunkText:
    """``chunk_text(text, size, overlap[, enhanced])``: the recursive splitter as a table function."""

    def eval(self, text: str, size: int, overlap: int, enhanced: bool = True):
        if text:
            yield from enumerate(split_recursive(text, size, overlap, V.SEPARATORS if enhanced else V.BASIC_SEPARATORS, enhanced))


def register_table_functions(spark) -> None:
    """After this ``SELECT doc_id, c.* FROM documents, LATERAL chunk_text(text, 1000, 150) c`` works in SQL."""
    spark.udtf.register("chunk_text", ChunkText)


def format_chunks(chunks: DataFrame, size: int, overlap: int) -> DataFrame:
    """Chunk rows with id and metadata; the index counts chunks before any filter."""
    return chunks.select(
        "doc_id", "chunk_index", F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_id"), "text",
        F.length("text").alias("chunk_size"),
        F.struct(F.col("source"), F.lit(None).cast("int").alias("page"),
                 F.struct(F.lit(size).alias("size"), F.lit(overlap).alias("overlap")).alias("chunk_params"),
                 ).alias("metadata"))


def filter_valid_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.filter(T.chunk_is_valid(F.col("text")))


def merge_small_chunks(chunks: DataFrame, least: int = MIN_CHUNK) -> DataFrame:
    """Join chunks under ``least`` characters with a neighbour, left to right in each document.

    A small chunk takes its successor, which is then used up; a small last chunk joins what
    precedes it; a lone small chunk stays. In a run of small chunks the 1st, 3rd, 5th ... take
    the one after them, so the position in the run decides and no fold is needed. A window over
    ``doc_id`` holds the chunks of one document, which came from one input row.
    """
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    rn = F.row_number().over(w)
    df = chunks.withColumn("_small", F.length("text") < least).withColumn("_rn", rn)
    big_before = F.coalesce(F.max(F.when(~F.col("_small"), F.col("_rn"))).over(w), F.lit(0))
    df = df.withColumn("_takes", F.col("_small") & ((F.col("_rn") - big_before) % 2 == 1))
    df = df.withColumn("_taken", F.coalesce(F.lag("_takes").over(w), F.lit(False)))
    last = F.lead("_rn").over(w).isNull()
    joins_back = last & F.col("_takes") & ~F.col("_taken") & (F.col("_rn") > 1)
    df = df.withColumn("_head", ~F.col("_taken") & ~joins_back)
    df = df.withColumn("_group", F.sum(F.col("_head").cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return (df.groupBy("doc_id", "_group").agg(parts.alias("p"))
            .select("doc_id", F.col("p")[0]["chunk_index"].alias("chunk_index"),
                    F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"),
                    F.size("p").alias("merged_chunks"),
                    F.array_join(F.transform("p", lambda x: x["chunk_index"].cast("string")), ",")
                    .alias("original_indices")))


def validate_chunks(chunks: DataFrame, least: int = MIN_CHUNK) -> DataFrame:
    """One row per issue: missing text, blank text, too small."""
    text = F.col("text")
    issues = F.array_compact(F.array(
        F.when(text.isNull(), "missing_text"),
        F.when(T.strip(text) == "", "empty_text"),
        F.when(F.length(F.coalesce(text, F.lit(""))) < least, "below_minimum")))
    return (chunks.withColumn("issue", F.explode(issues))
            .select("chunk_id", "issue", F.length(F.coalesce(text, F.lit(""))).alias("size")))
