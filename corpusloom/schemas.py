"""Fixed schemas of files (DDL text) and the check that operators use at their entry."""

from __future__ import annotations

from pyspark.sql import DataFrame

QUERY_LOG = (
    "timestamp TIMESTAMP, session_id STRING, query STRING, query_hash LONG, latency DOUBLE, hit_count INT, "
    "event_type STRING, metadata STRUCT<search_type: STRING>, "
    "retrieval_details STRUCT<chunks_retrieved: INT, similarity_scores: ARRAY<DOUBLE>, context_length: INT, "
    "context_quality_score: DOUBLE>")

FEEDBACK = (
    "feedback_id STRING, timestamp TIMESTAMP, question STRING, context STRING, answer STRING, "
    "feedback STRUCT<type: STRING, text: STRING>, "
    "performance STRUCT<total_processing_time: DOUBLE, retrieval_time: DOUBLE, feedback_delay_seconds: DOUBLE>, "
    "retrieval_metrics STRUCT<engine_used: STRING, chunks_retrieved: INT, max_similarity: DOUBLE>, "
    "session_info STRUCT<session_id: STRING, query_hash: LONG>")

QA = "question STRING, answer STRING"


def need(df: DataFrame, *columns: str) -> DataFrame:
    """The frame itself, or an error that names the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df
