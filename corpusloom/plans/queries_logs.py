"""Registered queries: statistics of chunks, logs and feedback (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V, text as T
from ..operators import fusion, logs, quality
from ..sources import readers
from . import sqlparts as Q
from .registry import query

LOGS = {
    "log": """SELECT event_id, ts::TIMESTAMP AS ts, user_id::VARCHAR AS session_id, event_type AS engine, value AS latency,
                     (props->>'$.k')::INT AS hit_count, (props->>'$.k')::INT / 100.0 AS quality FROM events""",
    "feedback": """SELECT doc_id AS feedback_id, ts, CASE quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' END AS type,
                     engine, hit_count / 100.0 AS score, latency AS processing_time
                   FROM labels JOIN (SELECT event_id, ts, engine, hit_count, latency FROM log) g ON g.event_id = labels.doc_id""",
    "expected": f"""
        SELECT query_id, pos, CASE pos WHEN 1 THEN 'required' WHEN 2 THEN 'keyword' ELSE 'context' END AS kind, phrase FROM (
          SELECT query_id, w AS phrase, row_number() OVER (PARTITION BY query_id ORDER BY length(w) DESC, w) AS pos FROM (
            SELECT query_id, unnest({Q.words('query')}) AS w FROM queries)) WHERE pos <= 3""",
}


def log_of(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select("event_id", "ts", F.col("user_id").cast("string").alias("session_id"),
                           F.col("event_type").alias("engine"), F.col("value").alias("latency"),
                           k.alias("hit_count"), (k / 100.0).alias("quality"))


def feedback_of(t):
    """Labels as feedback on the log entry with the same number."""
    return t.labels.join(log_of(t).withColumnRenamed("quality", "score"), F.col("event_id") == F.col("doc_id")).select(
        F.col("doc_id").alias("feedback_id"), "ts",
        F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative").alias("type"),
        "engine", "score", F.col("latency").alias("processing_time"))


def expectations_of(t):
    """(query_id, pos, kind, phrase): the three longest words of each benchmark text."""
    words = F.array_sort(F.transform(T.word_set(F.col("query")), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return (t.queries.select("query_id", F.posexplode(F.slice(words, 1, 3)).alias("p", "x"))
            .select("query_id", (F.col("p") + 1).alias("pos"),
                    F.when(F.col("p") == 0, "required").when(F.col("p") == 1, "keyword").otherwise("context").alias("kind"),
                    F.col("x.w").alias("phrase")))


@query("g1_chunk_distribution", Q.sql("""
    SELECT *, round(100.0 * small / n, 6) AS small_pct, round(100.0 * normal / n, 6) AS normal_pct, round(100.0 * large / n, 6) AS large_pct
    FROM (SELECT count(*) AS n, min(s)::INT AS min_size, max(s)::INT AS max_size, round(avg(s), 6) AS avg_size,
            count(*) FILTER (s < 50) AS small, count(*) FILTER (s BETWEEN 50 AND 2000) AS normal, count(*) FILTER (s > 2000) AS large,
            list_sort(list(s))[count(*) // 2 + 1]::INT AS median_upper FROM (SELECT length(text) AS s FROM raw_chunks))"""))
def _(t):
    return logs.chunk_distribution(t.raw_chunks)


@query("g2_content_stats", Q.sql("""
    SELECT *, round(100.0 * matching / n, 6) AS matching_pct, n BETWEEN 100 AND 400 AS fitting_count,
           avg_size BETWEEN 300 AND 1200 AS fitting_size, matching > 0 AS has_matching
    FROM (SELECT count(*) AS n, min(length(text))::INT AS min_size, max(length(text))::INT AS max_size, round(avg(length(text)), 6) AS avg_size,
            count(*) FILTER (regexp_matches(text, '(?i)licen[sc]e|copyright')) AS matching FROM chunks)"""))
def _(t):
    return logs.content_stats(t.chunks, "(?i)licen[sc]e|copyright")


@query("g3_processing_stats", Q.sql("""
    SELECT lang, count(*) AS documents, sum(coalesce(n, 0))::BIGINT AS chunks, sum(strlen(text))::BIGINT AS bytes,
           round(avg(coalesce(n, 0)), 6) AS avg_chunks, round(avg(strlen(text)), 6) AS avg_bytes
    FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) USING (doc_id) GROUP BY 1"""))
def _(t):
    manifest = readers.document_manifest(t.documents, t.chunks).join(t.documents.select("doc_id", "lang"), "doc_id")
    return logs.processing_stats(manifest, "lang")


@query("g4_score_distribution", Q.sql("""
    SELECT query_id, n, max(score) AS highest, min(score) AS lowest, max(CASE WHEN rank - 1 = n // 2 THEN score END) AS median_upper,
           round(max(score) - min(score), 6) AS score_range,
           round(avg(CASE WHEN n < 4 OR rank - 1 < n // 4 THEN score END), 6) AS top_quarter,
           round(avg(CASE WHEN n < 4 OR rank - 1 >= n - n // 4 THEN score END), 6) AS bottom_quarter
    FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM vec20) GROUP BY 1, 2"""))
def _(t):
    return logs.score_distribution(t.vector_hits(20))


@query("g5_context_quality", Q.sql(f"""
    SELECT query_id, round(list_avg(list_filter([m, CASE WHEN n > 1 THEN greatest(0, 1 - v) END,
        CASE WHEN length(context) < 500 THEN length(context) / 500.0 WHEN length(context) <= 5000 THEN 1.0
             ELSE greatest(0.5, 1 - (length(context) - 5000) / 10000.0) END,
        {Q.overlap('query', 'context')}], lambda x: x IS NOT NULL)), 6) AS quality
    FROM (SELECT query_id, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM (
            SELECT query_id, least(1, greatest(0, score)) AS x FROM vec10) GROUP BY 1)
    JOIN ctx USING (query_id) JOIN queries USING (query_id)""",
    ctx=Q.context_sql("(SELECT query_id, rank, source, text FROM vec10 JOIN chunks USING (chunk_id))", 8000)))
def _(t):
    hits = t.vector_hits(10)
    contexts = fusion.assemble_context(fusion.with_text(hits, t.chunks), 8000)
    scores = hits.groupBy("query_id").agg(F.collect_list("score").alias("scores"))
    return contexts.join(scores, "query_id").join(t.queries, "query_id").select(
        "query_id", F.round(quality.context_quality(F.col("query"), F.col("context"), F.col("scores")), 6).alias("quality"))


@query("g6_query_patterns", Q.sql("""
    SELECT engine, count(*) AS uses, round(avg((quality > 0.5)::INT), 6) AS success_rate,
           round(avg(CASE WHEN latency > 0 THEN latency END), 6) AS avg_latency
    FROM (SELECT * FROM log ORDER BY ts DESC, event_id DESC LIMIT 50) GROUP BY 1""", **LOGS))
def _(t):
    return logs.query_patterns(log_of(t))


@query("g7_zero_hit_queries", Q.sql("""
    SELECT engine, session_id, count(*) AS times, max(ts) AS last_ts FROM log WHERE hit_count = 0 GROUP BY 1, 2""", **LOGS))
def _(t):
    return logs.zero_hit_queries(log_of(t), ["engine", "session_id"])


@query("g8_latency_stats", Q.sql("""
    SELECT engine, count(*) AS n, min(latency) AS min_latency, max(latency) AS max_latency, round(avg(latency), 6) AS avg_latency,
           round(sum(latency), 4) AS total_latency, max(CASE WHEN r = 1 THEN latency END) AS latest FROM (
      SELECT *, row_number() OVER (PARTITION BY engine ORDER BY ts DESC, event_id) AS r FROM log QUALIFY r <= 1000) GROUP BY 1""", **LOGS))
def _(t):
    return logs.latency_stats(log_of(t))


_FEEDBACK_COLS = """count(*) AS total, count(*) FILTER (type = 'positive') AS positive, count(*) FILTER (type = 'negative') AS negative,
    round(avg((type = 'positive')::INT), 6) AS positive_rate"""


@query("g9_feedback_summary", Q.sql(f"""
    SELECT {_FEEDBACK_COLS}, round(avg(score), 6) AS avg_score, round(avg(processing_time), 6) AS avg_time
    FROM (SELECT * FROM feedback ORDER BY ts DESC, feedback_id DESC LIMIT 20)""", **LOGS))
def _(t):
    return logs.feedback_summary(feedback_of(t))


@query("g10_feedback_analytics", Q.sql(f"""
    SELECT {_FEEDBACK_COLS}, round(avg(score) FILTER (type = 'positive'), 6) AS positive_score,
           round(avg(score) FILTER (type = 'negative'), 6) AS negative_score, round(avg(processing_time), 6) AS avg_time
    FROM feedback WHERE ts >= (SELECT max(ts) FROM feedback) - INTERVAL 2 DAY""", **LOGS))
def _(t):
    feedback = feedback_of(t)
    return logs.feedback_analytics(feedback, 2, feedback.agg(F.max("ts")).scalar())


@query("g11_engine_breakdown", Q.sql(f"SELECT engine, {_FEEDBACK_COLS} FROM feedback GROUP BY 1", **LOGS))
def _(t):
    return logs.engine_breakdown(feedback_of(t))


@query("g12_negative_patterns", Q.sql("""
    SELECT feedback_id, ts, engine, score, processing_time FROM feedback WHERE type = 'negative'
    ORDER BY ts DESC, feedback_id DESC LIMIT 10""", **LOGS))
def _(t):
    return logs.negative_patterns(feedback_of(t))


_NEAR = ["the", "and", "der", "les"]
_PATTERN = "(?i)licen[sc]e|copyright|@"


@query("g13_pattern_distribution", Q.sql(f"""
    SELECT count(*) FILTER (m > 0) AS matching_chunks, sum(m)::BIGINT AS matches,
           {', '.join(f"count(*) FILTER (m > 0 AND contains(low, '{w}')) AS with_{w}" for w in _NEAR)}
    FROM (SELECT len(regexp_extract_all(text, '{_PATTERN}')) AS m, lower(text) AS low FROM chunks)"""))
def _(t):
    return logs.pattern_distribution(t.chunks, _PATTERN, _NEAR)


_PROC = ["on", "der", "les"]


@query("g14_structure_profile", Q.sql(f"""
    SELECT class, count(*) AS chunks, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS ratio, round(avg(n), 6) AS avg_length,
           count(*) FILTER (n < 500) AS short, count(*) FILTER (n >= 500 AND n < 1500) AS medium, count(*) FILTER (n >= 1500) AS long
    FROM (SELECT length(text) AS n, CASE WHEN length(text) - length(replace(text, chr(10), '')) > 10 AND {Q.any_of('text', V.LIST_MARKS)} THEN 'directory'
            WHEN {Q.any_of('lower(text)', _PROC)} THEN 'procedural' ELSE 'reference' END AS class FROM chunks) GROUP BY 1"""))
def _(t):
    return logs.structure_profile(t.chunks, _PROC)


_CONCERN, _PROCESS, _FOLLOW = ["ein", "ion"], ["der", "the", "les", "and"], ["on", "ich"]


@query("g15_complete_process_chunks", Q.sql(f"""
    SELECT chunk_id, {Q.count_of('lower(text)', _PROCESS)} AS process_words FROM chunks
    WHERE {Q.any_of('lower(text)', _CONCERN)} AND {Q.count_of('lower(text)', _PROCESS)} >= 2 AND {Q.any_of('lower(text)', _FOLLOW)}"""))
def _(t):
    return logs.complete_process_chunks(t.chunks, _CONCERN, _PROCESS, _FOLLOW)


COVERAGE = {**LOGS, "expected_chunks": "SELECT DISTINCT chunk_id, phrase FROM bm10 JOIN expected USING (query_id) WHERE rank <= 3",
            "coverage": """
    SELECT *, round(100.0 * found / expected, 1) AS coverage_pct, found::DOUBLE / expected < 0.5 AS poor FROM (
      SELECT chunk_id, count(*) AS expected, count(*) FILTER (contains(lower(text), lower(phrase))) AS found, bool_or(text IS NOT NULL) AS present
      FROM expected_chunks LEFT JOIN chunks USING (chunk_id) GROUP BY 1)"""}


def _expected_chunks(t):
    return (t.bm25_hits(3).join(expectations_of(t), "query_id").select("chunk_id", "phrase").distinct())


@query("g16_keyword_coverage", Q.sql("SELECT * FROM coverage", **COVERAGE))
def _(t):
    return logs.keyword_coverage(_expected_chunks(t), t.chunks)


@query("g17_compare_stores", Q.sql("""
    SELECT chunk_id, CASE WHEN a.text IS NULL THEN 'added' WHEN b.text IS NULL THEN 'removed' WHEN a.text = b.text THEN 'same'
           ELSE 'changed' END AS status, length(a.text)::INT AS old_size, length(b.text)::INT AS new_size
    FROM raw_chunks a FULL JOIN (SELECT chunk_id, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM chunks) b USING (chunk_id)"""))
def _(t):
    new = t.chunks.withColumn("text", F.regexp_replace("text", r"\s+", " "))
    return logs.compare_stores(t.raw_chunks, new)


@query("g17_score_store", Q.sql("""
    SELECT count(*) AS found, round(sum(10 + coverage_pct / 100 * 5 + CASE WHEN length(text) > 100 THEN 5 WHEN length(text) < 50 THEN -5 ELSE 0 END)
           + (SELECT CASE WHEN count(*) BETWEEN 150 AND 300 THEN 20 WHEN count(*) > 1000 THEN -50 ELSE 0 END FROM chunks), 4) AS points
    FROM coverage JOIN chunks USING (chunk_id) WHERE present""", **COVERAGE))
def _(t):
    return logs.score_store(logs.keyword_coverage(_expected_chunks(t), t.chunks), t.chunks)


@query("g18_session_order", Q.sql("""
    SELECT event_id, session_id, row_number() OVER w AS sequence,
           round((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 3) AS gap_seconds
    FROM log WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)""", **LOGS))
def _(t):
    return logs.with_session_order(log_of(t)).select("event_id", "session_id", "sequence", "gap_seconds")


@query("g18_session_stats", Q.sql("""
    SELECT session_id, count(*) AS queries, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS duration_seconds,
           round(avg(latency), 6) AS avg_latency, count(*) AS last_sequence, max(gap) AS longest_gap FROM (
      SELECT *, round((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 3) AS gap FROM log
      WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)) GROUP BY 1""", **LOGS))
def _(t):
    return logs.session_stats(log_of(t))


@query("g19_response_stats", Q.sql("""
    SELECT query_id, count(*) AS results, round(avg(score), 6) AS avg_score, max(score) AS max_score,
           string_agg(chunk_id, ',' ORDER BY rank) FILTER (rank <= 3) AS top_ids FROM bm10 GROUP BY 1"""))
def _(t):
    return logs.response_stats(t.bm25_hits(10))
