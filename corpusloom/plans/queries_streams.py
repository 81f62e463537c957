"""Registered queries: streams (S). Each runs a stream over the table's file until it is worked off and
returns what the sink holds; the SQL is the batch form of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..session import scratch_folder
from ..sources import versions
from ..streaming import stateful, streams
from . import sqlparts as Q
from .queries_logs import LOGS
from .registry import query
from .tables import CHUNK_SIZE, OVERLAP


def _stream(t, table: str):
    """A table is one file or a folder of files. A stream's path must be a folder unless it is a pattern, and this one matches both."""
    return t.spark.readStream.schema(t.spark.read.parquet(f"{t.folder}/{table}.parquet").schema).parquet(f"{t.folder}/{table}.parque[t]")


def _run(t, df, mode: str = "append"):
    """Run a stream into a parquet folder and read it back."""
    out = scratch_folder(t.spark, "sink")
    streams.run_once(df.writeStream.outputMode(mode).format("parquet").option("path", out), scratch_folder(t.spark, "progress"))
    return t.spark.read.schema(df.schema).parquet(out)


def _log(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return _stream(t, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("session_id"),
        F.col("event_type").alias("engine"), F.col("value").alias("latency"), k.alias("hit_count"))


def _plain_time(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


@query("s1_stream_ingest", Q.sql("SELECT chunk_id, md5(text) AS digest FROM chunks",
    raw_chunks=Q.CTES["raw_chunks"].replace("coalesce(text, '')", "prepared").replace("FROM documents", "FROM prepared_docs"),
    prepared_docs=f"""
      SELECT doc_id, source, lang, {Q.thin_dropped('b')} AS prepared FROM (SELECT *, {Q.breaks_repaired('a')} AS b FROM (
        SELECT *, {Q.noise_filtered("coalesce(text, '')")} AS a FROM documents))"""))
def _(t):
    return _run(t, streams.ingest(_stream(t, "documents"), CHUNK_SIZE, OVERLAP)).select("chunk_id", F.md5("text").alias("digest"))


@query("s2_stream_dedup", f"SELECT DISTINCT sha256({Q.normalized("coalesce(text, '')")}) AS content_hash FROM documents")
def _(t):
    # Documents arrive one minute apart in the order of their numbers.
    docs = _stream(t, "documents").withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + 60 * F.col("doc_id")))
    return _run(t, streams.dedup(docs).select("content_hash"))


_PARTS = 3


def _ranges(df, order: str, parts: int = _PARTS) -> list:
    """The rows in parts of equal ranges of a number."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    step = max(1, -(-((high or 0) - (low or 0) + 1) // parts))
    return [df.filter((F.col(order) >= (low or 0) + n * step) & (F.col(order) < (low or 0) + (n + 1) * step)) for n in range(parts)]


def _arrivals(t, df, order: str, parts: int = _PARTS) -> str:
    """The rows as files that arrive one after the other in the order of a number, to be read one file a micro-batch."""
    out = scratch_folder(t.spark, "arrivals")
    for part in _ranges(df, order, parts):
        part.coalesce(1).write.mode("append").parquet(out)
    return out


def _run_stateful(t, folder: str, schema, build):
    stateful.with_state_store(t.spark)
    made = build(t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    return _run(t, made)


def _run_by_parts(t, df, order: str, build):
    """The rows arrive in parts in the order of a number; all tasks write a part, and the stream takes it as one micro-batch before the next arrives."""
    stateful.with_state_store(t.spark)
    folder, out, progress = (scratch_folder(t.spark, name) for name in ("arrivals", "sink", "progress"))
    for part in _ranges(df, order):
        part.write.mode("append").parquet(folder)
        made = build(t.spark.readStream.schema(df.schema).parquet(folder))
        streams.run_once(made.writeStream.format("parquet").option("path", out), progress)
    return t.spark.read.schema(made.schema).parquet(out)


@query("s2_stream_duplicates", f"""
    WITH RECURSIVE docs AS (
      SELECT doc_id, sha256({Q.normalized("coalesce(text, '')")}) AS content_hash, (1704067200 + 60 * doc_id) * 1000 AS ms FROM documents),
    firsts AS (
      SELECT content_hash, min(ms) AS first_ms FROM docs GROUP BY 1
      UNION ALL SELECT content_hash, next_ms FROM (
        SELECT f.content_hash, min(d.ms) AS next_ms FROM firsts f JOIN docs d ON d.content_hash = f.content_hash AND d.ms >= f.first_ms + 10800000 GROUP BY f.content_hash, f.first_ms)),
    counted AS (
      SELECT f.content_hash, f.first_ms, min(doc_id) AS doc_id, count(*) AS copies FROM firsts f JOIN docs d
        ON d.content_hash = f.content_hash AND d.ms >= f.first_ms AND d.ms < f.first_ms + 10800000 GROUP BY 1, 2)
    SELECT content_hash, doc_id, first_ms, 'first' AS event, 1 AS copies FROM counted
    UNION ALL SELECT content_hash, doc_id, first_ms, 'closed', copies FROM counted WHERE first_ms + 10800000 <= (SELECT max(ms) FROM docs) - 630000
       OR EXISTS (SELECT 1 FROM docs d WHERE d.content_hash = counted.content_hash AND d.ms >= first_ms + 10800000)""")
def _(t):
    """Documents arrive one minute apart in three parts; a content is new again three hours after its first row."""
    docs = t.documents.select("doc_id", "text", F.timestamp_seconds(F.lit(1_704_067_200) + 60 * F.col("doc_id")).alias("ts"))
    return _run_by_parts(t, docs, "doc_id", lambda s: stateful.duplicates(s, "3 hours", "630 seconds"))


_HOURS = """
    SELECT w AS start, w + INTERVAL 1 HOUR AS "end", engine, count(*) AS n, round(avg(latency), 6) AS avg_latency,
           count(*) FILTER (hit_count = 0) AS zero_hits
    FROM {source} GROUP BY 1, 2, 3 HAVING w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM log) - INTERVAL 1 HOUR"""


@query("s3_stream_query_metrics", Q.sql(_HOURS.format(source="(SELECT *, date_trunc('hour', ts) AS w FROM log)"), **LOGS))
def _(t):
    return _plain_time(_run(t, streams.query_metrics(_log(t))), "start", "end")


@query("s3_stream_sliding_metrics", Q.sql(_HOURS.format(source="""(
    SELECT *, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '2024-01-01') - i * INTERVAL 15 MINUTE AS w FROM log, (SELECT unnest(range(4)) AS i))"""), **LOGS))
def _(t):
    return _plain_time(_run(t, streams.query_metrics(_log(t), slide="15 minutes")), "start", "end")


@query("s4_stream_feedback_rate", Q.sql("""
    SELECT date_trunc('day', ts) - i * INTERVAL 1 DAY AS start, count(*) AS n, count(*) FILTER (type = 'positive') AS positive,
           round(avg((type = 'positive')::INT), 6) AS rate FROM feedback, (SELECT unnest(range(7)) AS i) GROUP BY 1""", **LOGS))
def _(t):
    kind = F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative")
    feedback = (_log(t).join(t.labels.select(F.col("doc_id").alias("event_id"), kind.alias("type")), "event_id"))
    out = scratch_folder(t.spark, "sink")
    rate = streams.feedback_rate(feedback)
    streams.run_once(rate.writeStream.outputMode("update").foreachBatch(streams.upsert_batch(out, "start")), scratch_folder(t.spark, "progress"))
    return _plain_time(streams.read_upserted(t.spark, out, "start"), "start")


@query("s5_stream_sessions", Q.sql("""
    SELECT session_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS queries, round(avg(latency), 6) AS avg_latency FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS g FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM log))
    GROUP BY session_id, g HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM log) - INTERVAL 1 HOUR""", **LOGS))
def _(t):
    return _plain_time(_run(t, streams.sessions(_log(t))), "start", "end")


@query("s5_stream_early_sessions", Q.sql("""
    SELECT session_id, epoch_us(min(ts)) // 1000 AS start_ms, count(*) AS queries, round(avg(latency), 6) AS avg_latency, epoch_us(max(ts)) // 1000 AS last_ms FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS g FROM (
        SELECT *, CASE WHEN epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY session_id ORDER BY ts, event_id) < 1800000 THEN 0 ELSE 1 END AS fresh FROM log))
    GROUP BY session_id, g""", **LOGS))
def _(t):
    """The last row of every session, early or closed, from three files in the order of time."""
    k = F.get_json_object("props", "$.k").cast("int")
    log = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("session_id"), F.col("value").alias("latency"), k.alias("hit_count"))
    ranked = log.withColumn("_at", F.unix_millis("ts"))
    out = _run_stateful(t, _arrivals(t, ranked, "_at"), ranked.schema, stateful.early_sessions)
    last = out.groupBy("session_id", "start_ms").agg(F.max_by(F.struct("queries", "avg_latency", "last_ms"), F.col("queries")).alias("r"))
    return last.select("session_id", "start_ms", "r.*")


@query("s6_stream_upsert_store", Q.sql("SELECT chunk_id, length(text)::INT AS size, CASE WHEN chunk_index > 0 THEN 2 ELSE 1 END AS version FROM chunks"))
def _(t):
    """All chunks in a first run, then the follow-up chunks again with a new version."""
    out, progress = scratch_folder(t.spark, "store"), scratch_folder(t.spark, "progress")
    chunks = t.chunks.select("chunk_id", F.length("text").alias("size"), "chunk_index")
    first = scratch_folder(t.spark, "arrivals")
    chunks.select("chunk_id", "size", F.lit(1).alias("version")).write.parquet(first)

    def run():
        arriving = t.spark.readStream.schema("chunk_id STRING, size INT, version INT").parquet(first)
        streams.run_once(arriving.writeStream.foreachBatch(streams.upsert_batch(out)), progress)

    run()
    chunks.filter("chunk_index > 0").select("chunk_id", "size", F.lit(2).alias("version")).write.mode("append").parquet(first)
    run()
    return streams.read_upserted(t.spark, out)


@query("s6_stream_versioned_store", Q.sql("SELECT chunk_id, length(text)::INT AS size, CASE WHEN chunk_index > 0 THEN 2 ELSE 1 END AS version FROM chunks"))
def _(t):
    """The same arrivals in a versioned store: each micro-batch is one commit and rewrites the buckets it touches."""
    out, progress, first = (scratch_folder(t.spark, n) for n in ("versions", "progress", "arrivals"))
    schema = "chunk_id STRING, size INT, version INT"
    chunks = t.chunks.select("chunk_id", F.length("text").alias("size"), "chunk_index")
    for version, part in ((1, chunks), (2, chunks.filter("chunk_index > 0"))):
        part.select("chunk_id", "size", F.lit(version).alias("version")).write.mode("append").parquet(first)
        streams.run_once(t.spark.readStream.schema(schema).parquet(first).writeStream.foreachBatch(versions.upsert_writer(out)), progress)
    return versions.read_store(t.spark, out, schema)


@query("s7_stream_match", Q.sql("SELECT query_id, chunk_id, score, rank FROM bm10"))
def _(t):
    out = scratch_folder(t.spark, "hits")
    asked = _stream(t, "benchmark").select(F.col("item_id").alias("query_id"), T.text_of("text").alias("query"))
    streams.run_once(asked.writeStream.foreachBatch(streams.match_batch(t.index(), out, 10)), scratch_folder(t.spark, "progress"))
    return t.spark.read.option("basePath", out).parquet(out).select("query_id", "chunk_id", "score", "rank")
