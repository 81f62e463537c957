"""Statistics of chunks, query logs and feedback.

log = (event_id, ts, session_id, engine, latency, hit_count, quality)
feedback = (feedback_id, ts, type, engine, score, processing_time)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as V, scores as S, text as T


def _pct(part: Column, whole: Column) -> Column:
    return F.round(100.0 * T.ratio(part, whole), 6)


def chunk_distribution(chunks: DataFrame, small: int = 50, large: int = 2000) -> DataFrame:
    """Count, sizes, upper median, and share of small, normal and large chunks."""
    sized = chunks.select(F.length(T.text_of("text")).alias("size"), F.lit(1).alias("all"))
    size = F.col("size")
    stats = sized.groupBy("all").agg(
        F.count(F.lit(1)).alias("n"), F.min(size).alias("min_size"), F.max(size).alias("max_size"),
        F.round(F.avg(size), 6).alias("avg_size"), F.count_if(size < small).alias("small"),
        F.count_if((size >= small) & (size <= large)).alias("normal"), F.count_if(size > large).alias("large"))
    median = S.upper_median(sized, ["all"], "size", "median_upper")
    n = F.col("n")
    return stats.join(median, "all").drop("all").select(
        "*", *[_pct(F.col(c), n).alias(f"{c}_pct") for c in ("small", "normal", "large")])


def content_stats(chunks: DataFrame, pattern: str) -> DataFrame:
    """Sizes, share of chunks with the pattern and the quality flags."""
    size = F.length("text")
    s = chunks.agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("min_size"), F.max(size).alias("max_size"),
                   F.round(F.avg(size), 6).alias("avg_size"), F.count_if(F.col("text").rlike(pattern)).alias("matching"))
    return s.select("*", _pct(F.col("matching"), F.col("n")).alias("matching_pct"),
                    F.col("n").between(100, 400).alias("fitting_count"),
                    F.col("avg_size").between(300, 1200).alias("fitting_size"), (F.col("matching") > 0).alias("has_matching"))


def processing_stats(manifest: DataFrame, kind: str) -> DataFrame:
    """Per kind of document: documents, chunks, bytes and averages per document."""
    return manifest.groupBy(kind).agg(
        F.count(F.lit(1)).alias("documents"), F.sum("chunk_count").alias("chunks"), F.sum("size").alias("bytes"),
        F.round(F.avg("chunk_count"), 6).alias("avg_chunks"), F.round(F.avg("size"), 6).alias("avg_bytes"))


def score_distribution(hits: DataFrame) -> DataFrame:
    """Per query: highest, lowest, upper median from the top, range and means of the outer quarters.

    Works on ranked hits, whose number per query is the fetch depth.
    """
    size = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    df = hits.join(size, "query_id")
    quarter, pos = F.floor(F.col("n") / 4), F.col("rank") - 1
    few = F.col("n") < 4

    def mean(test: Column) -> Column:
        return F.round(F.avg(F.when(few | test, F.col("score"))), 6)

    return df.groupBy("query_id", "n").agg(
        F.max("score").alias("highest"), F.min("score").alias("lowest"),
        F.max(F.when(pos == F.floor(F.col("n") / 2), F.col("score"))).alias("median_upper"),
        F.round(F.max("score") - F.min("score"), 6).alias("score_range"),
        mean(pos < quarter).alias("top_quarter"), mean(pos >= F.col("n") - quarter).alias("bottom_quarter"))


def latest(log: DataFrame, n: int, tie: str = "event_id") -> DataFrame:
    """The last ``n`` entries: each task keeps its own ``n`` newest before they meet."""
    return log.orderBy(F.desc("ts"), F.desc(tie)).limit(n)


def query_patterns(log: DataFrame, n: int = 50) -> DataFrame:
    """Per engine over the last ``n`` entries: uses, share with quality above .5, mean latency above 0."""
    return latest(log, n).groupBy("engine").agg(
        F.count(F.lit(1)).alias("uses"),
        F.round(F.avg((F.col("quality") > 0.5).cast("double")), 6).alias("success_rate"),
        F.round(F.avg(F.when(F.col("latency") > 0, F.col("latency"))), 6).alias("avg_latency"))


def zero_hit_queries(log: DataFrame, by: list[str]) -> DataFrame:
    return (log.filter("hit_count = 0").groupBy(*by)
            .agg(F.count(F.lit(1)).alias("times"), F.max("ts").alias("last_ts")))


def latency_stats(log: DataFrame, last: int = 1000) -> DataFrame:
    """Per engine over its last entries: count, min, max, mean, total, latest."""
    recent = S.top_k(log.withColumn("_t", S.micros(F.col("ts"))), last, by="engine", score="_t", tie="event_id")
    return recent.groupBy("engine").agg(
        F.count(F.lit(1)).alias("n"), F.min("latency").alias("min_latency"), F.max("latency").alias("max_latency"),
        F.round(F.avg("latency"), 6).alias("avg_latency"), F.round(F.sum("latency"), 4).alias("total_latency"),
        F.max_by("latency", F.struct("_t", -F.col("event_id"))).alias("latest"))


def _good(kind: str) -> Column:
    return F.count_if(F.col("type") == kind)


def feedback_summary(feedback: DataFrame, n: int = 20) -> DataFrame:
    return latest(feedback, n, "feedback_id").agg(
        F.count(F.lit(1)).alias("total"), _good("positive").alias("positive"), _good("negative").alias("negative"),
        F.round(F.avg((F.col("type") == "positive").cast("double")), 6).alias("positive_rate"),
        F.round(F.avg("score"), 6).alias("avg_score"), F.round(F.avg("processing_time"), 6).alias("avg_time"))


def feedback_analytics(feedback: DataFrame, days: int, now: Column) -> DataFrame:
    recent = feedback.filter(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))

    def mean(kind: str) -> Column:
        return F.round(F.avg(F.when(F.col("type") == kind, F.col("score"))), 6)

    return recent.agg(
        F.count(F.lit(1)).alias("total"), _good("positive").alias("positive"), _good("negative").alias("negative"),
        F.round(F.avg((F.col("type") == "positive").cast("double")), 6).alias("positive_rate"),
        mean("positive").alias("positive_score"), mean("negative").alias("negative_score"),
        F.round(F.avg("processing_time"), 6).alias("avg_time"))


def engine_breakdown(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("engine").agg(
        F.count(F.lit(1)).alias("total"), _good("positive").alias("positive"), _good("negative").alias("negative"),
        F.round(F.avg((F.col("type") == "positive").cast("double")), 6).alias("positive_rate"))


def negative_patterns(feedback: DataFrame, n: int = 10) -> DataFrame:
    return latest(feedback.filter("type = 'negative'"), n, "feedback_id").select(
        "feedback_id", "ts", "engine", "score", "processing_time")


def pattern_distribution(chunks: DataFrame, pattern: str, near: list[str]) -> DataFrame:
    """Chunks that match, all matches, and how many matching chunks have each nearby word."""
    low = F.lower("text")
    found = chunks.select(F.regexp_count("text", F.lit(pattern)).alias("m"),
                          *[F.contains(low, F.lit(w)).alias(f"with_{w}") for w in near])
    return found.agg(F.count_if(F.col("m") > 0).alias("matching_chunks"), F.sum("m").cast("long").alias("matches"),
                     *[F.count_if((F.col("m") > 0) & F.col(f"with_{w}")).alias(f"with_{w}") for w in near])


def structure_class(text: Column, procedural: list[str] = V.PROCEDURAL_WORDS) -> Column:
    line_ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (F.when((line_ends > 10) & T.contains_any(text, V.LIST_MARKS), "directory")
            .when(T.contains_any(F.lower(text), procedural), "procedural").otherwise("reference"))


def structure_profile(chunks: DataFrame, procedural: list[str] = V.PROCEDURAL_WORDS) -> DataFrame:
    """Per class: chunks, share, mean length, and how many are short, medium and long."""
    n = F.length("text")
    per = chunks.groupBy(structure_class(F.col("text"), procedural).alias("class")).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(n).alias("_len"), F.count_if(n < 500).alias("short"),
        F.count_if((n >= 500) & (n < 1500)).alias("medium"), F.count_if(n >= 1500).alias("long"))
    total = per.agg(F.sum("chunks")).scalar()
    return per.select("class", "chunks", F.round(F.col("chunks") / total, 6).alias("ratio"),
                      F.round(F.col("_len") / F.col("chunks"), 6).alias("avg_length"), "short", "medium", "long")


def complete_process_chunks(chunks: DataFrame, concern: list[str] = V.CONCERN_WORDS,
                            process: list[str] = V.PROCESS_WORDS, follow: list[str] = V.FOLLOW_WORDS) -> DataFrame:
    """Chunks with a concern word, two process words and a word for a step."""
    low = F.lower("text")
    df = chunks.select("chunk_id", T.contains_any(low, concern).alias("concern"),
                       T.count_contained(low, process).alias("process_words"), T.contains_any(low, follow).alias("follow"))
    return df.filter("concern and process_words >= 2 and follow").select("chunk_id", "process_words")


def keyword_coverage(expected: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per expected chunk: found words, coverage and whether it is poor. expected = (chunk_id, phrase)."""
    df = expected.join(chunks.select("chunk_id", F.lower("text").alias("_t")), "chunk_id", "left")
    hit = F.coalesce(F.contains("_t", F.lower("phrase")), F.lit(False))
    out = df.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("expected"), F.count_if(hit).alias("found"),
                                     F.max(F.col("_t").isNotNull()).alias("present"))
    share = F.col("found") / F.col("expected")
    return out.select("*", F.round(100 * share, 1).alias("coverage_pct"), (share < 0.5).alias("poor"))


def compare_stores(old: DataFrame, new: DataFrame) -> DataFrame:
    """(chunk_id, status, old_size, new_size) of two stores."""
    a = old.select("chunk_id", F.length("text").alias("old_size"), F.xxhash64("text").alias("_a"))
    b = new.select("chunk_id", F.length("text").alias("new_size"), F.xxhash64("text").alias("_b"))
    status = (F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed")
              .when(F.col("_a") == F.col("_b"), "same").otherwise("changed"))
    return a.join(b, "chunk_id", "full_outer").select("chunk_id", status.alias("status"), "old_size", "new_size")


def score_store(coverage: DataFrame, chunks: DataFrame) -> DataFrame:
    """Points of a store: 10 per expected chunk found, 5 for its coverage, 5 for its size (less 5 if
    tiny), 20 for 150 to 300 chunks, less 50 above 1,000."""
    sizes = coverage.filter("present").join(chunks.select("chunk_id", F.length("text").alias("size")), "chunk_id")
    points = 10 + F.col("coverage_pct") / 100 * 5 + F.when(F.col("size") > 100, 5).when(F.col("size") < 50, -5).otherwise(0)
    total = chunks.agg(F.count(F.lit(1))).scalar()
    whole = F.when(total.between(150, 300), 20).when(total > 1000, -50).otherwise(0)
    return sizes.agg(F.count(F.lit(1)).alias("found"), F.sum(points).alias("p")).select(
        "found", F.round(F.coalesce("p", F.lit(0.0)) + whole, 4).alias("points"))


def with_session_order(log: DataFrame) -> DataFrame:
    """Adds the number of the entry in its session and the seconds since the entry before.

    Entries are numbered in range parts of (session, time) and stitched, so a session with a third of all entries, on one day even, is spread.
    """
    df = S.with_range_parts(log, "session_id", "ts", "event_id").withColumn("_at", F.struct("ts", "event_id"))
    df = S.numbered(df, "_at", F.col("_part"), to="sequence", keys=("session_id",))
    df = S.previous(df, ["session_id"], "_at", "ts", F.col("_part"), "_prev").drop("_part")
    gap = (S.micros(F.col("ts")) - S.micros(F.col("_prev"))) / 1e6
    return df.withColumn("gap_seconds", F.round(gap, 3)).drop("_at", "_prev")


def session_stats(log: DataFrame) -> DataFrame:
    span = (S.micros(F.max("ts")) - S.micros(F.min("ts"))) / 1e6
    return with_session_order(log).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("queries"), F.round(span, 3).alias("duration_seconds"),
        F.round(F.avg("latency"), 6).alias("avg_latency"), F.max("sequence").alias("last_sequence"),
        F.round(F.max("gap_seconds"), 3).alias("longest_gap"))


def response_stats(hits: DataFrame, top: int = 3) -> DataFrame:
    """Per query: hits, mean and best score and the ids of the best ``top``."""
    return hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("results"), F.round(F.avg("score"), 6).alias("avg_score"), F.max("score").alias("max_score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
            F.col("rank") <= top, F.struct("rank", "chunk_id")))), lambda x: x["chunk_id"]), ",").alias("top_ids"))
