"""Removal of exact and near copies."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as ty

from ..functions import text as T
from ..session import cut_lineage, scratch_folder, write_step
from . import vectors as X


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the smallest key of each normalised content.

    An aggregate folds copies in the map tasks, so a content held by a third of the rows does not
    fill one task.
    """
    digest = T.content_hash(T.normalize_text(T.text_of(text)))
    firsts = docs.groupBy(digest.alias("content_hash")).agg(
        F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))
    return firsts


def semantic_dedup(vectors: DataFrame, threshold: float = 0.95, key: str = "chunk_id", miss: float = 1e-4, exact: bool = False,
                   rounds: list | None = None) -> DataFrame:
    """Keys kept by the greedy rule: in key order, a kept row removes the later rows like it.

    Each round keeps the rows without a similar smaller undecided row and removes the rows similar to
    those. No list of pairs is built, and keys of the join (``vectors.join_keys``) are made once for all rounds.

    A row that is undecided after a round has a smaller one that was, and the smallest of any chain of similar
    rows of falling keys is decided each time with the row after it. So a corpus whose longest such chain has n rows
    takes n // 2 + 1 rounds at most; ``rounds`` collects the number of rows that each round began with.
    """
    # Parquet takes far less than the rows of a checkpoint
    stored = lambda df, name: write_step(df, scratch_folder(vectors.sparkSession, name), compression="zstd")
    rows = stored(X.distinct_vectors(vectors, key), "distinct-vectors")
    keys = X.join_keys(rows.count(), threshold, miss, exact)
    undecided = stored(X.with_keys(rows, keys, key), "undecided") if keys.bands else X.with_keys(rows, keys, key)
    kept: DataFrame | None = None
    while left := undecided.count():
        if rounds is not None:
            rounds.append(left)
        behind = cut_lineage(X.first_similar(undecided, undecided, threshold, key, keys))
        roots = undecided.join(behind, key, "left_anti")
        found = cut_lineage(roots.select(key))
        kept = found if kept is None else kept.unionByName(found)
        rest = stored(undecided.join(behind, key, "left_semi"), "rest")
        if rest.isEmpty():
            break
        gone = X.first_similar(undecided.join(found, key, "left_semi"), rest, threshold, key, keys)
        undecided = stored(rest.join(gone, key, "left_anti"), "undecided")
    return kept if kept is not None else undecided.select(key)


def dedup_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    both = (before.select(F.lit(1).alias("b"), F.lit(0).alias("a"))
            .unionAll(after.select(F.lit(0).alias("b"), F.lit(1).alias("a")))
            .agg(F.sum("b").alias("original_rows"), F.sum("a").alias("kept_rows")))
    removed = F.col("original_rows") - F.col("kept_rows")
    return both.select(
        "original_rows", "kept_rows", removed.alias("removed_rows"),
        F.round(100 * T.ratio(removed, F.col("original_rows")), 6).alias("removal_percentage"),
        F.round(F.when(F.col("original_rows") > 0, F.col("kept_rows") / F.col("original_rows")).otherwise(1.0), 6)
        .alias("compression_ratio"))


@F.pandas_udf(ty.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two normalised texts; only for candidate pairs of one query."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


# Hits of one query in one task; fetch depths are far below.
MOST_HITS = 500


def per_query(hits: DataFrame, run, schema: str, most_hits: int = MOST_HITS) -> DataFrame:
    """Grouped map over the hits of one query, which are bounded by the fetch depth.

    The work per query is heavy and its rows are few, so queries are spread by number of tasks and not
    by size. More than ``most_hits`` hits are an error.
    """
    def checked(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most_hits:
            raise ValueError(f"{len(pdf)} hits for one query; cut them to {most_hits} first")
        return run(pdf)
    tasks = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return hits.repartition(tasks, "query_id").groupBy("query_id").applyInPandas(checked, schema)


def dedup_context(hits: DataFrame, threshold: float = 0.8, shortest: int = 50, most_hits: int = MOST_HITS) -> DataFrame:
    """Best first, drop a hit too much like a kept one (sequence ratio or containment).

    Texts below ``shortest`` characters match nothing. Needs (query_id, chunk_id, rank, text).
    """
    ready = hits.withColumn("norm", T.normalize_text(F.col("text")))

    def alike(norm: str, kept: str, matcher: SequenceMatcher) -> bool:
        short, long = sorted((norm, kept), key=len)
        if long and short in long and len(short) / len(long) >= threshold:
            return True
        matcher.set_seq1(norm)
        return (matcher.real_quick_ratio() >= threshold and matcher.quick_ratio() >= threshold
                and matcher.ratio() >= threshold)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        kept: list[int] = []
        seen: list[tuple[str, SequenceMatcher]] = []  # a matcher prepares its second text once
        for at, (text, norm) in enumerate(zip(pdf["text"], pdf["norm"])):
            if len(text) >= shortest:
                if any(alike(norm, other, matcher) for other, matcher in seen):
                    continue
                seen.append((norm, SequenceMatcher(None, "", norm)))
            kept.append(at)
        return pdf.iloc[kept][["query_id", "chunk_id", "rank"]]

    q = hits.schema["query_id"].dataType.simpleString()
    return per_query(ready.select("query_id", "chunk_id", "rank", "text", "norm"), run,
                     f"query_id {q}, chunk_id string, rank int", most_hits)


def dedup_hits(hits: DataFrame, limit: float = 0.6) -> DataFrame:
    """In rank order, drop a hit whose word Jaccard with a kept hit is above ``limit``.

    A fold over the rank-sorted hits of one query; their number is bounded by k.
    """
    rows = F.array_sort(F.collect_list(F.struct(
        "rank", "chunk_id", "score", T.word_set(F.col("text")).alias("words"))))

    def jaccard(a: Column, b: Column) -> Column:
        return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
            F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))

    def add(kept: Column, hit: Column) -> Column:
        seen = F.exists(kept, lambda k: jaccard(k["words"], hit["words"]) > limit)
        return F.when(seen, kept).otherwise(F.concat(kept, F.array(hit)))

    kind = f"array<struct<rank:int,chunk_id:string,score:double,words:array<string>>>"
    return (hits.groupBy("query_id").agg(rows.alias("h"))
            .select("query_id", F.explode(F.aggregate("h", F.array().cast(kind), add)).alias("x"))
            .select("query_id", "x.chunk_id", "x.score", "x.rank"))
