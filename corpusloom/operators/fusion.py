"""Fusion, reranking, diversification and context assembly over hits.

hits = (query_id, chunk_id, score, rank); the number per query is bounded by the fetch depth.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as V, scores as S, text as T
from ..session import cut_lineage, has_at_most
from .dedup import per_query
from .encoders import PairScorer, score_pairs
from .lexical import TermIndex, query_terms, smooth_idf

PAIR = ["query_id", "chunk_id"]
#: Hits up to this number are broadcast to fetch their texts.
BROADCAST_HITS = 100_000


def above(hits: DataFrame, threshold: float) -> DataFrame:
    """The similarity threshold, applied after the top-k cut."""
    return hits.filter(F.col("score") >= threshold)


def _minmax(hits: DataFrame, to: str) -> DataFrame:
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    span = F.when(high == low, 1.0).otherwise(high - low)
    return hits.select(*PAIR, ((F.col("score") - low) / span).alias(to))


def fuse_minmax(vector_hits: DataFrame, keyword_hits: DataFrame, weight: float, k: int,
                threshold: float = 0.0) -> DataFrame:
    """weight * vector + (1 - weight) * keyword after min-max scaling per query and side."""
    both = _minmax(vector_hits, "v").join(_minmax(keyword_hits, "kw"), PAIR, "full_outer")
    score = weight * F.coalesce("v", F.lit(0.0)) + (1 - weight) * F.coalesce("kw", F.lit(0.0))
    return above(S.top_k(both.select(*PAIR, F.round(score, 6).alias("score")), k), threshold)


def fuse_max(vector_hits: DataFrame, word_scores: DataFrame, word_best: DataFrame, alpha: float, k: int) -> DataFrame:
    """alpha * vector / max + (1 - alpha) * words / max for the vector hits only.

    ``word_scores`` are the word scores of the vector hits, ``word_best`` the best word hit per query.
    """
    v_max = Window.partitionBy("query_id")
    left = vector_hits.select(*PAIR, "score", F.max("score").over(v_max).alias("_vm"))
    left = left.select(*PAIR, F.when(F.col("_vm") != 0, F.col("score") / F.col("_vm")).otherwise(0.0).alias("v"))
    w_max = word_best.filter("rank = 1").select("query_id", F.col("score").alias("_wm"))
    df = (left.join(word_scores.select(*PAIR, F.col("score").alias("b")), PAIR, "left")
          .join(w_max, "query_id", "left"))
    b = F.coalesce(F.when(F.col("_wm") > 0, F.col("b") / F.col("_wm")).otherwise(F.col("b")), F.lit(0.0))
    df = df.select(*PAIR, S.round6(alpha * F.col("v") + (1 - alpha) * b).alias("score"),
                   S.round6(F.col("v")).alias("vector_score"), S.round6(b).alias("bm25_score"))
    return S.top_k(df, k)


def mmr(hits: DataFrame, text_weights: DataFrame, query_weights: DataFrame, k: int, trade: float = 0.7) -> DataFrame:
    """Maximal marginal relevance on unit TF-IDF rows: the first pick is the most like the query, each
    next one maximises trade * relevance - (1 - trade) * likeness to the picked.

    ``text_weights``(chunk_id, term, weight) is reduced to the hits before it is grouped.
    """
    pair = F.collect_list(F.struct("term", "weight"))
    terms = (text_weights.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
             .groupBy("chunk_id").agg(F.map_from_entries(pair).alias("d")))
    asked = query_weights.groupBy("query_id").agg(F.map_from_entries(pair).alias("q"))
    df = hits.select(*PAIR, "rank").join(terms, "chunk_id", "left").join(asked, "query_id", "left")

    def dot(a: dict, b: dict) -> float:
        a, b = (a, b) if len(a) < len(b) else (b, a)
        return sum(w * b[t] for t, w in a.items() if t in b)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        docs = [dict(d or {}) for d in pdf["d"]]
        query = dict(pdf["q"].iloc[0] or {})
        rel = [dot(query, d) for d in docs]
        likest = [0.0] * len(docs)
        left, picked = list(range(len(docs))), []
        while left and len(picked) < k:
            def worth(i: int) -> float:
                return round(rel[i] if not picked else trade * rel[i] - (1 - trade) * likest[i], 6)
            best = max(left, key=lambda i: (worth(i), -i))
            picked.append((best, worth(best)))
            left.remove(best)
            for i in left:
                likest[i] = max(likest[i], dot(docs[i], docs[best]))
        at = [i for i, _ in picked]
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "chunk_id": pdf["chunk_id"].to_numpy()[at],
                             "score": [s for _, s in picked], "rank": range(1, len(at) + 1)})

    kind = hits.schema["query_id"].dataType.simpleString()
    return per_query(df, run, f"query_id {kind}, chunk_id string, score double, rank int")


def _bigrams(words: Column) -> Column:
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(
        F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1),
                   lambda a, b: F.concat(a, F.lit(" "), b))))


def ready_queries(queries: DataFrame, index: TermIndex) -> DataFrame:
    """(query_id, words with idf, idf sum, word pairs): what the default pair scorer needs."""
    n = index.totals.select("n").scalar()
    terms = query_terms(queries).join(index.vocabulary, "term", "left")
    idf = F.log((1 + n) / (1 + F.coalesce("df", F.lit(0)))) + 1
    weighed = (terms.select("query_id", "term", idf.alias("idf")).groupBy("query_id")
               .agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("q_terms"),
                    F.sum("idf").alias("q_idf")))
    return queries.select("query_id", _bigrams(T.tokens(F.col("query"))).alias("q_pairs")).join(weighed, "query_id")


def pair_score(text: Column) -> Column:
    """Default pair score: .5 word overlap + .3 idf share + .2 share of the query's word pairs."""
    def score(words: Column) -> Column:
        seen = F.array_distinct(words)
        pairs = T.ratio(F.size(F.array_intersect(F.col("q_pairs"), _bigrams(words))), F.size("q_pairs"))
        shared = T.let(F.array_intersect(F.map_keys("q_terms"), seen), lambda s: (
            0.5 * T.ratio(F.size(s), F.size("q_terms"))
            + 0.3 * F.aggregate(s, F.lit(0.0), lambda acc, t: acc + F.col("q_terms")[t]) / F.col("q_idf")))
        return shared + 0.2 * pairs
    return T.let(T.tokens(text), score)


def pair_scores(candidates: DataFrame, chunks: DataFrame, ready: DataFrame | None = None, queries: DataFrame | None = None,
                scorer: PairScorer | None = None) -> DataFrame:
    """(query_id, chunk_id, pair_score) of candidates; texts are read for the hit chunks only.

    With a ``scorer`` (a pair model, see ``encoders.score_pairs``) it is asked with the texts of ``queries``, else the default score
    with ``ready`` is taken.
    """
    texts = chunks.join(candidates.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", "text")
    pairs = candidates.select(*PAIR).join(texts, "chunk_id")
    if scorer is None:
        return pairs.join(ready, "query_id").select(*PAIR, F.round(pair_score(F.col("text")), 6).alias("pair_score"))
    asked = pairs.join(queries.select("query_id", "query"), "query_id").select(*PAIR, "query", "text")
    return score_pairs(asked, scorer, to="pair_score").select(*PAIR, F.round("pair_score", 6).alias("pair_score"))


def rerank_scored(candidates: DataFrame, scored: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """The best ``k`` candidates by pair score, with ``original_score``, then threshold.

    A query with at most ``k`` candidates keeps the order it came in.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    df = candidates.select(*PAIR, F.col("score").alias("original_score"), n.alias("_n")).join(scored, PAIR)
    score = F.when(F.col("_n") <= k, F.col("original_score")).otherwise(F.col("pair_score"))
    return above(S.top_k(df.select(*PAIR, "original_score", score.alias("score")), k), threshold)


def rerank(candidates: DataFrame, chunks: DataFrame, ready: DataFrame | None, k: int, threshold: float = 0.0,
           queries: DataFrame | None = None, scorer: PairScorer | None = None) -> DataFrame:
    """Rescore (query, text) of the candidates by the default pair score or by a plug-in, see ``pair_scores`` and ``rerank_scored``."""
    return rerank_scored(candidates, pair_scores(candidates, chunks, ready, queries, scorer), k, threshold)


def keyword_fallback(queries: DataFrame, vector_hits: DataFrame, search) -> DataFrame:
    """Vector hits, and for queries without any the hits of ``search(queries)``; tagged."""
    empty = queries.join(vector_hits.select("query_id").distinct(), "query_id", "left_anti")
    cols = [*PAIR, "score", "rank"]
    return (vector_hits.select(*cols, F.lit("vector").alias("search_type"))
            .unionByName(search(empty).select(*cols, F.lit("keyword_fallback").alias("search_type"))))


def failure_rows(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per hit, and a failure mark for each query without hits."""
    return (queries.select("query_id").join(hits.select(*PAIR, "score", "rank"), "query_id", "left")
            .withColumn("status", F.when(F.col("chunk_id").isNull(), "PIPELINE_FAILURE").otherwise("OK")))


def with_text(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their text and source. Up to ``BROADCAST_HITS`` hits go to the tasks that read the chunks, so no text is shuffled."""
    hits = cut_lineage(hits)
    few = F.broadcast(hits) if has_at_most(hits, BROADCAST_HITS) else hits
    return few.join(chunks.select("chunk_id", "text", "source"), "chunk_id")


def assemble_context(hits: DataFrame, max_len: int, page: Column | None = None) -> DataFrame:
    """contexts(query_id, context, n_chunks): numbered chunks with their source, up to ``max_len``.

    Stops before the first chunk that would pass the limit; if that is the first one, it is cut.
    """
    where = F.coalesce("source", F.lit("Unknown source"))
    page_info = F.lit("") if page is None else F.when(page.isNull(), "").otherwise(
        F.concat(F.lit(" (page "), page.cast("string"), F.lit(")")))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] From "), where, page_info,
                     F.lit(":\n"), F.col("text"), F.lit("\n"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = hits.select("query_id", "rank", block.alias("block")).withColumn("upto", F.sum(F.length("block")).over(w))
    cut = F.when(F.col("upto") <= max_len, F.col("block")).when(
        F.col("rank") == 1, F.concat(F.left("block", F.lit(max(0, max_len - 3))), F.lit("...")))
    kept = df.select("query_id", "rank", cut.alias("block")).filter("block is not null")
    return kept.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n")
        .alias("context"), F.count(F.lit(1)).cast("int").alias("n_chunks"))


def contexts_for(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """Every query has a context; the ones without hits get the fixed phrase."""
    return queries.select("query_id").join(contexts, "query_id", "left").select(
        "query_id", F.coalesce("context", F.lit(V.NO_CONTEXT)).alias("context"),
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def assemble_plain(hits: DataFrame, max_len: int) -> DataFrame:
    """Texts joined by a blank line, cut at ``max_len`` with ``...``."""
    joined = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n")
    return hits.groupBy("query_id").agg(joined.alias("c")).select(
        "query_id", T.preview(F.col("c"), max_len).alias("context"))


def multi_query_search(hits: DataFrame, most: int = 20) -> DataFrame:
    """Merge the hits of a primary query and its related queries.

    ``hits`` has (query_group, query_pos, query_id, chunk_id, score, rank, text); position 0 is the
    primary query. The first 100 normalised characters identify a text; the primary query wins.
    """
    same = F.left(F.array_join(T.tokens(F.col("text")), " "), F.lit(100))
    w = Window.partitionBy("query_group", "_key").orderBy("query_pos", "rank")
    first = hits.withColumn("_key", same).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    order = Window.partitionBy("query_group").orderBy(F.desc("score"), "query_pos", "rank")
    best = first.withColumn("merged_rank", F.row_number().over(order)).filter(F.col("merged_rank") <= most)
    return best.select("query_group", "query_id", "chunk_id", "score", "merged_rank",
                       F.when(F.col("query_pos") == 0, "primary").otherwise("supplementary").alias("query_type"))
