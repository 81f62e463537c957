"""Lexical and sparse retrieval over term tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as V, scores as S, text as T
from ..session import freed_shuffles, has_at_most, salted_join
from . import blocks

# Query terms up to this number are broadcast; beyond it the join is salted by chunk.
BROADCAST_TERMS = 500_000
# Vocabularies up to this number of terms go through the driver to every task; larger ones are joined. They grow with the corpus.
BROADCAST_VOCABULARY = 50_000


@dataclass(frozen=True)
class TermIndex:
    """Term tables of a corpus.

    rows = (key, dl, terms array<struct<term,tf>>), one row per chunk; vocabulary = (term, df, max_tf, min_dl).
    """
    rows: DataFrame
    vocabulary: DataFrame
    key: str = "chunk_id"

    @property
    def postings(self) -> DataFrame:
        """(key, term, tf, dl). The postings of a chunk stay in the task that reads the chunk."""
        return (self.rows.select(self.key, "dl", F.explode("terms").alias("t"))
                .select(self.key, "t.term", "t.tf", "dl"))

    @property
    def totals(self) -> DataFrame:
        """(n, avgdl); reads one small column."""
        return self.rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))

    def stored(self, path: str) -> "TermIndex":
        """The same index read back from ``path``: texts are split once and words counted once."""
        spark = self.rows.sparkSession
        with freed_shuffles(spark):
            self.rows.write.mode("overwrite").parquet(f"{path}/rows")
            rows = spark.read.parquet(f"{path}/rows")
            _vocabulary(rows).write.mode("overwrite").parquet(f"{path}/vocabulary")
            return TermIndex(rows, spark.read.parquet(f"{path}/vocabulary"), self.key)


def _vocabulary(rows: DataFrame) -> DataFrame:
    """Document frequencies and the bounds of BM25 (most occurrences in a row, shortest row), folded in each map task."""
    return (rows.select("dl", F.explode("terms").alias("t")).select("dl", "t.term", "t.tf")
            .groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl")))


def build_postings(chunks: DataFrame, words=T.tokens, key: str = "chunk_id") -> TermIndex:
    """Term index of the chunks. Terms are counted inside each row; only the vocabulary is shuffled."""
    listed = chunks.select(key, words(F.col("text")).alias("w"))
    rows = listed.select(key, F.size("w").alias("dl"), T.counted(F.col("w")).alias("terms"))
    return TermIndex(rows, _vocabulary(rows), key)


def query_terms(queries: DataFrame, words=T.tokens) -> DataFrame:
    """(query_id, term, qtf)"""
    return (queries.select("query_id", F.explode(words(F.col("query"))).alias("term"))
            .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))


def on_terms(postings: DataFrame, weights: DataFrame, bound_by: DataFrame, spread_by: str = "chunk_id") -> DataFrame:
    """Postings joined with per-query term weights.

    ``bound_by`` has at least as many rows as ``weights`` and is cheap to count.
    """
    if has_at_most(bound_by, BROADCAST_TERMS):
        return postings.join(F.broadcast(weights), "term")
    return salted_join(postings, weights, "term", spread_by)


def bm25_idf(index: TermIndex) -> DataFrame:
    """(term, idf): Okapi idf, negative values replaced by epsilon times the mean over all terms."""
    n = index.totals.select("n").scalar()
    raw = index.vocabulary.withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).scalar()
    return raw.select("term", F.when(F.col("raw") < 0, V.BM25_EPSILON * mean).otherwise(F.col("raw")).alias("idf"))


def bm25_weights(queries: DataFrame, index: TermIndex) -> DataFrame:
    """(query_id, term, w): idf times the number of times the query has the term."""
    return bm25_idf(index).join(query_terms(queries), "term").select(
        "query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))


def bm25_scores(queries: DataFrame, index: TermIndex, within: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of every chunk that shares a word with the query, by a join on the
    terms; with ``within`` only for those (query_id, chunk_id) pairs."""
    avgdl = index.totals.select("avgdl").scalar()
    part = F.col("w") * F.col("tf") * (V.BM25_K1 + 1) / (
        F.col("tf") + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * F.col("dl") / avgdl))
    joined = matched(index.postings, bm25_weights(queries, index), query_terms(queries), within)
    return joined.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))


def matched(postings: DataFrame, weights: DataFrame, bound_by: DataFrame, within: DataFrame | None) -> DataFrame:
    """Postings of shared terms per query; ``within`` cuts the postings before they meet the queries."""
    if within is None:
        return on_terms(postings, weights, bound_by)
    pairs = within.select("query_id", "chunk_id").distinct()
    near = postings.join(pairs.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return near.join(pairs, "chunk_id").join(weights, ["query_id", "term"])


def bm25_search(queries: DataFrame, index: TermIndex, k: int, broadcast_terms: int | None = None, products: tuple | None = None) -> DataFrame:
    """Top ``k`` per query. Up to ``broadcast_terms`` query terms are scored inside the map tasks, with bounds per term;
    more of them are joined."""
    if not has_at_most(query_terms(queries), BROADCAST_TERMS if broadcast_terms is None else broadcast_terms):
        return S.top_k(bm25_scores(queries, index), k)
    avgdl = index.totals.first()["avgdl"]  # one row

    def part(tf, dl):
        return tf * (V.BM25_K1 + 1) / (tf + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * dl / avgdl))

    most = index.vocabulary.select("term", part(F.col("max_tf"), F.col("min_dl")).alias("most"))
    weights = bm25_weights(queries, index).join(most, "term")
    return blocks.top_k_products(index.rows, weights, k, "tf", part, index.key, length="dl", products=products)


def _grams(word: Column, longest: int = 3) -> Column:
    """All substrings of 1..longest characters."""
    def of(n: int) -> Column:
        return F.when(F.length(word) >= n, F.transform(
            F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substring(word, i, F.lit(n)))
        ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(n) for n in range(1, longest + 1)]))


def keyword_words(queries: DataFrame) -> DataFrame:
    wanted = queries.select("query_id", T.word_set(F.col("query")).alias("_w"))
    return wanted.select("query_id", F.size("_w").alias("n_words"), F.explode("_w").alias("word"))


def keyword_search(queries: DataFrame, index: TermIndex, k: int, broadcast_terms: int | None = None) -> DataFrame:
    """Shared words / query words + 0.1 for each time a query word occurs as a substring; top ``k``.

    A query word has no white space, so its occurrences lie inside single words of the text: words are
    searched once and counted through the term lists. A bounded set of queries is scored inside the map
    tasks, any other by :func:`keyword_scores`.
    """
    wanted = keyword_words(queries)
    if has_at_most(wanted, BROADCAST_TERMS if broadcast_terms is None else broadcast_terms):
        return blocks.top_k_keywords(index.rows, wanted, k, index.key)
    return S.top_k(keyword_scores(wanted, index), k)


def keyword_scores(wanted: DataFrame, index: TermIndex) -> DataFrame:
    """The same scores by joins: vocabulary and query words meet on their first one to three
    characters, the matches meet the postings on the vocabulary word."""
    words = wanted.select("word").distinct().withColumn("gram", F.left("word", F.lit(3)))
    vocabulary = index.vocabulary.select("term", F.explode(_grams(F.col("term"))).alias("gram"))
    found = (salted_join(vocabulary, words, "gram", "term").filter(F.contains("term", F.col("word")))
             .select("term", "word", T.occurrences(F.col("term"), F.col("word")).alias("inside"),
                     (F.col("term") == F.col("word")).cast("int").alias("same")))
    hits = salted_join(index.postings, found, "term", "chunk_id").groupBy("chunk_id", "word").agg(
        F.sum(F.col("tf") * F.col("inside")).alias("times"), F.max("same").alias("same"))
    score = F.sum("same") / F.first("n_words") + 0.1 * F.sum("times")
    return (salted_join(hits, wanted, "word", "chunk_id").groupBy("query_id", "chunk_id")
            .agg(F.round(score, 6).alias("score")).filter("score > 0"))


def smooth_idf(index: TermIndex) -> DataFrame:
    n = index.totals.select("n").scalar()
    return index.vocabulary.select("term", _smooth(n).alias("idf"))


def _smooth(n: Column) -> Column:
    return F.log((1 + n) / (1 + F.col("df"))) + 1


def tfidf_rows(index: TermIndex) -> DataFrame:
    """(key, terms array<struct<term,weight>>): tf times smooth idf, rows of unit length.

    A small vocabulary goes to the tasks that read the rows, of a larger one the common words only.
    """
    if has_at_most(index.vocabulary, BROADCAST_VOCABULARY):
        return blocks.unit_weights(index.rows, smooth_idf(index), index.key)
    return _joined_tfidf_rows(index)


def split_vocabulary(vocabulary: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(common, rare) words: at most ``most`` common ones, which hold most postings; a rare one is in no more rows than any of them."""
    n, least = vocabulary.select("df").orderBy(F.desc("df")).limit(most + 1).agg(F.count(F.lit(1)), F.min("df")).first()
    cut = least if n > most else 0
    return vocabulary.filter(F.col("df") > cut), vocabulary.filter(F.col("df") <= cut)


def _joined_tfidf_rows(index: TermIndex) -> DataFrame:
    """The same for any vocabulary: rare words, none of which is frequent enough for salt, meet their idf in a join, and
    each row gets the idf of its own rare words."""
    key = index.key
    common, rare = split_vocabulary(index.vocabulary, BROADCAST_VOCABULARY)
    idf = _smooth(index.totals.select("n").scalar()).alias("idf")
    met = (index.postings.select(key, "term").join(F.broadcast(common.select("term")), "term", "left_anti")
           .join(rare.select("term", idf), "term"))
    own = met.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct("term", "idf")).alias("rare"))
    # two arrays take less in the shuffle than an array of pairs
    flat = index.rows.select(key, F.col("terms.term").alias("term"), F.col("terms.tf").alias("tf"))
    rows = flat.join(own, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, "rare", F.arrays_zip("term", "tf").alias("terms"))
    return blocks.unit_weights(rows, common.select("term", idf), key, "rare")


def tfidf(index: TermIndex) -> DataFrame:
    """(key, term, weight)"""
    return long_form(tfidf_rows(index), index.key)


def long_form(rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    return rows.select(key, F.explode("terms").alias("t")).select(key, "t.term", "t.weight")


def query_tfidf(queries: DataFrame, index: TermIndex) -> DataFrame:
    """(query_id, term, weight) with the corpus idf; words the corpus lacks are dropped."""
    raw = (query_terms(queries, T.terms).join(smooth_idf(index), "term")
           .select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("raw")))
    norm = raw.groupBy("query_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, "query_id").select("query_id", "term", (F.col("raw") / F.col("norm")).alias("weight"))


def sparse_expand(rows: DataFrame, k: int = 100, max_len: int = 256, key: str = "chunk_id") -> DataFrame:
    """The ``k`` heaviest terms of each text, at most ``max_len``, inside the row."""
    order = F.array_sort(F.transform("terms", lambda x: F.struct(
        (-F.round(x["weight"], 6)).alias("o"), x["term"].alias("term"), x["weight"].alias("weight"))))
    return rows.select(key, F.transform(F.slice(order, 1, min(k, max_len)), lambda x: F.struct(
        x["term"].alias("term"), x["weight"].alias("weight"))).alias("terms"))


def followers(chunks: DataFrame, wanted: DataFrame, most: int = 3) -> DataFrame:
    """(term, other, share): the words that most often come right after a wanted term.

    Pairs are adjacent words, so their number grows with the text and not with its square.
    """
    words = chunks.select(T.terms(F.col("text")).alias("w")).filter(F.size("w") > 1)
    pairs = words.select(F.explode(F.arrays_zip(
        F.slice("w", F.lit(1), F.size("w") - 1).alias("term"),
        F.slice("w", F.lit(2), F.size("w") - 1).alias("other"))).alias("p")).select("p.*")
    wanted = wanted.select("term").distinct()
    small = has_at_most(wanted, BROADCAST_TERMS)
    counts = (pairs.join(F.broadcast(wanted) if small else wanted, "term", "left_semi")
              .groupBy("term", "other").agg(F.count(F.lit(1)).alias("c")))
    every = counts.groupBy("term").agg(F.sum("c").alias("n"))
    best = S.top_k(counts, most, by="term", score="c", tie="other")
    return best.join(every, "term").select("term", "other", (F.col("c") / F.col("n")).alias("share"))


def sparse_queries(queries: DataFrame, chunks: DataFrame, index: TermIndex, k: int = 100,
                   max_len: int = 256, damp: float = 0.5) -> DataFrame:
    """(query_id, term, weight): TF-IDF weights plus weight for the usual followers of each term."""
    base = query_tfidf(queries, index)
    near = followers(chunks, query_terms(queries, T.terms))
    more = base.join(near, "term").select(
        "query_id", F.col("other").alias("term"), (damp * F.col("weight") * F.col("share")).alias("weight"))
    both = (base.select("query_id", "term", "weight").unionByName(more)
            .groupBy("query_id", "term").agg(F.sum("weight").alias("weight")))
    rows = both.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    return long_form(sparse_expand(rows, k, max_len, "query_id"), "query_id")


def _unit_queries(queries: DataFrame) -> DataFrame:
    norm = queries.groupBy("query_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return queries.join(norm, "query_id").select("query_id", "term", (F.col("weight") / F.col("norm")).alias("w"))


def sparse_scores(queries: DataFrame, texts: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """Sum of products over shared terms / length of the query vector.

    queries = (query_id, term, weight); texts = (chunk_id, terms); with ``within`` only for its pairs. Up to ``BROADCAST_TERMS`` query terms go
    to the tasks that read the texts, so that only ids that repeat make a shuffle; more of them, and pairs, are joined on the terms.
    """
    if within is None and has_at_most(queries, BROADCAST_TERMS):
        sums = blocks.all_products(texts, _unit_queries(queries).select("query_id", "term", "w"), "weight")
        with freed_shuffles(texts.sparkSession):
            rows, ids = texts.agg(F.count(F.lit(1)), F.count_distinct("chunk_id")).first()
        if ids < rows:
            sums = sums.groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"))
        return sums.withColumn("score", F.round("score", 6))
    joined = matched(long_form(texts), _unit_queries(queries), queries, within)
    return (joined.groupBy("query_id", "chunk_id")
            .agg(F.round(F.sum(F.col("w") * F.col("weight")), 6).alias("score")))


def term_bounds(texts: DataFrame) -> DataFrame:
    """(term, most): the largest weight of each term in any text; store it beside the texts."""
    return texts.select(F.explode("terms").alias("t")).groupBy(F.col("t.term").alias("term")).agg(F.max("t.weight").alias("most"))


def sparse_search(queries: DataFrame, texts: DataFrame, k: int, threshold: float = 0.0, bounds: DataFrame | None = None,
                  broadcast_terms: int | None = None, products: tuple | None = None) -> DataFrame:
    """Top ``k``, then the threshold. Up to ``broadcast_terms`` query terms are scored inside the map tasks, with ``bounds``
    (see ``term_bounds``) where they are given; more of them are joined."""
    if has_at_most(queries, BROADCAST_TERMS if broadcast_terms is None else broadcast_terms):
        weights = _unit_queries(queries).select("query_id", "term", "w")
        if bounds is not None:
            weights = weights.join(bounds, "term")  # a term that no text has adds nothing
        hits = blocks.top_k_products(texts, weights, k, "weight", lambda weight, _: weight, products=products)
    else:
        hits = S.top_k(sparse_scores(queries, texts), k)
    return hits.filter(F.col("score") >= threshold)


def dense_or_overlap(hits: DataFrame, query_vectors: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine where the chunk has a vector, else the word overlap of query and text.

    ``hits`` has query, text; vectors are fetched for the hits only.
    """
    near = vectors.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi").select(
        "chunk_id", F.col("embedding").alias("_v"))
    df = hits.join(query_vectors.select("query_id", F.col("embedding").alias("_q")), "query_id").join(
        near, "chunk_id", "left")
    dense = F.when(F.col("_v").isNotNull(), S.cosine(F.col("_q"), F.col("_v")) + 1e-9)
    return df.select("query_id", "chunk_id",
                     F.round(F.coalesce(dense, T.word_overlap(F.col("query"), F.col("text"))), 6).alias("score"),
                     F.when(F.col("_v").isNotNull(), "dense").otherwise("overlap").alias("method"))
