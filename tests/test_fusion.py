import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import dedup, fusion, grouping, lexical
from corpusloom.plans import search


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id string, score double, rank int")


def test_minmax_with_equal_scores_and_missing_side(spark):
    v = hits(spark, [(0, "a", 0.5, 1), (0, "b", 0.5, 2)])
    kw = hits(spark, [(0, "b", 2.0, 1), (0, "c", 1.0, 2)])
    got = {r["chunk_id"]: r["score"] for r in fusion.fuse_minmax(v, kw, 0.7, 10).collect()}
    assert got == {"a": 0.0, "b": 0.3, "c": 0.0}


def test_context_limits(spark):
    df = spark.createDataFrame([(0, 1, "s", "x" * 50), (0, 2, "s", "y" * 10), (1, 1, None, "z")],
                               "query_id long, rank int, source string, text string")
    whole = {r["query_id"]: r for r in fusion.assemble_context(df, 1000).collect()}
    assert whole[0]["context"] == "[1] From s:\n" + "x" * 50 + "\n\n[2] From s:\n" + "y" * 10 + "\n" and whole[0]["n_chunks"] == 2
    assert whole[1]["context"] == "[1] From Unknown source:\nz\n"
    cut = {r["query_id"]: r for r in fusion.assemble_context(df, 30).collect()}
    assert cut[0]["context"] == ("[1] From s:\n" + "x" * 50)[:27] + "..." and cut[0]["n_chunks"] == 1
    assert {r["query_id"]: r["n_chunks"] for r in fusion.assemble_context(df, 64).collect()} == {0: 1, 1: 1}


def test_queries_without_hits(spark):
    q = spark.createDataFrame([(0, "a"), (1, "b")], "query_id long, query string")
    h = hits(spark, [(0, "c", 0.9, 1)])
    assert {r["query_id"]: r["status"] for r in fusion.failure_rows(q, h).collect()} == {0: "OK", 1: "PIPELINE_FAILURE"}
    back = fusion.keyword_fallback(q, h, lambda e: e.select("query_id", F.lit("k").alias("chunk_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank")))
    assert {r["query_id"]: r["search_type"] for r in back.collect()} == {0: "vector", 1: "keyword_fallback"}


def test_dedup_hits_compares_with_kept_only(spark):
    df = spark.createDataFrame([(0, "a", .9, 1, "p q r s t"), (0, "b", .8, 2, "p q r s u"), (0, "c", .7, 3, "p q r u v"), (0, "d", .6, 4, "")],
                               "query_id long, chunk_id string, score double, rank int, text string")
    assert sorted(r["chunk_id"] for r in dedup.dedup_hits(df).collect()) == ["a", "c", "d"]


def test_dedup_context_ignores_short_texts(spark):
    long = "the quick brown fox jumps over the lazy dog and runs far away"
    df = spark.createDataFrame([(0, "a", 1, long), (0, "b", 2, long.upper() + "!"), (0, "c", 3, "short"), (0, "d", 4, "short"),
                                (0, "e", 5, "completely different words are written here for the last row")],
                               "query_id long, chunk_id string, rank int, text string")
    assert sorted(r["chunk_id"] for r in dedup.dedup_context(df).collect()) == ["a", "c", "d", "e"]


def test_group_too_large_is_an_error(spark):
    df = spark.range(dedup.MOST_HITS + 1).select(F.lit(0).cast("long").alias("query_id"), F.col("id").cast("string").alias("chunk_id"),
                                                 F.col("id").cast("int").alias("rank"), F.lit("x").alias("text"))
    with pytest.raises(Exception):
        dedup.dedup_context(df).collect()


def test_mmr_prefers_different_texts(spark):
    chunks = spark.createDataFrame([("a", "red apple pie"), ("b", "red apple pie"), ("c", "red car"), ("d", "blue sky")], "chunk_id string, text string")
    q = spark.createDataFrame([(0, "red apple")], "query_id long, query string")
    index = lexical.build_postings(chunks, T.terms)
    h = hits(spark, [(0, "a", 4.0, 1), (0, "b", 3.0, 2), (0, "c", 2.0, 3), (0, "d", 1.0, 4)])
    got = fusion.mmr(h, lexical.tfidf(index), lexical.query_tfidf(q, index), 3, trade=0.5).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["a", "c", "d"]


def test_rerank_keeps_order_of_few_candidates(spark):
    chunks = spark.createDataFrame([("a", "one two three"), ("b", "two words only"), ("c", "nothing")], "chunk_id string, text string")
    q = spark.createDataFrame([(0, "one two")], "query_id long, query string")
    ready = fusion.ready_queries(q, lexical.build_postings(chunks))
    h = hits(spark, [(0, "c", 0.9, 1), (0, "b", 0.8, 2), (0, "a", 0.7, 3)])
    few = fusion.rerank(h, chunks, ready, 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in few] == ["c", "b", "a"]
    best = fusion.rerank(h, chunks, ready, 2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in best] == ["a", "b"] and best[0]["score"] == 1.0 and best[0]["original_score"] == 0.7


def test_plan_names():
    assert search.resolve("sparse") == "splade_only" and search.stage_one_depth(2) == 15 and search.stage_one_depth(10) == 30
    with pytest.raises(ValueError):
        search.resolve("nothing")


def test_average_linkage():
    import numpy as np
    d = np.array([[0, .1, .9, .9], [.1, 0, .9, .9], [.9, .9, 0, .2], [.9, .9, .2, 0]])
    assert grouping.average_linkage(d, 0.25).tolist() == [0, 0, 2, 2]
    assert len(set(grouping.average_linkage(d, 0.05))) == 4


def test_clusters_are_connected_parts(spark):
    h = spark.createDataFrame([(0, c) for c in "abcdefg"] + [(1, "x"), (1, "y")], "query_id long, chunk_id string")
    e = spark.createDataFrame([(0, "b", "c"), (0, "c", "d"), (0, "a", "e"), (1, "x", "y")], "query_id long, a string, b string")
    got = {(r["query_id"], r["chunk_id"]): r["cluster_id"] for r in grouping.cluster_topics(h, e).collect()}
    assert got == {(0, "a"): 1, (0, "b"): 0, (0, "c"): 0, (0, "d"): 0, (0, "e"): 1, (0, "f"): None, (0, "g"): None}
