"""The grid against single plans, its plug-ins and its refusals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import encoders, evaluation as E
from corpusloom.plans import grid, search
from corpusloom.plans.tables import Tables

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "config_id string, chunk_size int, plan string, rerank_top_k int, top_k int, similarity_threshold double"


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "source", T.text_of("text").alias("text"))
    questions = spark.read.parquet(f"{FOLDER}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return docs, questions


def test_settings_equal_single_plans(spark, corpus):
    """At the depths that a single plan takes by itself the grid has the hits of that plan."""
    docs, questions = corpus
    plans = ["vector_only", "reranker_only", "splade_only", "splade_then_reranker"]
    depth = {"reranker_only": 30, "splade_then_reranker": search.stage_one_depth(5)}
    configs = spark.createDataFrame([(p, 1000, p, depth.get(p, 20), 5, 0.0) for p in plans] + [("cut", 1000, "vector_only", 20, 3, 0.4)], COLUMNS)
    got = {}
    for r in grid.grid_hits(docs, questions, configs).collect():
        got.setdefault(r["config_id"], set()).add((r["query_id"], r["chunk_id"], r["rank"], r["score"]))
    sized = grid.SizedCorpus(docs, 1000, 0, encoders.hashing_encoder(64), 64)
    asked = encoders.embed(questions, encoders.hashing_encoder(64), text="query", dims=64).select("query_id", "embedding")
    from corpusloom.operators import lexical
    one = search.Corpus(sized.chunks, sized.vectors, sized.index, sized.sparse)
    q = search.Questions(questions, asked, lexical.sparse_queries(questions, sized.chunks, sized.terms))
    for p in plans:
        want = {(r["query_id"], r["chunk_id"], r["rank"], r["score"]) for r in search.run_plan(p, one, q, 5).collect()}
        assert got[p] == want, p
    assert got["cut"] == {h for h in got["vector_only"] if h[2] <= 3 and h[3] >= 0.4}


def test_plug_ins_reach_the_grid(spark, corpus):
    docs, questions = corpus
    calls = spark.sparkContext.accumulator(0)

    def longest(queries, texts):
        calls.add(len(texts))
        return np.array([len(t) for t in texts], float)

    def first_letters(texts):
        return np.array([[t.count(c) + 0.1 for c in "abcdefgh"] for t in texts], float)

    configs = spark.createDataFrame([("a", 400, "reranker_only", 12, 3, 0.0), ("b", 400, "vector_only", 12, 12, 0.0)], COLUMNS)
    rows = grid.grid_hits(docs, questions, configs, encoder=first_letters, dims=8, scorer=longest).collect()
    assert calls.value == questions.count() * 12  # one pass over the deepest candidates
    for q in {r["query_id"] for r in rows}:
        deep = [r for r in rows if r["config_id"] == "b" and r["query_id"] == q]
        best = sorted(deep, key=lambda r: (-len(r["text"]), r["chunk_id"]))[:3]
        assert [r["chunk_id"] for r in best] == [r["chunk_id"] for r in sorted((r for r in rows if r["config_id"] == "a" and r["query_id"] == q), key=lambda r: r["rank"])]


def test_refusals(spark, corpus, monkeypatch):
    docs, questions = corpus
    with pytest.raises(ValueError, match="unknown plan"):
        grid.grid_hits(docs, questions, spark.createDataFrame([("a", 400, "nothing", 12, 3, 0.0)], COLUMNS))
    monkeypatch.setattr(grid, "MOST_CONFIGS", 3)
    with pytest.raises(ValueError, match="more than 3"):
        grid.grid_hits(docs, questions, E.config_grid(spark))
