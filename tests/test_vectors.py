import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dedup, vectors as X


def frame(spark, matrix, key="vec_id"):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(matrix)], f"{key} long, embedding array<double>")


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = unit(rng.normal(size=(6, 16)))
    return np.concatenate([unit(c + 0.08 * rng.normal(size=(40, 16))) for c in centres])


def brute(q, v, k):
    sims = np.round(unit(q) @ unit(v).T + 1e-9, 6)
    return {(i, int(j)): r + 1 for i in range(len(q)) for r, j in enumerate(np.lexsort((np.arange(len(v)), -sims[i]))[:k])}


def test_scan_and_grid_agree_with_brute_force(spark, clustered, monkeypatch):
    q, v = clustered[::25], clustered
    queries = frame(spark, q, "query_id")
    want = brute(q, v, 7)
    got = {(r["query_id"], r["vec_id"]): r["rank"] for r in X.knn_exact(queries, frame(spark, v), 7, "vec_id").collect()}
    assert got == want
    monkeypatch.setattr(X, "BROADCAST_QUERIES", 2)
    monkeypatch.setattr(X, "BLOCK_ROWS", 50)
    got = {(r["query_id"], r["vec_id"]): r["rank"] for r in X.knn_exact(queries, frame(spark, v), 7, "vec_id").collect()}
    assert got == want


def test_k_above_corpus_size(spark):
    v = np.eye(3)
    assert X.knn_exact(frame(spark, v[:1], "query_id"), frame(spark, v), 10, "vec_id").count() == 3


@pytest.mark.parametrize("most", [8192, 2])
def test_cells_find_most_of_the_exact_hits(spark, clustered, monkeypatch, most):
    """Queries that go to the cells, and queries that meet them in a join."""
    monkeypatch.setattr(X, "BROADCAST_QUERIES", most)
    monkeypatch.setattr(X, "BLOCK_ROWS", 15 if most == 2 else X.BLOCK_ROWS)
    q = clustered[::25]
    hits = X.knn_ivf(frame(spark, q, "query_id"), frame(spark, clustered), 10, "vec_id", recall="low")
    got = {(r["query_id"], r["vec_id"]): r["rank"] for r in hits.collect()}
    assert len(got) == 10 * len(q)
    assert len(set(got) & set(brute(q, clustered, 10))) / (10 * len(q)) >= 0.9


def test_cell_store_reads_asked_cells_only(spark, clustered, tmp_path):
    X.write_cells(frame(spark, clustered), str(tmp_path), "vec_id", cells=12)
    store = X.open_cells(spark, str(tmp_path), "vec_id")
    assert store.vectors.count() == len(clustered) and len(store.cells) == 12
    hits = X.search_cells(frame(spark, clustered[:1], "query_id"), store, 5, 1)
    plan = hits._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PartitionFilters: \[.*cell#", plan)
    home = store.vectors.where("vec_id = 0").first()["cell"]
    inside = {r["vec_id"] for r in store.vectors.where(F.col("cell") == home).collect()}
    assert {r["vec_id"] for r in hits.collect()} <= inside and hits.first()["vec_id"] == 0
    everything = X.search_cells(frame(spark, clustered[::25], "query_id"), store, 7, 12)
    assert {(r["query_id"], r["vec_id"]): r["rank"] for r in everything.collect()} == brute(clustered[::25], clustered, 7)


def greedy(m, t):
    kept = []
    for i, v in enumerate(unit(m)):
        if not any(round(float(v @ unit(m)[j]) + 1e-9, 6) > t for j in kept):
            kept.append(i)
    return kept


@pytest.mark.parametrize("block", [20_000, 15])
def test_semantic_dedup_is_the_greedy_order(spark, clustered, monkeypatch, block):
    monkeypatch.setattr(X, "BLOCK_ROWS", block)
    m = np.concatenate([clustered[:120], np.repeat(clustered[5:6], 60, axis=0)])  # a third are copies of one row
    got = sorted(r[0] for r in dedup.semantic_dedup(frame(spark, m), 0.9, key="vec_id").collect())
    assert got == greedy(m, 0.9)


def test_chain_keeps_both_ends(spark):
    angle = np.radians([0, 15, 30])
    m = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    got = sorted(r[0] for r in dedup.semantic_dedup(frame(spark, m), 0.95, key="vec_id").collect())
    assert got == [0, 2]


@pytest.mark.parametrize("block", [20_000, 15])
def test_similar_pairs_lose_nothing(spark, clustered, monkeypatch, block):
    monkeypatch.setattr(X, "BLOCK_ROWS", block)
    m = clustered[::3]
    sims = np.round(m @ m.T + 1e-9, 6)
    want = {(i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if sims[i, j] > 0.93}
    got = {(r["id_a"], r["id_b"]) for r in X.similar_pairs(frame(spark, m), 0.93, neighbours=1000).collect()}
    assert got == want and want


def test_keys_equal_the_exact_join(spark, clustered, monkeypatch):
    """With keys (several blocks of rows, hot keys cut) the join finds what the exact one finds, each pair once."""
    m = np.concatenate([clustered, np.random.default_rng(5).normal(size=(400, 16))])
    want = sorted(tuple(r) for r in X.similar_pairs(frame(spark, m), 0.9, neighbours=10).collect())
    kept = sorted(r[0] for r in dedup.semantic_dedup(frame(spark, m), 0.9, key="vec_id").collect())
    monkeypatch.setattr(X, "BLOCK_ROWS", 30)
    monkeypatch.setattr(X, "KEY_ROWS", 10)
    keys = X.join_keys(len(m), 0.9)
    assert 0 < keys.bands <= X.MOST_BANDS and keys.recall >= 0.999
    got = sorted(tuple(r) for r in X.similar_pairs(frame(spark, m), 0.9, neighbours=10).collect())
    assert got == want and len(got) > 100
    assert sorted(r[0] for r in dedup.semantic_dedup(frame(spark, m), 0.9, key="vec_id").collect()) == kept == greedy(m, 0.9)


def test_keys_are_refused_where_they_spare_nothing():
    assert X.join_keys(X.BLOCK_ROWS, 0.1) == X.Keys(0, 0, 1.0) == X.join_keys(10**9, 0.1, exact=True)
    with pytest.raises(ValueError, match="exact"):
        X.join_keys(10**6, 0.35)
    for rows in (10**5, 10**7, 10**9):
        keys = X.join_keys(rows, 0.95)
        # compared pairs are a small share of all, and pairs at the threshold are hardly ever missed
        assert keys.bands * 2.0 ** -keys.bits < 0.25 and keys.recall >= 0.9999 - 1e-9


@pytest.mark.parametrize("length", [1, 2, 3, 7, 10])
def test_rounds_follow_the_longest_chain(spark, length):
    angle = np.radians(15.0 * np.arange(length))
    m = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    rounds = []
    got = sorted(r[0] for r in dedup.semantic_dedup(frame(spark, m), 0.95, key="vec_id", rounds=rounds).collect())
    assert got == list(range(0, length, 2)) and len(rounds) <= length // 2 + 1


def test_mixed_dimensions_are_reported_and_refused(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0])], "vec_id long, embedding array<double>")
    assert {r["check"] for r in X.vector_store_check(df).collect()} == {"mixed_dimensions", "very_few_chunks"}
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>")
    with pytest.raises(Exception):
        X.knn_exact(q, df, 1, "vec_id").collect()


@pytest.mark.parametrize("most", [8192, 2])
def test_profile_counts_every_vector(spark, clustered, monkeypatch, most):
    """In one pass, and in blocks of queries."""
    monkeypatch.setattr(X, "BROADCAST_QUERIES", most)
    q = frame(spark, clustered[:5], "query_id")
    profile = X.similarity_profile(q, frame(spark, clustered).repartition(3), "vec_id")
    for row in profile.collect():
        sims = np.round(unit(clustered) @ unit(clustered)[row["query_id"]] + 1e-9, 6)
        asc = np.sort(sims)
        assert row["n"] == len(clustered) and row["median_upper"] == pytest.approx(asc[len(asc) // 2])
        assert (row["above_8"], row["above_5"], row["above_3"]) == tuple(int((sims > t).sum()) for t in (0.8, 0.5, 0.3))
        assert row["min_score"] == pytest.approx(asc[0]) and row["avg_score"] == pytest.approx(sims.mean(), abs=1e-6)
        order = np.arange(len(sims))
        assert row["top_ids"] == ",".join(map(str, np.lexsort((order, -sims))[:10])) and row["bottom_ids"] == ",".join(map(str, np.lexsort((order, sims))[:10]))


def test_pair_bands(spark):
    v = frame(spark, np.array([[1, 0], [1, 0.1], [1, 1.3], [0, 1]]))
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "a long, b long")
    got = {r["b"]: r["band"] for r in X.pair_similarity(pairs, v, "vec_id").collect()}
    assert got == {1: "HIGH", 2: "MEDIUM", 3: "LOW"}


def test_vectors_without_length_are_similar_to_nothing(spark):
    from corpusloom.operators import dedup
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.99, 0.1])], "vec_id long, embedding array<double>")
    assert sorted(r["vec_id"] for r in dedup.semantic_dedup(rows, 0.9, key="vec_id").collect()) == [0, 1, 2]
    pairs = {(r["id_a"], r["id_b"]) for r in X.similar_pairs(rows, 0.9).collect()}
    assert pairs == {(2, 3), (2, 4), (3, 4)}


def test_copies_count_within_the_neighbours(spark):
    rows = frame(spark, np.array([[1.0, 0.0]] * 5 + [[0.99, 0.1]]))
    pairs = sorted((r["id_a"], r["id_b"]) for r in X.similar_pairs(rows, 0.9, neighbours=2).collect())
    assert pairs == [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (3, 5), (4, 5)]


@pytest.mark.parametrize("most", [8192, 2])
def test_exact_cell_search_reads_on_where_a_nearer_vector_may_lie(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(X, "BROADCAST_QUERIES", most)
    rng = np.random.default_rng(5)
    mat = np.concatenate([rng.normal(size=(400, 8)), np.zeros((3, 8))])
    vecs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(mat)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([rng.normal(size=(5, 8)), np.zeros((1, 8))]))], "query_id long, embedding array<double>")
    path = str(tmp_path / "cells")
    X.write_cells(vecs, path, "vec_id")
    store = X.open_cells(spark, path, "vec_id")
    get = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())
    want = get(X.knn_exact(asked, vecs, 10, "vec_id"))
    assert get(X.search_cells(asked, store, 10, 1)) != want
    assert get(X.search_cells(asked, store, 10, 1, exact=True)) == want


def test_similar_pairs_miss_none_while_blocks_cost_no_more_than_keys(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_ROWS", 100)
    m = np.random.default_rng(8).normal(size=(250, 4))
    assert 3 <= X.join_keys(250, 0.6, miss=0.5).bands
    sims = np.round(unit(m) @ unit(m).T + 1e-9, 6)
    want = {(i, j) for i in range(250) for j in range(i + 1, 250) if sims[i, j] > 0.6}
    got = X.similar_pairs(frame(spark, m), 0.6, neighbours=250, miss=0.5)
    assert {(r["id_a"], r["id_b"]) for r in got.collect()} == want


def test_text_keys_in_blocks_with_an_empty_side(spark):
    m = unit(np.random.default_rng(3).normal(size=(40, 6)))
    rows = frame(spark, m).withColumn("vec_id", F.concat(F.lit("k"), F.lpad(F.col("vec_id").cast("string"), 3, "0")))
    keyed = X.with_keys(rows, X.Keys(4, 3, 0.9), "vec_id")
    # most keys of the right rows have no left row
    assert X.first_similar(keyed.where("vec_id = 'k000'"), keyed, 2.0, "vec_id", X.Keys(4, 3, 0.9)).count() == 0


@pytest.mark.parametrize("bands", [0, 3])
def test_block_joins_go_round_by_round(spark, monkeypatch, bands):
    """A round copies rows for one band, or for one block of the left side; rounds together find what one join finds."""
    r = np.random.default_rng(5)
    base = r.normal(size=(20, 6))
    v = [list(map(float, base[i % 20] + 0.05 * r.normal(size=6))) for i in range(90)]
    rows, keys = frame(spark, v), X.Keys(2, bands, 0.9) if bands else X.Keys(0, 0, 1.0)
    monkeypatch.setattr(X, "BLOCK_ROWS", 20)
    keyed = X.with_keys(rows, keys, "vec_id").localCheckpoint()
    want = {(x["vec_id"], x["by"]) for x in X.first_similar(keyed, keyed, 0.9, "vec_id", keys).collect()}
    made = []
    monkeypatch.setattr(X, "cut_lineage", lambda df: made.append(df.columns) or df.localCheckpoint())
    monkeypatch.setattr(X, "ROUND", 1)
    assert {(x["vec_id"], x["by"]) for x in X.first_similar(keyed, keyed, 0.9, "vec_id", keys).collect()} == want and want
    assert made.count(["vec_id", "by"]) == (bands or 5)
