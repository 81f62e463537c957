import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import lexical

random.seed(11)
WORDS = ["on", "one", "stone", "a", "banana", "an", "müller", "mü", "x1", "tone"]
# "the" is in every chunk (negative idf), "a" is a third of all words
TEXTS = ["the " + " ".join(random.choice(WORDS + ["a"] * 4) for _ in range(random.randint(1, 15))) for _ in range(40)]
QUERIES = ["the stone", "a banana on", "an an tone", "mü", "zzz"]


@pytest.fixture(scope="module")
def data(spark):
    chunks = spark.createDataFrame([(f"c{i:02d}", t) for i, t in enumerate(TEXTS)], "chunk_id string, text string")
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
    return queries, chunks, lexical.build_postings(chunks)


def rows(df):
    return {(r["query_id"], r["chunk_id"], r["rank"]): r["score"] for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def ranked(scores, k):
    out = {}
    for q, per in enumerate(scores):
        for r, (c, s) in enumerate(sorted(per.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]):
            out[(q, c, r + 1)] = s
    return out


def okapi():
    docs = [t.lower().split() for t in TEXTS]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: (v if v >= 0 else 0.25 * mean) for w, v in idf.items()}
    out = []
    for q in QUERIES:
        per = {}
        for i, d in enumerate(docs):
            tf = Counter(d)
            shared = [w for w in q.lower().split() if w in tf]
            if shared:
                per[f"c{i:02d}"] = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in shared)
        out.append(per)
    return out


@pytest.mark.parametrize("bound", [500_000, 0])
def test_bm25_equals_the_formula(data, monkeypatch, bound):
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", bound)
    queries, _, index = data
    same(rows(lexical.bm25_search(queries, index, 6)), ranked(okapi(), 6))


def test_bm25_within_pairs(data):
    queries, _, index = data
    pairs = lexical.bm25_search(queries, index, 3)
    got = {(r["query_id"], r["chunk_id"]): round(r["score"], 5) for r in lexical.bm25_scores(queries, index, pairs).collect()}
    assert got == {(r["query_id"], r["chunk_id"]): round(r["score"], 5) for r in pairs.collect()}


@pytest.mark.parametrize("bound", [500_000, 0])
def test_keyword_search_counts_substrings(data, monkeypatch, bound):
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", bound)
    queries, _, index = data
    want = []
    for q in QUERIES:
        words = set(q.lower().split())
        per = {}
        for i, t in enumerate(TEXTS):
            s = len(words & set(t.lower().split())) / len(words) + 0.1 * sum(t.lower().count(w) for w in words)
            if s > 0:
                per[f"c{i:02d}"] = s
        want.append(per)
    same(rows(lexical.keyword_search(queries, index, 6)), ranked(want, 6))


def test_tfidf_ways_agree_and_have_unit_length(data):
    _, chunks, _ = data
    index = lexical.build_postings(chunks, T.terms)
    def get(df):
        return {(r["chunk_id"], r["term"]): round(r["weight"], 9) for r in lexical.long_form(df).collect()}
    a, b = get(lexical.tfidf_rows(index)), get(lexical._joined_tfidf_rows(index))
    assert a == b
    lengths = Counter()
    for (c, _), w in a.items():
        lengths[c] += w * w
    assert all(abs(v - 1) < 1e-6 for v in lengths.values())


def test_only_common_words_pass_the_driver(spark, data, monkeypatch):
    _, chunks, _ = data
    more = spark.createDataFrame([("e1", ""), ("e2", "a rare1 rare2 rare1"), (None, "rare3 stone")], chunks.schema)
    index, sent, send = lexical.build_postings(chunks.unionByName(more), T.terms), [], lexical.blocks.unit_weights
    def get(df):
        return {(r["chunk_id"], x["term"]): round(x["weight"], 9) for r in df.collect() for x in r["terms"]}
    want = get(lexical.tfidf_rows(index))
    monkeypatch.setattr(lexical, "BROADCAST_VOCABULARY", 3)
    monkeypatch.setattr(lexical.blocks, "unit_weights", lambda rows, idf, *more: sent.append(idf.count()) or send(rows, idf, *more))
    assert get(lexical.tfidf_rows(index)) == want
    assert sent == [3]


@pytest.mark.parametrize("bound", [500_000, 0])
def test_sparse_search(data, monkeypatch, bound):
    queries, chunks, _ = data
    index = lexical.build_postings(chunks, T.terms)
    texts = lexical.sparse_expand(lexical.tfidf_rows(index), 3)
    asked = lexical.query_tfidf(queries, index)
    d = {}
    for r in lexical.long_form(texts).collect():
        d.setdefault(r["chunk_id"], {})[r["term"]] = r["weight"]
    assert max(map(len, d.values())) == 3
    want = [{} for _ in QUERIES]
    q = {}
    for r in asked.collect():
        q.setdefault(r["query_id"], {})[r["term"]] = r["weight"]
    for i, ws in q.items():
        norm = math.sqrt(sum(w * w for w in ws.values()))
        for c, ts in d.items():
            if set(ws) & set(ts):
                want[i][c] = sum(w * ts[t] for t, w in ws.items() if t in ts) / norm
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", bound)
    same(rows(lexical.sparse_search(asked, texts, 5)), ranked(want, 5))


@pytest.fixture(scope="module")
def skewed(spark):
    """Common words in every chunk, rare ones that decide."""
    rng = np.random.default_rng(11)
    common, rare = [f"common{i}" for i in range(12)], [f"rare{i}" for i in range(900)]
    texts = [" ".join([*rng.permutation(common * 2)[:16], *rng.choice(rare, 4)]) for _ in range(6000)]
    chunks = spark.createDataFrame([(f"c{i:05d}", t) for i, t in enumerate(texts)], "chunk_id string, text string").repartition(1).cache()
    queries = spark.createDataFrame([(i, " ".join([*common[i % 4:i % 4 + 6], *rng.choice(rare, 3)])) for i in range(40)], "query_id long, query string")
    return chunks, queries


def _hits(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 5)) for r in df.collect())


def test_bounded_and_joined_searches_agree(spark, skewed):
    """E1, E3 and E6 inside the tasks and by joins give the same hits."""
    chunks, queries = skewed
    index = lexical.build_postings(chunks)
    assert _hits(lexical.bm25_search(queries, index, 5)) == _hits(lexical.bm25_search(queries, index, 5, broadcast_terms=0))
    assert _hits(lexical.keyword_search(queries, index, 5)) == _hits(lexical.keyword_search(queries, index, 5, broadcast_terms=0))
    terms = lexical.build_postings(chunks, T.terms)
    texts = lexical.sparse_expand(lexical.tfidf_rows(terms))
    asked = lexical.sparse_queries(queries, chunks, terms)
    want = _hits(lexical.sparse_search(asked, texts, 5, broadcast_terms=0))
    assert _hits(lexical.sparse_search(asked, texts, 5)) == want == _hits(lexical.sparse_search(asked, texts, 5, bounds=lexical.term_bounds(texts)))


def test_bounds_leave_common_terms_closed(spark, skewed):
    """With bounds less than half of the products are made, with the same hits."""
    chunks, queries = skewed
    terms = lexical.build_postings(chunks, T.terms)
    texts = lexical.sparse_expand(lexical.tfidf_rows(terms))
    asked = lexical.query_tfidf(queries, terms)
    counts = [spark.sparkContext.accumulator(0) for _ in range(4)]
    got = _hits(lexical.sparse_search(asked, texts, 5, bounds=lexical.term_bounds(texts), products=(counts[0], counts[1])))
    assert got == _hits(lexical.sparse_search(asked, texts, 5, products=(counts[2], counts[3])))
    assert counts[2].value == counts[3].value == counts[1].value  # without bounds all are made
    assert counts[0].value < 0.5 * counts[1].value
    index = lexical.build_postings(chunks)
    made, every = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    lexical.bm25_search(queries, index, 5, products=(made, every)).collect()
    assert 0 < made.value <= every.value


def test_keyword_memory_is_bounded():
    """A task remembers a bounded number of words, in flat arrays, and counts the same after it forgot them."""
    from corpusloom.operators.blocks import Inside
    words, known = ["an", "na"], Inside()
    find = lambda term: [i for i, w in enumerate(words) if w in term]
    for n in range(40):
        number = known.numbers([f"banana{n}{i}" for i in range(10)], find, words, 50)
        assert len(known.known) <= 60
        at, counts, limits = known.arrays()
        assert at[limits[number[0]]:limits[number[0] + 1]].tolist() == [0, 1] and counts[limits[number[0]]:limits[number[0] + 1]].tolist() == [2.0, 2.0]


def test_hits_are_searched_once(spark, monkeypatch):
    """Shallower hits are ranks of the kept ones, and texts of hits come without a shuffle of texts."""
    from corpusloom.operators import fusion, lexical
    from corpusloom.plans.tables import Tables
    t, calls, search = Tables(spark, "/root/testdata/sf0.001"), [], lexical.bm25_search
    monkeypatch.setattr(lexical, "bm25_search", lambda *a, **k: calls.append(1) or search(*a, **k))
    deep, few = t.bm25_hits(10), t.bm25_hits(3)
    assert len(calls) == 1 and {r["rank"] for r in few.collect()} == {1, 2, 3}
    assert few.exceptAll(deep).isEmpty() and deep.filter("rank <= 3").count() == few.count()
    plan = fusion.with_text(few, t.chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_sparse_scores_of_all_pairs_need_no_shuffle_of_postings(spark, skewed, monkeypatch):
    """In the tasks and joined, with ids that repeat as well; with one row per id nothing is exchanged."""
    chunks, queries = skewed
    terms = lexical.build_postings(chunks, T.terms)
    texts = lexical.sparse_expand(lexical.tfidf_rows(terms)).localCheckpoint()
    asked = lexical.sparse_queries(queries, chunks, terms).localCheckpoint()
    twice = texts.unionByName(texts.filter(F.xxhash64("chunk_id") % 3 == 0))
    get = lambda df: sorted((r["query_id"], r["chunk_id"], r["score"]) for r in df.collect())
    inside = [lexical.sparse_scores(asked, x) for x in (texts, twice)]
    assert "Exchange" not in inside[0]._jdf.queryExecution().executedPlan().toString()
    got = [get(df) for df in inside]
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 0)
    assert got == [get(lexical.sparse_scores(asked, x)) for x in (texts, twice)] and got[0] != got[1]


def test_many_candidates_are_not_looked_up_one_by_one(monkeypatch):
    """Both ways add the same; where candidates times closed terms exceed the products, products are made."""
    import pandas as pd
    from corpusloom.operators.blocks import Products
    r = np.random.default_rng(2)
    table = pd.DataFrame([(q, f"t{t}", r.random() + 0.1, 1.0) for q in range(20) for t in r.choice(300, 40, replace=False)], columns=["query_id", "term", "w", "most"])
    p = Products(table, np.arange(20))
    row, col = np.repeat(np.arange(50), 10), np.concatenate([r.choice(len(p.terms), 10, replace=False) for _ in range(50)])
    amount, closed = r.random(500), np.flatnonzero(r.random(len(p.term)) < 0.5)
    many, few = [a.ravel() for a in np.meshgrid(np.arange(50), np.arange(20))], [np.array([3]), np.array([4])]
    want = p.looked_up(closed, row, col, amount, *many)
    monkeypatch.setattr(Products, "looked_up", lambda *a: 1 / 0)
    got, made = p.rest(closed, row, col, amount, *many, 50)
    assert np.allclose(got, want) and 0 < made < len(want) * 40
    got, _ = p.rest(closed, row, col, amount, *few, 50)
    assert np.allclose(got, want.reshape(20, 50)[4, 3])
