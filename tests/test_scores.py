import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scores as S

random.seed(5)
# one key holds most of the rows
ROWS = [("hot" if i % 3 else f"k{i % 7}", i, float(random.randint(0, 50))) for i in random.sample(range(500), 400)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "key string, at long, x double").repartition(5)


def per_key():
    out = {}
    for k, at, x in sorted(ROWS, key=lambda r: r[1]):
        out.setdefault(k, []).append((at, x))
    return out


def test_numbered_and_previous(df):
    slices = F.floor(F.col("at") / 20)
    got = {(r["key"], r["at"]): (r["n"], r["before"]) for r in S.previous(
        S.numbered(df, "at", slices, to="n", keys=("key",)), ["key"], "at", "x", slices, "before").collect()}
    want = {(k, at): (i + 1, v[i - 1][1] if i else None) for k, v in per_key().items() for i, (at, _) in enumerate(v)}
    assert got == want


def test_rolling_mean_over_block_borders(df):
    seq = S.numbered(df, "at", F.floor(F.col("at") / 50))
    got = {r["at"]: round(r["m"], 9) for r in S.rolling_mean(seq, "seq", "x", 50, "m", block=64).collect()}
    xs = sorted((at, x) for _, at, x in ROWS)
    want = {at: round(sum(v for _, v in xs[max(0, i - 49):i + 1]) / min(50, i + 1), 9) for i, (at, _) in enumerate(xs)}
    assert got == want


def test_upper_median(df):
    got = {r["key"]: r["m"] for r in S.upper_median(df, ["key"], "x", "m").collect()}
    assert got == {k: sorted(x for _, x in v)[len(v) // 2] for k, v in per_key().items()}


def test_top_k_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(0, "b", 1.0), (0, "a", 1.0), (0, "c", 2.0)], "query_id long, chunk_id string, score double")
    assert [r["chunk_id"] for r in S.top_k(df, 2).orderBy("rank").collect()] == ["c", "a"]


def test_null_keys_are_numbered_too(spark):
    from corpusloom.functions import scores as S
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("a", None)], "k string, o int")
    out = S.numbered(rows, "o", F.floor(F.col("o") / 10), keys=("k",))
    assert sorted(((r["k"] or "", r["o"] or 0, r["seq"]) for r in out.collect())) == [("", 3, 1), ("", 4, 2), ("a", 0, 1), ("a", 1, 2), ("a", 2, 3)]
    lag = S.previous(rows, ["k"], "o", "o", F.floor(F.col("o") / 10), "before")
    assert sorted(((r["k"] or "", r["o"] or 0, r["before"]) for r in lag.collect()), key=str) == [("", 3, None), ("", 4, 3), ("a", 0, None), ("a", 1, None), ("a", 2, 1)]
