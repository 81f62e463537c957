import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import fixed_values as V
from corpusloom.operators import chunking


def test_fixed_windows_equal_slices(spark):
    texts = ["", "a", "ab" * 5, "é😀" * 40, "line\nline\n" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in [(10, 0), (10, 3), (10, 5), (10, 7), (100, 15)]:
        got = {(r["doc_id"], r["chunk_index"]): r["text"] for r in chunking.chunk_fixed(df, size, overlap).collect()}
        want = {(i, n): t[s:s + size] for i, t in enumerate(texts) for n, s in enumerate(range(0, len(t), size - overlap))}
        assert got == want


def merged_by_fold(chunks, least):
    out, i = [], 0
    while i < len(chunks):
        if len(chunks[i]) < least and i + 1 < len(chunks):
            out.append([i, i + 1])
            i += 2
        elif len(chunks[i]) < least and out:
            out[-1].append(i)
            i += 1
        else:
            out.append([i])
            i += 1
    return out


def test_merge_small_chunks_equals_the_fold(spark):
    random.seed(7)
    docs = [["x" * random.choice([5, 5, 60]) for _ in range(random.randint(1, 12))] for _ in range(60)]
    docs += [["x"], ["x" * 60, "x"], ["x", "x"], ["x", "x", "x"]]
    rows = [(d, i, t) for d, chunks in enumerate(docs) for i, t in enumerate(chunks)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_index int, text string")
    got = {}
    for r in chunking.merge_small_chunks(df).collect():
        got.setdefault(r["doc_id"], []).append(([int(i) for i in r["original_indices"].split(",")], r["text"]))
    for d, chunks in enumerate(docs):
        want = [(g, " ".join(chunks[i] for i in g)) for g in merged_by_fold(chunks, 50)]
        assert sorted(got[d]) == sorted(want)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(20, 60), st.integers(0, 10))
def test_splitter_keeps_words_and_size(text, size, overlap):
    chunks = chunking.split_recursive(text, size, overlap, V.SEPARATORS, True)
    assert all(0 < len(c) <= size for c in chunks)
    assert "".join(text.split()) == "" or chunks
    if overlap == 0:
        assert "".join("".join(c.split()) for c in chunks) == "".join(text.split())


def test_clamp(spark):
    df = spark.createDataFrame([(100, 50), (3000, 800), (400, 300), (1000, 600), (1000, 200)], "s int, o int")
    size, overlap = chunking.clamp_chunk_params(F.col("s"), F.col("o"))
    assert [tuple(r) for r in df.select(size, overlap).collect()] == [
        (200, 150), (1500, 375), (400, 100), (1000, 250), (1000, 200)]


@pytest.mark.parametrize("enhanced", [True, False])
def test_table_function_equals_the_operator(spark, enhanced):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(
        spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    chunking.register_table_functions(spark)
    docs.createOrReplaceTempView("documents_here")
    got = spark.sql(f"SELECT doc_id, c.* FROM documents_here, LATERAL chunk_text(text, 600, 80, {str(enhanced).lower()}) c")
    want = chunking.chunk_text(docs, 600, 80, enhanced).select("doc_id", "chunk_index", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert max(len(r["chunk"]) for r in got.collect()) <= 600 or not enhanced
