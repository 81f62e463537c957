import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check import TABLES, plain  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["a3_list_files", "a4_file_manifest", "a5_versioned_store", "d3_recall", "d5_similarity_profile", "ask_contexts",
          "v6_answer_correct_semantic", "b5_prepare_text", "b10_merge_small_chunks", "c1_extract_links", "d2_knn_exact", "e1_keyword_search",
          "e3_bm25_search", "f1_fuse_minmax", "f11_assemble_context", "g18_session_order", "h1_similar_documents", "h8_cluster_topics",
          "v12_summarise_configs", "v25_parameter_sweep", "v27_spot_check_sample", "s5_stream_sessions", "answer_contexts"]


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    res = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=str)
    assert sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=str) == want


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
