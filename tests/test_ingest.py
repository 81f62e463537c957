"""The ingest plan from documents to a versioned store."""

import numpy as np

from corpusloom.functions import text as T
from corpusloom.operators import chunking, encoders, vectors
from corpusloom.plans import ingest


def test_ingest_keeps_each_text_once_with_metadata(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    docs = docs.unionByName(docs.where("doc_id < 5").withColumn("doc_id", docs["doc_id"] + 1000)).unionByName(
        spark.createDataFrame([(2000, None, "en", "s", 0), (2001, "  ", "en", "s", 0)], docs.schema))
    path, encoder = str(tmp_path / "store"), encoders.hashing_encoder(64)
    assert ingest.ingest(docs, path, 600, 80, encoder, 64, threshold=0.97) == 0
    rows = ingest.store(spark, path).collect()
    ready = docs.select("doc_id", "source", T.prepare_text(T.text_of("text")).alias("text"))
    chunks = {(r["doc_id"], r["chunk_index"]): r["text"] for r in chunking.filter_valid_chunks(chunking.chunk_text(ready, 600, 80)).collect()}
    # greedy by document and chunk number
    order, kept = sorted(chunks), []
    vec = encoder([chunks[k] for k in order])
    for i in range(len(order)):
        if not kept or np.round(vec[kept] @ vec[i] + 1e-9, 6).max() <= 0.97:
            kept.append(i)
    assert sorted((r["doc_id"], r["chunk_index"]) for r in rows) == [order[i] for i in kept]
    assert 0 < len(rows) < len(chunks) and not any(r["doc_id"] >= 1000 for r in rows)
    assert all(r["metadata"]["chunk_size"] == len(r["text"]) and r["metadata"]["size"] == 600 and len(r["embedding"]) == 64 for r in rows)
    # the store is searched as it is, and replaced as a whole
    query = spark.createDataFrame([(1, [float(x) for x in rows[0]["embedding"]])], "query_id long, embedding array<double>")
    assert vectors.knn_exact(query, ingest.store(spark, path), 1).first()["score"] == 1.0
    assert ingest.ingest(docs.where("doc_id < 3"), path, 600, 80, encoder, 64) == 1
    assert {r["doc_id"] for r in ingest.store(spark, path).collect()} <= {0, 1, 2}
