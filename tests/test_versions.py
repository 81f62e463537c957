from pyspark.sql import functions as F

from corpusloom.sources import versions
from corpusloom.streaming import streams

SCHEMA = "chunk_id string, v int"


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def held(spark, path, version=None):
    return {r["chunk_id"]: r["v"] for r in versions.read_store(spark, path, SCHEMA, version).collect()}


def test_a_reader_sees_old_or_new(spark, tmp_path):
    path = str(tmp_path / "store")
    assert held(spark, path) == {}
    versions.replace_store(rows(spark, ("a", 1), ("b", 1)), path, buckets=4)
    reader = versions.read_store(spark, path, SCHEMA)  # opened before the change
    # a writer that fails before its commit leaves parts that nobody reads
    versions._write(rows(spark, ("x", 9)), path, "chunk_id", 4, [0, 1, 2, 3], 1)
    assert held(spark, path) == {"a": 1, "b": 1}
    assert versions.replace_store(rows(spark, ("c", 2)), path, buckets=4) == 1
    assert {r["chunk_id"] for r in reader.collect()} == {"a", "b"}
    assert held(spark, path) == {"c": 2} and held(spark, path, 0) == {"a": 1, "b": 1}


def test_a_store_may_replace_itself(spark, tmp_path):
    path = str(tmp_path / "store")
    versions.replace_store(rows(spark, ("a", 1), ("b", 2)), path)
    versions.replace_store(versions.read_store(spark, path, SCHEMA).withColumn("v", F.col("v") + 10), path)
    assert held(spark, path) == {"a": 11, "b": 12}
    versions.replace_store(rows(spark), path)
    assert held(spark, path) == {}


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    path = str(tmp_path / "store")
    versions.replace_store(spark.range(200).select(F.col("id").cast("string").alias("chunk_id"), F.lit(0).alias("v")), path, buckets=8)
    want = {str(i): 0 for i in range(200)}
    for n in range(6):
        before = versions.current(spark, path)[1]
        versions.upsert_store(rows(spark, ("7", n), ("7", n + 1), ("new", n)), path)
        after = versions.current(spark, path)[1]
        assert 1 <= sum(before[b] != after[b] for b in before) <= 2 and len(after) == 8
        want |= {"7": n + 1, "new": n}
    assert held(spark, path) == want


def test_a_repeated_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "store")
    write = versions.upsert_writer(path, buckets=4)
    write(rows(spark, ("a", 1)), 0)
    write(rows(spark, ("a", 2)), 1)
    version = versions.current(spark, path)[0]
    write(rows(spark, ("a", 2)), 1)
    assert versions.current(spark, path)[0] == version and held(spark, path) == {"a": 2}
    # a stream with a new checkpoint counts from 0 again under another name
    versions.upsert_writer(path, stream="second")(rows(spark, ("a", 3)), 0)
    assert held(spark, path) == {"a": 3}


def test_a_stream_with_several_files_and_a_restart(spark, tmp_path):
    path, source, progress = (str(tmp_path / n) for n in ("store", "in", "progress"))
    want = {}
    for n in range(3):
        rows(spark, *[(f"c{i}", n) for i in range(n, n + 5)]).coalesce(1).write.mode("append").parquet(source)
        want |= {f"c{i}": n for i in range(n, n + 5)}
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        streams.run_once(stream.writeStream.foreachBatch(versions.upsert_writer(path, buckets=4)), progress)
    assert held(spark, path) == want and versions.current(spark, path)[0] == 2
