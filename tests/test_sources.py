import json

import pytest
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.sources import readers, sinks


def test_text_files_and_empty_ones(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("hello\nworld")
    (tmp_path / "sub" / "b.txt").write_text("deep")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "c.md").write_text("other")
    docs, rejects = readers.read_text_files(spark, str(tmp_path))
    assert {(r["source"], r["text"]) for r in docs.collect()} == {("a.txt", "hello\nworld"), ("b.txt", "deep")}
    assert [r["path"].split("/")[-1] for r in rejects.collect()] == ["empty.txt"]
    assert readers.list_files(spark, str(tmp_path), "*.txt", recursive=False).count() == 2


def test_manifest(spark, tmp_path):
    import hashlib
    (tmp_path / "a.TXT").write_text("abc")
    row = readers.file_manifest(spark, str(tmp_path)).first()
    assert (row["name"], row["extension"], row["size"], row["sha256"]) == ("a.TXT", ".txt", 3, hashlib.sha256(b"abc").hexdigest())


def test_log_skips_bad_lines_and_routing_events(spark, tmp_path):
    good = {"timestamp": "2024-01-01T00:00:00Z", "query": "q", "query_hash": 1, "latency": 0.5, "hit_count": 2}
    lines = [json.dumps(good), "{broken", json.dumps({**good, "event_type": "engine_routing"}), "not json"]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    got = readers.read_jsonl_log(spark, str(tmp_path / "log.jsonl")).collect()
    assert len(got) == 1 and got[0]["latency"] == 0.5


def test_question_files(spark, tmp_path):
    for name, n in [("one", 2), ("two", 3)]:
        (tmp_path / f"{name}.json").write_text(json.dumps([{"question": f"q{i}", "answer": "a"} for i in range(n)], indent=1))
    got = readers.read_qa(spark, {n: str(tmp_path / f"{n}.json") for n in ("one", "two")})
    assert {r["source"]: r["count"] for r in got.groupBy("source").count().collect()} == {"one": 2, "two": 3}


def test_update_store(spark, tmp_path):
    path = str(tmp_path / "store")
    def rows(n, d):
        return spark.range(n).select("id", F.array_repeat(F.lit(1.0), d).alias("embedding"))
    assert sinks.update_store(spark, path, rows(3, 4)) == "overwrite"
    assert sinks.update_store(spark, path, rows(2, 4)) == "append" and spark.read.parquet(path).count() == 5
    assert sinks.update_store(spark, path, rows(2, 8)) == "overwrite" and spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        sinks.update_store(spark, path, rows(1, 4).unionByName(rows(1, 8)))
    with pytest.raises(ValueError):
        sinks.update_store(spark, path, rows(1, 4).withColumn("text", F.lit(None).cast("string")))


def test_questions_follow_turns(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "user", "q2"), (1, 4, "user", "q3"),
             (1, 999, "assistant", "a3"), (1, 1500, "user", "q4"), (1, 2500, "assistant", "a4")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert {(r["question"], r["answer"]) for r in readers.qa_from_conversations(df).collect()} == {("q1", "a1"), ("q3", "a3"), ("q4", "a4")}


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="chunk_id"):
        schemas.need(spark.range(1), "id", "chunk_id")


def test_update_store_keeps_what_it_cannot_read(spark, tmp_path):
    import pytest
    path = str(tmp_path / "other")
    spark.range(5).write.parquet(path)
    new = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<double>")
    with pytest.raises(ValueError):
        sinks.update_store(spark, path, new)
    assert spark.read.parquet(path).count() == 5


def test_feedback_log_and_entries_without_hash(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"feedback_id": "1", "feedback": {"type": "positive"}}\nno json\n')
    rows = readers.read_feedback_log(spark, str(tmp_path / "f.jsonl")).collect()
    assert [(r["feedback_id"], r["feedback"]["type"]) for r in rows] == [("1", "positive")]
    (tmp_path / "q.jsonl").write_text('{"query": "a"}\n{"event_type": "route", "query": "b"}\nbroken\n')
    assert [r["query"] for r in readers.read_jsonl_log(spark, str(tmp_path / "q.jsonl")).collect()] == ["a"]
