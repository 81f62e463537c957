from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusloom.streaming import streams

T0 = datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(T0 + timedelta(minutes=m), s, "view", float(v), h) for m, s, v, h in rows],
                                 "ts timestamp, session_id string, engine string, latency double, hit_count int")


def feed(spark, tmp_path, frames, build, mode="append"):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    last = None
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(source)
        made = build(spark.readStream.schema(df.schema).parquet(source))
        last = streams.run_once(made.writeStream.outputMode(mode).format("parquet").option("path", out), progress)
    return spark.read.schema(made.schema).parquet(out), last


def test_windows_close_once_and_late_rows_are_counted(spark, tmp_path):
    frames = [events(spark, [(5, "a", 1, 0), (10, "a", 3, 2), (300, "b", 1, 1)]), events(spark, [(20, "a", 9, 1), (600, "b", 1, 1)])]
    got, last = feed(spark, tmp_path, frames, streams.query_metrics)
    rows = {r["start"].hour: (r["n"], r["avg_latency"], r["zero_hits"]) for r in got.collect()}
    assert rows == {0: (2, 2.0, 1), 5: (1, 1.0, 0)}
    dropped = sum(s["numRowsDroppedByWatermark"] for p in last.recentProgress for s in p["stateOperators"])
    assert dropped == 1


def test_session_of_two_events_in_one_gap(spark, tmp_path):
    frames = [events(spark, [(0, "a", 1, 1), (20, "a", 1, 1), (100, "a", 1, 1), (900, "b", 1, 1)])]
    got, _ = feed(spark, tmp_path, frames, streams.sessions)
    assert sorted((r["session_id"], r["queries"]) for r in got.collect()) == [("a", 1), ("a", 2)]


def test_duplicates_across_batches(spark, tmp_path):
    def docs(*texts):
        return spark.createDataFrame([(T0, t) for t in texts], "ts timestamp, text string")
    got, _ = feed(spark, tmp_path, [docs("A b", "a  B!", "c"), docs("c", "d")], lambda s: streams.dedup(s).select("text", "content_hash"))
    assert got.count() == 3


def test_each_file_is_ingested_once(spark, tmp_path):
    text = "A sentence that is long enough to be kept as a chunk of its own. " * 3
    def docs(i):
        return spark.createDataFrame([(i, "s", text)], "doc_id long, source string, text string")
    got, _ = feed(spark, tmp_path, [docs(1), docs(2)], lambda s: streams.ingest(s, 1000, 100))
    assert sorted(r["chunk_id"] for r in got.collect()) == ["1-0", "2-0"]


def test_upserts_take_the_latest_batch_and_repeat_safely(spark, tmp_path):
    path = str(tmp_path / "store")
    write = streams.upsert_batch(path)
    def rows(*r):
        return spark.createDataFrame(list(r), "chunk_id string, v int")
    write(rows(("a", 1), ("b", 1)), 0)
    write(rows(("b", 2), ("c", 2)), 1)
    write(rows(("b", 2), ("c", 2)), 1)  # the same batch again
    want = {"a": 1, "b": 2, "c": 2}
    assert {r["chunk_id"]: r["v"] for r in streams.read_upserted(spark, path).collect()} == want
    streams.compact(spark, path, str(tmp_path / "small"))
    assert {r["chunk_id"]: r["v"] for r in streams.read_upserted(spark, str(tmp_path / "small")).collect()} == want


def test_upserts_of_one_batch_and_of_a_new_checkpoint(spark, tmp_path):
    path = str(tmp_path / "ups")
    rows = lambda *r: spark.createDataFrame(list(r), "chunk_id string, v int, at int")
    streams.upsert_batch(path, order="at")(rows(("a", 1, 2), ("a", 9, 1), ("b", 3, 1)), 0)
    first = streams.next_batch(spark, path)
    streams.upsert_batch(path, order="at", first=first)(rows(("b", 4, 1)), 0)
    assert first == 1 and {r["chunk_id"]: r["v"] for r in streams.read_upserted(spark, path).collect()} == {"a": 1, "b": 4}


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    from corpusloom.plans import catalog
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("part-*")).rename(tmp_path / "file")
    (tmp_path / "single").mkdir()
    (tmp_path / "file").rename(tmp_path / "single" / "documents.parquet")
    wanted = streams.ingest(docs, 1000, 150).count()
    for folder in (tmp_path, tmp_path / "single"):
        assert catalog.QUERIES["s1_stream_ingest"](spark, str(folder)).count() == wanted > 0
        assert catalog.QUERIES["s2_stream_dedup"](spark, str(folder)).count() > 0


def test_parts_of_a_stream_are_written_by_all_tasks(spark, monkeypatch, tmp_path):
    """A part arrives as several files and is one micro-batch; rows of a content meet across parts."""
    from corpusloom.plans import queries_streams as Q
    from corpusloom.plans.tables import Tables
    from corpusloom.streaming import stateful
    rows = [(i, f"text {i % 7}") for i in range(90)] + [(None, "lost")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).select("doc_id", "text", F.timestamp_seconds(60 * F.col("doc_id")).alias("ts"))
    folders, scratch = [], Q.scratch_folder
    monkeypatch.setattr(Q, "scratch_folder", lambda s, name: folders.append((name, scratch(s, name))) or folders[-1][1])
    build = lambda s: stateful.duplicates(s, "3 hours", "630 seconds")
    got = sorted(Q._run_by_parts(Tables(spark, ""), docs, "doc_id", build).collect())
    arrived = spark.read.parquet(dict(folders)["arrivals"]).select(F.input_file_name().alias("f"), "doc_id")
    assert arrived.select("f").distinct().count() > 3
    want = sorted(Q._run_stateful(Tables(spark, ""), Q._arrivals(Tables(spark, ""), docs, "doc_id"), docs.schema, build).collect())
    assert got == want and sum(r["event"] == "first" for r in got) == 7
