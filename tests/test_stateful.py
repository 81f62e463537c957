"""Streams with own state over several files: expiry, late rows, restart."""

from datetime import datetime, timedelta

import pytest

from corpusloom.streaming import stateful, streams

T0 = datetime(2024, 1, 1)


def ms(minute):
    return 1_704_067_200_000 + 60_000 * minute


@pytest.fixture
def feed(spark, tmp_path):
    """Writes one file per call, runs the stream on it (a restart each time) and returns all rows so far."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.with_state_store(spark)
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def run(rows, schema, build):
        spark.createDataFrame([(T0 + timedelta(minutes=m), *rest) for m, *rest in rows], schema).coalesce(1).write.mode("append").parquet(source)
        made = build(spark.readStream.schema(schema).parquet(source))
        last = streams.run_once(made.writeStream.outputMode("append").format("parquet").option("path", out), progress)
        return spark.read.schema(made.schema).parquet(out).collect(), last
    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_duplicates_expire_and_come_again(feed):
    schema = "ts timestamp, doc_id long, text string"
    build = lambda s: stateful.duplicates(s, "60 minutes", "10 minutes")
    rows, _ = feed([(0, 1, "A b"), (5, 2, "a  B!"), (6, 3, "c")], schema, build)
    assert sorted((r["doc_id"], r["event"], r["copies"]) for r in rows) == [(1, "first", 1), (3, "first", 1)]
    # a restart keeps the state: one more copy, and a row after the horizon
    rows, _ = feed([(59, 4, "a b"), (60, 5, "a b"), (61, 6, "a b")], schema, build)
    assert sorted((r["doc_id"], r["event"], r["copies"], r["first_ms"]) for r in rows if r["doc_id"] != 3) == [
        (1, "closed", 3, ms(0)), (1, "first", 1, ms(0)), (5, "first", 1, ms(60))]
    # a timer closes what nobody comes back to, and a row behind the watermark is dropped
    rows, last = feed([(500, 7, "d"), (501, 8, "c")], schema, build)
    assert (3, "closed", 1) in {(r["doc_id"], r["event"], r["copies"]) for r in rows} and (5, "closed", 2) in {(r["doc_id"], r["event"], r["copies"]) for r in rows}
    rows, last = feed([(20, 9, "late text")], schema, build)
    assert 9 not in {r["doc_id"] for r in rows}
    assert sum(s["numRowsDroppedByWatermark"] for p in last.recentProgress for s in p["stateOperators"]) == 1


def test_sessions_show_early_and_close(feed):
    schema = "ts timestamp, session_id string, latency double"
    build = lambda s: stateful.early_sessions(s, "30 minutes", "10 minutes")
    rows, _ = feed([(0, "a", 1.0), (10, "a", 3.0), (12, "b", 5.0)], schema, build)
    assert sorted((r["session_id"], r["queries"], r["avg_latency"], r["event"]) for r in rows) == [("a", 2, 2.0, "early"), ("b", 1, 5.0, "early")]
    rows, _ = feed([(39, "a", 5.0), (70, "a", 7.0)], schema, build)
    got = {(r["session_id"], r["queries"], r["event"], r["start_ms"]) for r in rows}
    # 39 is within the gap of 10, 70 is not within that of 39
    assert {("a", 3, "closed", ms(0)), ("a", 1, "early", ms(70))} <= got
    rows, _ = feed([(400, "c", 1.0)], schema, build)
    got = {(r["session_id"], r["queries"], r["event"], r["start_ms"]) for r in rows}
    assert {("b", 1, "closed", ms(12)), ("a", 1, "closed", ms(70))} <= got


def test_a_session_moves_its_timer_once_a_batch():
    import pandas as pd
    from corpusloom.streaming import stateful as st
    calls, held = [], []

    class Value:
        exists = staticmethod(lambda: bool(held))
        get = staticmethod(lambda: held[-1])
        update = staticmethod(held.append)

    class Handle:
        getValueState = staticmethod(lambda *_: Value)
        registerTimer = staticmethod(lambda at: calls.append(("on", at)))
        deleteTimer = staticmethod(lambda at: calls.append(("off", at)))

    sessions = st.Sessions(100)
    sessions.init(Handle)
    def batch(*ms):
        return [tuple(r) for p in sessions.handleInputRows(("a",), iter([pd.DataFrame({"ms": ms, "latency": [1.0] * len(ms)})]), None)
                for r in p[["start_ms", "last_ms", "queries", "event"]].itertuples(index=False)]
    assert batch(50, 0, 300, 310) == [(0, 50, 2, "closed"), (300, 310, 2, "early")]
    assert batch(305) == [(300, 310, 3, "early")]
    assert batch(400, 900) == [(300, 400, 4, "closed"), (900, 900, 1, "early")]
    assert calls == [("on", 410), ("off", 410), ("on", 1000)]
