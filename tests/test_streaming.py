import datetime
import time

from pyspark.sql import functions as F

from lakeweave import params as P
from lakeweave.streaming import events as E
from lakeweave.streaming import ingest

SCHEMA = (
    "task_id string, seq bigint, type string, agent string, layer string, timestamp timestamp, input_size bigint, "
    "output_size bigint, latency_ms double, llm_tokens bigint, reason string, message string"
)
T0 = datetime.datetime(2024, 1, 1)


def event(task, seq, kind, agent=None, layer=None, size=None, at=None):
    ts = T0 + datetime.timedelta(seconds=seq if at is None else at)
    return (task, seq, kind, agent, layer, ts, size, None, None, None, None, None)


ROWS = [
    event("a", 1, "agent_started", "Planner"),
    event("a", 2, "agent_completed", "Planner", size=3),
    event("a", 3, "progress", "Planner"),
    event("a", 4, "agent_started", "Retrieval", "L1"),
    event("a", 5, "agent_started", "Retrieval"),
    event("a", 6, "agent_failed", "Other"),
    event("b", 7, "agent_degraded", "Matcher", "LLM"),
    event("b", 8, "task_completed"),
    event("b", 9, "agent_failed", "Planner"),
]
WANT = {
    ("a", "Planner"): ("success", 3),
    ("a", "Retrieval:L1"): ("running", None),
    ("b", "Matcher:LLM"): ("degraded", None),
    ("b", "Planner"): ("failed", None),
}


def folded(df):
    return {(r.task_id, r.node): (r.status, r.input_size) for r in df.collect()}


def test_timeline_fold(spark):
    events = spark.createDataFrame(ROWS, SCHEMA)
    assert folded(E.fold_timeline(events)) == WANT
    full = folded(E.full_timeline(E.fold_timeline(events), events))
    assert len(full) == 16 and full["b", "Profiling"] == ("pending", None)


def test_streamed_timeline_equals_batch_in_any_order(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    # Two runs over the same checkpoint; the later event of a node arrives first.
    for part in (ROWS[1::2], ROWS[0::2]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        E.stream_timeline(stream, out, checkpoint).awaitTermination()
    assert folded(E.current_timeline(spark.read.parquet(out))) == WANT


def test_stream_history_stops_and_drops_repeats(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for part in (ROWS[:7], ROWS[5:]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(source)
        history = E.stream_history(spark.readStream.schema(SCHEMA).parquet(source), idle_seconds=None)
        (history.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
         .start(out, format="parquet").awaitTermination())
    got = sorted(r.seq for r in spark.read.parquet(out).collect())
    assert got == [1, 2, 3, 4, 5, 6, 7, 8]


def streamed(spark, source, out, checkpoint, parts, **options):
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        history = E.stream_history(spark.readStream.schema(SCHEMA).parquet(source), idle_seconds=None, **options)
        (history.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
         .start(out, format="parquet").awaitTermination())
    return sorted((r.task_id, r.seq) for r in spark.read.parquet(out).collect())


def test_events_from_before_the_end_pass_in_any_order(spark, tmp_path):
    """Events and ends come late; what the stream gives is what the batch gives."""
    paths = [str(tmp_path / n) for n in ("in", "out", "cp")]
    end = P.TERMINAL_EVENT
    parts = (
        [event("a", 1, "progress", at=1), event("a", 3, "progress", at=3), event("a", 9, end, at=9), event("b", 2, "progress", at=2)],
        [event("a", 5, "progress", at=5), event("a", 20, "progress", at=20), event("b", 4, end, at=4)],
        [event("a", 8, end, at=8), event("a", 9, "progress", at=9), event("b", 3, "progress", at=3), event("b", 5, "progress", at=5)],
        [event("a", 6, "progress", at=6), event("a", 30, "progress", at=30), event("c", 1, "progress", at=1)],
    )
    got = streamed(spark, *paths, parts)
    # The end at 9 was passed on before the one at 8 was known.
    assert got == [("a", 1), ("a", 3), ("a", 5), ("a", 6), ("a", 8), ("a", 9), ("b", 2), ("b", 3), ("b", 4), ("c", 1)]


def test_recent_events_of_a_stream(spark, tmp_path):
    import random

    rows = [event(t, 100 * k + i, "progress", at=10 * i + k) for k, t in enumerate("abcdef") for i in range(30)]
    random.Random(4).shuffle(rows)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for i in range(0, len(rows), 45):
        spark.createDataFrame(rows[i : i + 45] + rows[max(0, i - 9) : i], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        E.stream_recent(spark.readStream.schema(SCHEMA).parquet(source), out, checkpoint, per_task=7, tasks=10).awaitTermination()
    want = E.bounded_history(spark.createDataFrame(rows, SCHEMA), per_task=7, tasks=10)
    key = lambda df: sorted((r.task_id, r.seq) for r in df.collect())
    assert key(E.recent_events(spark, out)) == key(want) and len(key(want)) == 42
    import os

    assert len([n for n in os.listdir(out) if n.startswith("batch=")]) == 2  # earlier ones are gone


def test_tasks_beyond_the_bound_begin_anew(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    parts = ([event("a", 1, "progress", at=1)], [event("b", 2, "progress", at=2), event("c", 3, "progress", at=3)], [event("a", 4, "progress", at=4)])
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        E.stream_recent(spark.readStream.schema(SCHEMA).parquet(source), out, checkpoint, tasks=2).awaitTermination()
    assert sorted((r.task_id, r.seq) for r in E.recent_events(spark, out).collect()) == [("a", 4), ("c", 3)]


def test_silent_tasks_stop_beating(spark, tmp_path):
    """A task whose end is lost gets a bounded number of heartbeats."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    spark.createDataFrame([event("a", 1, "progress", at=1)], SCHEMA).write.parquet(source)
    history = E.stream_history(spark.readStream.schema(SCHEMA).parquet(source), idle_seconds=1, most_beats=2)
    run = history.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime="500 milliseconds").start(out, format="parquet")
    try:
        time.sleep(20)
    finally:
        run.stop()
    beats = spark.read.schema("task_id string, type string").parquet(out).filter("type = 'heartbeat'").count()
    assert beats == 2


def test_replayed_and_late_events(spark, tmp_path):
    """Replays are dropped however many events lie between, late rows are counted, and state is bounded."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    parts = (
        [event("a", i, "progress", at=i) for i in range(6)],
        [event("a", i, "progress", at=i) for i in (0, 1)] + [event("b", 50, "progress", at=50_000)],
        [event("a", 7, "progress", at=7), event("b", 51, "progress", at=50_001)],
    )
    dropped = 0
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        history = E.stream_history(spark.readStream.schema(SCHEMA).parquet(source), idle_seconds=None)
        run = (history.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
               .start(out, format="parquet"))
        run.awaitTermination()
        dropped += E.late_rows(run)
    assert sorted(r.seq for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4, 5, 50, 51]
    assert dropped == 1
    numbers = next(op for op in run.recentProgress[-1]["stateOperators"] if "dedup" in op["operatorName"].lower())
    assert numbers["numRowsTotal"] == 2  # those of task a are behind the watermark


def test_idle_task_gets_a_heartbeat(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    spark.createDataFrame(ROWS[6:8] + ROWS[:1], SCHEMA).write.parquet(source)
    history = E.stream_history(spark.readStream.schema(SCHEMA).parquet(source), idle_seconds=1)
    run = history.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime="500 milliseconds").start(
        out, format="parquet")
    try:
        deadline = time.time() + 60
        beats = set()
        while not beats and time.time() < deadline:
            time.sleep(1)
            if run.lastProgress:
                beats = {r.task_id for r in spark.read.schema("task_id string, type string").parquet(out)
                         .filter("type = 'heartbeat'").collect()}
    finally:
        run.stop()
    assert beats == {"a"}


def test_history_bounds(spark):
    rows = [event(f"t{i % 4}", i, "progress") for i in range(40)]
    got = E.bounded_history(spark.createDataFrame(rows, SCHEMA), per_task=3, tasks=2).collect()
    assert sorted(r.seq for r in got) == [30, 31, 34, 35, 38, 39]


def test_heartbeats_fill_gaps_across_hours(spark):
    times = [0, 5, 3590, 3605, 3605, 7300]
    events = spark.createDataFrame([event("a", i, "progress", at=t) for i, t in enumerate(times)], SCHEMA)
    want = {a + k for a, b in zip(times, times[1:]) for k in range(10, b - a, 10)}

    def brute(until):
        return {int((r.timestamp - T0).total_seconds()) for r in E.heartbeats(events, until=until).collect()}

    def shifted(base):
        return {a + k for a, b in zip(base, base[1:]) for k in range(10, b - a, 10)}

    assert brute(None) == shifted(times) == {t for t in want}
    end = F.lit(T0 + datetime.timedelta(seconds=7325))
    assert brute(end) - brute(None) == {7310, 7320}


def test_until_terminal(spark):
    got = E.until_terminal(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted(r.seq for r in got) == [1, 2, 3, 4, 5, 6, 7, 8]


def test_continuous_ingest(spark, tmp_path):
    folder, store, checkpoint = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "cp")
    folder.mkdir()
    (folder / "a.csv").write_text("id,v\n1,2\n2,4\n")
    (folder / "broken.csv").write_text("\n")
    (folder / "zero.csv").write_text("")
    ingest.stream_tables(spark, str(folder), store, checkpoint).awaitTermination()
    (folder / "copy.csv").write_text("id,v\n1,2\n2,4\n")
    (folder / "b.csv").write_text("id,w\n1,x\n")
    ingest.stream_tables(spark, str(folder), store, checkpoint).awaitTermination()
    got = {r.source_uri.rsplit("/", 1)[-1]: r.status for r in spark.read.parquet(f"{store}/registry").collect()}
    assert got == {"a.csv": "READY", "broken.csv": "FAILED", "zero.csv": "FAILED", "copy.csv": "REJECTED", "b.csv": "READY"}
    assert spark.read.parquet(f"{store}/profiles").count() == 4
