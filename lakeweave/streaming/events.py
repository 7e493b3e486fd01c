"""Task events: history, timeline, end and heartbeat, on batches and on streams.

An event has ``task_id, type, agent, layer, timestamp``, a unique ``seq`` that breaks
ties in time, and the metrics ``input_size .. message``. The batch functions hold
for any history. On a stream the timeline keeps no state, as its parts can be merged at any time; the
history remembers sequence numbers until the watermark has passed them, and the end of each task that is over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave import params as P

_ORDER = ["timestamp", "seq"]


def enrich(events: DataFrame, task_id, timestamp) -> DataFrame:
    """Scope events to their task and stamp them."""
    return events.withColumn("task_id", task_id).withColumn("timestamp", timestamp)


def of_tasks(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """Only events of the given tasks; also as a stream against a static table."""
    return events.join(tasks.select("task_id").distinct(), "task_id", "left_semi")


def bounded_history(
    events: DataFrame, per_task: int = P.EVENTS_PER_TASK, tasks: int = P.TASKS_KEPT
) -> DataFrame:
    """The last ``per_task`` events of the ``tasks`` most recently active tasks.

    The tasks are chosen from one row each, by a top-n that never sorts all of them in
    one place; the rank within a task is cut before the shuffle.
    """
    recent = (
        events.groupBy("task_id")
        .agg(F.max(F.struct(*_ORDER)).alias("last"))
        .orderBy(F.col("last").desc(), "task_id")
        .limit(tasks)
        .select("task_id")
    )
    w = Window.partitionBy("task_id").orderBy(*[F.col(c).desc() for c in _ORDER])
    return (
        events.join(recent, "task_id", "left_semi")
        .withColumn("age", F.row_number().over(w))
        .filter(F.col("age") <= per_task)
        .drop("age")
    )


def until_terminal(events: DataFrame, terminal: str = P.TERMINAL_EVENT) -> DataFrame:
    """Drop what follows the first terminal event of a task."""
    ends = (
        events.filter(F.col("type") == terminal)
        .groupBy("task_id")
        .agg(F.min(F.struct(*_ORDER)).alias("end"))
    )
    return (
        events.join(ends, "task_id", "left")
        .filter(F.col("end").isNull() | (F.struct(*_ORDER) <= F.col("end")))
        .drop("end")
    )


def heartbeats(events: DataFrame, seconds: int = P.HEARTBEAT_SECONDS, until=None) -> DataFrame:
    """``task_id, timestamp, type``: one heartbeat per ``seconds`` without an event.

    ``until`` also fills the time after the last event of a task that has not ended.
    Events fall into cells of ``seconds``; no gap within a cell is long enough, so the
    first and last event of each cell decide. They combine before the shuffle, and what
    is ordered per task is bounded by time and not by the number of events.
    """
    cells = events.groupBy(
        "task_id", F.expr(f"unix_micros(timestamp) div {seconds * 1_000_000}L").alias("cell")
    ).agg(
        F.min("timestamp").alias("first"),
        F.max("timestamp").alias("timestamp"),
        F.max_by("type", F.struct(*_ORDER)).alias("last_type"),
    )
    gaps = cells.withColumn("next", F.lead("first").over(Window.partitionBy("task_id").orderBy("cell")))
    if until is not None:
        open_end = F.when(F.col("last_type") != P.TERMINAL_EVENT, until)
        gaps = gaps.withColumn("next", F.coalesce("next", open_end))
    beat = f"interval {seconds} seconds"
    return gaps.filter(f"next > timestamp + {beat}").selectExpr(
        "task_id",
        f"explode(filter(sequence(timestamp + {beat}, next, {beat}), t -> t < next)) AS timestamp",
        "'heartbeat' AS type",
    )


def timeline_node() -> str:
    """SQL for the timeline node of an event; null for events that belong to none."""
    layered = ", ".join(f"'{a}'" for a in P.LAYERED_AGENTS)
    known = ", ".join(f"'{n}'" for n in P.TIMELINE_NODES)
    node = f"CASE WHEN agent IN ({layered}) THEN concat(agent, ':', layer) ELSE agent END"
    return f"CASE WHEN {node} IN ({known}) THEN {node} END"


_VALUES = ("status", *P.EVENT_METRICS)


def partial_timeline(events: DataFrame) -> DataFrame:
    """``task_id, node`` and for each value its latest event's time, number and value.

    Parts of a history can be folded one by one, in any order, and merged by ``current_timeline``.
    """
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.EVENT_STATUS.items())
    named = events.selectExpr("*", f"{timeline_node()} AS node", f"CASE type {cases} END AS status")
    return (
        named.filter("node IS NOT NULL")
        .groupBy("task_id", "node")
        .agg(*[F.expr(f"max(struct(timestamp, seq, {v} AS v)) FILTER (WHERE {v} IS NOT NULL)").alias(v) for v in _VALUES])
    )


def current_timeline(parts: DataFrame) -> DataFrame:
    """The state of every node from the partial timelines written so far."""
    merged = parts.groupBy("task_id", "node").agg(*[F.max(v).alias(v) for v in _VALUES])
    return merged.select(
        "task_id",
        "node",
        F.coalesce("status.v", F.lit("pending")).alias("status"),
        *[F.col(f"{m}.v").alias(m) for m in P.EVENT_METRICS],
    )


def fold_timeline(events: DataFrame) -> DataFrame:
    """``task_id, node, status`` and the last known metrics.

    Every value is the one of its latest event that has it, which combines before the
    shuffle and needs no order of arrival.
    """
    return current_timeline(partial_timeline(events))


def full_timeline(folded: DataFrame, tasks: DataFrame) -> DataFrame:
    """All nodes of every task; a node without events is pending."""
    nodes = ", ".join(f"'{n}'" for n in P.TIMELINE_NODES)
    every = tasks.select("task_id").distinct().selectExpr("task_id", f"explode(array({nodes})) AS node")
    return every.join(folded, ["task_id", "node"], "left").na.fill("pending", ["status"])


def stream_timeline(events: DataFrame, path: str, checkpoint: str):
    """Fold every batch of a stream of events and write it for ``current_timeline``.

    Nothing is kept between batches, so late events count and nothing grows but the output. A
    batch that is replayed after a failure overwrites its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        partial_timeline(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        events.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )


def stream_history(
    events: DataFrame,
    terminal: str = P.TERMINAL_EVENT,
    idle_seconds: int | None = P.HEARTBEAT_SECONDS,
    delay: str = "1 hour",
    most_beats: int = P.MOST_HEARTBEATS,
) -> DataFrame:
    """Events of each task up to its terminal event, with heartbeats while it idles.

    An event is passed on once: its number is remembered until the watermark, ``delay`` behind the
    latest event, has passed it, and what comes later than that is dropped (``late_rows`` counts it). Of an ended task the
    time and number of its end are kept, 16 bytes, so that events from before the end pass in whatever order they
    come, and events from after it never do. One that came before the end was known has been passed on already.
    A processing-time timer emits a heartbeat after ``idle_seconds`` without input, and no more than ``most_beats`` in a
    row, so that a task whose end is lost falls silent. Timers keep a stream alive, so one that shall end
    with its input (``availableNow``) needs ``idle_seconds=None``.
    """
    wait = idle_seconds * 1000 if idle_seconds else None

    def step(key, frames, state):
        import pandas as pd

        # No nulls, among which long numbers would turn into floating point.
        ended, end_at, end_seq, beats = state.get if state.exists else (False, 0, 0, 0)
        if state.hasTimedOut:
            now = state.getCurrentProcessingTimeMs()
            beats += 1
            # The negative time tells heartbeats apart.
            out = pd.DataFrame(
                {"task_id": [key[0]], "seq": [-now], "type": ["heartbeat"], "timestamp": [pd.Timestamp(now, unit="ms")]}
            )
        else:
            beats = 0
            out = pd.concat(list(frames)).sort_values(["timestamp", "seq"])
            micros = out["timestamp"].astype("datetime64[us]").astype("int64").to_numpy()
            seqs = out["seq"].to_numpy()
            stops = (out["type"] == terminal).to_numpy().nonzero()[0]
            if len(stops):
                first = int(micros[stops[0]]), int(seqs[stops[0]])
                end_at, end_seq = min(first, (end_at, end_seq)) if ended else first
                ended = True
            if ended:
                out = out[(micros < end_at) | ((micros == end_at) & (seqs <= end_seq))]
            out = out[["task_id", "seq", "type", "timestamp"]]
        state.update((ended, end_at, end_seq, beats))
        if wait and not ended and beats < most_beats:
            state.setTimeoutDuration(wait)
        yield out

    task_type = dict(events.dtypes)["task_id"]
    return (
        events.select("task_id", "seq", "type", "timestamp")
        .withWatermark("timestamp", delay)
        .dropDuplicatesWithinWatermark(["task_id", "seq"])
        .groupBy("task_id")
        .applyInPandasWithState(
            step,
            f"task_id {task_type}, seq bigint, type string, timestamp timestamp",
            "ended boolean, end_at bigint, end_seq bigint, beats int",
            "append",
            "ProcessingTimeTimeout" if wait else "NoTimeout",
        )
    )


def stream_recent(
    events: DataFrame, path: str, checkpoint: str, per_task: int = P.EVENTS_PER_TASK, tasks: int = P.TASKS_KEPT
):
    """Keep the last ``per_task`` events of the ``tasks`` most recently active tasks of a stream.

    Every batch is merged with what was kept and cut to the bounds again, so what is read and written per batch is
    bounded by the batch and ``per_task * tasks`` rows, and events may come in any order. What was dropped
    for its age stays dropped: a task that comes back after ``tasks`` others begins anew. Repeated numbers count once.
    A replayed batch starts from the folder of the batch before it, which is kept as long as it can be needed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(conf)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        kept = sorted(int(n[6:]) for n in names if n.startswith("batch="))
        before = [i for i in kept if i < batch_id]
        if before:
            batch = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/batch={before[-1]}"))
        bounded_history(batch.dropDuplicates(["task_id", "seq"]), per_task, tasks).write.mode("overwrite").parquet(
            f"{path}/batch={batch_id}"
        )
        for i in before[:-1]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/batch={i}"), True)

    return (
        events.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )


def recent_events(spark: SparkSession, path: str) -> DataFrame:
    """What ``stream_recent`` keeps now: the folder of its last batch."""
    kept = spark.read.option("basePath", path).parquet(path)
    last = kept.agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{path}/batch={last}")


def late_rows(query) -> int:
    """Events that a running or ended stream dropped as later than its watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
