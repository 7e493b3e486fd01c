"""Task events as a batch and as a stream, and continuous ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeweave import params as P
from lakeweave.operators import profile
from lakeweave.session import work_dir
from lakeweave.streaming import events as E
from lakeweave.streaming import ingest
from suite import common as C
from suite.common import query

# Users play tasks; the kind of an event, its place and its metrics follow from its columns.
_TYPE = """CASE event_type WHEN 'click' THEN 'agent_started' WHEN 'view' THEN 'agent_completed'
  WHEN 'signup' THEN 'agent_degraded' WHEN 'error' THEN 'agent_failed' ELSE 'progress' END"""
_AGENT = """CASE event_id % 10 WHEN 0 THEN 'Planner' WHEN 1 THEN 'Profiling' WHEN 2 THEN 'Retrieval' WHEN 3 THEN 'Retrieval'
  WHEN 4 THEN 'Retrieval' WHEN 5 THEN 'Matcher' WHEN 6 THEN 'Matcher' WHEN 7 THEN 'Matcher' WHEN 8 THEN 'Unknown' END"""
_LAYER = """CASE event_id % 10 WHEN 2 THEN 'L1' WHEN 3 THEN 'L2' WHEN 4 THEN 'L3' WHEN 5 THEN 'filtering' WHEN 6 THEN 'LLM'
  WHEN 7 THEN 'decision' END"""
_COLUMNS = f"""user_id AS task_id, event_id AS seq, {_TYPE} AS type, {_AGENT} AS agent, {_LAYER} AS layer,
  CASE WHEN event_id % 3 = 0 THEN event_id END AS input_size, CASE WHEN event_id % 4 = 0 THEN user_id + event_id END AS output_size,
  CASE WHEN value > 50 THEN value END AS latency_ms, CAST(NULL AS BIGINT) AS llm_tokens,
  CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS reason, CAST(NULL AS VARCHAR(10)) AS message"""
SQL_EVENTS = f"ev AS (SELECT {_COLUMNS}, ts AS timestamp FROM events)"
_SPARK_COLUMNS = f"SELECT {_COLUMNS.replace('VARCHAR(10)', 'STRING')}, cast(ts AS timestamp) AS timestamp FROM {{events}}"


def task_events(events):
    return events.sparkSession.sql(_SPARK_COLUMNS, events=events)


def stream_of(spark, sf_dir, name, time, parts=4, late="false"):
    """A given table as a stream of a few file groups, in the order of its times, with repeats.

    Each part but the first brings the last tenth of the part before it once more; rows of that tenth that are ``late``
    come with the next part only. A part has as many files as its rows need.
    """
    static = C.table(spark, sf_dir, name)
    folder = work_dir(spark, f"{name}-stream")
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    low, high = static.agg(F.min(micros), F.max(micros)).first()
    part = F.least(F.floor((micros - low) * parts / (high - low + 1)), F.lit(parts - 1))
    placed = static.withColumn("part", part)
    for i in range(parts):
        own = placed.filter(F.col("part") == i)
        if i < parts - 1:
            own = own.filter(~((micros > low + (i + 0.9) * (high - low) / parts) & F.expr(late)))
        recent = (F.col("part") == i - 1) & (micros > low + (i - 0.1) * (high - low) / parts)
        own.unionByName(placed.filter(recent)).drop("part").write.mode("append").parquet(f"{folder}/{i}")
    files = sum(1 for i in range(parts) for _ in spark.read.parquet(f"{folder}/{i}").inputFiles())
    return (
        spark.readStream.schema(static.schema)
        .option("maxFilesPerTrigger", max(1, files // parts))
        .parquet(f"{folder}/*")
    )


_NODE = """CASE WHEN agent IN ('Retrieval', 'Matcher') THEN agent || ':' || layer ELSE agent END"""
SQL_TIMELINE = f"""{SQL_EVENTS},
nodes(node) AS (VALUES {", ".join(f"('{n}')" for n in P.TIMELINE_NODES)}),
placed AS (SELECT *, {_NODE} AS node, CASE type WHEN 'agent_started' THEN 'running' WHEN 'agent_degraded' THEN 'degraded'
             WHEN 'agent_failed' THEN 'failed' WHEN 'agent_completed' THEN 'success' END AS st FROM ev),
folded AS (
  SELECT task_id, node, coalesce(arg_max(st, (timestamp, seq)) FILTER (WHERE st IS NOT NULL), 'pending') AS status,
    {", ".join(f"arg_max({m}, (timestamp, seq)) FILTER (WHERE {m} IS NOT NULL) AS {m}" for m in P.EVENT_METRICS)}
  FROM placed JOIN nodes USING (node) GROUP BY task_id, node)"""
SHOWN = ("task_id", "node", "status", "input_size", "output_size", "latency_ms", "reason")


@query(
    "timeline",
    f"""WITH {SQL_TIMELINE}
    SELECT t.task_id, n.node, coalesce(f.status, 'pending') AS status, input_size, output_size, latency_ms, reason
    FROM (SELECT DISTINCT task_id FROM ev) t CROSS JOIN nodes n LEFT JOIN folded f USING (task_id, node)""",
)
def timeline(spark, sf_dir):
    events = task_events(C.table(spark, sf_dir, "events"))
    return E.full_timeline(E.fold_timeline(events), events).select(*SHOWN)


@query("timeline_stream", f"WITH {SQL_TIMELINE} SELECT {', '.join(SHOWN)} FROM folded")
def timeline_stream(spark, sf_dir):
    """The same fold over a stream, from the updates that it wrote."""
    out, checkpoint = work_dir(spark, "timeline"), work_dir(spark, "timeline-checkpoint")
    run = E.stream_timeline(task_events(stream_of(spark, sf_dir, "events", "ts")), out, checkpoint)
    run.awaitTermination()
    return E.current_timeline(spark.read.parquet(out)).select(*SHOWN)


@query(
    "event_history",
    f"""WITH {SQL_EVENTS},
    recent AS (SELECT task_id FROM ev GROUP BY task_id ORDER BY max((timestamp, seq)) DESC, task_id LIMIT 100)
    SELECT task_id, seq, type FROM ev SEMI JOIN recent USING (task_id)
    QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY timestamp DESC, seq DESC) <= 20""",
)
def event_history(spark, sf_dir):
    """The last 20 events of the 100 most recently active tasks."""
    events = task_events(C.table(spark, sf_dir, "events"))
    return E.bounded_history(events, per_task=20, tasks=100).select("task_id", "seq", "type")


@query(
    "recent_stream",
    f"""WITH {SQL_EVENTS},
    recent AS (SELECT task_id FROM ev GROUP BY task_id ORDER BY max((timestamp, seq)) DESC, task_id LIMIT 100000)
    SELECT task_id, seq, type, output_size FROM ev SEMI JOIN recent USING (task_id)
    QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY timestamp DESC, seq DESC) <= {P.EVENTS_PER_TASK}""",
)
def recent_stream(spark, sf_dir):
    """What a stream keeps of its events, which come out of order: the last ones of every task."""
    out, checkpoint = work_dir(spark, "recent"), work_dir(spark, "recent-checkpoint")
    source = stream_of(spark, sf_dir, "events", "ts", late="event_id % 2 = 0")
    E.stream_recent(task_events(source), out, checkpoint, tasks=100_000).awaitTermination()
    return E.recent_events(spark, out).select("task_id", "seq", "type", "output_size")


# Repeats come up to a fortieth of the table's time late.
STREAM_DELAY = "30 days"

SQL_ENDS = f"""{SQL_EVENTS},
ends AS (SELECT task_id, min((timestamp, seq)) AS e FROM ev WHERE type = 'agent_failed' GROUP BY task_id)
SELECT task_id, seq, type FROM ev LEFT JOIN ends USING (task_id) WHERE e IS NULL OR (timestamp, seq) <= e"""


@query("events_until_terminal", f"WITH {SQL_ENDS}")
def events_until_terminal(spark, sf_dir):
    """The first failure plays the terminal event."""
    events = task_events(C.table(spark, sf_dir, "events"))
    return E.until_terminal(events, "agent_failed").select("task_id", "seq", "type")


@query("event_stream", f"WITH {SQL_ENDS}")
def event_stream(spark, sf_dir):
    """The same on a stream with state per task, where a third of the rows at a part's end come a part late."""
    out, checkpoint = work_dir(spark, "history"), work_dir(spark, "history-checkpoint")
    source = stream_of(spark, sf_dir, "events", "ts", late="event_type <> 'error' AND event_id % 3 = 0")
    history = E.stream_history(task_events(source), "agent_failed", None, STREAM_DELAY)
    (
        history.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out, format="parquet")
        .awaitTermination()
    )
    return spark.read.parquet(out).filter("type <> 'heartbeat'").select("task_id", "seq", "type")


@query(
    "heartbeats",
    f"""WITH {SQL_EVENTS},
    gaps AS (SELECT task_id, timestamp, lead(timestamp) OVER (PARTITION BY task_id ORDER BY timestamp, seq) AS next FROM ev)
    SELECT task_id, epoch_us(unnest(range(timestamp + INTERVAL 1 HOUR, next, INTERVAL 1 HOUR))) AS beat_us FROM gaps WHERE next IS NOT NULL""",
)
def heartbeats(spark, sf_dir):
    """One heartbeat per hour without an event."""
    events = task_events(C.table(spark, sf_dir, "events"))
    return E.heartbeats(events, seconds=3600).selectExpr("task_id", "unix_micros(timestamp) AS beat_us")


@query(
    "events_of_tasks",
    f"""WITH {SQL_EVENTS} SELECT task_id, seq, type FROM ev
    WHERE task_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def events_of_tasks(spark, sf_dir):
    """Events scoped to the tasks somebody watches, here customers of one segment."""
    raw = C.table(spark, sf_dir, "events").selectExpr("*", "user_id AS scope", "ts AS at")
    events = E.enrich(task_events(raw).drop("task_id", "timestamp").join(
        raw.selectExpr("event_id AS seq", "scope", "at"), "seq"), F.col("scope"), F.col("at"))
    watched = C.table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").selectExpr("c_custkey AS task_id")
    return E.of_tasks(events, watched).select("task_id", "seq", "type")


@query(
    "ingest_stream",
    """SELECT o_orderpriority AS part, 'READY' AS status, count(*) AS row_count, CAST(5 AS BIGINT) AS col_count,
      round(avg(o_totalprice), 3) AS mean FROM orders GROUP BY ALL""",
)
def ingest_stream(spark, sf_dir):
    """Orders as one CSV file per priority, picked up by the stream, registered and profiled."""
    folder, store, checkpoint = (work_dir(spark, n) for n in ("arrivals", "store", "ingest-checkpoint"))
    C.table(spark, sf_dir, "orders").repartition("o_orderpriority").write.partitionBy("o_orderpriority").csv(
        folder, header=True
    )
    ingest.stream_tables(spark, folder, store, checkpoint, pattern="*.csv").awaitTermination()
    profiles = profile.load_profiles(spark.read.parquet(f"{store}/profiles"))
    price = profiles.filter("col_name = 'o_totalprice'").selectExpr("table_id", "round(numeric_stats.mean, 3) AS mean")
    part = F.expr("url_decode(regexp_extract(source_uri, 'o_orderpriority=([^/]*)', 1))")
    return (
        spark.read.parquet(f"{store}/registry")
        .join(price, "table_id")
        .select(part.alias("part"), "status", "row_count", "col_count", "mean")
    )
