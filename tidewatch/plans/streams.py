"""Streams over the events table, drained; each must agree with its batch twin (T, S7-S10)."""

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import forecast as fc
from ..sources import findings
from ..sources.eventlog import event_log
from ..sources.scratch import work_folder
from ..sources.tables import RUNS_SQL, SCHEMAS, load
from ..streaming import stateful, streams, watch
from .registry import query

#: With append output, windows count once the watermark (an hour behind the newest event) has passed their end.
CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


def source(spark, folder):
    """The events as a stream; a glob, as the source takes folders or patterns. Watermarks need zoned timestamps."""
    return streams.stream(spark, f"{folder}/event[s].parquet", SCHEMAS["events"]).withColumn("ts", F.col("ts").cast("timestamp"))


def runs_stream(spark, folder):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").otherwise("ok")
    return source(spark, folder).select("ts", F.col("user_id").alias("job"), F.col("event_id").alias("run_id"), status.alias("status"))


def drained(df, spark, name, idle=True):
    base = work_folder(spark, name)
    out = streams.drain(df, f"{base}/out", f"{base}/checkpoint", idle=idle)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in out.dtypes if kind == "timestamp"})


@query("s7_stream", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def s7(spark, folder):
    rows = drained(source(spark, folder).select("event_id", "event_type"), spark, "s7")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    "t1_health_stream",
    f"WITH {RUNS_SQL} SELECT * FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS start, status, count(*) AS n FROM runs GROUP BY 1, 2) WHERE start + INTERVAL 30 MINUTE <= {CLOSED}",
)
def t1(spark, folder):
    return drained(streams.health_stream(runs_stream(spark, folder)), spark, "t1")


@query(
    "t2_error_rate_stream",
    f"""WITH {RUNS_SQL}, w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS b, status FROM runs), s AS (SELECT b AS start, status FROM w UNION ALL SELECT b - INTERVAL 30 MINUTE, status FROM w)
    SELECT start, count(*) AS n, count(*) FILTER (status = 'failed') AS errors, round(count(*) FILTER (status = 'failed') / count(*), 6) AS error_rate FROM s WHERE start + INTERVAL 1 HOUR <= {CLOSED} GROUP BY 1""",
)
def t2(spark, folder):
    return drained(streams.error_rate_stream(runs_stream(spark, folder)), spark, "t2")


@query(
    "t3_incident_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
    SELECT user_id AS job, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events WHERE event_type = 'error') - INTERVAL 1 HOUR""",
)
def t3(spark, folder):
    return drained(streams.incident_sessions(runs_stream(spark, folder), "job"), spark, "t3")


@query(
    "t3_incident_threads",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id AS key, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k""",
)
def t3_threads(spark, folder):
    """Threads as they stand, open ones too."""
    base = work_folder(spark, "t3-threads")
    stateful.use_rocksdb(spark)
    changes = stateful.incident_threads(keyed(spark, folder).where("status = 'failed'").select("key", "ts"))
    streams.upsert_threads(changes, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return streams.threads(spark, f"{base}/out")


@query("t4_first_findings", "SELECT count(DISTINCT user_id) AS jobs, count(DISTINCT user_id) AS n FROM events WHERE event_type = 'error'")
def t4(spark, folder):
    """With a watermark as long as the table, every job's finding is posted once."""
    failed = runs_stream(spark, folder).where("status = 'failed'")
    out = drained(streams.first_findings(failed, ["job"], "60 days"), spark, "t4")
    return out.agg(F.count_distinct("job").alias("jobs"), F.count("*").alias("n"))


def keyed(spark, folder):
    return runs_stream(spark, folder).select(F.col("job").alias("key"), F.col("run_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "status")


def stateful_drained(df, spark, name, idle=True):
    stateful.use_rocksdb(spark)
    return drained(df, spark, name, idle)


@query(
    "t5_stay_quiet",
    """WITH s AS (SELECT user_id AS key, event_id AS id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS now, ts FROM events),
    l AS (SELECT *, lag(now, 1, 'ok') OVER (PARTITION BY key ORDER BY ts, id) AS was FROM s) SELECT key, id, now FROM l WHERE now <> was""",
)
def t5(spark, folder):
    return stateful_drained(stateful.stay_quiet(keyed(spark, folder)), spark, "t5").select("key", "id", "now")


@query(
    "t6_retry_escalate",
    """WITH s AS (SELECT user_id AS key, event_id AS id, ts, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
    n AS (SELECT key, id, row_number() OVER (PARTITION BY key, run ORDER BY ts, id) AS attempt FROM s WHERE bad)
    SELECT key, id, CAST(attempt AS INTEGER) AS attempt, CASE WHEN attempt >= 3 THEN 'escalate' ELSE 'retry' END AS action FROM n""",
)
def t6(spark, folder):
    return stateful_drained(stateful.retry_escalate(keyed(spark, folder)), spark, "t6").select("key", "id", "attempt", "action")


@query(
    "t7_rate_gate",
    """SELECT user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS key, event_id AS id, CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS INTEGER) AS place FROM events QUALIFY place <= 2""",
)
def t7(spark, folder):
    out = stateful_drained(stateful.rate_gate(keyed(spark, folder).select("key", "id", "ts")), spark, "t7", idle=False)
    return out.select(F.concat_ws("/", F.col("key").cast("string"), F.to_date("ts").cast("string")).alias("key"), "id", "place")


@query("t8_heartbeat", f"SELECT user_id AS key, max(ts) AS last FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 12 HOUR < {CLOSED}")
def t8(spark, folder):
    """Jobs that are silent at the end of the table (the events come in one batch, so earlier silences are over)."""
    out = stateful_drained(stateful.heartbeat(keyed(spark, folder), 12), spark, "t8")
    newest = load(spark, folder, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("last"))
    return out.select("key").join(newest, "key")


@query("t9_freshness_watch", f"SELECT user_id AS key FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 24 HOUR < {CLOSED}")
def t9(spark, folder):
    return stateful_drained(stateful.heartbeat(keyed(spark, folder), 24), spark, "t9").select("key")


@query("t10_route_stream", "SELECT event_id, CASE WHEN value > 100 THEN 'oncall' WHEN value > 20 THEN 'team' ELSE 'digest' END AS channel FROM events WHERE event_type = 'error'")
def t10(spark, folder):
    found = source(spark, folder).where("event_type = 'error'").select("event_id", F.when(F.col("value") > 100, "high").when(F.col("value") > 20, "low").otherwise("info").alias("severity"))
    routing = spark.createDataFrame([("high", "oncall"), ("low", "team")], "severity string, channel string")
    return drained(streams.route_stream(found, routing), spark, "t10").select("event_id", "channel")


@query(
    "t11_cause_join",
    "SELECT i.event_id AS incident_id, i.user_id AS entity, c.event_id AS change_id FROM events i JOIN events c ON i.user_id = c.user_id AND i.event_type = 'error' AND c.event_type = 'signup' AND c.ts <= i.ts AND c.ts >= i.ts - INTERVAL 6 HOUR",
)
def t11(spark, folder):
    failures = source(spark, folder).where("event_type = 'error'").select(F.col("event_id").alias("incident_id"), F.col("user_id").alias("entity"), "ts")
    changed = source(spark, folder).where("event_type = 'signup'").select(F.col("event_id").alias("change_id"), F.col("user_id").alias("entity"), "ts")
    return drained(streams.cause_join(failures, changed, "entity", 6), spark, "t11").select("incident_id", "entity", "change_id")


@query("t12_daily_digest", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def t12(spark, folder):
    base = work_folder(spark, "t12")
    report = lambda b: b.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    streams.daily_digest(source(spark, folder), report, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    written = spark.read.parquet(f"{base}/out/*").groupBy("event_type")
    return written.agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@query("t13_late_rows", "SELECT 0 AS late, count(*) AS n FROM events")
def t13(spark, folder):
    """Late rows of a drained run: none, as the table comes in one batch. The tests feed a late file."""
    base = work_folder(spark, "t13")
    df = streams.health_stream(runs_stream(spark, folder))
    q = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return load(spark, folder, "events").agg(F.lit(streams.late_rows(q)).alias("late"), F.count("*").alias("n"))


@query("s10_audit_iterations", "SELECT 'done' AS outcome, count(*) AS rows FROM events")
def s10(spark, folder):
    base = work_folder(spark, "s10")
    sink = lambda b, i: b.write.mode("overwrite").parquet(f"{base}/out/batch={i}")
    streams.audit_iterations(source(spark, folder), sink, f"{base}/log", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/log/*").groupBy("outcome").agg(F.sum("rows").cast("long").alias("rows"))


@query("s10_iterations", "SELECT 'done' AS outcome, count(*) AS rows, CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) AS errors, max(value) AS largest FROM events")
def s10_iterations(spark, folder):
    """Batches logged by the metrics observed while the sink reads them."""
    base = work_folder(spark, "s10-iterations")
    with watch.IterationLog(spark, f"{base}/log") as log:
        df = log.watch(source(spark, folder), errors=F.count_if(F.col("event_type") == "error"), largest=F.max("value"))
        q = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        log.finish(q)
    return watch.iterations(spark, f"{base}/log").groupBy("outcome").agg(F.sum("rows").alias("rows"), F.sum(F.col("metrics")["errors"]).alias("errors"), F.max(F.col("metrics")["largest"]).alias("largest"))


@query(
    "t13_late_rows_logged",
    """WITH w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events WHERE ts >= TIMESTAMP '2024-01-16')
    SELECT CAST(count(*) FILTER (ts < TIMESTAMP '2024-01-16' AND epoch_ms(ts) <= epoch_ms(mark)) AS BIGINT) AS late, count(*) AS rows FROM events, w""",
)
def t13_logged(spark, folder):
    """The second half of the month comes first, in a run of its own; what then comes of the first half is late. The log counts over both runs."""
    base, half = work_folder(spark, "t13-logged"), F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    rows = load(spark, folder, "events").select("event_id", "ts")
    with watch.IterationLog(spark, f"{base}/log") as log:
        for part in (rows.where(half), rows.where(~half)):
            part.write.mode("append").parquet(f"{base}/in")
            df = log.watch(streams.stream(spark, f"{base}/in", rows.schema)).withColumn("ts", F.col("ts").cast("timestamp"))
            q = streams.first_findings(df, ["event_id"]).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
            q.awaitTermination()
            log.finish(q)
    return watch.late_rows(spark, f"{base}/log").select("late", "rows")


@query("s8_write_findings", "SELECT CASE WHEN value > 100 THEN 'high' ELSE 'low' END AS severity, CAST(ts AS DATE) AS detected_on, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2")
def s8(spark, folder):
    path = work_folder(spark, "s8")
    found = load(spark, folder, "events").where("event_type = 'error'").select(F.when(F.col("value") > 100, "high").otherwise("low").alias("severity"), F.col("ts").alias("detected_at"), F.col("user_id").alias("entity"))
    findings.write_findings(found, path)
    return spark.read.parquet(path).groupBy("severity", F.col("detected_on").cast("date").alias("detected_on")).agg(F.count("*").alias("n"))


@query("s6_event_log", "SELECT CAST(quantity AS BIGINT) AS stage, count(*) AS tasks, CAST(max(l_partkey) AS DOUBLE) AS largest, CAST(sum(l_partkey) AS DOUBLE) AS total FROM (SELECT l_quantity AS quantity, l_partkey FROM lineitem) GROUP BY 1")
def s6(spark, folder):
    """Line items written as an event log (stage = quantity, run time = part key) and read back."""
    path = work_folder(spark, "s6")
    lines = load(spark, folder, "lineitem").select(
        F.lit("SparkListenerTaskEnd").alias("Event"),
        F.col("l_quantity").cast("int").alias("Stage ID"),
        F.struct(F.col("l_orderkey").alias("Task ID"), F.lit(0).cast("long").alias("Launch Time"), F.col("l_partkey").alias("Finish Time"), F.lit(False).alias("Failed")).alias("Task Info"),
        F.struct(F.col("l_partkey").alias("Executor Run Time")).alias("Task Metrics"),
    )
    lines.write.json(path)
    out = agg.job_skew(event_log(spark, path), "stage", "run_ms")
    return out.select(F.col("stage").cast("long").alias("stage"), "tasks", "largest", "total")


@query("p7_trigger_tuning")
def p7(spark, folder):
    """Progress of an own drained stream."""
    base = work_folder(spark, "p7")
    q = source(spark, folder).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = [("events", p.numInputRows, p.durationMs.get("triggerExecution", 0), p.durationMs.get("walCommit", 0) + p.durationMs.get("commitOffsets", 0)) for p in q.recentProgress]
    return fc.trigger_tuning(spark.createDataFrame(rows, "stream string, rows long, duration_ms long, commit_ms long"), "stream")
