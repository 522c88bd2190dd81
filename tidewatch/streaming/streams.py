"""Stateless and built-in stateful streams. A stream of events has ts, key and status columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, folder: str, schema: str, max_files: int = 10) -> DataFrame:
    """Files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append", query_name: str | None = None, idle: bool = True) -> DataFrame:
    """Runs a stream over everything there is and returns what it wrote.

    ``idle``: batches without data run too, as event-time timers need them. Operators in processing time
    ask for such batches for ever, so a run over them ends only without.
    """
    spark = df.sparkSession
    was = spark.conf.get(IDLE)
    spark.conf.set(IDLE, str(idle).lower())
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    try:
        (writer.queryName(query_name) if query_name else writer).start().awaitTermination()
    finally:
        spark.conf.set(IDLE, was)
    return spark.read.schema(df.schema).parquet(path)


def health_stream(events: DataFrame, every: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by status in tumbling windows."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "status").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "status", "n")


def error_rate_stream(events: DataFrame, every: str = "1 hour", slide: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Failed share in sliding windows."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", every, slide).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("errors"))
    return out.select(F.col("w.start").alias("start"), "n", "errors", F.round(F.col("errors") / F.col("n"), 6).alias("error_rate"))


def incident_sessions(events: DataFrame, key: str, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Alerts of a key without a gap of ``gap`` between them."""
    failed = events.where("status = 'failed'").withWatermark("ts", late)
    out = failed.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return out.select(key, "n", "first", "last")


def upsert_threads(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the changes of ``incident_threads``; a batch is written under its number, so a batch that is run again changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def threads(spark: SparkSession, path: str) -> DataFrame:
    """key, first, last, n of every thread as it stands: the newest change of each, without those that were joined into others."""
    changes = spark.read.parquet(path)
    newest = changes.groupBy("key", "thread").agg(F.max_by(F.struct("first", "last", "n"), "batch").alias("t")).where("t.n > 0")
    return newest.select("key", F.timestamp_micros("t.first").cast("timestamp_ntz").alias("first"), F.timestamp_micros("t.last").cast("timestamp_ntz").alias("last"), F.col("t.n").alias("n"))


def first_findings(findings: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each finding once within the watermark."""
    return findings.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def route_stream(findings: DataFrame, routing: DataFrame) -> DataFrame:
    """Stream-static join to the routing table; unknown severities go to the digest."""
    return findings.join(routing, "severity", "left").withColumn("channel", F.coalesce("channel", F.lit("digest")))


def cause_join(failures: DataFrame, changes: DataFrame, by: str, hours: int, late: str = "1 hour") -> DataFrame:
    """Failures with the changes of the same entity in the ``hours`` before; both sides keep state only that long."""
    f = failures.withColumnRenamed("ts", "incident_ts").withColumnRenamed(by, "f_by").withWatermark("incident_ts", late)
    c = changes.withColumnRenamed("ts", "change_ts").withColumnRenamed(by, "c_by").withWatermark("change_ts", late)
    near = (F.col("f_by") == F.col("c_by")) & (F.col("change_ts") <= F.col("incident_ts")) & (F.col("change_ts") >= F.col("incident_ts") - F.expr(f"INTERVAL {hours} HOURS"))
    return f.join(c, near).select("incident_id", F.col("f_by").alias(by), "incident_ts", "change_id", "change_ts")


def daily_digest(df: DataFrame, report: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """One batch over the new data; the report of a batch is written once, under its number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        report(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_iterations(df: DataFrame, sink: Callable[[DataFrame, int], None], log: str, checkpoint: str, trigger: str = "availableNow") -> StreamingQuery:
    """Runs ``sink`` for every batch and logs it: batch, time, trigger, rows, outcome. A rerun batch replaces its entry."""
    spark = df.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        rows, outcome = batch.count(), "done"
        try:
            sink(batch, batch_id)
        except Exception as e:
            outcome = f"failed: {type(e).__name__}"
            raise
        finally:
            entry = spark.range(1).select(F.lit(batch_id).alias("batch_id"), F.current_timestamp().alias("at"), F.lit(trigger).alias("trigger"), F.lit(rows).alias("rows"), F.lit(outcome).alias("outcome"))
            entry.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
            batch.unpersist()

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark, over all progress reports that are kept."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
