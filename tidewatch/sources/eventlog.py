"""Spark event logs as task metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "Event string, `Stage ID` int, `Task Info` struct<`Task ID`:long,`Launch Time`:long,`Finish Time`:long,Failed:boolean>, "
    "`Task Metrics` struct<`Executor Run Time`:long,`JVM GC Time`:long,`Memory Bytes Spilled`:long,`Disk Bytes Spilled`:long,"
    "`Shuffle Write Metrics`:struct<`Shuffle Bytes Written`:long>>"
)


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """stage, task, duration_ms, run_ms, gc_ms, spilled, shuffle_written, failed of every ended task."""
    rows = spark.read.schema(SCHEMA).json(path).where("Event = 'SparkListenerTaskEnd'")
    info, m = F.col("Task Info"), F.col("Task Metrics")
    return rows.select(
        F.col("Stage ID").alias("stage"),
        info["Task ID"].alias("task"),
        (info["Finish Time"] - info["Launch Time"]).alias("duration_ms"),
        m["Executor Run Time"].alias("run_ms"),
        m["JVM GC Time"].alias("gc_ms"),
        (m["Memory Bytes Spilled"] + m["Disk Bytes Spilled"]).alias("spilled"),
        m["Shuffle Write Metrics"]["Shuffle Bytes Written"].alias("shuffle_written"),
        info["Failed"].alias("failed"),
    )
