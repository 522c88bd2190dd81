"""Work folders in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; ``clear`` deletes it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/tidewatch/{kind}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _checkpoint_dir(spark: SparkSession) -> str:
    """The context's checkpoint folder, set from ``spark.checkpoint.dir``; a local one only where Spark runs in one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="tidewatch-"))
    return context.getCheckpointDir()


#: Work folders of each Spark application, not yet deleted.
_WRITTEN: dict[str, list[str]] = {}


#: Whether Spark deletes the shuffle files of a query when it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that begin in this block leave no shuffle files behind: for tables that are written, from which later reads go on."""
    before = spark.conf.get(CLEANUP, "false")
    if before == "true":
        yield
        return
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, kind: str, *partitions: str) -> DataFrame:
    """``df`` from a table in a work folder: cuts lineage, survives lost executors, keeps sizes for the planner; ``release`` deletes it. Its shuffle files go at once."""
    spark, path = df.sparkSession, work_folder(df.sparkSession, kind)
    with shuffles_freed(spark):
        df.write.partitionBy(*partitions).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for table in tables:
        if getattr(table, "written_to", None):
            _delete(table.sparkSession, table.written_to)


def clear(spark: SparkSession) -> None:
    """Deletes all work folders of this application; call it once the results are consumed."""
    for path in list(_WRITTEN.get(spark.sparkContext.applicationId, [])):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    made = _WRITTEN.get(spark.sparkContext.applicationId, [])
    if path in made:
        made.remove(path)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the cluster's shared folder (``spark.checkpoint.dir``)."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()
