"""Work folders are refused where executors couldn't read them."""

import time

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import scratch


class Context:
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None


class Session:
    sparkContext = Context()
    conf = {}


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.work_folder(Session(), "x")


def test_local_folder_in_one_machine(spark):
    assert "/tidewatch/x-" in scratch.work_folder(spark, "x")


def test_written_tables_leave_no_shuffle_files(spark):
    """Only those that other queries left may stay; the setting is as before, and the table can be read again and again."""
    files = lambda: {f for f in map(str, spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles())) if "/shuffle_" in f}
    before, setting = files(), spark.conf.get(scratch.CLEANUP, "false")
    sums = spark.range(5000).groupBy((F.col("id") % 50).alias("g")).agg(F.sum("id").alias("n"))
    table = scratch.written(sums, "sums")
    end = time.time() + 10
    while files() - before and time.time() < end:
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(scratch.CLEANUP, "false") == setting
    assert [r.n for r in table.orderBy("g").collect()] == [r.n for r in table.orderBy("g").collect()] == [r.n for r in sums.orderBy("g").collect()]
