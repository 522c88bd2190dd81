"""Iterations logged by metrics: every batch once, over restarts, beyond the reports that Spark keeps."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.streaming import streams, watch

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "key long, ts timestamp"


def put(spark, folder, rows):
    spark.createDataFrame([(k, T0 + datetime.timedelta(minutes=m)) for k, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, log, tmp_path, shape=lambda df: df, sink=None):
    df = shape(log.watch(streams.stream(spark, f"{tmp_path}/in", SCHEMA, max_files=1), keys=F.sum("key")))
    writer = df.writeStream.foreachBatch(sink) if sink else df.writeStream.format("parquet").option("path", f"{tmp_path}/out")
    q = writer.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        log.finish(q)


def test_all_batches_though_spark_keeps_few_reports(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        for k in range(6):
            put(spark, f"{tmp_path}/in", [(k, 0), (10 * k, 1)][: 1 + k % 2])
        with watch.IterationLog(spark, f"{tmp_path}/log") as log:
            run(spark, log, tmp_path)
            put(spark, f"{tmp_path}/in", [(7, 0)])
            run(spark, log, tmp_path)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    got = sorted((r.batch_id, r.rows, r.outcome) for r in watch.iterations(spark, f"{tmp_path}/log").collect())
    assert got == [(i, 1 + i % 2 if i < 6 else 1, "done") for i in range(7)]
    assert watch.iterations(spark, f"{tmp_path}/log").agg(F.sum(F.col("metrics")["keys"])).first()[0] == sum(range(6)) + 10 + 30 + 50 + 7


def test_late_rows_over_restarts(spark, tmp_path):
    shape = lambda df: streams.first_findings(df, ["key"], "1 minute")
    with watch.IterationLog(spark, f"{tmp_path}/log") as log:
        put(spark, f"{tmp_path}/in", [(1, 600)])
        run(spark, log, tmp_path, shape)
        put(spark, f"{tmp_path}/in", [(2, 5), (3, 6), (4, 700)])
        run(spark, log, tmp_path, shape)
        put(spark, f"{tmp_path}/in", [(5, 650)])
        run(spark, log, tmp_path, shape)
    r = watch.late_rows(spark, f"{tmp_path}/log").first()
    assert (r.late, r.rows) == (3, 5)


def test_a_failed_batch_is_logged_and_its_rerun_replaces_it(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [(1, 0)])
    put(spark, f"{tmp_path}/in", [(2, 0), (3, 0)])

    def sink(fails):
        def write(batch, batch_id):
            batch.write.format("noop").mode("overwrite").save()
            if fails and batch_id == 1:
                raise RuntimeError("no sink")

        return write

    with watch.IterationLog(spark, f"{tmp_path}/log") as log:
        with pytest.raises(Exception, match="no sink"):
            run(spark, log, tmp_path, sink=sink(True))
        got = {r.batch_id: r.outcome for r in watch.iterations(spark, f"{tmp_path}/log").collect()}
        assert got[0] == "done" and got[1].startswith("failed")
        run(spark, log, tmp_path, sink=sink(False))
    assert sorted((r.batch_id, r.rows, r.outcome) for r in watch.iterations(spark, f"{tmp_path}/log").collect()) == [(0, 1, "done"), (1, 2, "done")]


def test_other_streams_are_not_logged(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [(1, 0)])
    with watch.IterationLog(spark, f"{tmp_path}/log") as log, watch.IterationLog(spark, f"{tmp_path}/other"):
        run(spark, log, tmp_path)
    assert watch.iterations(spark, f"{tmp_path}/log").count() == 1
    assert not (tmp_path / "other").exists()
