"""Streams: restarts, late and shuffled files, silences."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.streaming import stateful, streams

SCHEMA = "key long, id long, ts timestamp, status string"
T0 = dt.datetime(2024, 1, 1)


def put(spark, folder, rows):
    """One file with the given rows: (key, id, minutes, status)."""
    made = [(k, i, T0 + dt.timedelta(minutes=m), s) for k, i, m, s in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_restart_from_the_checkpoint(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [(1, 1, 0, "ok"), (1, 2, 10, "failed"), (2, 3, 20, "failed")])
    stateful.use_rocksdb(spark)

    def run():
        events = streams.stream(spark, f"{tmp_path}/in", SCHEMA)
        return streams.drain(stateful.stay_quiet(events), f"{tmp_path}/out", f"{tmp_path}/cp")

    assert {(r.key, r.id, r.now) for r in run().collect()} == {(1, 2, "failed"), (2, 3, "failed")}
    put(spark, f"{tmp_path}/in", [(1, 4, 30, "failed"), (1, 5, 40, "ok"), (2, 6, 50, "ok"), (3, 7, 60, "ok")])
    assert {(r.key, r.id, r.now) for r in run().collect()} == {(1, 2, "failed"), (2, 3, "failed"), (1, 5, "ok"), (2, 6, "ok")}
    assert run().count() == 4  # nothing new, nothing again


def test_retries_go_on_over_batches(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [(1, i, i, "failed") for i in (2, 1)])
    stateful.use_rocksdb(spark)
    run = lambda: streams.drain(stateful.retry_escalate(streams.stream(spark, f"{tmp_path}/in", SCHEMA)), f"{tmp_path}/out", f"{tmp_path}/cp")
    run()
    put(spark, f"{tmp_path}/in", [(1, 3, 3, "failed"), (1, 4, 4, "ok"), (1, 5, 5, "failed")])
    assert [(r.id, r.attempt, r.action) for r in run().orderBy("id").collect()] == [(1, 1, "retry"), (2, 2, "retry"), (3, 3, "escalate"), (5, 1, "retry")]


def test_rate_gate_forgets_days(spark, tmp_path):
    """30 days in six batches: two proposals a day pass, a late one of a forgotten day doesn't, and the state keeps three days a key."""
    stateful.use_rocksdb(spark)
    run = lambda: streams.drain(stateful.rate_gate(streams.stream(spark, f"{tmp_path}/in", SCHEMA)), f"{tmp_path}/out", f"{tmp_path}/cp", idle=False)
    kept = []
    for n in range(6):
        put(spark, f"{tmp_path}/in", [(k, 1000 * k + 10 * d + i, 1440 * d + 30 - i, "ok") for k in (1, 2) for d in range(5 * n, 5 * n + 5) for i in range(4)])
        out = run()
        state = spark.read.format("statestore").option("stateVarName", "passed").load(f"{tmp_path}/cp")
        kept.append(state.count())
    assert out.count() == 2 * 2 * 30 and max(kept) <= 2 * 3
    assert sorted(r.id % 10 for r in out.where("place = 1").collect()) == [3] * 60
    put(spark, f"{tmp_path}/in", [(1, 9999, 60, "ok"), (1, 9998, 1440 * 29 + 600, "ok")])
    assert run().count() == 2 * 2 * 30


def test_late_alert_joins_two_threads(spark, tmp_path):
    """A late alert between two threads makes them one; a batch that is run again changes nothing."""
    stateful.use_rocksdb(spark)

    def run(out="out"):
        alerts = streams.stream(spark, f"{tmp_path}/in", SCHEMA).select("key", "ts")
        streams.upsert_threads(stateful.incident_threads(alerts, 2), f"{tmp_path}/{out}", f"{tmp_path}/cp").awaitTermination()
        return sorted((r.key, (r.first - T0).total_seconds() / 60, (r["last"] - T0).total_seconds() / 60, r.n) for r in streams.threads(spark, f"{tmp_path}/{out}").collect())

    put(spark, f"{tmp_path}/in", [(1, 1, 0, "x"), (1, 2, 60, "x"), (1, 3, 240, "x"), (2, 4, 0, "x")])
    assert run() == [(1, 0, 60, 2), (1, 240, 240, 1), (2, 0, 0, 1)]
    put(spark, f"{tmp_path}/in", [(1, 5, 150, "x"), (2, 6, -30, "x"), (2, 7, 500, "x")])
    assert run() == [(1, 0, 240, 4), (2, -30, 0, 2), (2, 500, 500, 1)]
    # the last batch once more: its folder is replaced
    for kind in ("commits",):
        for f in (tmp_path / "cp" / kind).iterdir():
            if f.name.strip(".crc").lstrip(".") == "1":
                f.unlink()
    assert run() == [(1, 0, 240, 4), (2, -30, 0, 2), (2, 500, 500, 1)]


def test_rate_gate_over_batches(spark, tmp_path):
    stateful.use_rocksdb(spark)
    run = lambda: streams.drain(stateful.rate_gate(streams.stream(spark, f"{tmp_path}/in", SCHEMA).withColumn("key", F.col("key").cast("string"))), f"{tmp_path}/out", f"{tmp_path}/cp", idle=False)
    for n in range(3):
        put(spark, f"{tmp_path}/in", [(1, n, n, "ok"), (n, 100 + n, n, "ok")])
        out = run()
    passed = {(r.key, r.id) for r in out.collect()}
    assert len([p for p in passed if p[0] == "1"]) == 2 and ("2", 102) in passed


def test_late_rows_are_counted(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [(1, 1, 600, "ok")])
    df = streams.health_stream(streams.stream(spark, f"{tmp_path}/in", SCHEMA, max_files=1))

    def run():
        q = df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    assert streams.late_rows(run()) == 0
    put(spark, f"{tmp_path}/in", [(1, 2, 5, "ok"), (1, 3, 5, "failed")])
    assert streams.late_rows(run()) > 0


def test_a_silence_is_reported_once(spark, tmp_path):
    stateful.use_rocksdb(spark)
    put(spark, f"{tmp_path}/in", [(1, 1, 0, "ok"), (2, 2, 0, "ok")])
    df = stateful.heartbeat(streams.stream(spark, f"{tmp_path}/in", SCHEMA), quiet_hours=2, late="1 minute")
    streams.drain(df, f"{tmp_path}/out", f"{tmp_path}/cp")
    for minutes in (200, 400):
        put(spark, f"{tmp_path}/in", [(1, minutes, minutes, "ok")])
        out = streams.drain(df, f"{tmp_path}/out", f"{tmp_path}/cp")
    assert [r.key for r in out.where("key = 2").collect()] == [2]


def test_audit_logs_a_failed_batch(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [(1, 1, 0, "ok")])

    def sink(batch, batch_id):
        raise RuntimeError("no sink")

    query = streams.audit_iterations(streams.stream(spark, f"{tmp_path}/in", SCHEMA), sink, f"{tmp_path}/log", f"{tmp_path}/cp")
    with pytest.raises(Exception, match="no sink"):
        query.awaitTermination()
    assert [(r.rows, r.outcome) for r in spark.read.parquet(f"{tmp_path}/log/*").collect()] == [(1, "failed: RuntimeError")]


def test_duplicates_within_the_watermark(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [(1, 1, 0, "failed"), (1, 2, 1, "failed"), (2, 3, 1, "failed")])
    df = streams.first_findings(streams.stream(spark, f"{tmp_path}/in", SCHEMA), ["key"], "1 day")
    streams.drain(df, f"{tmp_path}/out", f"{tmp_path}/cp")
    put(spark, f"{tmp_path}/in", [(1, 4, 30, "failed"), (3, 5, 30, "failed")])
    assert sorted(r.key for r in streams.drain(df, f"{tmp_path}/out", f"{tmp_path}/cp").collect()) == [1, 2, 3]
