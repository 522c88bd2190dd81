"""Waiting times against a plain queue."""

import datetime
import heapq
import random

import pytest

from tidewatch.operators import queues

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "r string, kind string, a timestamp_ntz, b timestamp_ntz, n long"


def plain(rows, places):
    """{n: (wait, hours with a queue that no earlier request has covered)} in seconds."""
    out = {}
    for r in {r for r, *_ in rows}:
        free, last = [0.0] * places.get(r, 1), 0.0
        for _, _, a, b, n in sorted((x for x in rows if x[0] == r and x[2] and x[3]), key=lambda x: (x[2], x[4])):
            at = (a - T0).total_seconds() + 1e6
            begin = max(at, free[0])
            heapq.heapreplace(free, begin + max(0.0, (b - a).total_seconds()))
            out[r, n] = (begin - at, max(0.0, begin - max(at, last)))
            last = begin
    return out


def requests(seed, n, load):
    rng, rows, at = random.Random(seed), [], 0
    for k in range(n):
        at += rng.choice([0, 0, rng.expovariate(1 / 1800)])
        length = rng.expovariate(1 / (900 * load))
        start = T0 + datetime.timedelta(seconds=int(at))
        rows.append((rng.choice(["a", "a", "b", None]), rng.choice("xy"), start, start + datetime.timedelta(seconds=int(length)), k))
    return rows


@pytest.mark.parametrize("seed,load,places", [(1, 0.5, None), (2, 2.0, None), (3, 1.5, {"a": 3, "b": 2}), (4, 6.0, {"a": 4, None: 2}), (5, 0.2, {"a": 3})])
def test_waits_equal_a_plain_queue(spark, seed, load, places):
    rows = requests(seed, 150, load)
    rows += [("a", "x", None, T0, 900), ("a", "x", T0, None, 901), ("b", "x", T0 + datetime.timedelta(hours=1), T0, 902)]
    capacity = None if places is None else spark.createDataFrame(list(places.items()), "r string, capacity int")
    df = spark.createDataFrame(rows, SCHEMA)
    found = queues.waits(df, "r", "a", "b", "n", capacity, bucket_hours=2)
    want = plain(rows, places or {})
    got = {(r.resource, r.tie): (r.begins - r.at) / 1e6 for r in found.collect()}
    assert got == {k: pytest.approx(w) for k, (w, _) in want.items()}
    by = {r.r: r for r in queues.queueing(df, "r", "a", "b", "n", capacity, bucket_hours=2).collect()}
    for name, r in by.items():
        mine = [v for (x, _), v in want.items() if x == name]
        assert (r.requests, r.queued) == (len(mine), sum(w > 0 for w, _ in mine))
        assert (r.longest_wait, r.contended) == (pytest.approx(max(w for w, _ in mine) / 3600, abs=1e-6), pytest.approx(sum(f for _, f in mine) / 3600, abs=1e-6))
    waited = {(r.r, r.workload): r.waited for r in queues.isolation(df, "r", "kind", "a", "b", "n", capacity, 2).collect()}
    kind = {(r, n): k for r, k, _, _, n in rows}
    for key, hours in waited.items():
        assert hours == pytest.approx(sum(w for (r, n), (w, _) in want.items() if (r, kind[r, n]) == key) / 3600, abs=1e-6)


def test_one_resource_is_many_buckets(spark):
    """A hot resource: no task of the request windows gets more than one bucket."""
    rows = [("a", "x", T0 + datetime.timedelta(minutes=k), T0 + datetime.timedelta(minutes=k + 3), k) for k in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = queues.waits(df, "r", "a", "b", "n", None, bucket_hours=1)
    assert found.groupBy("bucket").count().agg({"count": "max"}).first()[0] == 60
    assert {r.tie: r.begins - r.at for r in found.collect()} == {k: k * 120_000_000 for k in range(600)}


def test_entries_are_beside_the_requests(spark, monkeypatch):
    """Of 500 places one is taken at the end of a bucket: that is its list, and no request carries one."""
    lists, plans = [], []
    keep = queues.written

    def written(df, kind):
        out = keep(df, kind)
        if kind == "queue-buckets":
            plans.append(df._jdf.queryExecution().toString())
            lists.extend(len(r.free) for r in out.where("free IS NOT NULL").collect())
        return out

    monkeypatch.setattr(queues, "written", written)
    rows = [("a", "x", T0 + datetime.timedelta(minutes=k), T0 + datetime.timedelta(minutes=k + 2), k) for k in range(150)]
    found = queues.waits(spark.createDataFrame(rows, SCHEMA), "r", "a", "b", "n", spark.createDataFrame([("a", 500)], "r string, capacity int"), bucket_hours=1)
    assert found.count() == 150 and found.where("begins <> at").count() == 0
    assert lists and max(lists) == 1 and any("CoGroup" in p for p in plans)


def test_a_long_jam_raises(spark):
    rows = [("a", "x", T0 + datetime.timedelta(hours=k), T0 + datetime.timedelta(hours=k + 5), k) for k in range(12)]
    capacity = spark.createDataFrame([("a", 2)], "r string, capacity int")
    with pytest.raises(RuntimeError, match="settle"):
        queues.waits(spark.createDataFrame(rows, SCHEMA), "r", "a", "b", "n", capacity, bucket_hours=1, rounds=3)


def test_no_requests(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert queues.queueing(empty, "r", "a", "b", "n").count() == 0
    assert queues.queueing(empty, "r", "a", "b", "n", spark.createDataFrame([], "r string, capacity int")).count() == 0
