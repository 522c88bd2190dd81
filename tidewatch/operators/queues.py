"""Queues and contention (W5): how long requests wait for a resource with a limited number of places."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import micros
from ..sources.scratch import release, written
from .windows import same

HOUR = 3_600_000_000


def waits(requests: DataFrame, resource: str, start: str, end: str, tie: str, capacity: DataFrame | None = None, bucket_hours: float = 24, rounds: int = 1000) -> DataFrame:
    """resource, tie, at, begins (microseconds since the epoch) of every request: when it comes, and when it gets a place.

    Requests are served in order of ``start`` and ``tie``; each takes a place for the time
    from ``start`` to ``end`` (none, if that is negative). capacity: resource, capacity; a
    resource without one has 1 place. Requests with a null start or end have no row.

    A resource isn't one task: its time is cut into buckets. What a bucket does to the time
    at which the one place is free again is a small operator, ``x -> max(x + work, last)``;
    such operators compose, so running sums and maxima over the buckets give each its
    entry, and running sums and maxima within a bucket the requests. With several places
    the free times are a list, which has no such form: buckets are gone through at once,
    first from empty places, then again where the bucket before ends with later free times
    than assumed, until none does. Later entries never make earlier exits, so that ends at
    the true ones, after as many rounds as the longest jam has buckets; a jam of more than
    ``rounds`` buckets raises.
    """
    rows = requests.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    at = micros(F.col(start))
    rows = rows.select(F.col(resource).alias("resource"), F.col(tie).alias("tie"), at.alias("at"), F.greatest(micros(F.col(end)) - at, F.lit(0).cast("long")).alias("service"))
    rows = rows.withColumn("bucket", F.floor(F.col("at") / int(bucket_hours * HOUR)))
    if capacity is None:
        return _one_place(rows)
    places = capacity.select(F.col(resource).alias("of"), F.col("capacity").cast("int").alias("places"))
    rows = written(rows.join(places, F.col("resource").eqNullSafe(F.col("of")), "left").withColumn("places", F.greatest(F.coalesce("places", F.lit(1)), F.lit(1))).drop("of"), "requests")
    return _one_place(rows.where("places = 1")).unionByName(_many_places(rows.where("places > 1"), int(bucket_hours * HOUR), rounds))


def _one_place(rows: DataFrame) -> DataFrame:
    """Served until = max over the requests so far of (coming + all work from there on), and the entry before them."""
    inner = Window.partitionBy("resource", "bucket").orderBy("at", "tie").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.max(F.col("at") - (F.col("work") - F.col("service"))).over(inner)
    local = rows.withColumn("work", F.sum("service").over(inner)).withColumn("ahead", latest)
    before = Window.partitionBy("resource").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = local.groupBy("resource", "bucket").agg(F.sum("service").alias("total"), F.max("ahead").alias("ahead"))
    buckets = buckets.withColumn("done", F.coalesce(F.sum("total").over(before), F.lit(0))).withColumn("level", F.col("ahead") - F.col("done"))
    entry = (F.col("done") + F.max("level").over(before)).alias("entry")
    met = local.alias("l").join(buckets.select("resource", "bucket", entry).alias("r"), same("l", "r", ["resource", "bucket"]))
    until = F.col("work") + F.greatest("ahead", "entry")  # null before the first bucket: greatest takes the other
    return met.select("l.resource", "l.bucket", "tie", "at", (until - F.col("service")).alias("begins"))


def _serve(rows: pd.DataFrame, entry: list[int] | None) -> tuple[list[int], list[int]]:
    """(begins of each, free times afterwards) of requests in order; ``entry`` holds the free times of the places that are taken at first."""
    taken = [] if entry is None else [int(x) for x in entry]
    free = [0] * (int(rows["places"].iloc[0]) - len(taken)) + taken
    heapq.heapify(free)
    begins = []
    for at, service in zip(rows["at"].tolist(), rows["service"].tolist(), strict=True):
        begins.append(max(at, free[0]))
        heapq.heapreplace(free, begins[-1] + service)
    return begins, sorted(free)


def _many_places(rows: DataFrame, width: int, rounds: int) -> DataFrame:
    keys = ["resource", "bucket"]
    kind = rows.schema["resource"].dataType.simpleString()

    def ordered(group: pd.DataFrame) -> pd.DataFrame:
        return group.sort_values(["at", "tie"], kind="stable", na_position="first")

    def exits(key: tuple, group: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
        # what is free before the next bucket begins is free: entries that make no difference are the same
        begin = (int(key[1]) + 1) * width
        free = [x for x in _serve(ordered(group), entered["entry"].iloc[0])[1] if x > begin]
        return pd.DataFrame({"resource": [key[0]], "bucket": [key[1]], "free": [free or None]})

    def served(key: tuple, group: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
        group = ordered(group)
        return group.assign(begins=_serve(group, entered["entry"].iloc[0])[0])[["resource", "bucket", "tie", "at", "begins"]]

    def of(buckets: DataFrame):
        """Requests of these buckets beside their entry: a list of places is there once for a bucket, not for each request."""
        entered = buckets.select(*keys, "entry")
        own = rows.alias("l").join(buckets.select(*keys).alias("r"), same("l", "r", keys), "left_semi")
        return own.groupBy(*keys).cogroup(entered.groupBy(*keys))

    order = Window.partitionBy("resource").orderBy("bucket")
    known = written(rows.groupBy(*keys).agg(F.lit(None).cast("array<long>").alias("entry"), F.lit(True).alias("open"), F.lit(None).cast("array<long>").alias("free")), "queue-buckets")
    for _ in range(rounds):
        ends = of(known.where("open")).applyInPandas(exits, f"resource {kind}, bucket long, free array<long>").alias("r")
        joined = known.alias("l").join(ends, same("l", "r", keys), "left").select("l.resource", "l.bucket", "entry", F.when(F.col("l.open"), F.col("r.free")).otherwise(F.col("l.free")).alias("free"))
        moved = joined.withColumn("next", F.lag("free").over(order))
        old, known = known, written(moved.select(*keys, F.col("next").alias("entry"), (~F.col("entry").eqNullSafe(F.col("next"))).alias("open"), "free"), "queue-buckets")
        release(old)
        if known.where("open").isEmpty():
            break
    else:
        raise RuntimeError(f"queues did not settle in {rounds} rounds")
    tie = rows.schema["tie"].dataType.simpleString()
    return of(known).applyInPandas(served, f"resource {kind}, bucket long, tie {tie}, at long, begins long")


def queueing(requests: DataFrame, resource: str, start: str, end: str, tie: str, capacity: DataFrame | None = None, bucket_hours: float = 24) -> DataFrame:
    """Per resource: requests, queued ones, longest and mean wait and the time with a queue (contended), in hours.

    As ``waits``; places are given in order, so the times with a queue are those from the
    coming of a request to its begin, without what the request before has already covered.
    """
    rows = written(waits(requests, resource, start, end, tie, capacity, bucket_hours), "waits")
    inner = Window.partitionBy("resource", "bucket").orderBy("at", "tie")
    before = F.lag("begins").over(inner)
    ends = rows.groupBy("resource", "bucket").agg(F.max("begins").alias("last"))
    ends = ends.withColumn("carried", F.lag("last").over(Window.partitionBy("resource").orderBy("bucket"))).drop("last")
    met = rows.withColumn("within", before).alias("l").join(ends.alias("r"), same("l", "r", ["resource", "bucket"]))
    wait = F.col("begins") - F.col("at")
    fresh = F.greatest(F.lit(0).cast("long"), F.col("begins") - F.greatest("at", F.coalesce("within", "carried")))
    out = met.select("l.resource", wait.alias("wait"), fresh.alias("fresh")).groupBy(F.col("resource").alias(resource))
    hours = lambda c: F.round(c / float(HOUR), 6)
    return out.agg(F.count("*").alias("requests"), F.count_if(F.col("wait") > 0).alias("queued"), hours(F.max("wait")).alias("longest_wait"), hours(F.sum("wait") / F.count("*")).alias("mean_wait"), hours(F.sum("fresh")).alias("contended"))


def isolation(requests: DataFrame, resource: str, workload: str, start: str, end: str, tie: str, capacity: DataFrame | None = None, bucket_hours: float = 24) -> DataFrame:
    """Which kinds of work wait for which: per resource and workload, its requests, the hours it waits and its share of the work.

    A workload that waits long though it brings little work is one to be moved to a resource of its own.
    """
    told = requests.select(F.col(resource).alias("of"), F.col(tie).alias("t"), F.col(workload).alias("workload"), F.greatest(micros(F.col(end)) - micros(F.col(start)), F.lit(0).cast("long")).alias("work"))
    rows = waits(requests, resource, start, end, tie, capacity, bucket_hours)
    met = rows.join(told, F.col("resource").eqNullSafe(F.col("of")) & F.col("tie").eqNullSafe(F.col("t")))
    by = met.groupBy(F.col("resource").alias(resource), "workload").agg(F.count("*").alias("requests"), F.sum(F.col("begins") - F.col("at")).alias("waited"), F.sum("work").alias("work"))
    share = F.try_divide(F.col("work").cast("double"), F.sum("work").over(Window.partitionBy(resource)).cast("double"))
    return by.select(resource, "workload", "requests", F.round(F.col("waited") / float(HOUR), 6).alias("waited"), F.round(share, 6).alias("work_share"))
