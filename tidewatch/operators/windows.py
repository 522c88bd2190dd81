"""Window functions, sorts and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import hours_between, micros, ratio
from ..sources.scratch import cut

#: Accuracy of the sketches that bound quantiles.
SKETCH = 10_000


def period_delta(df: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """Change against the row of the period before, absolute and as a share."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(period))
    return df.withColumn("previous", before).withColumn("delta", F.round(F.col(value) - F.col("previous"), 4)).withColumn("delta_pct", F.round(F.try_divide(F.col(value) - F.col("previous"), F.col("previous")), 6))


def top_n(df: DataFrame, keys: list[str], order: list, n: int, ties: bool = False) -> DataFrame:
    """The first n rows of each key; Catalyst cuts before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", (F.dense_rank() if ties else F.row_number()).over(w)).where(F.col("rank") <= n)


def time_bucket(ts: Column, hours: float) -> Column:
    return F.floor(micros(ts) / F.lit(int(hours * 3_600_000_000)))


def streaks(runs: DataFrame, key: str, order: list[str], failed: Column, bucket_hours: float = 24) -> DataFrame:
    """Runs of consecutive failures: first, last and length. ``order`` starts with ``ts``.

    A streak is known by the other rows before it. They are counted in time buckets,
    and bucket counts carry over, so no task sorts a whole key. Rows whose state is
    null end a streak.
    """
    rows = runs.withColumn("_bad", failed).withColumn("_bucket", time_bucket(F.col("ts"), bucket_hours))
    other = F.when(F.col("_bad"), 0).otherwise(1)
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(key, "_bucket").agg(F.sum(other).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within = F.sum(other).over(Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("_at", within).where("_bad").alias("l").join(bases.alias("r"), same("l", "r", [key, "_bucket"]))
    marked = marked.select(F.col(f"l.{key}").alias(key), F.col("l.ts").alias("ts"), (F.col("l._at") + F.col("r._base")).alias("island"))
    return marked.groupBy(key, "island").agg(F.count("*").alias("length"), F.min("ts").alias("first"), F.max("ts").alias("last")).drop("island")


def idle_gaps(activity: DataFrame, key: str, ts: str, min_hours: float, tie: str, bucket_hours: float = 24) -> DataFrame:
    """Times without activity of at least ``min_hours``.

    The next time is looked for in the row's time bucket, else it is the first of the
    key's next bucket that has any. Null times have no gap.
    """
    rows = activity.select(key, ts, tie).withColumn("_bucket", time_bucket(F.col(ts), bucket_hours))
    after = F.lead("_first").over(Window.partitionBy(key).orderBy("_bucket"))
    firsts = rows.groupBy(key, "_bucket").agg(F.min(ts).alias("_first")).withColumn("_next", after)
    within = F.lead(ts).over(Window.partitionBy(key, "_bucket").orderBy(ts, tie))
    met = rows.withColumn("_in", within).alias("l").join(firsts.alias("r"), same("l", "r", [key, "_bucket"]))
    found = met.select(F.col(f"l.{key}").alias(key), F.col(f"l.{ts}").alias("since"), F.coalesce("l._in", "r._next").alias("until"))
    gap = hours_between(F.col("since"), F.col("until"))
    return found.where(gap >= min_hours).withColumn("hours", F.round(gap, 4))


def concurrency(intervals: DataFrame, resource: str, start: str, end: str) -> DataFrame:
    """Peak number of open intervals of each resource and when it was first reached; ends count before starts."""
    moves = F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")))
    steps = intervals.select(resource, F.inline(moves)).groupBy(resource, "at").agg(F.sum("step").alias("step"))
    open_ = F.sum("step").over(Window.partitionBy(resource).orderBy("at"))
    return steps.withColumn("open", open_).groupBy(resource).agg(F.max("open").alias("peak"), F.min_by("at", F.struct(-F.col("open"), F.col("at"))).alias("peak_at"))


def concurrency_by_bucket(intervals: DataFrame, start: str, end: str, bucket_us: int) -> DataFrame:
    """Peak of one large resource: steps are summed within time buckets, bucket totals carry over as offsets.

    Only one row for each bucket meets in a task, whatever the number of intervals.
    """
    moves = F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")))
    steps = intervals.select(F.inline(moves)).groupBy("at").agg(F.sum("step").alias("step")).withColumn("bucket", F.floor(micros(F.col("at")) / bucket_us))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = steps.groupBy("bucket").agg(F.sum("step").alias("total")).select("bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = F.sum("step").over(Window.partitionBy("bucket").orderBy("at"))
    return steps.join(offsets, "bucket").withColumn("open", within + F.col("base")).agg(F.max("open").alias("peak"))


def rolling(df: DataFrame, key: str, ts: str, value: str, days: int) -> DataFrame:
    """Mean over the trailing ``days`` days, the row itself included, by time and not by rows.

    Time is cut into buckets of ``days``; each row is also history of the bucket after
    its own, so a key is spread over its buckets. Rows without a time see each other.
    """
    at = time_bucket(F.col(ts), days * 24)
    own, past = F.struct(at.alias("_bucket"), F.lit(True).alias("_own")), F.struct((at + 1).alias("_bucket"), F.lit(False).alias("_own"))
    rows = df.select("*", F.inline(F.when(at.isNull(), F.array(own)).otherwise(F.array(own, past))))
    w = Window.partitionBy(key, "_bucket").orderBy(micros(F.col(ts))).rangeBetween(-days * 86_400_000_000, 0)
    return rows.withColumn("rolling", F.round(F.avg(value).over(w), 9)).withColumn("rows", F.count("*").over(w)).where("_own").drop("_bucket", "_own")


def sessions(df: DataFrame, key: str, ts: str, gap_minutes: int) -> DataFrame:
    """Events of a key without a gap of ``gap_minutes`` between them."""
    out = df.groupBy(key, F.session_window(ts, f"{gap_minutes} minutes").alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return out.drop("w")


def budget_burn(costs: DataFrame, key: str, period: str, cost: str, budget: float) -> DataFrame:
    """Running cost and the first period in which the budget is passed (null: never)."""
    running = F.sum(cost).over(Window.partitionBy(key).orderBy(period))
    return costs.withColumn("spent", running).groupBy(key).agg(F.round(F.max("spent"), 2).alias("spent"), F.min(F.when(F.col("spent") > budget, F.col(period))).alias("breach"))


def owner_share(commits: DataFrame, path: str, who: str, declared: DataFrame | None = None) -> DataFrame:
    """The main contributor of each path, with its share, against the declared owner."""
    counts = commits.groupBy(path, who).agg(F.count("*").alias("n"))
    share = ratio(F.col("n"), F.sum("n").over(Window.partitionBy(path)))
    first = F.row_number().over(Window.partitionBy(path).orderBy(F.desc("n"), who))
    top = counts.withColumn("share", F.round(share, 6)).withColumn("rank", first).where("rank = 1").drop("rank")
    if declared is None:
        return top
    return top.join(declared, path, "left").withColumn("drifted", ~F.col(who).eqNullSafe(F.col("owner")))


def latest_state(log: DataFrame, key: str, ts: str, tie: str, columns: list[str]) -> DataFrame:
    """The newest row of each entity; an aggregation, so a hot entity is reduced before the shuffle."""
    names = list(dict.fromkeys((ts, tie, *columns)))
    return log.groupBy(key).agg(F.max(F.struct(*names)).alias("top")).select(key, *[F.col(f"top.{c}").alias(c) for c in names])


def same(left: str, right: str, columns: list[str]) -> Column:
    """Equal values of ``columns`` on both sides, nulls included."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def running(df: DataFrame, keys: list[str], order: list, step: Column, name: str) -> DataFrame:
    """Running sum of ``step`` within ``keys`` (none: of the whole table) by ``order``, however few or large the keys are.

    Rows are dealt by ranges of keys and order and summed within each range; a range
    goes on from the sums of the ranges before it, a table of ranges times keys met
    in them. ``order`` must tell rows apart, or ties are summed in any order.
    """
    dealt = cut(df.withColumn("_step", step).repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy(*keys, "_range").agg(F.sum("_step").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within = F.sum("_step").over(Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = dealt.withColumn("_at", within).alias("l").join(bases.alias("r"), same("l", "r", [*keys, "_range"]))
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("_base") + F.col("_at")).alias(name))


def ranked(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    """Row numbers within ``keys`` by ``order``; as ``running``, so no task holds a whole key."""
    return running(df, keys, order, F.lit(1), name).withColumn(name, F.col(name).cast("int"))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of ``value`` in each key, as name: share, interpolated between neighbours; nulls don't count.

    Sketches first bound each quantile: of ``n`` values, the bounds lie 3 n / ``SKETCH``
    ranks around it, three times a sketch's error. Values between the bounds are then
    counted one by one and all others together, so a key of any size leaves a few
    thousandths of its values to be sorted. A quantile that its bounds miss raises.
    Keys without a value have no row.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    ends = [min(max(p + side * 3 / SKETCH, 0.0), 1.0) for p in shares.values() for side in (-1, 1)]
    sketched = rows.groupBy(*keys).agg(F.count("*").alias("_size"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", ends, SKETCH).alias("_ends"))
    widest = F.array(*[F.col("_min" if i % 2 == 0 else "_max") for i in range(len(ends))])
    bounds = F.when(F.col("_size") <= SKETCH, widest).otherwise(F.col("_ends"))
    return settled(rows, sketched.select(*keys, "_size", bounds.alias("_ends")), keys, shares)


def settled(rows: DataFrame, sketched: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of ``_v`` within bounds. sketched: keys, _size (values of the key) and _ends (low and high bound of each share in turn)."""
    ends = range(2 * len(shares))
    both = rows.alias("l").join(sketched.alias("s"), same("l", "s", keys)).select("l.*", "s._size", *[F.col("_ends")[i].alias(f"_e{i}") for i in ends])
    inside = reduce(lambda a, b: a | b, [F.col("_v").between(F.col(f"_e{i}"), F.col(f"_e{i + 1}")) for i in range(0, len(ends), 2)])
    passed = [F.when(F.col("_v") > F.col(f"_e{i}"), F.col(f"_e{i}")) for i in range(1, len(ends), 2)]
    held = F.when(inside, F.col("_v")).otherwise(F.greatest(*passed, F.lit(None).cast("double")))
    counts = both.groupBy(*keys, "_size", held.alias("_held"), (~inside).alias("_out")).agg(F.count("*").alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys, "_size").orderBy(F.asc_nulls_first("_held"), "_out").rowsBetween(Window.unboundedPreceding, 0)))

    def holder(place: Column) -> Column:
        return F.max(F.when(~F.col("_out") & (place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_n")), F.col("_held")))

    places = {name: F.lit(float(p)) * (F.col("_size") - 1) for name, p in shares.items()}
    found = upto.groupBy(*keys, "_size").agg(*[holder(f(at)).alias(f"_{side}_{name}") for name, at in places.items() for side, f in (("low", F.floor), ("high", F.ceil))])

    def between(name: str) -> Column:
        part, low, high = places[name] - F.floor(places[name]), F.col(f"_low_{name}"), F.col(f"_high_{name}")
        missed = F.raise_error(F.lit("a quantile lies outside the bounds of its sketch")).cast("double")
        return F.when(low.isNull() | high.isNull(), missed).when(part == 0, low).otherwise((1 - part) * low + part * high)

    return found.select(*keys, *[between(n).alias(n) for n in shares])


def with_quantiles(out: DataFrame, df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``out``, an aggregate of ``df`` by ``keys``, with ``quantiles`` (null where a key has no value)."""
    met = out.alias("l").join(quantiles(df, keys, value, shares).alias("q"), same("l", "q", keys), "left")
    return met.select(*[F.col(f"l.{c}") for c in out.columns], *[F.col(f"q.{n}") for n in shares])


def percentile_band(df: DataFrame, keys: list[str], value: str, tie: str, bands: int = 4) -> DataFrame:
    """Position of each row among its peers: percent_rank and cume_dist by value, ``bands`` of equal size by value and tie.

    All three follow from the row's number, the first and last number of its value
    and the rows of its key, so no task sorts a whole key.
    """
    rows = cut(ranked(df, keys, [F.asc(value), F.asc(tie)], "_row"))
    ties = rows.groupBy(*keys, value).agg(F.min("_row").alias("_first"), F.max("_row").alias("_last"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    both = rows.alias("l").join(ties.alias("r"), same("l", "r", [*keys, value])).join(sizes.alias("s"), same("l", "s", keys))
    row, n = F.col("l._row"), F.col("s._n")
    small, more = F.floor(n / bands), n % bands
    wide = more * (small + 1)
    band = F.when(row <= wide, F.floor((row - 1) / (small + 1))).otherwise(more + F.floor((row - 1 - wide) / F.greatest(small, F.lit(1)))) + 1
    share = F.when(n > 1, (F.col("r._first") - 1) / (n - 1)).otherwise(F.lit(0.0))
    return both.select(*[F.col(f"l.{c}") for c in df.columns], F.round(share, 6).alias("percent_rank"), F.round(F.col("r._last") / n, 6).alias("cume_dist"), band.cast("int").alias("band"))
