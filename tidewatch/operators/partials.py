"""Day partials (Q1, A5, A6): mergeable summaries kept in a table by day; any range of days is answered from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import day
from .windows import same, settled

#: Values that a quantile sketch keeps in its widest level.
SKETCH_K = 2048
#: Rank error of such a sketch, merged or not, as a share of the values (99 of 100 times).
RANK_ERROR = 2.296 / SKETCH_K**0.9723
#: HLL takes these types as they are; others are counted by their text.
HLL_TYPES = ("int", "bigint", "string", "binary")


def _finite(value: Column) -> Column:
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def day_partials(rows: DataFrame, ts: str, keys: list[str], measures: list[str] = (), counted: list[str] = (), flags: dict[str, Column] | None = None) -> DataFrame:
    """One row for each day and key: day, keys, n, last and what can be merged later.

    ``measure_<m>`` holds the finite values of a measure: values, total (a decimal, so
    every merge gives the same sum), low, high and a KLL sketch; nulls, NaN and
    infinities aren't values. ``distinct_<c>`` is an HLL sketch, nulls don't count.
    ``count_<flag>`` counts rows for which a condition holds. Rows without a time are
    the partial of day null, which is in no range. One aggregation, reduced before
    its shuffle; what a key and day leaves has a fixed size however many rows it has.
    """
    kinds = dict(rows.dtypes)
    out = [F.count("*").alias("n"), F.max(ts).alias("last")]
    out += [F.count_if(test).alias(f"count_{name}") for name, test in (flags or {}).items()]
    for m in measures:
        v = _finite(F.col(m))
        parts = [F.count(v).alias("values"), F.sum(v.cast("decimal(28,6)")).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"), F.kll_sketch_agg_double(v, SKETCH_K).alias("sketch")]
        out.append(F.struct(*parts).alias(f"measure_{m}"))
    out += [F.hll_sketch_agg(F.col(c) if kinds[c] in HLL_TYPES else F.col(c).cast("string")).alias(f"distinct_{c}") for c in counted]
    return rows.groupBy(day(F.col(ts)).alias("day"), *keys).agg(*out)


def keep_days(partials: DataFrame, path: str) -> None:
    """Writes partials below ``path`` by day. A day that is there already is replaced, other days stay: reruns and late rows need their days only. A day of very many keys is written by several tasks."""
    partials.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def kept_days(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Partials of the days ``first`` to ``last`` (both included); the files of other days aren't read."""
    return spark.read.parquet(path).where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def merged(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Partials of all days of each key as one: the columns of ``day_partials`` without day. ``keys`` may be any columns that the partials have or were given."""
    out = [F.sum("n").alias("n"), F.max("last").alias("last")]
    for c in partials.columns:
        if c in keys:
            continue
        if c.startswith("count_"):
            out.append(F.sum(c).alias(c))
        elif c.startswith("measure_"):
            parts = [F.sum(f"{c}.values").alias("values"), F.sum(f"{c}.total").cast("decimal(38,6)").alias("total"), F.min(f"{c}.low").alias("low"), F.max(f"{c}.high").alias("high"), F.kll_merge_agg_double(f"{c}.sketch").alias("sketch")]
            out.append(F.struct(*parts).alias(c))
        elif c.startswith("distinct_"):
            out.append(F.hll_union_agg(c).alias(c))
    return partials.groupBy(*keys).agg(*out)


def summary(partials: DataFrame, keys: list[str], shares: dict[str, float] | None = None) -> DataFrame:
    """Profile of each key from its partials alone: n, last, flags, per measure values, nulls, mean, min, max and ``shares``, per counted column its distinct values.

    Counts, sums, means and extremes are exact. Quantiles are values whose rank is
    within ``RANK_ERROR`` of the share, distinct counts within some 2 % (HLL). A
    measure without values has nulls.
    """
    whole = merged(partials, keys)
    out = [*keys, "n", "last"]
    for c in whole.columns:
        kind, _, name = c.partition("_")
        if c in keys or not name:
            continue
        if kind == "count":
            out.append(F.col(c).alias(name))
        elif kind == "measure":
            values, some = F.col(f"{c}.values"), F.col(f"{c}.values") > 0
            out += [values.alias(f"{name}_values"), (F.col("n") - values).alias(f"{name}_nulls"), F.try_divide(F.col(f"{c}.total").cast("double"), values.cast("double")).alias(f"{name}_mean"), F.col(f"{c}.low").alias(f"{name}_min"), F.col(f"{c}.high").alias(f"{name}_max")]
            out += [F.when(some, F.kll_sketch_get_quantile_double(f"{c}.sketch", F.lit(float(p)))).alias(f"{name}_{label}") for label, p in (shares or {}).items()]
        elif kind == "distinct":
            out.append(F.hll_sketch_estimate(c).alias(f"{name}_distinct"))
    return whole.select(*out)


def exact_quantiles(partials: DataFrame, rows: DataFrame, keys: list[str], measure: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles (interpolated) of a measure in each key: partials bound them, so ``rows`` are read once instead of twice.

    ``rows`` are the rows of the same days, with the columns ``keys`` and ``measure``.
    Of them, values between the bounds (three rank errors around each share) are counted
    one by one, the rest by bound. Rows that the partials don't know (late ones of a day
    that wasn't replaced) shift ranks; if that leads out of the bounds, it raises.
    """
    ends = [min(max(p + side * 3 * RANK_ERROR, 0.0), 1.0) for p in shares.values() for side in (-1, 1)]
    whole = merged(partials, keys)
    of = lambda part: F.col(f"measure_{measure}.{part}")
    widest = F.array(*[of("low" if i % 2 == 0 else "high") for i in range(len(ends))])
    bounds = F.when(of("values") <= SKETCH_K, widest).otherwise(F.kll_sketch_get_quantile_double(of("sketch"), F.array(*[F.lit(e) for e in ends])))
    sketched = whole.where(of("values") > 0).select(*keys, of("values").alias("_size"), bounds.alias("_ends"))
    finite = rows.select(*keys, _finite(F.col(measure)).alias("_v")).where("_v IS NOT NULL")
    return settled(finite, sketched, keys, shares)


def sla_report(partials: DataFrame, rows: DataFrame, ts: str, measure: str, misses: str) -> DataFrame:
    """A5 from day partials: by week n, misses and slowest from the partials, percentiles exact by one pass over the rows."""
    week = lambda c: F.date_trunc("week", c).cast("date").alias("week")
    by_week = partials.withColumn("week", week(F.col("day")))
    whole = merged(by_week, ["week"])
    exact = exact_quantiles(by_week, rows.select(week(F.col(ts)), measure), ["week"], measure, {"p50": 0.5, "p95": 0.95})
    met = whole.alias("l").join(exact.alias("q"), same("l", "q", ["week"]), "left")
    return met.select("l.week", "n", F.col(f"count_{misses}").alias("misses"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), F.col(f"measure_{measure}.high").alias("slowest"))
