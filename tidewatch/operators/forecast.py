"""Forecasting and optimisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import with_quantiles


def fit_lines(series: DataFrame, key: str, t: str, y: str) -> DataFrame:
    """Least squares of y on t for each key."""
    return series.groupBy(key).agg(F.regr_slope(y, t).alias("slope"), F.regr_intercept(y, t).alias("intercept"), F.regr_r2(y, t).alias("r2"), F.max(t).alias("last_t"))


def linear_forecast(series: DataFrame, key: str, t: str, y: str, horizon: int, planned: DataFrame | None = None) -> DataFrame:
    """Trend value ``horizon`` periods after the last, plus planned additions (key, planned)."""
    fits = fit_lines(series, key, t, y).withColumn("t", F.col("last_t") + horizon)
    out = fits.join(planned, key, "left") if planned is not None else fits.withColumn("planned", F.lit(0.0))
    value = F.col("intercept") + F.col("slope") * F.col("t") + F.coalesce("planned", F.lit(0.0))
    return out.select(key, "t", F.round("slope", 4).alias("slope"), F.round("r2", 6).alias("r2"), F.round(value, 2).alias("forecast"))


def time_to_limit(series: DataFrame, limits: DataFrame, key: str, t: str, y: str) -> DataFrame:
    """Periods from the last one until the trend meets the limit; null if it doesn't rise, 0 if it is already there."""
    fits = fit_lines(series, key, t, y).join(limits, key)
    at = F.when(F.col("slope") > 0, F.greatest(F.lit(0.0), (F.col("limit_value") - F.col("intercept")) / F.col("slope") - F.col("last_t")))
    return fits.select(key, "limit_value", F.round(at, 4).alias("periods_left"))


def right_size(history: DataFrame, key: str, load: str, sizes: list[tuple[str, float, float]], share: float = 0.95) -> DataFrame:
    """The cheapest size that carries the ``share`` quantile of the load. sizes: (size, capacity, price)."""
    need = with_quantiles(history.select(key).distinct(), history, [key], load, {"need": share})
    fitting = [F.when(F.col("need") <= capacity, F.struct(F.lit(float(price)).alias("price"), F.lit(size).alias("size"))) for size, capacity, price in sizes]
    return need.withColumn("m", F.array_min(F.array_compact(F.array(*fitting)))).select(key, F.round("need", 4).alias("need"), "m.size", "m.price")


def commit_optimizer(hourly: DataFrame, levels: list[float], on_demand: float, committed: float) -> DataFrame:
    """Cost of every commitment level over the hourly use: one sum for each level in one pass."""

    def cost(level: float) -> Column:
        return F.round(F.sum(F.greatest(F.col("used") - level, F.lit(0.0)) * on_demand + level * committed), 2)

    wide = hourly.agg(*[cost(float(x)).alias(f"c{i}") for i, x in enumerate(levels)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(float(x)).alias("level"), F.col(f"c{i}").alias("cost")) for i, x in enumerate(levels)])))


def best_commitment(costs: DataFrame) -> DataFrame:
    """The cheapest level of ``commit_optimizer`` (ties: the lower one) and what it saves against no commitment."""
    none = F.max(F.when(F.col("level") == 0, F.col("cost")))
    best = costs.agg(F.min(F.struct("cost", "level")).alias("m"), none.alias("without"))
    return best.select("m.level", "m.cost", F.round(F.col("without") - F.col("m.cost"), 2).alias("saving"))


def headroom(stack: list[tuple[str, DataFrame]]) -> DataFrame:
    """The first series to run out over several layers, each with periods_left."""
    every = reduce(DataFrame.unionByName, [df.select(F.lit(layer).alias("layer"), "series", "periods_left") for layer, df in stack])
    return every.where("periods_left IS NOT NULL").groupBy("layer").agg(F.min(F.struct("periods_left", "series")).alias("m")).select("layer", "m.series", "m.periods_left")


def placement(history: DataFrame, workload: str, platform: str, cost: str, least: int) -> DataFrame:
    """The cheapest platform of each workload class by own history with ``least`` runs or more, and the saving against the mean."""
    stats = history.groupBy(workload, platform).agg(F.count("*").alias("n"), F.avg(cost).alias("cost")).where(F.col("n") >= least)
    best = stats.groupBy(workload).agg(F.min(F.struct("cost", platform)).alias("m"), F.avg("cost").alias("mean"))
    return best.select(workload, F.col(f"m.{platform}").alias("platform"), F.round("m.cost", 4).alias("cost"), F.round(1 - F.col("m.cost") / F.col("mean"), 6).alias("saving"))


def trigger_tuning(batches: DataFrame, stream: str) -> DataFrame:
    """Rows, backlog and commit share of a stream's micro-batches, with the change of trigger they suggest."""
    out = batches.groupBy(stream).agg(F.count("*").alias("batches"), F.avg("rows").alias("mean_rows"), F.percentile("duration_ms", 0.95).alias("p95_ms"), F.avg(F.col("commit_ms") / F.col("duration_ms")).alias("commit_share"))
    advice = F.when(F.col("commit_share") > 0.5, "longer trigger").when(F.col("mean_rows") == 0, "available now").otherwise("keep")
    return out.withColumn("advice", advice)
