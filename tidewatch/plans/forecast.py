"""Forecasting and optimisation (P)."""

from pyspark.sql import functions as F

from ..functions.columns import exact_sum
from ..operators import forecast as fc
from ..sources.tables import METRICS_SQL, USAGE_SQL, load, metrics
from .registry import query

FIT_SQL = f"WITH {USAGE_SQL}, {METRICS_SQL}, f AS (SELECT series, regr_slope(value, month_no) AS slope, regr_intercept(value, month_no) AS intercept, regr_r2(value, month_no) AS r2, max(month_no) AS last_t FROM metrics GROUP BY 1)"


@query("p1_linear_forecast", f"{FIT_SQL} SELECT series, CAST(last_t + 3 AS INTEGER) AS t, round(slope, 2) AS slope, round(r2, 6) AS r2, round(intercept + slope * (last_t + 3) + CASE series WHEN 'R' THEN 1000 ELSE 0 END, 0) AS forecast FROM f")
def p1(spark, folder):
    planned = spark.createDataFrame([("R", 1000.0)], "series string, planned double")
    out = fc.linear_forecast(metrics(spark, folder), "series", "month_no", "value", 3, planned)
    return out.select("series", "t", F.round("slope", 2).alias("slope"), "r2", F.round("forecast", 0).alias("forecast"))


@query("p2_time_to_limit", f"{FIT_SQL} SELECT series, 1e9 AS limit_value, CASE WHEN slope > 0 THEN round(greatest(0, (1e9 - intercept) / slope - last_t), 1) END AS periods_left FROM f")
def p2(spark, folder):
    limits = metrics(spark, folder).select("series").distinct().withColumn("limit_value", F.lit(1e9))
    return fc.time_to_limit(metrics(spark, folder), limits, "series", "month_no", "value").withColumn("periods_left", F.round("periods_left", 1))


SIZES = [("S", 50.0, 1.0), ("M", 100.0, 2.0), ("L", 200.0, 4.0), ("XL", 1000.0, 9.0)]


@query(
    "p3_right_size",
    f"""WITH n AS (SELECT user_id, quantile_cont(value, 0.95) AS need FROM events GROUP BY 1), s(size, capacity, price) AS (VALUES {", ".join(map(str, SIZES))})
    SELECT user_id, round(need, 4) AS need, arg_min(size, (price, size)) AS size, CAST(min(price) AS DOUBLE) AS price FROM n LEFT JOIN s ON capacity >= need GROUP BY user_id, need""",
)
def p3(spark, folder):
    return fc.right_size(load(spark, folder, "events"), "user_id", "value", SIZES)


HOURLY_SQL = "h AS (SELECT date_trunc('hour', ts) AS hour, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS used FROM events GROUP BY 1)"


@query("p4_commit_optimizer", f"WITH {HOURLY_SQL}, l AS (SELECT unnest([0.0, 100.0, 300.0, 500.0, 800.0]::DOUBLE[]) AS level) SELECT level, round(sum(greatest(used - level, 0) * 1.0 + level * 0.6), 2) AS cost FROM h, l GROUP BY 1")
def p4(spark, folder):
    hourly = load(spark, folder, "events").groupBy(F.window("ts", "1 hour").alias("w")).agg(exact_sum(F.col("value")).alias("used"))
    return fc.commit_optimizer(hourly, [0, 100, 300, 500, 800], 1.0, 0.6)


@query(
    "p4_best_commitment",
    f"""WITH {HOURLY_SQL}, l AS (SELECT unnest([0.0, 100.0, 300.0, 500.0, 800.0]::DOUBLE[]) AS level), c AS (SELECT level, round(sum(greatest(used - level, 0) * 1.0 + level * 0.6), 2) AS cost FROM h, l GROUP BY 1)
    SELECT arg_min(level, (cost, level)) AS level, min(cost) AS cost, round(max(cost) FILTER (level = 0) - min(cost), 2) AS saving FROM c""",
)
def p4_best(spark, folder):
    return fc.best_commitment(p4(spark, folder))


@query(
    "p5_headroom",
    f"""{FIT_SQL}, t AS (SELECT 'warehouse' AS layer, series, CASE WHEN slope > 0 THEN round(greatest(0, (1e9 - intercept) / slope - last_t), 4) END AS p FROM f
        UNION ALL SELECT 'storage', series, CASE WHEN slope > 0 THEN round(greatest(0, (5e8 - intercept) / slope - last_t), 4) END FROM f)
    SELECT layer, arg_min(series, (p, series)) AS series, round(min(p), 1) AS periods_left FROM t WHERE p IS NOT NULL GROUP BY 1""",
)
def p5(spark, folder):
    rows = metrics(spark, folder)
    left = lambda limit: fc.time_to_limit(rows, rows.select("series").distinct().withColumn("limit_value", F.lit(limit)), "series", "month_no", "value")
    return fc.headroom([("warehouse", left(1e9)), ("storage", left(5e8))]).withColumn("periods_left", F.round("periods_left", 1))


@query(
    "p6_placement",
    """WITH s AS (SELECT p_type, l_returnflag, count(*) AS n, avg(l_extendedprice) AS cost FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING count(*) >= 100)
    SELECT p_type, arg_min(l_returnflag, (cost, l_returnflag)) AS platform, round(min(cost), 4) AS cost, round(1 - min(cost) / avg(cost), 6) AS saving FROM s GROUP BY 1""",
)
def p6(spark, folder):
    both = load(spark, folder, "lineitem").join(load(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return fc.placement(both, "p_type", "l_returnflag", "l_extendedprice", 100)
