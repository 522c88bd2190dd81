"""Windows, sorts, top-k (W)."""

from pyspark.sql import functions as F

from ..operators import queues
from ..operators import windows as win
from ..sources.tables import METRICS_SQL, USAGE_SQL, load, metrics, usage
from .registry import query


@query(
    "w1_period_delta",
    f"""WITH {USAGE_SQL}, {METRICS_SQL}, d AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY month_no) AS previous FROM metrics)
    SELECT series, month_no, value, previous, round(value - previous, 4) AS delta, round((value - previous) / previous, 6) AS delta_pct FROM d""",
)
def w1(spark, folder):
    return win.period_delta(metrics(spark, folder), ["series"], "month_no", "value")


@query(
    "w2_top_n",
    "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS rank FROM lineitem QUALIFY rank <= 3",
)
def w2(spark, folder):
    rows = load(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return win.top_n(rows, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 3)


@query("w2_top_ties", "SELECT p_brand, p_partkey, p_size, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS INTEGER) AS rank FROM part QUALIFY rank <= 2")
def w2_ties(spark, folder):
    return win.top_n(load(spark, folder, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], [F.desc("p_size")], 2, ties=True)


STREAKS_SQL = """WITH m AS (SELECT user_id, ts, event_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS island FROM events)
    SELECT user_id, count(*) AS length, min(ts) AS first, max(ts) AS last FROM m WHERE bad GROUP BY user_id, island"""


@query("w3_streaks", STREAKS_SQL)
def w3(spark, folder):
    return win.streaks(load(spark, folder, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query(
    "w4_idle_gaps",
    "WITH n AS (SELECT user_id, ts AS since, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events) SELECT user_id, since, until, round((epoch_us(until) - epoch_us(since)) / 3600000000.0, 4) AS hours FROM n WHERE (epoch_us(until) - epoch_us(since)) / 3600000000.0 >= 24",
)
def w4(spark, folder):
    return win.idle_gaps(load(spark, folder, "events"), "user_id", "ts", 24, "event_id")


def intervals(spark, folder):
    """Event intervals [ts, ts + value minutes), with the length cut to whole microseconds."""
    end = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 60_000_000)).cast("timestamp_ntz")
    return load(spark, folder, "events").select("user_id", "ts", end.alias("until"))


STEPS_SQL = """i AS (SELECT user_id, ts, make_timestamp(epoch_us(ts) + CAST(floor(value * 60000000) AS BIGINT)) AS until FROM events)"""


@query(
    "w5_concurrency",
    f"""WITH {STEPS_SQL}, s AS (SELECT user_id, mom, sum(step) AS step FROM (SELECT user_id, ts AS mom, 1 AS step FROM i UNION ALL SELECT user_id, until, -1 FROM i) GROUP BY 1, 2),
    o AS (SELECT user_id, mom, sum(step) OVER (PARTITION BY user_id ORDER BY mom) AS open FROM s)
    SELECT user_id, CAST(max(open) AS BIGINT) AS peak, arg_min(mom, (-open, mom)) AS peak_at FROM o GROUP BY 1""",
)
def w5(spark, folder):
    return win.concurrency(intervals(spark, folder), "user_id", "ts", "until")


@query(
    "w5_concurrency_overall",
    f"""WITH {STEPS_SQL}, s AS (SELECT mom, sum(step) AS step FROM (SELECT ts AS mom, 1 AS step FROM i UNION ALL SELECT until, -1 FROM i) GROUP BY 1)
    SELECT CAST(max(open) AS BIGINT) AS peak FROM (SELECT sum(step) OVER (ORDER BY mom) AS open FROM s)""",
)
def w5_overall(spark, folder):
    return win.concurrency_by_bucket(intervals(spark, folder), "ts", "until", 3_600_000_000)


QUEUE_SQL = """WITH r AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS a, CAST(floor(value * 60000000) AS BIGINT) AS s FROM events),
    w AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS work FROM r),
    e AS (SELECT *, work - s + max(a - (work - s)) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS UNBOUNDED PRECEDING) AS begins FROM w)"""


def requests(spark, folder):
    """Each event asks its user's one place for ``value`` minutes."""
    end = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 60_000_000)).cast("timestamp_ntz")
    return load(spark, folder, "events").select("event_id", "user_id", "event_type", "ts", end.alias("until"))


@query(
    "w5_queueing",
    f"""{QUEUE_SQL}, l AS (SELECT *, greatest(0, begins - greatest(a, coalesce(lag(begins) OVER (PARTITION BY user_id ORDER BY a, event_id), a))) AS fresh FROM e)
    SELECT user_id, count(*) AS requests, count(*) FILTER (begins > a) AS queued, round(max(begins - a) / 3600000000.0, 6) AS longest_wait,
        round(sum(begins - a) / count(*) / 3600000000.0, 6) AS mean_wait, round(sum(fresh) / 3600000000.0, 6) AS contended FROM l GROUP BY 1""",
)
def w5_queue(spark, folder):
    return queues.queueing(requests(spark, folder), "user_id", "ts", "until", "event_id")


@query(
    "w5_isolation",
    f"""{QUEUE_SQL}, g AS (SELECT user_id, event_type, count(*) AS requests, sum(begins - a) AS waited, CAST(sum(s) AS DOUBLE) AS work FROM e GROUP BY 1, 2)
    SELECT user_id, event_type AS workload, requests, round(waited / 3600000000.0, 6) AS waited, round(work / nullif(sum(work) OVER (PARTITION BY user_id), 0), 6) AS work_share FROM g""",
)
def w5_isolation(spark, folder):
    return queues.isolation(requests(spark, folder), "user_id", "event_type", "ts", "until", "event_id")


@query("w5_queueing_places")
def w5_places(spark, folder):
    """Each event type is a resource with a fifth more places than its mean number of open intervals; against a plain queue in ``tests/test_queues.py``."""
    rows = requests(spark, folder)
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    busy = rows.groupBy("event_type").agg(F.sum(seconds("until") - seconds("ts")).alias("work"), (F.max(seconds("ts")) - F.min(seconds("ts"))).alias("span"))
    capacity = busy.select("event_type", F.ceil(F.coalesce(F.try_divide(1.2 * F.col("work"), F.col("span")), F.lit(1))).alias("capacity"))
    return queues.queueing(rows, "event_type", "ts", "until", "event_id", capacity)


@query(
    "w6_rolling",
    """SELECT event_id, user_id, round(avg(value) OVER w, 9) AS rolling, count(*) OVER w AS rows FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW)""",
)
def w6(spark, folder):
    return win.rolling(load(spark, folder, "events"), "user_id", "ts", "value", 7).select("event_id", "user_id", "rolling", "rows")


SESSIONS_SQL = """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY user_id, k"""


@query("w7_sessions", SESSIONS_SQL)
def w7(spark, folder):
    return win.sessions(load(spark, folder, "events").where("event_type = 'error'"), "user_id", "ts", 120)


@query(
    "w8_budget_burn",
    f"""WITH {USAGE_SQL}, {METRICS_SQL}, r AS (SELECT series, month_no, sum(value) OVER (PARTITION BY series ORDER BY month_no) AS spent FROM metrics)
    SELECT series, round(max(spent), 2) AS spent, min(month_no) FILTER (spent > 20000000) AS breach FROM r GROUP BY 1""",
)
def w8(spark, folder):
    return win.budget_burn(metrics(spark, folder), "series", "month_no", "value", 20_000_000)


@query(
    "w9_owner_share",
    """WITH c AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, round(n / sum(n) OVER (PARTITION BY l_partkey), 6) AS share FROM c QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) = 1)
    SELECT l_partkey, l_suppkey, n, share, l_partkey % 100 AS owner, l_suppkey IS DISTINCT FROM l_partkey % 100 AS drifted FROM r""",
)
def w9(spark, folder):
    rows = load(spark, folder, "lineitem")
    declared = rows.select("l_partkey").distinct().withColumn("owner", F.col("l_partkey") % 100)
    return win.owner_share(rows, "l_partkey", "l_suppkey", declared)


@query("w10_latest_state", "SELECT user_id, ts, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def w10(spark, folder):
    return win.latest_state(load(spark, folder, "events"), "user_id", "ts", "event_id", ["event_type", "value"])


@query(
    "w11_percentile_band",
    """SELECT c_custkey, c_mktsegment, round(percent_rank() OVER w, 6) AS percent_rank, round(cume_dist() OVER w, 6) AS cume_dist, CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS INTEGER) AS band
    FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal)""",
)
def w11(spark, folder):
    return win.percentile_band(load(spark, folder, "customer"), ["c_mktsegment"], "c_acctbal", "c_custkey").select("c_custkey", "c_mktsegment", "percent_rank", "cume_dist", "band")


@query("w8_usage_total", f"WITH {USAGE_SQL} SELECT resource, CAST(sum(cost) AS DOUBLE) AS cost FROM usage GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_resources(spark, folder):
    """The ten most expensive resources."""
    return usage(spark, folder).groupBy("resource").agg(F.sum("cost").cast("double").alias("cost")).orderBy(F.desc("cost"), "resource").limit(10)
