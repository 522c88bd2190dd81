"""Typed scans, and the canonical tables bound to the sample schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with its pinned schema, so that no file is opened to infer one."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Run log: run_id, job, ts, status, duration_s, cost, paused, attrs."""
    failed = F.col("event_type") == "error"
    return load(spark, folder, "events").select(
        F.col("event_id").alias("run_id"),
        F.col("user_id").alias("job"),
        "ts",
        F.when(failed, "failed").when(F.col("event_type") == "view", "running").otherwise("ok").alias("status"),
        F.col("value").alias("duration_s"),
        F.col("value").alias("cost"),
        (F.col("user_id") % 10 == 0).alias("paused"),
        F.col("props").alias("attrs"),
        F.col("event_type").alias("kind"),
    )


RUNS_SQL = """runs AS (SELECT event_id AS run_id, user_id AS job, ts,
    CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'running' ELSE 'ok' END AS status,
    value AS duration_s, value AS cost, user_id % 10 = 0 AS paused, props AS attrs, event_type AS kind FROM events)"""


def usage(spark: SparkSession, folder: str) -> DataFrame:
    """Usage and billing: resource, service, tag, ts, cost, quantity."""
    return load(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("resource"),
        F.col("l_returnflag").alias("service"),
        F.col("l_linestatus").alias("tag"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("cost"),
        F.col("l_quantity").alias("quantity"),
    )


USAGE_SQL = """usage AS (SELECT l_suppkey AS resource, l_returnflag AS service, l_linestatus AS tag, l_shipdate AS ts,
    CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS cost, l_quantity AS quantity FROM lineitem)"""


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """Change events: change_id, system, entity, ts."""
    rows = load(spark, folder, "events").where("event_type = 'signup'")
    return rows.select(F.col("event_id").alias("change_id"), F.lit("deploy").alias("system"), F.col("user_id").alias("entity"), "ts")


CHANGES_SQL = """changes AS (SELECT event_id AS change_id, 'deploy' AS system, user_id AS entity, ts FROM events WHERE event_type = 'signup')"""


def incidents(spark: SparkSession, folder: str) -> DataFrame:
    """Failures: incident_id, entity, ts."""
    rows = load(spark, folder, "events").where("event_type = 'error'")
    return rows.select(F.col("event_id").alias("incident_id"), F.col("user_id").alias("entity"), "ts")


INCIDENTS_SQL = """incidents AS (SELECT event_id AS incident_id, user_id AS entity, ts FROM events WHERE event_type = 'error')"""


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly cost per service: series, month_no (months since year 0), value."""
    monthly = usage(spark, folder).groupBy(F.col("service").alias("series"), (F.year("ts") * 12 + F.month("ts") - 1).alias("month_no"))
    return monthly.agg(F.sum("cost").cast("double").alias("value"))


METRICS_SQL = """metrics AS (SELECT service AS series, CAST(year(ts) * 12 + month(ts) - 1 AS INTEGER) AS month_no,
    CAST(sum(cost) AS DOUBLE) AS value FROM usage GROUP BY ALL)"""


def entity_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Lineage of keys, from source to use: region, nation, customer, order, part; nodes are kind:key."""
    key = lambda kind, column: F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))
    nation, customer, orders, lines = (load(spark, folder, t) for t in ("nation", "customer", "orders", "lineitem"))
    parts = [
        nation.select(key("region", "n_regionkey").alias("src"), key("nation", "n_nationkey").alias("dst")),
        customer.select(key("nation", "c_nationkey").alias("src"), key("customer", "c_custkey").alias("dst")),
        orders.select(key("customer", "o_custkey").alias("src"), key("order", "o_orderkey").alias("dst")),
        lines.select(key("order", "l_orderkey").alias("src"), key("part", "l_partkey").alias("dst")).distinct(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


EDGES_SQL = """edges AS (
    SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation
    UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
    UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders
    UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem)"""
