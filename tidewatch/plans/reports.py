"""Composite reports (R)."""

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import forecast as fc
from ..operators import reports
from ..sources.tables import CHANGES_SQL, INCIDENTS_SQL, METRICS_SQL, RUNS_SQL, USAGE_SQL, changes, entity_edges, incidents, load, metrics, runs, usage

from .forecast import SIZES
from .graph import ROOT_SQL, seeds, status
from .quality import DAILY_SQL, daily
from .registry import query
from .text import CAUSES, LINES_SQL, lines

NOW = datetime(2024, 1, 31)


DIGEST_SQL = f"""WITH {RUNS_SQL}, s AS (SELECT job, CASE WHEN status = 'failed' THEN 'failed' ELSE 'stuck' END AS state, count(*) AS n FROM runs
        WHERE NOT paused AND (status = 'failed' OR (status = 'running' AND (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 3600000000.0 > 240)) GROUP BY 1, 2),
    h AS (SELECT job, count(*) FILTER (status = 'failed') AS failed, count(*) AS n FROM runs GROUP BY 1), f AS (SELECT user_id, max(ts) AS newest FROM events GROUP BY 1)
    SELECT 'runs' AS source, CAST(job AS VARCHAR) AS entity, state AS issue, 'high' AS severity, CAST(n AS VARCHAR) AS evidence, CAST(NULL AS VARCHAR) AS recommendation FROM s
    UNION ALL SELECT 'health', CAST(job AS VARCHAR), 'failure rate', 'medium', CAST(failed AS VARCHAR), NULL FROM h WHERE round(failed / n, 6) > 0.3
    UNION ALL SELECT 'freshness', CAST(user_id AS VARCHAR), 'stale', 'low', CAST(CAST(newest AS DATE) AS VARCHAR), NULL FROM f WHERE (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(newest)) / 3600000000.0 > 24"""


@query(
    "r1_daily_report",
    DIGEST_SQL,
)
def r1(spark, folder):
    return reports.daily_report(runs(spark, folder), load(spark, folder, "events"), NOW, 240, 24)


@query(
    "r2_incident_causes",
    f"""WITH {INCIDENTS_SQL}, {CHANGES_SQL} SELECT incident_id, i.entity, change_id FROM incidents i JOIN changes c ON i.entity = c.entity AND c.ts <= i.ts AND epoch_us(i.ts) - epoch_us(c.ts) <= 21600000000
    QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY c.ts DESC, change_id) = 1""",
)
def r2(spark, folder):
    return reports.incident_triage(incidents(spark, folder), changes(spark, folder), entity_edges(spark, folder), status(spark, folder), 6)[0].select("incident_id", "entity", "change_id")


@query("r2_incident_roots", ROOT_SQL)
def r2_roots(spark, folder):
    return reports.incident_triage(incidents(spark, folder), changes(spark, folder), entity_edges(spark, folder), status(spark, folder), 6)[1]


TRIAGE_SQL = f"""WITH {RUNS_SQL}, {CHANGES_SQL}, {LINES_SQL}, s AS (SELECT run_id, job, ts, CASE WHEN status = 'failed' THEN 'failed' ELSE 'stuck' END AS state FROM runs
        WHERE NOT paused AND (status = 'failed' OR (status = 'running' AND (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 3600000000.0 > 240))),
    n AS (SELECT run_id, change_id FROM s JOIN changes c ON job = entity AND c.ts <= s.ts AND epoch_us(s.ts) - epoch_us(c.ts) <= 21600000000 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY c.ts DESC, change_id) = 1),
    k AS (SELECT doc_id, CASE {" ".join(f"WHEN regexp_matches(text, '{p}') THEN '{c}'" for c, p in CAUSES)} ELSE 'unknown' END AS category FROM documents WHERE text <> ''),
    m AS (SELECT *, regexp_matches(line, '###') AS noise, min(line_no) FILTER (contains(line, '!!')) OVER w AS start, count(*) OVER w AS total, count(*) FILTER (regexp_matches(line, '###')) OVER w AS noisy FROM lines WINDOW w AS (PARTITION BY doc_id)),
    b AS (SELECT * FROM m WHERE NOT noise AND line_no >= start - 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) <= 5),
    f AS (SELECT doc_id, CAST(min(line_no) AS INTEGER) AS first_line, CAST(max(line_no) AS INTEGER) AS last_line, any_value(total) - count(*) AS suppressed, any_value(noisy) AS noise FROM b GROUP BY 1)
    SELECT run_id, job, state, change_id, category, first_line, last_line, suppressed, noise FROM s LEFT JOIN n USING (run_id) LEFT JOIN k ON run_id = k.doc_id LEFT JOIN f ON run_id = f.doc_id"""


@query(
    "r2_incident_triage",
    TRIAGE_SQL,
)
def r2_triage(spark, folder):
    """The log of a run is the document of the same number."""
    logs = lines(spark, folder).withColumnRenamed("doc_id", "run_id")
    return reports.incident_report(runs(spark, folder), changes(spark, folder), logs, NOW, 240, 6, CAUSES, "###", "!!")


@query(
    "r2_triage_chain",
    f"""WITH t AS ({TRIAGE_SQL}), g AS ({ROOT_SQL}), m AS (SELECT node, arg_max(root, (depth, root)) AS root FROM g GROUP BY 1)
    SELECT t.*, m.root FROM t LEFT JOIN m ON m.node = 'customer:' || t.job""",
)
def r2_chain(spark, folder):
    """A run's job loads the customer of the same number."""
    node = F.concat(F.lit("customer:"), F.col("job").cast("string"))
    return reports.triage_chain(r2_triage(spark, folder), entity_edges(spark, folder), status(spark, folder), node)


UNUSUAL_SQL = f"""{DAILY_SQL}, b AS (SELECT *, avg(total) OVER w AS base, stddev_samp(total) OVER w AS spread FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
    o AS (SELECT event_type, day, round((total - base) / nullif(spread, 0), 4) AS score FROM b)"""


@query(
    "r1_daily_ops",
    f"""WITH d AS ({DIGEST_SQL}), {UNUSUAL_SQL}, f AS (SELECT * FROM d UNION ALL SELECT 'anomaly', event_type, CASE WHEN score > 0 THEN 'unusually high' ELSE 'unusually low' END, CASE WHEN abs(score) > 4 THEN 'high' ELSE 'medium' END, CAST(day AS VARCHAR), NULL FROM o WHERE abs(score) > 2)
    SELECT *, CASE severity WHEN 'high' THEN 'oncall' WHEN 'medium' THEN 'team' ELSE 'digest' END AS channel, severity = 'high' AS page FROM f""",
)
def r1_ops(spark, folder):
    routing = spark.createDataFrame([("high", "oncall", True), ("medium", "team", False)], "severity string, channel string, page boolean")
    return reports.daily_ops(r1(spark, folder), daily(spark, folder), "event_type", "total", routing)


@query(
    "r3_cost_findings",
    f"""WITH {USAGE_SQL}, s AS (SELECT user_id, sum(value) / 43200.0 AS share FROM events GROUP BY 1),
    m AS (SELECT service, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(sum(cost) AS DOUBLE) AS cost FROM usage GROUP BY 1, 2),
    b AS (SELECT *, avg(cost) OVER w AS base, stddev_samp(cost) OVER w AS spread FROM m WINDOW w AS (PARTITION BY service ORDER BY month ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
    SELECT 'cost' AS what, coalesce(service, 'all') AS entity, CAST(sum(cost) AS DOUBLE) AS amount FROM usage GROUP BY ROLLUP (service)
    UNION ALL SELECT CASE WHEN share < 0.05 THEN 'idle' ELSE 'hot' END, CAST(user_id AS VARCHAR), round(share, 6) FROM s WHERE share < 0.05 OR share > 0.08
    UNION ALL SELECT 'unusual month', service || ' ' || month, cost FROM b WHERE abs(round((cost - base) / nullif(spread, 0), 4)) > 2""",
)
def r3_findings(spark, folder):
    return reports.cost_findings(usage(spark, folder), load(spark, folder, "events"), "user_id", "value", 43200.0, 0.05, 0.08)


@query(
    "r3_cost_audit",
    f"""WITH {USAGE_SQL}, {METRICS_SQL}, d AS (SELECT series, month_no, value - lag(value) OVER (PARTITION BY series ORDER BY month_no) AS delta FROM metrics), t AS (SELECT resource, CAST(sum(cost) AS DOUBLE) AS amount FROM usage GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
    SELECT 'top resource' AS what, CAST(resource AS VARCHAR) AS entity, round(amount, 3) AS amount FROM t UNION ALL SELECT 'largest rise', series, round(max(delta), 3) FROM d GROUP BY series""",
)
def r3(spark, folder):
    return reports.cost_audit(usage(spark, folder), metrics(spark, folder)).withColumn("amount", F.round("amount", 3))


@query(
    "r4_cost_anomaly_causes",
    f"""WITH {DAILY_SQL}, b AS (SELECT *, avg(total) OVER w AS base, stddev_samp(total) OVER w AS spread FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
    o AS (SELECT event_type, day FROM b WHERE abs(round((total - base) / nullif(spread, 0), 4)) > 2), c AS (SELECT event_type, CAST(ts AS DATE) AS d FROM events WHERE value > 150)
    SELECT o.event_type, day, count(d) AS changes FROM o LEFT JOIN c ON o.event_type = c.event_type AND d IN (day, day - 1) GROUP BY 1, 2""",
)
def r4(spark, folder):
    large = load(spark, folder, "events").where("value > 150").select("event_type", "ts")
    return reports.cost_anomaly_causes(daily(spark, folder), large, "event_type", 2.0)


@query(
    "r5_quality_report",
    """SELECT * FROM (VALUES ('nulls:l_tax', true), ('nulls:l_shipdate', true), ('required:l_partkey', true)) t("check", passed)
    UNION ALL SELECT 'duplicates', count(*) = 0 FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    UNION ALL SELECT 'range:l_quantity', count(*) FILTER (l_quantity > 49) = 0 FROM lineitem""",
)
def r5(spark, folder):
    return reports.quality_report(load(spark, folder, "lineitem"), ["l_tax", "l_shipdate"], ["l_orderkey", "l_linenumber"], {"required": ["l_partkey"], "ranges": {"l_quantity": (0, 49)}})


@query(
    "r5_quality_over_time",
    """WITH q AS (SELECT unnest(['nulls:value', 'duplicates', 'allowed:event_type', 'range:value']) AS "check", unnest([count(*) = count(value), count(*) = count(DISTINCT event_id), count(*) FILTER (event_type NOT IN ('view', 'click', 'error')) = 0, count(*) FILTER (value NOT BETWEEN 0 AND 100000) = 0]) AS passed FROM events),
    f AS (SELECT CAST(user_id AS VARCHAR) AS entity, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) / 3600000000.0 AS age FROM events GROUP BY 1),
    d AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total FROM events GROUP BY ALL),
    b AS (SELECT *, avg(total) OVER w AS base, stddev_samp(total) OVER w AS spread FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
    o AS (SELECT event_type, day, round((total - base) / nullif(spread, 0), 4) AS score FROM b WHERE abs(round((total - base) / nullif(spread, 0), 4)) > 2),
    r AS (SELECT "check", CAST(NULL AS VARCHAR) AS entity, CAST(NULL AS DATE) AS day, CAST(NULL AS DOUBLE) AS measure, passed FROM q
        UNION ALL SELECT 'freshness', entity, NULL, round(age, 4), false FROM f WHERE age > 12 UNION ALL SELECT 'anomalies', event_type, day, round(score, 3), false FROM o)
    SELECT * FROM r UNION ALL SELECT 'freshness', NULL, NULL, NULL, (SELECT count(*) FROM f WHERE age > 12) = 0 UNION ALL SELECT 'anomalies', NULL, NULL, NULL, (SELECT count(*) FROM o) = 0""",
)
def r5_over_time(spark, folder):
    contract = {"allowed": {"event_type": ("view", "click", "error")}, "ranges": {"value": (0, 100000)}}
    return reports.quality_report_over_time(load(spark, folder, "events"), ["value"], ["event_id"], contract, "ts", "user_id", "event_type", "value", datetime(2024, 1, 31), 12, 2.0)


@query(
    "r6_sla_impact",
    """WITH o AS (SELECT 'order:' || o_orderkey AS node, o_orderpriority AS kind, o_orderdate AS due FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 5)
    SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY due, node) AS INTEGER) AS rank FROM o""",
)
def r6(spark, folder):
    due = load(spark, folder, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("node"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("due"))
    return reports.sla_impact(entity_edges(spark, folder), seeds(spark, "nation:5"), due)


@query(
    "r7_savings_roadmap",
    f"""WITH n AS (SELECT user_id, quantile_cont(value, 0.95) AS need, sum(value) AS busy FROM events GROUP BY 1), s(size, capacity, price) AS (VALUES {", ".join(map(str, SIZES))}),
    a AS (SELECT user_id AS entity, 'move to ' || arg_min(size, (price, size)) AS action, CAST(9.0 - min(price) AS DOUBLE) AS saving FROM n JOIN s ON capacity >= need GROUP BY user_id),
    b AS (SELECT user_id, 'suspend', CAST(7.5 AS DOUBLE) FROM n WHERE busy / 43200.0 < 0.05), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
    SELECT *, CAST(row_number() OVER (ORDER BY saving DESC, entity) AS INTEGER) AS rank FROM (SELECT entity, arg_max(action, (saving, action)) AS action, max(saving) AS saving FROM u GROUP BY 1)""",
)
def r7(spark, folder):
    events = load(spark, folder, "events")
    sized = fc.right_size(events, "user_id", "value", SIZES).where("size IS NOT NULL")
    idle = agg.utilization(events, "user_id", "value", 43200.0, 0.05, 0.08).where("class = 'idle'")
    return reports.savings_roadmap(
        sized.select(F.col("user_id").alias("entity"), F.concat(F.lit("move to "), F.col("size")).alias("action"), (9.0 - F.col("price")).alias("saving")),
        idle.select(F.col("user_id").alias("entity"), F.lit("suspend").alias("action"), F.lit(7.5).alias("saving")),
    )


@query("r8_governance_scorecard", """WITH s AS (SELECT source AS entity, avg(CASE WHEN l.doc_id IS NULL THEN 0.0 ELSE 1.0 END) AS covered, avg(CASE WHEN contains(text, '@') THEN 0.0 ELSE 1.0 END) AS private, bool_or(text LIKE '%token = %') AS blocked FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1)
    SELECT entity, round((2 * covered + private) / 3.0, 6) AS score, blocked, NOT blocked AND (2 * covered + private) / 3.0 >= 0.5 AS go FROM s""")
def r8(spark, folder):
    rows = load(spark, folder, "documents").join(load(spark, folder, "labels").select("doc_id", F.lit(True).alias("known")), "doc_id", "left").withColumnRenamed("source", "entity")
    signal = lambda name, test, blocker: rows.groupBy("entity").agg(F.lit(name).alias("signal"), F.avg(test.cast("double")).alias("score"), blocker.alias("blocker"))
    both = signal("covered", F.col("known").isNotNull(), F.bool_or(F.contains("text", F.lit("token = ")))).unionByName(signal("private", ~F.contains("text", F.lit("@")), F.lit(False)))
    return reports.governance_scorecard(both, {"covered": 2.0, "private": 1.0})


@query(
    "r9_release_readiness",
    """SELECT lang AS release, count(*) AS commits, count(*) FILTER (doc_id % 4 = 1 AND lang <> 'es') AS breaking, count(*) FILTER (doc_id % 4 = 1 AND lang <> 'es') = 0 AND (SELECT avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) FROM events) <= 0.5 AS go FROM documents GROUP BY 1""",
)
def r9(spark, folder):
    docs = load(spark, folder, "documents")
    msg = F.when((F.col("doc_id") % 4 == 1) & (F.col("lang") != "es"), F.concat(F.lit("fix!: "), F.col("source"))).otherwise(F.concat(F.lit("feat: "), F.col("source")))
    return reports.release_readiness(runs(spark, folder), docs.select(F.col("lang").alias("release"), msg.alias("msg")), "msg", "release", 0.5)


@query(
    "r10_one_root_cause",
    f"""{ROOT_SQL.replace("SELECT seed AS node", ", q AS (SELECT seed AS node", 1)}), f AS (SELECT 'order:' || o_orderkey AS entity FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000 UNION ALL SELECT 'customer:' || c_custkey FROM customer WHERE c_acctbal < -500)
    SELECT root, count(*) AS findings, count(DISTINCT entity) AS entities FROM f JOIN q ON entity = q.node GROUP BY 1""",
)
def r10(spark, folder):
    orders = load(spark, folder, "orders").where("o_orderstatus = 'F' AND o_totalprice > 300000").select(F.lit("orders").alias("source"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("entity"), F.lit("large failed").alias("issue"))
    customers = load(spark, folder, "customer").where("c_acctbal < -500").select(F.lit("customers").alias("source"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("entity"), F.lit("overdrawn").alias("issue"))
    return reports.one_root_cause([orders, customers], entity_edges(spark, folder), status(spark, folder))


