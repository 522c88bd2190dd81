"""Scans, sources, filters (S, F)."""

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.columns import exact_sum
from ..operators import filters
from ..sources import findings, synth, text
from ..sources.tables import RUNS_SQL, SCHEMAS, load, runs
from .registry import query

#: Documents with frontmatter made of the labels and ids, in every shape the checks know.
HEADED = """SELECT doc_id, CASE doc_id % 6
    WHEN 0 THEN '---' || chr(10) || 'name: doc-' || doc_id || chr(10) || 'description: a: b' || chr(10) || 'risk: read-only' || chr(10) || 'loop-tier: on-demand' || chr(10) || '---' || chr(10) || text
    WHEN 1 THEN '---' || chr(10) || 'name: x' || chr(10) || 'name: doc-' || doc_id || chr(10) || 'risk: high' || chr(10) || ' --- ' || chr(10) || text
    WHEN 2 THEN '---' || chr(10) || 'name: open' || chr(10) || 'description: no end'
    WHEN 3 THEN '---' || chr(10) || 'no colon here' || chr(10) || 'description:' || chr(10) || 'loop-tier: never' || chr(10) || '---' || chr(10) || 'run `scripts/a.py` and `./scripts/b.sh x` in Cursor' || chr(10) || 'use `/two-words` or C:' || chr(92) || 'x' || chr(10) || text
    WHEN 4 THEN 'the copilot and MCP server' || chr(10) || text
    ELSE '' END AS text FROM documents"""


#: Documents with the fields of their frontmatter: ``last`` is the line that closes it (null: none), fields are its lines with a colon.
FRONT_SQL = f"""headed AS ({HEADED}), cells AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM headed),
    ls AS (SELECT doc_id, CASE WHEN a[len(a)] = '' THEN a[1:len(a)-1] ELSE a END AS ls FROM cells),
    ends AS (SELECT doc_id, ls, CASE WHEN trim(ls[1]) = '---' THEN nullif(list_position(list_transform(ls[2:], lambda x: trim(x)), '---'), 0) + 1 END AS last FROM ls),
    front AS (SELECT doc_id, ls, last, CASE WHEN last IS NULL THEN [] ELSE list_filter(ls[2:last-1], lambda x: contains(x, ':')) END AS fields FROM ends)"""


def field_sql(name: str) -> str:
    """The value of the last field of that name, in SQL over ``front``."""
    line = f"list_filter(fields, lambda x: trim(split_part(x, ':', 1)) = '{name}')[-1]"
    return f"trim(substr({line}, strpos({line}, ':') + 1))"


#: Finding documents of the labels: nested, malformed, with missing keys and empty evidence.
JSON_SQL = """made AS (SELECT doc_id, CASE doc_id % 5
    WHEN 0 THEN '{"items":[{"issue":"q' || quality || '","evidence":"e","recommendation":"r","severity":"low"},{"recommendation":"x","evidence":"' || CASE WHEN toxic = 1 THEN 'y' ELSE '' END || '","severity":"high"}]}'
    WHEN 1 THEN '{"issue":"a","evidence":[' || CASE WHEN quality = 1 THEN '1' ELSE '' END || '],"recommendation":"r","severity":"s","more":{"issue":"inner"}}'
    WHEN 2 THEN '{"broken": ' WHEN 3 THEN '[{"a":{"b":[' || toxic || ']}}]' ELSE '{"issue":"only"}' END AS text FROM labels),
    objects AS (SELECT v.doc_id, replace(t.fullkey, '$', 'root') AS path, v.text, t.fullkey AS place FROM (SELECT * FROM made WHERE json_valid(text)) v, json_tree(v.text) t WHERE t.type = 'OBJECT')"""


def headed(spark, folder):
    docs = load(spark, folder, "documents")
    nl = F.lit("\n")
    j = lambda *parts: F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    name = F.concat(F.lit("name: doc-"), F.col("doc_id").cast("string"))
    kind = F.col("doc_id") % 6
    made = (
        F.when(kind == 0, j("---", name, "description: a: b", "risk: read-only", "loop-tier: on-demand", "---", F.col("text")))
        .when(kind == 1, j("---", "name: x", name, "risk: high", " --- ", F.col("text")))
        .when(kind == 2, j("---", "name: open", "description: no end"))
        .when(kind == 3, j("---", "no colon here", "description:", "loop-tier: never", "---", "run `scripts/a.py` and `./scripts/b.sh x` in Cursor", "use `/two-words` or C:\\x", F.col("text")))
        .when(kind == 4, F.concat(F.lit("the copilot and MCP server"), nl, F.col("text")))
        .otherwise("")
    )
    return docs.select("doc_id", made.alias("text"))


def json_findings(spark, folder):
    """Finding documents made of the labels: nested, malformed, with missing keys and empty evidence."""
    rows = load(spark, folder, "labels")
    q, t = F.col("quality").cast("string"), F.col("toxic").cast("string")
    made = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('{"items":[{"issue":"q'), q, F.lit('","evidence":"e","recommendation":"r","severity":"low"},{"recommendation":"x","evidence":"'), F.when(F.col("toxic") == 1, "y").otherwise(""), F.lit('","severity":"high"}]}')))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit('{"issue":"a","evidence":['), F.when(F.col("quality") == 1, "1").otherwise(""), F.lit('],"recommendation":"r","severity":"s","more":{"issue":"inner"}}')))
        .when(F.col("doc_id") % 5 == 2, F.lit('{"broken": '))
        .when(F.col("doc_id") % 5 == 3, F.concat(F.lit('[{"a":{"b":['), t, F.lit("]}}]")))
        .otherwise('{"issue":"only"}')
    )
    return rows.select("doc_id", made.alias("text"))


@query("s1_load", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def s1(spark, folder):
    return load(spark, folder, "orders")


for _table in SCHEMAS:

    def _scan(spark, folder, table=_table):
        return load(spark, folder, table)

    query(f"s1_load_{_table}", f"SELECT {', '.join(c.split()[0] for c in SCHEMAS[_table].split(', '))} FROM {_table}")(_scan)


@query(
    "s2_explode_lines",
    """WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
    t AS (SELECT doc_id, CASE WHEN a[len(a)] = '' THEN a[1:len(a)-1] ELSE a END AS a FROM s)
    SELECT doc_id, CAST(i AS INTEGER) AS line_no, a[i] AS line FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM t)""",
)
def s2(spark, folder):
    return text.explode_lines(load(spark, folder, "documents"), "doc_id", "text")


@query(
    "s3_parse_findings",
    f"WITH {JSON_SQL} SELECT doc_id, NOT json_valid(text) AS malformed FROM made",
)
def s3(spark, folder):
    return findings.parse_findings(json_findings(spark, folder), "doc_id", "text").drop("value")


@query(
    "s4_walk_json",
    f"WITH {JSON_SQL} SELECT doc_id, path FROM objects",
)
def s4(spark, folder):
    return findings.walk_json(findings.parse_findings(json_findings(spark, folder), "doc_id", "text"), "doc_id").select("doc_id", "path")


@query(
    "s5_extract_frontmatter",
    f"""WITH {FRONT_SQL} SELECT doc_id, {field_sql('name')} AS name, {field_sql('description')} AS description, last IS NOT NULL AS closed, CAST(coalesce(last + 1, 1) AS INTEGER) AS body_start_line FROM front""",
)
def s5(spark, folder):
    f = text.extract_frontmatter(headed(spark, folder), "doc_id", "text")
    value = lambda k: F.try_element_at("frontmatter", F.lit(k)).alias(k)
    return f.select("doc_id", value("name"), value("description"), F.col("frontmatter").isNotNull().alias("closed"), "body_start_line")


@query("s9_route", "SELECT event_id, severity, CASE severity WHEN 'high' THEN 'oncall' WHEN 'low' THEN 'team' ELSE 'digest' END AS channel, severity = 'high' AS page FROM (SELECT event_id, CASE WHEN value > 100 THEN 'high' WHEN value > 20 THEN 'low' ELSE 'info' END AS severity FROM events WHERE event_type = 'error')")
def s9(spark, folder):
    found = load(spark, folder, "events").where("event_type = 'error'").select("event_id", F.when(F.col("value") > 100, "high").when(F.col("value") > 20, "low").otherwise("info").alias("severity"))
    routing = spark.createDataFrame([("high", "oncall", True), ("low", "team", False)], "severity string, channel string, page boolean")
    return findings.route(found, routing)


@query("s11_synth", "SELECT count(*) AS n, true AS keys_hold, true AS ranges_hold, 4 AS tags FROM orders")
def s11(spark, folder):
    """A made-up twin of the orders table: as many rows, foreign keys into the customers."""
    orders, customers = load(spark, folder, "orders"), load(spark, folder, "customer")
    n, parents = orders.count(), customers.count()
    made = synth.synth(spark, {"customer": ("foreign", parents), "price": ("double", 1.0, 9.0), "tag": ("choice", ("a", "b", "c", "d"))}, n, seed=5)
    joined = made.join(customers.select(F.col("c_custkey").alias("customer"), F.lit(1).alias("hit")), "customer", "left")
    return joined.agg(F.count("*").alias("n"), F.bool_and(F.col("hit").isNotNull()).alias("keys_hold"), F.bool_and(F.col("price").between(1, 9)).alias("ranges_hold"), F.count_distinct("tag").cast("int").alias("tags"))


@query("f1_safe_query", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def f1(spark, folder):
    return filters.safe_query(load(spark, folder, "orders").select("o_orderkey", "o_totalprice"), 50, (F.desc("o_totalprice"), "o_orderkey"))


@query(
    "f2_failed_or_stuck",
    f"""WITH {RUNS_SQL} SELECT run_id, job, ts, status, CASE WHEN status = 'failed' THEN 'failed' ELSE 'stuck' END AS state FROM runs
    WHERE NOT paused AND (status = 'failed' OR (status = 'running' AND (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 3600000000.0 > 240))""",
)
def f2(spark, folder):
    return filters.failed_or_stuck(runs(spark, folder), datetime(2024, 1, 31), 240).select("run_id", "job", "ts", "status", "state")


@query("f3_expiring", "SELECT o_orderkey, CAST(date_diff('day', DATE '2001-07-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days_left FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2001-07-01' AND DATE '2001-07-31'")
def f3(spark, folder):
    return filters.expiring(load(spark, folder, "orders"), "o_orderdate", "2001-07-01", 30).select("o_orderkey", "days_left")


@query("f4_stale", "SELECT c_custkey, last_order FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE last_order IS NULL OR CAST(last_order AS DATE) < DATE '2001-03-01'")
def f4(spark, folder):
    last = load(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_order"))
    return filters.stale(load(spark, folder, "customer").join(last, "c_custkey", "left"), "last_order", "2001-07-01", 122).select("c_custkey", "last_order")


@query(
    "f5_config_audit",
    """SELECT 'part' AS kind, CAST(p_partkey AS VARCHAR) AS entity, 'oversized' AS issue, 'high' AS severity FROM part WHERE p_size > 45
    UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), 'promo priced high', 'low' FROM part WHERE p_type = 'PROMO' AND p_retailprice > 1000
    UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), 'untagged', 'info' FROM part WHERE p_brand = 'Brand#1'""",
)
def f5(spark, folder):
    rules = [("oversized", "high", "p_size > 45"), ("promo priced high", "low", "p_type = 'PROMO' AND p_retailprice > 1000"), ("untagged", "info", "p_brand = 'Brand#1'")]
    return filters.config_audit(load(spark, folder, "part"), "part", "p_partkey", rules)


@query("f6_aggregates_only", "SELECT c_nationkey, c_mktsegment, count(*) AS n, round(CAST(sum(CAST(c_acctbal AS DECIMAL(18,6))) AS DOUBLE) / count(*), 4) AS mean_balance FROM customer GROUP BY ALL HAVING count(*) >= 12")
def f6(spark, folder):
    return filters.aggregates_only(load(spark, folder, "customer"), ["c_nationkey", "c_mktsegment"], [F.round(exact_sum(F.col("c_acctbal")) / F.count("*"), 4).alias("mean_balance")], 12)


@query(
    "f7_redact",
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '[0-9a-f]{32,}', '[token]', 'g'),
    '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}', '[ip]', 'g') AS text FROM documents""",
)
def f7(spark, folder):
    return filters.redact(load(spark, folder, "documents").select("doc_id", "text"), "text")


@query(
    "f8_forensic_slice",
    """SELECT * FROM (SELECT 'commit' AS source, user_id AS actor, ts, event_type AS what FROM events WHERE event_type = 'signup'
    UNION ALL SELECT 'reflog', user_id, ts, event_type FROM events WHERE event_type = 'error') WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' AND actor IN (1, 2, 3, 5, 8, 13, 21)""",
)
def f8(spark, folder):
    e = load(spark, folder, "events").withColumnsRenamed({"user_id": "actor", "event_type": "what"})
    sources = [e.where(f"what = '{k}'").select(F.lit(s).alias("source"), "actor", "ts", "what") for s, k in (("commit", "signup"), ("reflog", "error"))]
    return filters.forensic_slice(sources, datetime(2024, 1, 10), datetime(2024, 1, 12), [1, 2, 3, 5, 8, 13, 21])


@query("f9_pattern_gate", "SELECT event_id, event_type AS pattern, CASE WHEN event_type IN ('error', 'click') THEN 'propose retry' ELSE 'escalate' END AS action FROM events")
def f9(spark, folder):
    found = load(spark, folder, "events").select("event_id", F.col("event_type").alias("pattern"))
    return filters.pattern_gate(found, spark.createDataFrame([("error",), ("click",)], "pattern string"))
