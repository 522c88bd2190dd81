"""Data quality, contracts, drift (Q)."""

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import exact_sum
from ..operators import graph, quality, schemas, text
from ..sources.tables import RUNS_SQL, load, runs
from .registry import query
from .scans import FRONT_SQL, JSON_SQL, field_sql, headed, json_findings

_NUMERIC = """SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS "distinct", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev, round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 4) AS median FROM customer"""
_TEXT = """SELECT '{c}', count(*), count(*) - count({c}), count(DISTINCT {c}), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM customer"""
PROFILE_SQL = " UNION ALL ".join((_NUMERIC if c in ("c_custkey", "c_nationkey", "c_acctbal") else _TEXT).format(c=c) for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))


@query("q1_profile", PROFILE_SQL)
def q1(spark, folder):
    return quality.profile(load(spark, folder, "customer"), exact=True).drop("min", "max")


@query("q1_profile_extremes", """SELECT 'o_orderstatus' AS "column", min(o_orderstatus) AS min, max(o_orderstatus) AS max FROM orders UNION ALL SELECT 'o_orderpriority', min(o_orderpriority), max(o_orderpriority) FROM orders""")
def q1_extremes(spark, folder):
    return quality.profile(load(spark, folder, "orders").select("o_orderstatus", "o_orderpriority")).select("column", "min", "max")


@query(
    "q2_null_check",
    """WITH w AS (SELECT avg(CASE WHEN last_ok IS NULL THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN ts IS NULL THEN 1.0 ELSE 0.0 END) AS b FROM (SELECT ts, CASE WHEN event_type <> 'error' THEN ts END AS last_ok FROM events))
    SELECT 'last_ok' AS "column", round(CAST(a AS DOUBLE), 6) AS ratio, a <= 0.1 AS passed FROM w UNION ALL SELECT 'ts', round(CAST(b AS DOUBLE), 6), b <= 0.1 FROM w""",
)
def q2(spark, folder):
    rows = load(spark, folder, "events").select("ts", F.when(F.col("event_type") != "error", F.col("ts")).alias("last_ok"))
    return quality.null_check(rows, ["last_ok", "ts"], 0.1)


@query("q3_duplicate_check", "SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) - 1 AS surplus FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q3(spark, folder):
    return quality.duplicate_check(load(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("q4_freshness", "SELECT user_id, max(ts) AS newest, round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) / 3600000000.0, 4) AS age_hours, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) / 3600000000.0 > 12 AS breach FROM events GROUP BY 1")
def q4(spark, folder):
    return quality.freshness(load(spark, folder, "events"), "ts", ["user_id"], datetime(2024, 1, 31), 12)


def daily(spark, folder):
    return load(spark, folder, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(exact_sum(F.col("value")).alias("total"))


DAILY_SQL = "daily AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total FROM events GROUP BY ALL)"


@query(
    "q5_anomalies",
    f"""WITH {DAILY_SQL}, b AS (SELECT *, avg(total) OVER w AS base, stddev_samp(total) OVER w AS spread FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
    SELECT event_type, day, round(round((total - base) / nullif(spread, 0), 4), 3) AS score FROM b WHERE abs(round((total - base) / nullif(spread, 0), 4)) > 2""",
)
def q5(spark, folder):
    return quality.anomalies(daily(spark, folder), ["event_type"], "day", "total", k=2.0).select("event_type", "day", F.round("score", 3).alias("score"))


@query(
    "q5_anomalies_mad",
    f"""WITH {DAILY_SQL}, c AS (SELECT event_type, median(total) AS base FROM daily GROUP BY 1), n AS (SELECT d.*, base FROM daily d JOIN c USING (event_type)),
    s AS (SELECT event_type, median(abs(total - base)) * 1.4826 AS spread FROM n GROUP BY 1)
    SELECT event_type, day, round(round((total - base) / spread, 4), 3) AS score FROM n JOIN s USING (event_type) WHERE abs(round((total - base) / spread, 4)) > 1.5""",
)
def q5_mad(spark, folder):
    return quality.anomalies(daily(spark, folder), ["event_type"], "day", "total", k=1.5, method="mad").select("event_type", "day", F.round("score", 3).alias("score"))


@query(
    "q6_validate_contract",
    """SELECT 'type:l_orderkey' AS rule, 0 AS failing, true AS passed UNION ALL SELECT 'type:l_tax', 1, false
    UNION ALL SELECT 'required:l_shipdate', count(*) FILTER (l_shipdate IS NULL), count(*) FILTER (l_shipdate IS NULL) = 0 FROM lineitem
    UNION ALL SELECT 'allowed:l_returnflag', count(*) FILTER (l_returnflag NOT IN ('A', 'R')), count(*) FILTER (l_returnflag NOT IN ('A', 'R')) = 0 FROM lineitem
    UNION ALL SELECT 'range:l_discount', count(*) FILTER (l_discount NOT BETWEEN 0 AND 0.05), count(*) FILTER (l_discount NOT BETWEEN 0 AND 0.05) = 0 FROM lineitem
    UNION ALL SELECT 'unique:l_orderkey,l_linenumber', CAST(sum(n - 1) AS BIGINT), sum(n - 1) = 0 FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
    UNION ALL SELECT 'reference:l_orderkey', count(*), count(*) = 0 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""",
)
def q6(spark, folder):
    contract = {
        "types": {"l_orderkey": "bigint", "l_tax": "decimal(10,2)"},
        "required": ["l_shipdate"],
        "allowed": {"l_returnflag": ("A", "R")},
        "ranges": {"l_discount": (0.0, 0.05)},
        "unique": [["l_orderkey", "l_linenumber"]],
        "references": {"l_orderkey": ("orders", "o_orderkey")},
    }
    return quality.validate_contract(load(spark, folder, "lineitem"), contract, {"orders": load(spark, folder, "orders")})


@query("q6_reference_fails", "SELECT 'reference:doc_id' AS rule, count(*) AS failing, count(*) = 0 AS passed FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q6_reference(spark, folder):
    return quality.validate_contract(load(spark, folder, "documents"), {"references": {"doc_id": ("labels", "doc_id")}}, {"labels": load(spark, folder, "labels")})


@query(
    "q7_required_keys",
    f"""WITH {FRONT_SQL}, k AS (SELECT *, {field_sql('risk')} AS risk, {field_sql('loop-tier')} AS tier, list_transform(fields, lambda x: trim(split_part(x, ':', 1))) AS keys FROM front),
    m AS (SELECT *, list_filter(list_sort({list(text.REQUIRED_KEYS)}), lambda x: NOT list_contains(keys, x)) AS missing FROM k),
    p AS (SELECT doc_id, unnest([CASE WHEN last IS NULL THEN 'no frontmatter' END, CASE WHEN last IS NOT NULL AND len(missing) > 0 THEN 'missing: ' || array_to_string(missing, ', ') END,
        CASE WHEN NOT list_contains({list(text.RISKS)}, risk) THEN 'risk: ' || risk END, CASE WHEN NOT list_contains({list(text.TIERS)}, tier) THEN 'loop-tier: ' || tier END]) AS problem FROM m)
    SELECT doc_id, problem FROM p WHERE problem IS NOT NULL""",
)
def q7(spark, folder):
    return text.required_keys(headed(spark, folder), "doc_id", "text")


@query(
    "q8_check_findings",
    f"""WITH {JSON_SQL}, f AS (SELECT doc_id, path, json_keys(text, place) AS keys, json_extract(text, place || '.evidence') AS evidence FROM objects),
    m AS (SELECT *, list_filter({list(text.FINDING_KEYS)}, lambda x: NOT list_contains(keys, x)) AS missing FROM f WHERE list_contains(keys, 'issue') OR list_contains(keys, 'recommendation')),
    p AS (SELECT doc_id, path, CASE WHEN len(missing) > 0 THEN 'missing: ' || array_to_string(missing, ', ') WHEN CAST(evidence AS VARCHAR) IN ('null', 'false', '0', '""', '[]', '{{}}') THEN 'empty evidence' END AS problem FROM m)
    SELECT doc_id, path, problem FROM p WHERE problem IS NOT NULL UNION ALL SELECT doc_id, 'root', 'malformed' FROM made WHERE NOT json_valid(text)""",
)
def q8(spark, folder):
    return text.check_findings(json_findings(spark, folder), "doc_id", "text")


@query(
    "q9_propose_rules",
    f"""WITH p AS ({PROFILE_SQL}) SELECT "column", unnest(list_filter([CASE WHEN nulls = 0 THEN 'not_null' END, CASE WHEN "distinct" = rows THEN 'unique' END,
        CASE WHEN mean IS NOT NULL THEN 'range' END, CASE WHEN "distinct" <= 20 THEN 'enum' END], lambda x: x IS NOT NULL)) AS rule FROM p""",
)
def q9(spark, folder):
    return quality.propose_rules(quality.profile(load(spark, folder, "customer"), exact=True))


@query(
    "q10_remediate",
    """WITH d AS (SELECT sum(n - 1) AS surplus FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)), k AS (SELECT count(*) FILTER (l_tax = 0) AS nulls FROM lineitem)
    SELECT 1 AS attempt, 'fill' AS fix, CAST(surplus + nulls AS BIGINT) AS failing_before, CAST(surplus AS BIGINT) AS failing_after, 'retry' AS outcome FROM d, k
    UNION ALL SELECT 2, 'deduplicate', CAST(surplus AS BIGINT), 0, 'fixed' FROM d""",
)
def q10(spark, folder):
    rows = load(spark, folder, "lineitem").withColumn("l_tax", F.when(F.col("l_tax") != 0, F.col("l_tax")))
    return quality.remediate(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey"], {"l_tax": 0.0})[1]


_SNAPSHOT = "SELECT p_brand AS table_name, string_split(p_name, ' ')[1] AS column_name, min(p_type) AS {t} FROM part WHERE p_partkey % 2 = {k} GROUP BY 1, 2"


@query(
    "q11_schema_diff",
    f"""WITH a AS ({_SNAPSHOT.format(t="old_type", k=0)}), b AS ({_SNAPSHOT.format(t="new_type", k=1)}),
    j AS (SELECT *, CASE WHEN old_type IS NULL THEN 'added' WHEN new_type IS NULL THEN 'dropped' WHEN old_type <> new_type THEN 'retyped' END AS change FROM a FULL JOIN b USING (table_name, column_name))
    SELECT *, 'ALTER TABLE ' || table_name || CASE change WHEN 'added' THEN ' ADD COLUMN ' || column_name || ' ' || new_type WHEN 'dropped' THEN ' DROP COLUMN ' || column_name ELSE ' ALTER COLUMN ' || column_name || ' TYPE ' || new_type END AS statement
    FROM j WHERE change IS NOT NULL""",
)
def q11(spark, folder):
    """Two catalog snapshots made of the parts: brand as table, first word of the name as column, type as data type."""
    parts = load(spark, folder, "part")

    def snapshot(k):
        rows = parts.where(F.col("p_partkey") % 2 == k)
        return rows.groupBy(F.col("p_brand").alias("table_name"), F.split("p_name", " ")[0].alias("column_name")).agg(F.min("p_type").alias("data_type"))

    return quality.schema_diff(snapshot(0), snapshot(1))


@query(
    "q11_converge",
    """WITH s AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'prod' ELSE 'qa' END AS env, p_brand AS table_name, string_split(p_name, ' ')[1] AS column_name, CASE min(p_size) % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'bigint' WHEN 2 THEN 'decimal(12,2)' ELSE 'double' END AS data_type, min(p_partkey) % 2 = 0 AS nullable FROM part WHERE p_size > 5 GROUP BY 1, 2, 3),
    h AS (SELECT table_name, count(DISTINCT env) AS homes FROM s GROUP BY 1),
    t AS (SELECT table_name, column_name, count(*) AS n, bool_or(nullable) AS lax, CASE WHEN count(DISTINCT data_type) = 1 THEN min(data_type) WHEN bool_or(data_type = 'double') THEN 'double' WHEN NOT bool_or(data_type LIKE 'dec%') THEN 'bigint' WHEN bool_or(data_type = 'bigint') THEN 'decimal(21,2)' ELSE 'decimal(12,2)' END AS data_type FROM s GROUP BY 1, 2),
    e AS (SELECT unnest(['dev', 'prod', 'qa']) AS env, table_name, column_name, t.data_type, lax OR n < homes AS nullable FROM t JOIN h USING (table_name)),
    c AS (SELECT e.env, e.table_name, e.column_name, e.data_type, e.nullable, CASE WHEN NOT EXISTS (SELECT 1 FROM s x WHERE x.env = e.env AND x.table_name = e.table_name) THEN 'create' WHEN s.env IS NULL THEN 'add' ELSE concat_ws(',', CASE WHEN s.data_type <> e.data_type THEN 'retype' END, CASE WHEN e.nullable AND NOT s.nullable THEN 'relax' END) END AS change
        FROM e LEFT JOIN s ON s.env = e.env AND s.table_name = e.table_name AND s.column_name = e.column_name)
    SELECT * FROM c WHERE change <> ''""",
)
def q11_converge(spark, folder):
    """Three snapshots made of the parts, by the remainder of the key; types by size."""
    size = F.min("p_size") % 4
    kind = F.when(size == 0, "int").when(size == 1, "bigint").when(size == 2, "decimal(12,2)").otherwise("double")
    env = F.when(F.col("p_partkey") % 3 == 0, "dev").when(F.col("p_partkey") % 3 == 1, "prod").otherwise("qa")
    rows = load(spark, folder, "part").where("p_size > 5").groupBy(env.alias("env"), F.col("p_brand").alias("table_name"), F.split("p_name", " ")[0].alias("column_name"))
    return schemas.changes(rows.agg(kind.alias("data_type"), (F.min("p_partkey") % 2 == 0).alias("nullable")), ["dev", "prod", "qa"])


@query(
    "q12_drift",
    """WITH s AS (SELECT year(l_shipdate) AS y, CASE WHEN l_extendedprice < 0 THEN 0 WHEN l_extendedprice >= 100000 THEN 11 ELSE CAST(floor(l_extendedprice / 10000.0) AS INTEGER) + 1 END AS bin FROM lineitem),
    c AS (SELECT bin, count(*) FILTER (y = 1996) AS b, count(*) FILTER (y = 2000) AS k FROM s WHERE y IN (1996, 2000) GROUP BY 1),
    w AS (SELECT greatest(b, 0.5) / sum(b) OVER () AS p, greatest(k, 0.5) / sum(k) OVER () AS q, abs(sum(b) OVER (ORDER BY bin) / sum(b) OVER () - sum(k) OVER (ORDER BY bin) / sum(k) OVER ()) AS gap FROM c)
    SELECT 'l_extendedprice' AS "column", round(sum((q - p) * ln(q / p)), 6) AS psi, round(max(gap), 6) AS ks FROM w""",
)
def q12(spark, folder):
    rows = load(spark, folder, "lineitem")
    return quality.drift(rows.where("year(l_shipdate) = 1996"), rows.where("year(l_shipdate) = 2000"), ["l_extendedprice"], {"l_extendedprice": (0.0, 100000.0)})


@query("q13_histogram", "SELECT CAST(CASE WHEN l_quantity < 0 THEN 0 WHEN l_quantity >= 50 THEN 11 ELSE floor(l_quantity / 5.0) + 1 END AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def q13(spark, folder):
    from ..operators.aggregates import histogram_counts

    return histogram_counts(load(spark, folder, "lineitem"), "l_quantity", 0, 50, 10)


@query("q13_topk", "SELECT l_partkey AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def q13_topk(spark, folder):
    return quality.top_values(load(spark, folder, "lineitem"), "l_partkey", 10)


PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), ("ip", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), ("token", r"[0-9a-f]{40}"))


@query(
    "q14_classify_sensitivity",
    " UNION ALL ".join(f"SELECT '{n}' AS tag, count(*) AS rows, CAST(sum(m) AS BIGINT) AS matches FROM (SELECT len(regexp_extract_all(text, '{p}')) AS m FROM documents) WHERE m > 0 HAVING count(*) > 0" for n, p in PATTERNS),
)
def q14(spark, folder):
    return quality.classify_sensitivity(load(spark, folder, "documents"), "text", PATTERNS)


@query("q14_coverage_gaps", f"SELECT 'ip' AS tag FROM documents WHERE regexp_matches(text, '{PATTERNS[1][1]}') LIMIT 1")
def q14_gaps(spark, folder):
    framework = spark.createDataFrame([("email",), ("token",)], "tag string")
    return quality.coverage_gaps(quality.classify_sensitivity(load(spark, folder, "documents"), "text", PATTERNS).select("tag"), framework)


@query("q15_regressions", "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'regressed' ELSE 'fixed' END AS change FROM labels WHERE (quality = 1) <> (toxic = 0) AND doc_id % 7 <> 0 UNION ALL SELECT doc_id, 'lost' FROM labels WHERE doc_id % 7 = 0")
def q15(spark, folder):
    rows = load(spark, folder, "labels")
    return quality.regressions(rows.select("doc_id", (F.col("quality") == 1).alias("ok")), rows.where("doc_id % 7 <> 0").select("doc_id", (F.col("toxic") == 0).alias("ok")), "doc_id", "ok")


@query(
    "q16_trace_failed_tests",
    """SELECT 'unique:l_orderkey,l_linenumber' AS rule, s AS source, CAST(d AS INTEGER) AS depth FROM (VALUES ('lineitem', 0), ('orders', 1), ('customer', 2), ('nation', 3), ('region', 4)) t(s, d)""",
)
def q16(spark, folder):
    """Failing rules of the line items, walked up the lineage of the tables."""
    failing = quality.validate_contract(load(spark, folder, "lineitem"), {"required": ["l_tax"], "unique": [["l_orderkey", "l_linenumber"]]}).where("NOT passed")
    edges = spark.createDataFrame([("region", "nation"), ("nation", "customer"), ("customer", "orders"), ("orders", "lineitem"), ("part", "mart")], "src string, dst string")
    up = graph.reach(edges, failing.select(F.lit("lineitem").alias("node")).distinct(), "up")
    return failing.select("rule", F.lit("lineitem").alias("seed")).join(up, "seed").select("rule", F.col("node").alias("source"), "depth")


@query(
    "q16_failing_upstream",
    """WITH RECURSIVE rules AS (SELECT 'lineitem' AS t, 'unique:l_orderkey,l_linenumber' AS rule, (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS failing
        UNION ALL SELECT 'orders', 'allowed:o_orderstatus', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'P'))
        UNION ALL SELECT 'customer', 'range:c_acctbal', (SELECT count(*) FROM customer WHERE c_acctbal NOT BETWEEN 0 AND 1e9)
        UNION ALL SELECT 'nation', 'required:n_name', (SELECT count(*) FROM nation WHERE n_name IS NULL)
        UNION ALL SELECT 'part', 'range:p_size', (SELECT count(*) FROM part WHERE p_size NOT BETWEEN 1 AND 40)),
    bad AS (SELECT * FROM rules WHERE failing > 0), e(src, dst) AS (VALUES ('nation', 'customer'), ('customer', 'orders'), ('orders', 'lineitem'), ('part', 'lineitem'), ('region', 'nation')),
    b AS (SELECT * FROM e WHERE src IN (SELECT t FROM bad) AND dst IN (SELECT t FROM bad)),
    r AS (SELECT t AS seed, t AS node, 0 AS depth FROM bad UNION SELECT seed, src, depth + 1 FROM r JOIN b ON node = dst)
    SELECT x.rule, x.failing, node AS root, y.rule AS root_rule, CAST(min(depth) AS INTEGER) AS depth FROM r JOIN bad x ON x.t = seed JOIN bad y ON y.t = node WHERE node NOT IN (SELECT dst FROM b) GROUP BY 1, 2, 3, 4""",
)
def q16_upstream(spark, folder):
    """Every table's rules, and failing ones traced over failing tables to where the failure began."""
    contracts = {
        "lineitem": {"unique": [["l_orderkey", "l_linenumber"]]},
        "orders": {"allowed": {"o_orderstatus": ("O", "P")}},
        "customer": {"ranges": {"c_acctbal": (0, 1e9)}},
        "nation": {"required": ["n_name"]},
        "part": {"ranges": {"p_size": (1, 40)}},
    }
    checked = [quality.validate_contract(load(spark, folder, t), c).select(F.lit(t).alias("node"), "rule", "failing") for t, c in contracts.items()]
    edges = spark.createDataFrame([("nation", "customer"), ("customer", "orders"), ("orders", "lineitem"), ("part", "lineitem"), ("region", "nation")], "src string, dst string")
    return quality.trace_to_roots(reduce(DataFrame.unionByName, checked), edges)


@query(
    "q17_opportunities",
    """WITH u AS (SELECT p_partkey, p_retailprice AS score, coalesce(n, 0) AS uses FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)
    SELECT p_partkey, score, uses FROM u WHERE score >= (SELECT quantile_cont(score, 0.75) FROM u) AND uses <= (SELECT quantile_cont(uses, 0.25) FROM u)""",
)
def q17(spark, folder):
    parts = load(spark, folder, "part").select("p_partkey", F.col("p_retailprice").alias("score"))
    uses = load(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("uses"))
    return quality.opportunities(parts, uses, "p_partkey", "score", "uses")


@query(
    "q6_runs_contract",
    f"WITH {RUNS_SQL} SELECT 'allowed:status' AS rule, count(*) FILTER (status NOT IN ('ok', 'failed')) AS failing, count(*) FILTER (status NOT IN ('ok', 'failed')) = 0 AS passed FROM runs",
)
def q6_runs(spark, folder):
    return quality.validate_contract(runs(spark, folder), {"allowed": {"status": ("ok", "failed")}})
