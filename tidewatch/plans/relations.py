"""Joins and set operations (J, X)."""

from pyspark.sql import functions as F

from ..operators import digests, graph, joins, sets
from ..sources.scratch import work_folder
from ..sources.tables import CHANGES_SQL, INCIDENTS_SQL, changes, incidents, load
from .registry import query


@query(
    "j1_enrich",
    """SELECT n_name, l_returnflag, count(*) AS n, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS price FROM lineitem
    LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""",
)
def j1(spark, folder):
    supplier = load(spark, folder, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    nation = load(spark, folder, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    facts = joins.enrich(joins.enrich(load(spark, folder, "lineitem"), supplier, "l_suppkey"), nation, "s_nationkey")
    return facts.groupBy("n_name", "l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("price"))


@query("j2_orphans", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j2(spark, folder):
    return joins.orphans(load(spark, folder, "documents").select("doc_id", "source"), load(spark, folder, "labels"), "doc_id")


@query("j2_idle_suppliers", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-01-31')")
def j2_idle(spark, folder):
    used = load(spark, folder, "lineitem").where("CAST(l_shipdate AS DATE) BETWEEN '1995-01-01' AND '1995-01-31'").select(F.col("l_suppkey").alias("s_suppkey"))
    return joins.orphans(load(spark, folder, "supplier").select("s_suppkey"), used, "s_suppkey")


@query("j3_referenced", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def j3(spark, folder):
    used = load(spark, folder, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return joins.referenced(load(spark, folder, "part").select("p_partkey"), used, "p_partkey")


@query(
    "j4_snapshot_join",
    """WITH a AS (SELECT o_custkey, max(o_orderstatus) AS status, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1998-01-01' GROUP BY 1),
    b AS (SELECT o_custkey, max(o_orderstatus) AS status, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-01-01' GROUP BY 1),
    j AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.o_custkey IS NULL AS no_a, b.o_custkey IS NULL AS no_b, a.status IS DISTINCT FROM b.status AS s, a.n IS DISTINCT FROM b.n AS c FROM a FULL JOIN b USING (o_custkey))
    SELECT o_custkey, CASE WHEN no_a THEN 'only_right' WHEN no_b THEN 'only_left' ELSE 'changed' END AS state,
        CASE WHEN no_a OR no_b THEN '' ELSE concat_ws(',', CASE WHEN s THEN 'status' END, CASE WHEN c THEN 'n' END) END AS columns FROM j WHERE s OR c""",
)
def j4(spark, folder):
    side = lambda test: load(spark, folder, "orders").where(test).groupBy("o_custkey").agg(F.max("o_orderstatus").alias("status"), F.count("*").alias("n"))
    return joins.snapshot_join(side("CAST(o_orderdate AS DATE) < '1998-01-01'"), side("CAST(o_orderdate AS DATE) >= '1998-01-01'"), ["o_custkey"], ["status", "n"])


@query(
    "j4_drift_by_digest",
    """WITH b AS (SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS status, o_custkey FROM orders WHERE o_orderkey % 1000 <> 7)
    SELECT o.o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'only_left' ELSE 'changed' END AS state, CASE WHEN b.o_orderkey IS NULL THEN '' ELSE 'o_orderstatus' END AS columns
    FROM orders o LEFT JOIN b ON o.o_orderkey = b.o_orderkey WHERE b.o_orderkey IS NULL OR b.status <> o.o_orderstatus""",
)
def j4_by_digest(spark, folder):
    """All orders against a copy in which some are gone and some have another status."""
    base, orders = work_folder(spark, "snapshots"), load(spark, folder, "orders")
    deployed = orders.where("o_orderkey % 1000 <> 7").withColumn("o_orderstatus", F.when(F.col("o_totalprice") > 300000, "X").otherwise(F.col("o_orderstatus")))
    keys, values = ["o_orderkey"], ["o_orderstatus", "o_custkey"]
    for name, df in (("declared", orders), ("deployed", deployed)):
        digests.keep(df, f"{base}/{name}", keys, values, 8, 8)
    return digests.snapshot_join(spark, f"{base}/declared", f"{base}/deployed", keys, values)


@query(
    "j5_correlate",
    f"""WITH {INCIDENTS_SQL}, {CHANGES_SQL}, p AS (SELECT incident_id, i.entity, i.ts AS incident_ts, change_id, c.ts AS change_ts, epoch_us(i.ts) - epoch_us(c.ts) AS gap
        FROM incidents i JOIN changes c ON i.entity = c.entity AND c.ts <= i.ts AND epoch_us(i.ts) - epoch_us(c.ts) <= 21600000000)
    SELECT incident_id, entity, incident_ts, change_id, change_ts, round(gap / 3.6e9, 6) AS hours, CAST(row_number() OVER (PARTITION BY incident_id ORDER BY gap, change_id) AS INTEGER) AS rank FROM p""",
)
def j5(spark, folder):
    return joins.correlate(incidents(spark, folder), changes(spark, folder), "entity", 6)


@query("j6_as_of", f"WITH {INCIDENTS_SQL}, {CHANGES_SQL} SELECT incident_id, i.entity, i.ts, change_id FROM incidents i ASOF LEFT JOIN changes c ON i.entity = c.entity AND i.ts >= c.ts")
def j6(spark, folder):
    return joins.as_of(incidents(spark, folder), changes(spark, folder), "entity", "ts", "change_id")


LINE_RULES = [("license", "(?i)license"), ("token", "[0-9a-f]{40}"), ("shout", "!!"), ("address", "[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+")]


@query(
    "j7_pattern_join",
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule_id, count(*) AS n FROM l WHERE regexp_matches(line, '{p}') GROUP BY 1" for r, p in LINE_RULES),
)
def j7(spark, folder):
    from ..sources.text import explode_lines

    lines = explode_lines(load(spark, folder, "documents"), "doc_id", "text")
    return joins.pattern_join(lines, "line", LINE_RULES).groupBy("doc_id", "rule_id").agg(F.count("*").alias("n"))


RULES_SQL = r"""w AS (SELECT DISTINCT unnest(string_split(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), ' ')) AS word FROM benchmark),
    rules AS (SELECT word AS rule_id, CASE length(word) % 3 WHEN 0 THEN '(?i)' || word || ' [a-z]' WHEN 1 THEN word || '[ ,.]' ELSE word || '(s|ed)?$' END AS pattern,
        CASE WHEN length(word) > 9 THEN 'http' END AS exempt_pattern FROM w WHERE length(word) >= 8)"""


def rule_table(spark, folder):
    """A rule for each word of eight letters or more of the benchmark passages."""
    words = load(spark, folder, "benchmark").select(F.explode(F.split(F.regexp_replace("text", "[^A-Za-z]+", " "), " ")).alias("rule_id")).distinct().where("length(rule_id) >= 8")
    word, shape = F.col("rule_id"), F.length("rule_id") % 3
    pattern = F.when(shape == 0, F.concat(F.lit("(?i)"), word, F.lit(" [a-z]"))).when(shape == 1, F.concat(word, F.lit("[ ,.]"))).otherwise(F.concat(word, F.lit("(s|ed)?$")))
    return words.select("rule_id", pattern.alias("pattern"), F.when(F.length("rule_id") > 9, "http").alias("exempt_pattern"))


@query(
    "j7_rule_table",
    f"""WITH {RULES_SQL}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(string_split(lower(text), chr(10))) AS low FROM documents), k AS (SELECT *, lower(rule_id) AS word FROM rules)
    SELECT DISTINCT doc_id, rule_id FROM l JOIN k ON contains(low, word) AND regexp_matches(line, pattern) AND (exempt_pattern IS NULL OR NOT contains(line, exempt_pattern))""",
)
def j7_table(spark, folder):
    from ..operators.rules import match_rules
    from ..sources.text import explode_lines

    return match_rules(explode_lines(load(spark, folder, "documents"), "doc_id", "text"), "line", rule_table(spark, folder), ["doc_id"])


@query(
    "j8_overlap_pairs",
    """WITH r AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), k AS (SELECT l_partkey FROM r GROUP BY 1 HAVING count(*) <= 40), f AS (SELECT * FROM r JOIN k USING (l_partkey))
    SELECT x.l_orderkey AS a, y.l_orderkey AS b, count(*) AS shared FROM f x JOIN f y ON x.l_partkey = y.l_partkey AND x.l_orderkey < y.l_orderkey GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def j8(spark, folder):
    return joins.overlap_pairs(load(spark, folder, "lineitem"), "l_orderkey", "l_partkey", 2, 40)


@query(
    "j8_all_overlap_pairs",
    """WITH r AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
    SELECT x.l_orderkey AS a, y.l_orderkey AS b, count(*) AS shared FROM r x JOIN r y ON x.l_partkey = y.l_partkey AND x.l_orderkey < y.l_orderkey GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def j8_all(spark, folder):
    return joins.all_overlap_pairs(load(spark, folder, "lineitem"), "l_orderkey", "l_partkey", 2)


@query("j8_hot_items", "SELECT l_partkey, count(DISTINCT l_orderkey) AS groups FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 40")
def j8_hot(spark, folder):
    return joins.hot_items(load(spark, folder, "lineitem"), "l_orderkey", "l_partkey", 40)


@query(
    "j9_advisory_match",
    """WITH d AS (SELECT p_partkey, p_brand AS package, (p_partkey % 3) AS major, p_size AS minor FROM part), a AS (SELECT * FROM (VALUES ('Brand#1', 1, 2, 1, 10), ('Brand#7', 0, 9, 2, 0)) t(package, i1, i2, f1, f2))
    SELECT p_partkey, d.package, major || '.' || minor AS version, f1 || '.' || f2 AS upgrade_to FROM d JOIN a ON d.package = a.package AND (major, minor) >= (i1, i2) AND (major, minor) < (f1, f2)""",
)
def j9(spark, folder):
    deps = load(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("package"), F.concat((F.col("p_partkey") % 3).cast("string"), F.lit("."), F.col("p_size").cast("string")).alias("version"))
    advisories = spark.createDataFrame([("Brand#1", "1.2", "1.10"), ("Brand#7", "0.9", "2.0")], "package string, introduced string, fixed string")
    return joins.advisory_match(deps, advisories).select("p_partkey", "package", "version", "upgrade_to")


ROLES = [("click", "reader"), ("view", "reader"), ("purchase", "writer"), ("writer", "reader"), ("admin", "writer"), ("error", "admin")]
GRANTS = [("reader", "read"), ("writer", "write"), ("admin", "drop")]


@query(
    "j10_effective_access",
    f"""WITH RECURSIVE roles(child, parent) AS (VALUES {", ".join(map(str, ROLES))}), grants(principal, object) AS (VALUES {", ".join(map(str, GRANTS))}),
    e AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS child, event_type AS parent FROM events UNION SELECT * FROM roles),
    r AS (SELECT child AS principal, child AS role FROM e UNION SELECT principal, principal FROM grants UNION SELECT r.principal, e.parent FROM r JOIN e ON r.role = e.child)
    SELECT DISTINCT r.principal, object, r.principal IN ('1', '2') AND object = 'read' AS used FROM r JOIN grants g ON r.role = g.principal""",
)
def j10(spark, folder):
    members = load(spark, folder, "events").select(F.col("user_id").cast("string").alias("child"), F.col("event_type").alias("parent")).distinct()
    edges = members.unionByName(spark.createDataFrame(ROLES, "child string, parent string"))
    access = spark.createDataFrame([("1", "read"), ("2", "read")], "principal string, object string")
    return graph.effective_access(spark.createDataFrame(GRANTS, "principal string, object string"), edges, access)


@query(
    "j11_sla_due",
    "SELECT o_orderkey, o_orderpriority AS kind, o_orderdate AS due, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS rank FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)",
)
def j11(spark, folder):
    hit = load(spark, folder, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    impacted = load(spark, folder, "orders").join(hit, "o_custkey", "left_semi").select("o_orderkey")
    due = load(spark, folder, "orders").select("o_orderkey", F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("due"))
    return joins.sla_due(impacted, due, "o_orderkey")


_WEEK = "SELECT DISTINCT user_id, event_type FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '{}' AND DATE '{}'"


def week(spark, folder, first, last):
    return load(spark, folder, "events").where(f"CAST(ts AS DATE) BETWEEN '{first}' AND '{last}'").select("user_id", "event_type").distinct()


WEEKS = (("2024-01-01", "2024-01-07"), ("2024-01-08", "2024-01-14"))


@query("x1_new_since", f"{_WEEK.format(*WEEKS[1])} EXCEPT {_WEEK.format(*WEEKS[0])}")
def x1(spark, folder):
    return sets.new_since(week(spark, folder, *WEEKS[0]), week(spark, folder, *WEEKS[1]), ["user_id", "event_type"])


@query("x2_resolved_since", f"{_WEEK.format(*WEEKS[0])} EXCEPT {_WEEK.format(*WEEKS[1])}")
def x2(spark, folder):
    return sets.resolved_since(week(spark, folder, *WEEKS[0]), week(spark, folder, *WEEKS[1]), ["user_id", "event_type"])


@query(
    "x3_parity",
    """WITH e AS (SELECT DISTINCT o_custkey, o_orderpriority, CASE o_orderstatus WHEN 'O' THEN 'dev' WHEN 'F' THEN 'prod' ELSE 'test' END AS env FROM orders)
    SELECT o_custkey, o_orderpriority, string_agg(env, ',' ORDER BY env) AS present_in FROM e GROUP BY 1, 2 HAVING count(*) < 3""",
)
def x3(spark, folder):
    orders = load(spark, folder, "orders")
    return sets.parity({e: orders.where(f"o_orderstatus = '{s}'") for e, s in (("dev", "O"), ("prod", "F"), ("test", "P"))}, ["o_custkey", "o_orderpriority"])


@query(
    "x3_parity_by_digest",
    """WITH e AS (SELECT DISTINCT o_custkey, o_orderpriority, CASE o_orderstatus WHEN 'O' THEN 'dev' WHEN 'F' THEN 'prod' ELSE 'test' END AS env FROM orders)
    SELECT o_custkey, o_orderpriority, string_agg(env, ',' ORDER BY env) AS present_in FROM e GROUP BY 1, 2 HAVING count(*) < 3""",
)
def x3_by_digest(spark, folder):
    base, orders, columns = work_folder(spark, "snapshots"), load(spark, folder, "orders"), ["o_custkey", "o_orderpriority"]
    paths = {}
    for e, s in (("dev", "O"), ("prod", "F"), ("test", "P")):
        paths[e] = f"{base}/{e}"
        digests.keep(orders.where(f"o_orderstatus = '{s}'").select(*columns).distinct(), paths[e], columns, [], 8, 8)
    return digests.parity(spark, paths, columns)


@query(
    "x4_merge_findings",
    """SELECT 'runs' AS source, CAST(user_id AS VARCHAR) AS entity, 'failed' AS issue, 'high' AS severity, CAST(NULL AS VARCHAR) AS evidence, CAST(NULL AS VARCHAR) AS recommendation FROM events WHERE event_type = 'error' AND value > 200
    UNION ALL SELECT 'parts', CAST(p_partkey AS VARCHAR), 'oversized', NULL, CAST(p_size AS VARCHAR), 'split' FROM part WHERE p_size > 48""",
)
def x4(spark, folder):
    a = load(spark, folder, "events").where("event_type = 'error' AND value > 200").select(F.lit("runs").alias("source"), F.col("user_id").cast("string").alias("entity"), F.lit("failed").alias("issue"), F.lit("high").alias("severity"))
    b = load(spark, folder, "part").where("p_size > 48").select(F.lit("parts").alias("source"), F.col("p_partkey").cast("string").alias("entity"), F.lit("oversized").alias("issue"), F.col("p_size").cast("string").alias("evidence"), F.lit("split").alias("recommendation"))
    return sets.merge_findings(a, b)
