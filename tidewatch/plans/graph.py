"""Graph and lineage (G)."""

from pyspark.sql import functions as F

from ..operators import graph
from ..sources.tables import EDGES_SQL, entity_edges, load
from .registry import query

REACH_SQL = """r AS (SELECT node AS seed, node, 0 AS depth FROM seeds UNION SELECT r.seed, {to}, r.depth + 1 FROM r JOIN edges e ON r.node = e.{by} WHERE r.depth < 20)"""


def seeds(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node string")


@query("g1_reach_down", f"WITH RECURSIVE {EDGES_SQL}, seeds AS (SELECT 'region:1' AS node UNION ALL SELECT 'nation:2'), {REACH_SQL.format(to='e.dst', by='src')} SELECT seed, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1, 2")
def g1(spark, folder):
    return graph.reach(entity_edges(spark, folder), seeds(spark, "region:1", "nation:2"))


@query("g1_reach_up", f"WITH RECURSIVE {EDGES_SQL}, seeds AS (SELECT 'part:7' AS node), {REACH_SQL.format(to='e.src', by='dst')} SELECT seed, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1, 2")
def g1_up(spark, folder):
    return graph.reach(entity_edges(spark, folder), seeds(spark, "part:7"), "up")


CYCLE = [("order:1", "customer:1"), ("part:1", "region:0")]


@query(
    "g1_reach_cycle",
    f"""WITH RECURSIVE base AS (SELECT * FROM ({EDGES_SQL.removeprefix("edges AS ")})), edges AS (SELECT * FROM base UNION ALL VALUES {", ".join(map(str, CYCLE))}), seeds AS (SELECT 'nation:4' AS node),
    r AS (SELECT node FROM seeds UNION SELECT e.dst FROM r JOIN edges e ON r.node = e.src) SELECT node FROM r""",
)
def g1_cycle(spark, folder):
    edges = entity_edges(spark, folder).unionByName(spark.createDataFrame(CYCLE, "src string, dst string"))
    return graph.reach(edges, seeds(spark, "nation:4")).select("node")


@query(
    "g2_impact",
    f"""WITH RECURSIVE {EDGES_SQL}, r AS (SELECT 'region:2' AS node, CAST(1.0 AS DOUBLE) AS effect UNION SELECT e.dst, r.effect * CASE WHEN e.dst LIKE '%7' THEN 0.5 ELSE 0.9 END FROM r JOIN edges e ON r.node = e.src)
    SELECT node, round(max(effect), 6) AS effect FROM r GROUP BY 1""",
)
def g2(spark, folder):
    edges = entity_edges(spark, folder).withColumn("weight", F.when(F.col("dst").endswith("7"), 0.5).otherwise(0.9))
    return graph.impact(edges, seeds(spark, "region:2")).select("node", F.round("effect", 6).alias("effect"))


@query(
    "g2_what_if",
    f"""WITH RECURSIVE {EDGES_SQL}, w AS (SELECT src, dst, CASE WHEN dst LIKE '%7' THEN 0.5 ELSE 0.9 END AS was, CASE WHEN src LIKE 'nation:%' AND dst LIKE '%3' THEN 0.3 WHEN src LIKE 'customer:%' AND dst LIKE '%9' THEN NULL WHEN src LIKE 'customer:%' AND dst LIKE '%7' THEN 0.8 WHEN dst LIKE '%7' THEN 0.5 ELSE 0.9 END AS weight FROM edges),
    a AS (SELECT 'region:2' AS node, CAST(1.0 AS DOUBLE) AS effect UNION SELECT w.dst, a.effect * w.was FROM a JOIN w ON a.node = w.src),
    b AS (SELECT 'region:2' AS node, CAST(1.0 AS DOUBLE) AS effect UNION SELECT w.dst, b.effect * w.weight FROM b JOIN w ON b.node = w.src WHERE weight IS NOT NULL),
    x AS (SELECT node, max(effect) AS before FROM a GROUP BY 1), y AS (SELECT node, max(effect) AS after FROM b GROUP BY 1)
    SELECT node, round(before, 6) AS before, round(after, 6) AS after FROM x FULL JOIN y USING (node) WHERE before IS DISTINCT FROM after""",
)
def g2_what_if(spark, folder):
    """Some customers of a region weaken, orders on 9 go, orders on 7 gain weight: who is hit, and how much."""
    edges = entity_edges(spark, folder).withColumn("weight", F.when(F.col("dst").endswith("7"), 0.5).otherwise(0.9))
    customer = F.col("src").startswith("customer:")
    new = F.when(F.col("src").startswith("nation:") & F.col("dst").endswith("3"), 0.3).when(customer & F.col("dst").endswith("7"), 0.8)
    changed = edges.where((F.col("src").startswith("nation:") & F.col("dst").endswith("3")) | (customer & (F.col("dst").endswith("9") | F.col("dst").endswith("7")))).withColumn("weight", new)
    start = seeds(spark, "region:2")
    moved = graph.what_if(edges, start, graph.impact(edges, start), changed)
    return moved.where("NOT before <=> after").select("node", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


STATUS_SQL = """status AS (SELECT 'customer:' || c_custkey AS node, c_acctbal < 0 AS failing FROM customer UNION ALL SELECT 'order:' || o_orderkey, o_orderstatus = 'F' FROM orders UNION ALL SELECT 'nation:' || n_nationkey, n_nationkey % 3 = 0 FROM nation)"""


def status(spark, folder):
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")).alias("node")
    parts = [
        load(spark, folder, "customer").select(key("customer", "c_custkey"), (F.col("c_acctbal") < 0).alias("failing")),
        load(spark, folder, "orders").select(key("order", "o_orderkey"), (F.col("o_orderstatus") == "F").alias("failing")),
        load(spark, folder, "nation").select(key("nation", "n_nationkey"), (F.col("n_nationkey") % 3 == 0).alias("failing")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


ROOT_SQL = f"""WITH RECURSIVE {EDGES_SQL}, {STATUS_SQL}, bad AS (SELECT DISTINCT node FROM status WHERE failing), b AS (SELECT src, dst FROM edges WHERE src IN (FROM bad) AND dst IN (FROM bad)),
    r AS (SELECT node AS seed, node, 0 AS depth FROM bad UNION SELECT r.seed, b.src, r.depth + 1 FROM r JOIN b ON r.node = b.dst)
    SELECT seed AS node, node AS root, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE node NOT IN (SELECT dst FROM b) GROUP BY 1, 2"""


@query("g3_root_failure", ROOT_SQL)
def g3(spark, folder):
    return graph.root_failure(entity_edges(spark, folder), status(spark, folder))


DURATION_SQL = """durations AS (SELECT node, CAST(length(node) AS DOUBLE) AS duration FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges))"""


def durations(edges):
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return nodes.select("node", F.length("node").cast("double").alias("duration"))


@query(
    "g4_critical_path",
    f"""WITH RECURSIVE {EDGES_SQL}, {DURATION_SQL}, r AS (SELECT node, duration AS finish FROM durations UNION SELECT d.node, r.finish + d.duration FROM r JOIN edges e ON r.node = e.src JOIN durations d ON d.node = e.dst)
    SELECT node, max(finish) AS finish FROM r GROUP BY 1""",
)
def g4(spark, folder):
    edges = entity_edges(spark, folder)
    return graph.critical_path(edges, durations(edges)).select("node", "finish")


@query(
    "g4_slack",
    f"""WITH RECURSIVE {EDGES_SQL}, {DURATION_SQL}, r AS (SELECT node, duration AS finish FROM durations UNION SELECT d.node, r.finish + d.duration FROM r JOIN edges e ON r.node = e.src JOIN durations d ON d.node = e.dst),
    b AS (SELECT node, duration AS tail FROM durations UNION SELECT d.node, b.tail + d.duration FROM b JOIN edges e ON b.node = e.dst JOIN durations d ON d.node = e.src),
    f AS (SELECT node, max(finish) AS finish FROM r GROUP BY 1), t AS (SELECT node, max(tail) AS tail FROM b GROUP BY 1)
    SELECT f.node, finish, (SELECT max(finish) FROM f) - (finish + tail - duration) AS slack FROM f JOIN t USING (node) JOIN durations USING (node)""",
)
def g4_slack(spark, folder):
    edges = entity_edges(spark, folder)
    return graph.slack(edges, durations(edges))


@query(
    "g5_redundant_edges",
    f"""WITH {EDGES_SQL} SELECT DISTINCT 'nation:' || c_nationkey AS src, 'order:' || o_orderkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def g5(spark, folder):
    """Shortcuts from nations to orders are added to the lineage; they are what the customers' edges imply."""
    orders = load(spark, folder, "orders").join(load(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    shortcuts = orders.select(F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("src"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("dst"))
    return graph.redundant_edges(entity_edges(spark, folder).unionByName(shortcuts))


@query(
    "g5_needless_order",
    """SELECT 'customer:' || o.o_custkey AS src, 'order:' || n.o_orderkey AS dst FROM orders o JOIN orders n ON n.o_orderkey = o.o_orderkey + 1 GROUP BY 1, 2 HAVING bool_and(n.o_custkey <> o.o_custkey)""",
)
def g5_order(spark, folder):
    """A customer's order is made to wait for the order before it, whoever gave that: needed only if both are one customer's."""
    orders = load(spark, folder, "orders")
    key = lambda kind, column: F.concat(F.lit(f"{kind}:"), column.cast("string"))
    after = orders.select((F.col("o_orderkey") + 1).alias("next"), "o_custkey").join(orders.select(F.col("o_orderkey").alias("next")), "next")
    waits = after.select(key("customer", F.col("o_custkey")).alias("src"), key("order", F.col("next")).alias("dst"))
    return graph.needless_order(waits, entity_edges(spark, folder).where("src LIKE 'customer:%'"))


@query(
    "g6_levels",
    f"""WITH RECURSIVE {EDGES_SQL}, r AS (SELECT src AS node, 0 AS level FROM edges WHERE src NOT IN (SELECT dst FROM edges) UNION SELECT e.dst, r.level + 1 FROM r JOIN edges e ON r.node = e.src)
    SELECT node, CAST(max(level) AS INTEGER) AS level FROM r GROUP BY 1""",
)
def g6(spark, folder):
    return graph.levels(entity_edges(spark, folder))


@query(
    "g7_affected",
    f"""WITH RECURSIVE {EDGES_SQL}, s AS (SELECT DISTINCT 'nation:' || n_nationkey AS node FROM nation WHERE n_nationkey IN (3, 4)),
    r AS (SELECT node, 0 AS depth FROM s UNION SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON r.node = e.src) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1""",
)
def g7(spark, folder):
    packages = load(spark, folder, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("node"), F.concat(F.lit("src/"), F.lower("n_name")).alias("prefix"))
    files = spark.createDataFrame([("src/nation_3/a.sql",), ("src/nation_4/b/c.sql",), ("docs/nation_5/x.md",)], "path string")
    return graph.affected(entity_edges(spark, folder), packages, files)


@query(
    "g8_freshness_chain",
    f"""WITH RECURSIVE {EDGES_SQL}, {STATUS_SQL}, ends AS (SELECT 'order:' || o_orderkey AS node FROM orders),
    r AS (SELECT node AS seed, node, 0 AS depth FROM ends UNION SELECT r.seed, e.src, r.depth + 1 FROM r JOIN edges e ON r.node = e.dst), m AS (SELECT seed, node, min(depth) AS depth FROM r GROUP BY 1, 2)
    SELECT seed, arg_max(m.node, (depth, m.node)) AS node, CAST(max(depth) AS INTEGER) AS depth FROM m JOIN status s ON m.node = s.node AND failing GROUP BY 1""",
)
def g8(spark, folder):
    ends = load(spark, folder, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("node"))
    return graph.freshness_chain(entity_edges(spark, folder), status(spark, folder).withColumnRenamed("failing", "stale"), ends)
