"""Aggregations (A)."""

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import partials, splits
from ..sources.scratch import work_folder
from ..sources.tables import RUNS_SQL, USAGE_SQL, load, runs, usage
from .registry import query
from .text import SIGNATURE_SQL

HEALTH_SQL = f"""WITH {RUNS_SQL}, k AS (SELECT job, kind, count(*) AS n FROM runs GROUP BY ALL), t AS (SELECT job, arg_min(kind, (-n, kind)) AS top_kind FROM k GROUP BY 1)
    SELECT r.job, count(*) AS runs, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'ok') AS ok, max(ts) FILTER (status = 'failed') AS last_failure,
        any_value(top_kind) AS top_kind, round(sum(duration_s), 2) AS total_s, round(count(*) FILTER (status = 'failed') / count(*), 6) AS failure_rate
    FROM runs r JOIN t ON r.job = t.job GROUP BY 1"""


@query("health_summary", HEALTH_SQL)
@query("a3_health_summary", HEALTH_SQL)
def a3(spark, folder):
    return agg.health_summary(runs(spark, folder), ["job"])


@query("a1_cost_rollup", f"WITH {USAGE_SQL} SELECT service, tag, CAST(grouping_id(service, tag) AS BIGINT) AS level, CAST(sum(cost) AS DOUBLE) AS cost, count(*) AS n FROM usage GROUP BY ROLLUP (service, tag)")
def a1(spark, folder):
    return agg.cost_rollup(usage(spark, folder), ["service", "tag"])


@query("a1_cost_cube", f"WITH {USAGE_SQL} SELECT service, tag, CAST(grouping_id(service, tag) AS BIGINT) AS level, CAST(sum(cost) AS DOUBLE) AS cost, count(*) AS n FROM usage GROUP BY CUBE (service, tag)")
def a1_cube(spark, folder):
    return agg.cost_rollup(usage(spark, folder), ["service", "tag"], "cube")


@query(
    "a2_utilization",
    """SELECT user_id, round(sum(value), 4) AS busy, round(median(value), 4) AS median_run, round(sum(value) / 43200.0, 6) AS share, CASE WHEN sum(value) / 43200.0 < 0.05 THEN 'idle' WHEN sum(value) / 43200.0 > 0.08 THEN 'hot' ELSE 'normal' END AS "class" FROM events GROUP BY 1""",
)
def a2(spark, folder):
    out = agg.utilization(load(spark, folder, "events"), "user_id", "value", 43200.0, 0.05, 0.08)
    return out.select("user_id", F.round("busy", 4).alias("busy"), F.round("median_run", 4).alias("median_run"), F.round("share", 6).alias("share"), "class")


@query(
    "a4_error_rates",
    f"""WITH {RUNS_SQL} SELECT kind, date_trunc('day', ts) AS start, count(*) AS n, count(*) FILTER (status = 'failed') AS errors, count(*) FILTER (duration_s > 100) AS slow, round(count(*) FILTER (status = 'failed') / count(*), 6) AS error_rate FROM runs GROUP BY 1, 2""",
)
def a4(spark, folder):
    return agg.error_rates(runs(spark, folder), "kind")


@query(
    "a5_sla_report",
    f"""WITH {RUNS_SQL} SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n, count(*) FILTER (duration_s > 60) AS misses, round(quantile_cont(duration_s, 0.5), 6) AS p50, round(quantile_cont(duration_s, 0.95), 6) AS p95, max(duration_s) AS slowest FROM runs GROUP BY 1""",
)
def a5(spark, folder):
    return agg.sla_report(runs(spark, folder), 60)


@query("a6_usage_stats", "SELECT event_type, count(*) AS uses, count(DISTINCT user_id) AS actors, max(ts) AS last_used FROM events GROUP BY 1")
def a6(spark, folder):
    return agg.usage_stats(load(spark, folder, "events"), "event_type", "user_id")


@query("a6_usage_sketches", "SELECT event_type, CAST(sum(uses) AS BIGINT) AS uses, true AS near FROM (SELECT event_type, count(*) AS uses FROM events GROUP BY 1) GROUP BY 1")
def a6_sketches(spark, folder):
    """Daily sketches merged per type; within 5 % of the exact count."""
    merged = agg.usage_sketches(load(spark, folder, "events"), "event_type", "user_id").groupBy("event_type").agg(F.sum("uses").alias("uses"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"))
    exact = load(spark, folder, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("actors"))
    return merged.join(exact, "event_type").select("event_type", "uses", (F.abs(F.col("about") - F.col("actors")) <= 0.05 * F.col("actors")).alias("near"))


def run_days(spark, folder):
    """Partials of the runs by day and kind, kept by day; the queries ask for January 10 to 24."""
    path = work_folder(spark, "run-days")
    partials.keep_days(partials.day_partials(runs(spark, folder), "ts", ["kind"], ["duration_s"], ["job"], {"misses": F.col("duration_s") > 60}), path)
    return partials.kept_days(spark, path, *DAYS)


DAYS = ("2024-01-10", "2024-01-24")
DAYS_SQL = f"{RUNS_SQL}, r AS (SELECT *, CAST(ts AS DATE) AS day FROM runs WHERE CAST(ts AS DATE) BETWEEN DATE '{DAYS[0]}' AND DATE '{DAYS[1]}')"


@query(
    "a5_sla_from_days",
    f"""WITH {DAYS_SQL} SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n, count(*) FILTER (duration_s > 60) AS misses, round(quantile_cont(duration_s, 0.5), 6) AS p50, round(quantile_cont(duration_s, 0.95), 6) AS p95, max(duration_s) AS slowest FROM r GROUP BY 1""",
)
def a5_from_days(spark, folder):
    rows = runs(spark, folder).where(F.to_date("ts").between(*[F.lit(d).cast("date") for d in DAYS]))
    return partials.sla_report(run_days(spark, folder), rows, "ts", "duration_s", "misses")


@query(
    "a6_usage_from_days",
    f"""WITH {DAYS_SQL} SELECT kind, count(*) AS uses, max(ts) AS last_used, true AS near FROM r GROUP BY 1""",
)
def a6_from_days(spark, folder):
    """Uses and users of a range of days from partials; the users within 5 % of the exact count."""
    about = partials.summary(run_days(spark, folder), ["kind"])
    exact = runs(spark, folder).where(F.to_date("ts").between(*[F.lit(d).cast("date") for d in DAYS])).groupBy("kind").agg(F.count_distinct("job").alias("jobs"))
    return about.join(exact, "kind").select("kind", F.col("n").alias("uses"), F.col("last").alias("last_used"), (F.abs(F.col("job_distinct") - F.col("jobs")) <= 0.05 * F.col("jobs")).alias("near"))


@query(
    "q1_profile_from_days",
    f"""WITH {DAYS_SQL} SELECT kind, count(*) AS n, count(duration_s) AS "values", count(*) - count(duration_s) AS nulls, round(CAST(sum(CAST(duration_s AS DECIMAL(28,6))) AS DOUBLE) / count(duration_s), 6) AS mean, min(duration_s) AS low, max(duration_s) AS high, true AS median_near FROM r GROUP BY 1""",
)
def q1_from_days(spark, folder):
    """Profile of a range of days from partials; the share of values up to the sketched median lies within 0.02 of a half."""
    about = partials.summary(run_days(spark, folder), ["kind"], {"median": 0.5})
    rows = runs(spark, folder).where(F.to_date("ts").between(*[F.lit(d).cast("date") for d in DAYS])).alias("r")
    upto = rows.join(about.select(F.col("kind").alias("k"), "duration_s_median"), F.col("kind") == F.col("k")).groupBy("kind").agg(F.avg((F.col("duration_s") <= F.col("duration_s_median")).cast("double")).alias("upto"))
    out = about.join(upto, "kind")
    return out.select("kind", "n", F.col("duration_s_values").alias("values"), F.col("duration_s_nulls").alias("nulls"), F.round("duration_s_mean", 6).alias("mean"), F.col("duration_s_min").alias("low"), F.col("duration_s_max").alias("high"), F.col("upto").between(0.48, 0.52).alias("median_near"))


@query("a7_chargeback", f"WITH {USAGE_SQL}, k AS (SELECT resource, sum(cost) AS cost FROM usage GROUP BY 1) SELECT resource, CAST(cost AS DOUBLE) AS cost, round(CAST(cost AS DOUBLE) / CAST((SELECT sum(cost) FROM k) AS DOUBLE), 8) AS share FROM k")
def a7(spark, folder):
    return agg.chargeback(usage(spark, folder), "resource")


@query(
    "a8_dora",
    """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS deploys, round(median((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3600000000.0), 4) AS lead_hours, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS failure_rate
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def a8(spark, folder):
    commits = load(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"))
    deploys = load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("ts"), (F.col("l_returnflag") == "R").alias("failed"))
    return agg.dora(commits, deploys)


@query(
    "a8_dora_repair",
    """WITH d AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS deploys, round(median((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3600000000.0), 4) AS lead_hours, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS failure_rate
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
    i AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS incidents, round(avg((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3600000000.0), 4) AS repair_hours FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT month, deploys, lead_hours, failure_rate, coalesce(incidents, 0) AS incidents, repair_hours FROM d LEFT JOIN i USING (month)""",
)
def a8_repair(spark, folder):
    commits = load(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"))
    lines = load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("ts"), (F.col("l_returnflag") == "R").alias("failed"))
    incidents = lines.where("failed").join(commits.withColumnRenamed("ts", "opened"), "id").select("opened", F.col("ts").alias("resolved"))
    return agg.dora_with_repair(commits, lines, incidents)


@query(
    "a9_dismissal_rates",
    """WITH f AS (SELECT doc_id, 'license' AS rule FROM documents WHERE contains(lower(text), 'license') UNION ALL SELECT doc_id, 'shout' FROM documents WHERE contains(text, '!!'))
    SELECT rule, count(*) AS judged, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS dismissed FROM f JOIN labels USING (doc_id) GROUP BY 1""",
)
def a9(spark, folder):
    docs = load(spark, folder, "documents")
    found = docs.where(F.contains(F.lower("text"), F.lit("license"))).select("doc_id", F.lit("license").alias("rule")).unionByName(docs.where(F.contains("text", F.lit("!!"))).select("doc_id", F.lit("shout").alias("rule")))
    return agg.dismissal_rates(found, load(spark, folder, "labels").select("doc_id", (F.col("quality") == 1).alias("dismissed")), "rule", "doc_id")


@query(
    "a10_effectiveness",
    """WITH c AS (SELECT CASE WHEN contains(text, '!!') THEN 'bad' ELSE 'good' END AS p, CASE WHEN quality = 0 THEN 'bad' ELSE 'good' END AS a FROM documents JOIN labels USING (doc_id)),
    k AS (SELECT unnest(['bad', 'good']) AS category), s AS (SELECT category, count(*) FILTER (p = category) AS predicted, count(*) FILTER (a = category) AS actual, count(*) FILTER (p = category AND a = category) AS hits FROM c, k GROUP BY 1)
    SELECT *, round(hits / predicted, 6) AS precision, round(hits / actual, 6) AS recall, round(hits / predicted, 6) < 0.5 AS stale FROM s WHERE predicted + actual > 0""",
)
def a10(spark, folder):
    both = load(spark, folder, "documents").join(load(spark, folder, "labels"), "doc_id")
    cases = both.select(F.when(F.contains("text", F.lit("!!")), "bad").otherwise("good").alias("predicted"), F.when(F.col("quality") == 0, "bad").otherwise("good").alias("actual"))
    return agg.effectiveness(cases)


@query(
    "a11_scorecard",
    """WITH s AS (SELECT 'nation:' || c_nationkey AS entity, avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END) AS funded, avg(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0 ELSE 0.0 END) AS machinery, min(c_acctbal) < -990 AS blocked FROM customer GROUP BY 1)
    SELECT entity, round((3 * funded + machinery) / 4.0, 6) AS score, blocked, NOT blocked AND (3 * funded + machinery) / 4.0 >= 0.5 AS go FROM s""",
)
def a11(spark, folder):
    rows = load(spark, folder, "customer").withColumn("entity", F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")))
    signal = lambda name, test, blocker: rows.groupBy("entity").agg(F.lit(name).alias("signal"), F.avg(F.when(F.expr(test), 1.0).otherwise(0.0)).alias("score"), blocker.alias("blocker"))
    both = signal("funded", "c_acctbal > 0", F.min("c_acctbal") < -990).unionByName(signal("machinery", "c_mktsegment = 'MACHINERY'", F.lit(False)))
    return agg.scorecard(both, {"funded": 3.0, "machinery": 1.0})


@query(
    "a12_repeated_queries",
    f"""WITH t AS (SELECT {SIGNATURE_SQL.format(c="text")} AS template, n_chars FROM documents)
    SELECT md5(template) AS template, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS cost FROM t GROUP BY 1 HAVING count(*) >= 2""",
)
def a12(spark, folder):
    return agg.repeated_queries(load(spark, folder, "documents"), "text", "n_chars").withColumn("template", F.md5("template"))


@query(
    "a13_filter_usage",
    """SELECT "column", count(*) AS n, sum(w) AS weight, round(avg(w), 6) AS mean_weight FROM (SELECT unnest(list_concat(string_split(p_name, ' '), [p_type])) AS "column", CAST(p_size AS DOUBLE) AS w FROM part) GROUP BY 1""",
)
def a13(spark, folder):
    history = load(spark, folder, "part").select(F.concat(F.split("p_name", " "), F.array("p_type")).alias("columns"), "p_size")
    return agg.filter_usage(history, "columns", "p_size")


@query(
    "a14_merge_recommendations",
    """WITH r AS (SELECT s_suppkey AS entity, 'resize' AS action, round(s_acctbal * 0.2, 2) AS saving FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT l_suppkey, 'suspend', CAST(count(*) AS DOUBLE) FROM lineitem GROUP BY 1)
    SELECT *, CAST(row_number() OVER (ORDER BY saving DESC, entity) AS INTEGER) AS rank FROM (SELECT entity, arg_max(action, (saving, action)) AS action, max(saving) AS saving FROM r GROUP BY 1)""",
)
def a14(spark, folder):
    a = load(spark, folder, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("entity"), F.lit("resize").alias("action"), F.round(F.col("s_acctbal") * 0.2, 2).alias("saving"))
    b = load(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("entity")).agg(F.lit("suspend").alias("action"), F.count("*").cast("double").alias("saving"))
    return agg.merge_recommendations(a, b)


@query(
    "a15_size_buckets",
    """WITH t AS (SELECT l_orderkey, sum(l_quantity) AS size, count(*) AS parts FROM lineitem GROUP BY 1)
    SELECT CAST((size >= 50)::INT + (size >= 100)::INT + (size >= 200)::INT AS INTEGER) AS "class", count(*) AS changes, sum(size) AS size, max(parts) AS most_parts FROM t GROUP BY 1""",
)
def a15(spark, folder):
    return agg.size_buckets(load(spark, folder, "lineitem"), "l_orderkey", "l_quantity", (50, 100, 200))


@query(
    "a15_split_parts",
    """WITH f AS (SELECT l_orderkey AS change, l_returnflag AS d, l_returnflag || '/' || l_partkey AS node, CAST(sum(l_quantity) AS DECIMAL(28,6)) AS size, 1 AS files FROM lineitem GROUP BY 1, 2, 3),
    a AS (SELECT *, sum(size) OVER (PARTITION BY change, d ORDER BY size, node ROWS UNBOUNDED PRECEDING) <= 60 AS fits FROM f),
    g AS (SELECT change, d AS node, sum(size) AS size, count(*) AS files FROM a WHERE fits GROUP BY 1, 2),
    b AS (SELECT *, sum(size) OVER (PARTITION BY change ORDER BY size, node ROWS UNBOUNDED PRECEDING) <= 60 AS fits FROM g),
    p AS (SELECT change, node, size, files FROM a WHERE NOT fits UNION ALL SELECT change, node, size, files FROM b WHERE NOT fits UNION ALL SELECT change, '', sum(size), sum(files) FROM b WHERE fits GROUP BY 1)
    SELECT change, node AS root, CAST(files AS BIGINT) AS files, CAST(size AS DOUBLE) AS size, size > 60 AS oversized FROM p""",
)
def a15_split(spark, folder):
    """Orders as changes, their parts as files below the return flag; parts of 60 pieces at most."""
    lines = load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("change"), F.concat_ws("/", "l_returnflag", F.col("l_partkey").cast("string")).alias("path"), "l_quantity")
    return splits.split_parts(lines, "change", "path", "l_quantity", 60)


@query(
    "a16_before_after",
    """WITH m AS (SELECT o_orderpriority, median(o_totalprice) FILTER (CAST(o_orderdate AS DATE) < DATE '1998-01-01') AS b, median(o_totalprice) FILTER (CAST(o_orderdate AS DATE) >= DATE '1998-01-01') AS a FROM orders GROUP BY 1)
    SELECT o_orderpriority, round(b, 4) AS before, round(a, 4) AS after, round(1 - a / b, 6) AS saved FROM m""",
)
def a16(spark, folder):
    timed = load(spark, folder, "orders").withColumn("phase", F.when(F.col("o_orderdate").cast("date") < "1998-01-01", "before").otherwise("after"))
    out = agg.before_after(timed, "o_orderpriority", "phase", "o_totalprice")
    return out


@query(
    "a17_changelog",
    r"""WITH m AS (SELECT lang AS release, CASE doc_id % 4 WHEN 0 THEN 'feat(core): ' || n_chars WHEN 1 THEN 'fix!: ' || source WHEN 2 THEN 'docs: x' ELSE string_split(text, chr(10))[1] END AS msg FROM documents),
    p AS (SELECT release, regexp_extract(msg, '^([a-z]+)(?:\(([a-z0-9_-]+)\))?(!)?: (.+)$', 1) AS t, regexp_extract(msg, '^([a-z]+)(?:\(([a-z0-9_-]+)\))?(!)?: (.+)$', 2) AS s, regexp_extract(msg, '^([a-z]+)(?:\(([a-z0-9_-]+)\))?(!)?: (.+)$', 3) AS b FROM m)
    SELECT release, CASE WHEN t = '' THEN 'invalid' ELSE t END AS type, s AS scope, count(*) AS n, count(*) FILTER (b = '!') AS breaking FROM p GROUP BY 1, 2, 3""",
)
def a17(spark, folder):
    docs = load(spark, folder, "documents")
    kind = F.col("doc_id") % 4
    msg = F.when(kind == 0, F.concat(F.lit("feat(core): "), F.col("n_chars").cast("string"))).when(kind == 1, F.concat(F.lit("fix!: "), F.col("source"))).when(kind == 2, "docs: x").otherwise(F.split("text", "\n")[0])
    return agg.changelog(docs.select(F.col("lang").alias("release"), msg.alias("msg")), "msg", "release")


@query(
    "a17_invalid_messages",
    r"""WITH m AS (SELECT lang AS release, doc_id, string_split(CASE doc_id % 5 WHEN 0 THEN 'Fix: ' || source WHEN 1 THEN 'feat(Core): ' || n_chars WHEN 2 THEN 'docs: x' WHEN 3 THEN 'feat(a b): ' || source ELSE coalesce(text, '') END, chr(10))[1] AS line FROM documents)
    SELECT release, doc_id, md5(line) AS line, CASE WHEN trim(line, ' ') = '' THEN 'empty' WHEN NOT contains(line, ': ') THEN 'no type' WHEN regexp_matches(lower(line), '^([a-z]+)(?:\(([a-z0-9_-]+)\))?(!)?: (.+)$') THEN 'capitals in the type'
        WHEN contains(regexp_extract(line, '^([^:]*): ', 1), '(') THEN 'malformed scope' ELSE 'malformed type' END AS problem FROM m WHERE NOT regexp_matches(line, '^([a-z]+)(?:\(([a-z0-9_-]+)\))?(!)?: (.+)$')""",
)
def a17_invalid(spark, folder):
    """First lines of documents as messages, some of them made; each invalid one with its problem."""
    docs, kind = load(spark, folder, "documents"), F.col("doc_id") % 5
    msg = F.when(kind == 0, F.concat(F.lit("Fix: "), F.col("source"))).when(kind == 1, F.concat(F.lit("feat(Core): "), F.col("n_chars").cast("string"))).when(kind == 2, "docs: x").when(kind == 3, F.concat(F.lit("feat(a b): "), F.col("source"))).otherwise(F.col("text"))
    out = agg.invalid_messages(docs.select(F.col("lang").alias("release"), "doc_id", msg.alias("msg")), "msg", "release", "doc_id")
    return out.withColumn("line", F.md5("line"))


@query(
    "a18_flow_anomalies",
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(DISTINCT event_type) AS peers, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS volume FROM events GROUP BY 1, 2),
    w AS (SELECT *, CAST(sum(CAST(volume AS DECIMAL(18,6))) OVER (PARTITION BY user_id) AS DOUBLE) / count(*) OVER (PARTITION BY user_id) AS m FROM d)
    SELECT user_id, day, peers, round(volume, 4) AS volume, round(m, 6) AS mean_volume FROM w WHERE peers >= 5 OR volume > 3 * m""",
)
def a18(spark, folder):
    return agg.flow_anomalies(load(spark, folder, "events"), "user_id", "event_type", "value", 5, 3.0)


@query(
    "a18_flow_surges",
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(count(DISTINCT event_type) AS DOUBLE) AS peers, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS volume FROM events GROUP BY 1, 2),
    l AS (SELECT user_id, day, unnest(['peers', 'volume']) AS what, unnest([peers, volume]) AS value FROM d),
    b AS (SELECT *, avg(value) OVER w AS base, stddev_samp(value) OVER w AS spread FROM l WINDOW w AS (PARTITION BY user_id, what ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
    SELECT user_id, day, what, round(value, 4) AS value, round(base, 4) AS base FROM b WHERE abs(round((value - base) / nullif(spread, 0), 4)) > 3""",
)
def a18_surges(spark, folder):
    out = agg.flow_surges(load(spark, folder, "events"), "user_id", "event_type", "value")
    return out.select("user_id", "day", "what", F.round("value", 4).alias("value"), F.round("base", 4).alias("base"))


@query(
    "a19_storage_retention",
    """WITH r AS (SELECT l_partkey % 50 AS k, max(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS need FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT p_partkey AS k, CAST(p_size * 5 AS INTEGER) AS kept_days, p_retailprice / 1000 AS cost_per_day, CAST(coalesce(need, 0) AS INTEGER) AS needed_days, round(greatest(0, p_size * 5 - coalesce(need, 0)) * (p_retailprice / 1000), 4) AS saving FROM part LEFT JOIN r ON p_partkey = k""",
)
def a19(spark, folder):
    lines = load(spark, folder, "lineitem").where("l_returnflag = 'R'").join(load(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    restores = lines.select((F.col("l_partkey") % 50).alias("k"), F.datediff("l_shipdate", "o_orderdate").alias("age_days"))
    tables = load(spark, folder, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 5).alias("kept_days"), (F.col("p_retailprice") / 1000).alias("cost_per_day"))
    return agg.storage_retention(tables, restores, "k")


@query(
    "a20_job_skew",
    """WITH k AS (SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT l_returnflag, count(*) AS tasks, CAST(max(n) AS DOUBLE) AS largest, median(n) AS median, CAST(sum(n) AS DOUBLE) AS total, max(n) > 1.3 * median(n) AS skewed FROM k GROUP BY 1""",
)
def a20(spark, folder):
    tasks = load(spark, folder, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n"))
    return agg.job_skew(tasks, "l_returnflag", "n", 1.3)
