"""Text, logs and JSON (L)."""

from pyspark.sql import functions as F

from ..operators import text
from ..sources.tables import load
from ..sources.text import explode_lines
from .registry import query
from .scans import FRONT_SQL, headed

LINES_SQL = """lines AS (SELECT doc_id, i AS line_no, a[i] AS line FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i
    FROM (SELECT doc_id, CASE WHEN a[len(a)] = '' THEN a[1:len(a)-1] ELSE a END AS a FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))))"""
#: RE2 has no look-ahead and a match takes its separators along, so neighbours need the hex rule twice.
SIGNATURE_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '"[^"]*"', '<str>', 'g'), '(^|[^\p{{L}}\p{{N}}_])[0-9a-f]{{16,}}($|[^\p{{L}}\p{{N}}_])', '\1<hex>\2', 'g'), '(^|[^\p{{L}}\p{{N}}_])[0-9a-f]{{16,}}($|[^\p{{L}}\p{{N}}_])', '\1<hex>\2', 'g'), '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+', '<ip>', 'g'), '[0-9]+', '<n>', 'g')"""


def lines(spark, folder):
    return explode_lines(load(spark, folder, "documents"), "doc_id", "text")


@query("l1_signature", f"WITH {LINES_SQL} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, {SIGNATURE_SQL.format(c='line')} AS signature FROM lines WHERE regexp_matches(line, '[0-9]')")
def l1(spark, folder):
    return lines(spark, folder).where(F.col("line").rlike("[0-9]")).select("doc_id", "line_no", text.signature(F.col("line")).alias("signature"))


@query(
    "l2_prefilter_log",
    f"""WITH {LINES_SQL}, m AS (SELECT *, regexp_matches(line, '###') AS noise, min(line_no) FILTER (contains(line, '!!')) OVER (PARTITION BY doc_id) AS start, count(*) OVER (PARTITION BY doc_id) AS total FROM lines),
    b AS (SELECT * FROM m WHERE NOT noise AND line_no >= start QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) <= 5)
    SELECT doc_id, count(*) AS kept, CAST(min(line_no) AS INTEGER) AS first_line, CAST(max(line_no) AS INTEGER) AS last_line, any_value(total) - count(*) AS suppressed FROM b GROUP BY 1""",
)
def l2(spark, folder):
    return text.prefilter_log(lines(spark, folder), "doc_id", "###", "!!", 5).drop("noise")


@query(
    "l2_log_context",
    f"""WITH {LINES_SQL}, m AS (SELECT *, regexp_matches(line, '###') AS noise, min(line_no) FILTER (contains(line, '!!')) OVER w AS start, count(*) OVER w AS total, count(*) FILTER (regexp_matches(line, '###')) OVER w AS noisy FROM lines WINDOW w AS (PARTITION BY doc_id)),
    b AS (SELECT * FROM m WHERE NOT noise AND line_no >= start - 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) <= 5)
    SELECT doc_id, count(*) AS kept, CAST(min(line_no) AS INTEGER) AS first_line, CAST(max(line_no) AS INTEGER) AS last_line, any_value(total) - count(*) AS suppressed, any_value(noisy) AS noise FROM b GROUP BY 1""",
)
def l2_context(spark, folder):
    return text.prefilter_log(lines(spark, folder), "doc_id", "###", "!!", 5, 2)


CAUSES = [("credentials", "token = "), ("shouting", "!!"), ("license", "(?i)license"), ("symbols", "[#$%&]{3}")]


@query(
    "l3_root_cause",
    "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in CAUSES) + " ELSE 'unknown' END AS category FROM documents WHERE text <> ''",
)
def l3(spark, folder):
    return text.root_cause(lines(spark, folder), "doc_id", CAUSES)


@query(
    "l4_error_diff",
    """WITH c AS (SELECT 'error <n> of user <n>: ' || CASE WHEN value > 60 THEN 'slow' ELSE 'fast' END || ' k' || chr(97 + CAST(user_id % 26 AS INTEGER)) AS signature, ts >= TIMESTAMP '2024-01-30' AS late FROM events WHERE event_type = 'error'),
    g AS (SELECT signature, count(*) FILTER (NOT late) AS before, count(*) FILTER (late) AS after FROM c GROUP BY 1)
    SELECT *, CASE WHEN before = 0 THEN 'new' WHEN after = 0 THEN 'gone' WHEN after > before THEN 'grown' ELSE 'shrunk' END AS change FROM g WHERE before <> after""",
)
def l4(spark, folder):
    return text.error_diff(errors(spark, folder), F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz"))


def errors(spark, folder):
    rows = load(spark, folder, "events").where("event_type = 'error'")
    line = F.concat(F.lit("Error "), F.col("event_id").cast("string"), F.lit(" of user "), F.col("user_id").cast("string"), F.lit(": "), F.when(F.col("value") > 60, "slow").otherwise("fast"), F.lit(" k"), F.char((F.col("user_id") % 26 + 97).cast("int")))
    return rows.withColumn("line", line)


@query(
    "l4_error_diff_day",
    """WITH c AS (SELECT 'error <n> of user <n>: ' || CASE WHEN value > 60 THEN 'slow' ELSE 'fast' END || ' k' || chr(97 + CAST(user_id % 26 AS INTEGER)) AS signature, ts >= TIMESTAMP '2024-01-30' AS late FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-29'),
    g AS (SELECT signature, count(*) FILTER (NOT late) AS before, count(*) FILTER (late) AS after FROM c GROUP BY 1)
    SELECT *, CASE WHEN before = 0 THEN 'new' WHEN after = 0 THEN 'gone' WHEN after > before THEN 'grown' ELSE 'shrunk' END AS change FROM g WHERE before <> after""",
)
def l4_day(spark, folder):
    """The last day against the day before it."""
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    return text.error_diff(errors(spark, folder), F.col("ts") >= at("2024-01-30"), horizon=F.col("ts") >= at("2024-01-29"))


RULES_SQL = ", ".join(f"('{r.rule_id}', '{r.pattern}', {r.each}, '{r.exempt}')" for r in text.PORTABILITY)


@query(
    "l5_lint_corpus",
    f"""WITH {FRONT_SQL}, b AS (SELECT doc_id, coalesce(last, 0) AS before, ls[coalesce(last, 0) + 1:] AS body FROM front),
    n AS (SELECT doc_id, before + unnest(range(1, len(body) + 1)) AS line_no, unnest(body) AS line FROM b), r(rule_id, pattern, each, exempt) AS (VALUES {RULES_SQL}),
    h AS (SELECT n.*, r.rule_id, CASE WHEN exempt <> '' AND regexp_matches(line, exempt) THEN 0 WHEN each THEN len(regexp_extract_all(line, pattern)) ELSE 1 END AS times FROM n, r WHERE regexp_matches(line, pattern))
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, rule_id, trim(line)[1:{text.SNIPPET}] AS snippet FROM (SELECT *, unnest(range(times)) AS i FROM h)""",
)
def l5(spark, folder):
    return text.lint_corpus(headed(spark, folder), "doc_id", "text")


@query(
    "l6_secrets_scan",
    f"""WITH {LINES_SQL} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, rule_id, s[1:4] || '****' AS masked, CAST(len(s) AS INTEGER) AS span_length FROM (
    SELECT doc_id, line_no, 'hex-token' AS rule_id, unnest(regexp_extract_all(line, '[0-9a-f]{{40}}')) AS s FROM lines
    UNION ALL SELECT doc_id, line_no, 'assigned-token', unnest(regexp_extract_all(line, '(?i)(?:token|secret|password|api_key) *[=:] *"[^"]{{8,}}"')) FROM lines)""",
)
def l6(spark, folder):
    return text.secrets_scan(load(spark, folder, "documents"), "doc_id", "text")


@query(
    "l7_near_duplicates",
    r"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(t) >= 5 THEN list_transform(list_zip(t[:-5], t[2:-4], t[3:-3], t[4:-2], t[5:]), lambda x: concat_ws(' ', x[1], x[2], x[3], x[4], x[5])) ELSE [array_to_string(t, ' ')] END)) AS s FROM t WHERE len(t) > 0),
    r AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS first, s, len(s) AS n FROM s), u AS (SELECT doc_id, n, unnest(s) AS x FROM r WHERE doc_id = first),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS similarity FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2)
    SELECT a, b, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.8 UNION ALL SELECT first, doc_id, 1.0 FROM r WHERE doc_id <> first""",
)
def l7(spark, folder):
    return text.near_duplicates_of_all(load(spark, folder, "documents"), "doc_id", "text")


@query(
    "l8_complexity",
    r"""WITH c AS (SELECT page_id, html, list_filter(string_split(html, ''), lambda x: x IN ('(', ')', '{', '}', '<', '>')) AS cs FROM pages),
    s AS (SELECT page_id, html, list_transform(cs, lambda x: CASE WHEN x IN ('(', '{', '<') THEN 1 ELSE -1 END) AS d FROM c),
    u AS (SELECT page_id, i, sum(v) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM (SELECT page_id, unnest(d) AS v, unnest(range(1, len(d) + 1)) AS i FROM s)),
    m AS (SELECT page_id, greatest(0, max(depth)) AS depth FROM u GROUP BY 1)
    SELECT p.page_id, CAST(length(html) AS INTEGER) AS length, CAST(coalesce(depth, 0) AS INTEGER) AS depth, CAST(len(regexp_extract_all(html, '[A-Za-z_][A-Za-z0-9_]*\(')) AS INTEGER) AS calls FROM pages p LEFT JOIN m USING (page_id)""",
)
def l8(spark, folder):
    return text.complexity(load(spark, folder, "pages"), "page_id", "html")


@query("l9_attrs", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def l9(spark, folder):
    return text.attrs(load(spark, folder, "events"), "event_id", "props", "k int")
