"""Document checks, text functions and joins on hand-made cases."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import columns
from tidewatch.operators import aggregates, filters, forecast, graph, joins, quality, reports, sets, text, windows
from tidewatch.sources import findings, synth
from tidewatch.sources.text import explode_lines, extract_frontmatter


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


FULL = "---\nname: n\ndescription: d\nrisk: read-only\nloop-tier: on-demand\n---\nbody"


@pytest.mark.parametrize(
    ("body", "front", "start"),
    [
        (FULL, {"name": "n", "description": "d", "risk": "read-only", "loop-tier": "on-demand"}, 7),
        ("no block", None, 1),
        ("---\nname: n\nno end", None, 1),
        (" --- \nname: n\n  ---  \nx", {"name": "n"}, 4),
        ("---\nname: a\nname: b\n---\n", {"name": "b"}, 5),
        ("---\ndescription: a: b:c\n---\n", {"description": "a: b:c"}, 4),
        ("---\njust text\nname: n\n---\n", {"name": "n"}, 5),
        ("---\nname:\n---\n", {"name": ""}, 4),
        ('---\nname: "q"\n---\n', {"name": '"q"'}, 4),
        ("---\r\nname: n\r\n---\r\nx", {"name": "n"}, 4),
        ("---\n\tname\t:\u00a0n\u00a0\n---\n", {"name": "n"}, 4),
        ("---\n---\n", {}, 3),
        ("", None, 1),
        (None, None, 1),
    ],
)
def test_frontmatter(spark, body, front, start):
    row = extract_frontmatter(docs(spark, body), "doc_id", "text").first()
    assert row.frontmatter == front and row.body_start_line == start


@pytest.mark.parametrize("text", ["a\nb", "a\r\nb\rc", "a\n\nb\n", "\n", "", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g\u2028h\u2029i", "x\n\n\n"])
def test_lines(spark, text):
    got = [r.line for r in explode_lines(docs(spark, text), "doc_id", "text").orderBy("line_no").collect()]
    assert got == text.splitlines()


@pytest.mark.parametrize("value", ["  a ", "\t\u00a0a\u2003", "\x1ca\x1f", "", "a b"])
def test_strip(spark, value):
    assert spark.range(1).select(columns.strip(F.lit(value))).first()[0] == value.strip()


@pytest.mark.parametrize(
    ("body", "problems"),
    [
        (FULL, []),
        ("x", ["no frontmatter"]),
        (FULL.replace("name: n\n", ""), ["missing: name"]),
        (FULL.replace("read-only", "high"), ["risk: high"]),
        (FULL.replace("on-demand", "on-demand # note"), ["loop-tier: on-demand # note"]),
        ("---\n---\n", ["missing: description, loop-tier, name, risk"]),
        (FULL.replace("risk: read-only", "risk:"), ["risk: "]),
    ],
)
def test_required_keys(spark, body, problems):
    assert [r.problem for r in text.required_keys(docs(spark, body), "doc_id", "text").collect()] == problems


GOOD = '{"issue":"i","evidence":"e","recommendation":"r","severity":"s"}'


@pytest.mark.parametrize(
    ("json", "problems"),
    [
        (GOOD, []),
        ("{", [("root", "malformed")]),
        ("[]", []),
        ('{"a":1}', []),
        ('{"a":[{"issue":"i","evidence":"","recommendation":"r","severity":"s"}]}', [("root.a[0]", "empty evidence")]),
        *[(GOOD.replace('"e"', e), [("root", "empty evidence")]) for e in ("null", '""', "0", "false", "[]", "{}")],
        (GOOD.replace('"e"', "[0]"), []),
        ('{"recommendation":"r"}', [("root", "missing: evidence, severity")]),
        ('{"issue":1,"severity":2}', [("root", "missing: evidence, recommendation")]),
        ('[{"x":' + GOOD.replace('"s"}', '"s","in":{"issue":1}}') + "}]", [("root[0].x.in", "missing: evidence, recommendation, severity")]),
    ],
)
def test_check_findings(spark, json, problems):
    got = text.check_findings(docs(spark, json), "doc_id", "text").collect()
    assert sorted((r.path, r.problem) for r in got) == sorted(problems)


@pytest.mark.parametrize(
    ("line", "rules"),
    [
        ("use Claude code here", ["assistant-claude-code"]),
        ("an MCP_server and MCP", ["assistant-mcp"]),
        ("the cursor object", []),
        ("the Cursor", ["assistant-cursor"]),
        ("CODEX copilot", ["assistant-codex", "assistant-copilot"]),
        ("call `/two-words` not `/usr/bin/git` or `/one`", ["slash-command"]),
        ("`scripts/a.py` `./scripts/b.py`", ["bare-script-path", "bare-script-path"]),
        ("`{{SKILL_DIR}}/scripts/a.py`", []),
        ("C:\\x", ["drive-letter"]),
        ("C:\\path\\to\\x", []),
        ("C:\\<name>", []),
        ("D:\\x path/to", []),
    ],
)
def test_lint(spark, line, rules):
    got = text.lint_corpus(docs(spark, f"---\nname: Cursor\n---\n{line}"), "doc_id", "text").collect()
    assert sorted(r.rule_id for r in got) == sorted(rules) and all(r.line_no == 4 for r in got)


def test_lint_whole_text_and_snippet(spark):
    got = text.lint_corpus(docs(spark, "---\nCursor, no end", "  Cursor " + "x" * 200), "doc_id", "text").orderBy("doc_id").collect()
    assert [r.line_no for r in got] == [2, 1] and len(got[1].snippet) == 120 and got[1].snippet.startswith("Cursor")


def test_as_of_ties_and_correlation(spark):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    left = spark.createDataFrame([(1, "a", t(5)), (2, "a", t(0)), (3, "b", t(1))], "incident_id long, entity string, ts timestamp_ntz")
    right = spark.createDataFrame([(7, "a", t(5)), (8, "a", t(2)), (9, "c", t(0))], "change_id long, entity string, ts timestamp_ntz")
    assert {r.incident_id: r.change_id for r in joins.as_of(left, right, "entity", "ts", "change_id").collect()} == {1: 7, 2: None, 3: None}
    assert [(r.incident_id, r.change_id, r.rank) for r in joins.correlate(left, right, "entity", 3).orderBy("rank").collect()] == [(1, 7, 1), (1, 8, 2)]


@pytest.mark.parametrize("seed", range(3))
def test_correlation_is_the_naive_join(spark, seed):
    rng = random.Random(seed)
    t = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(6000))
    left = [(i, rng.randrange(5), t()) for i in range(150)]
    right = [(i, rng.randrange(5), t()) for i in range(150)]
    got = joins.correlate(spark.createDataFrame(left, "incident_id long, entity long, ts timestamp_ntz"), spark.createDataFrame(right, "change_id long, entity long, ts timestamp_ntz"), "entity", 7)
    want = {(i, c) for i, e, a in left for c, f, b in right if e == f and dt.timedelta(0) <= a - b <= dt.timedelta(hours=7)}
    assert {(r.incident_id, r.change_id) for r in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("least", [1, 2, 3])
def test_all_overlap_pairs(spark, least):
    """Two items in nearly all of 60 groups, more than the limit of 40, and some rare ones."""
    rng = random.Random(least)
    groups = {g: {i for i in (1, 2) if rng.random() < 0.8} | {rng.randrange(10, 60) for _ in range(rng.randrange(5))} for g in range(60)}
    rows = [(g, i) for g, of in groups.items() for i in of] * 2 + [(1, None), (None, 1), (None, 2)]
    got = joins.all_overlap_pairs(spark.createDataFrame(rows, "g long, i long"), "g", "i", least).collect()
    want = {(a, b): n for a in groups for b in groups if a < b and (n := len(groups[a] & groups[b])) >= least}
    assert {(r.a, r.b): r.shared for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("least,small", [(2, 32), (3, 32), (2, 3), (3, 3)])
def test_overlap_pairs_meet_where_they_share(spark, least, small):
    """An item in all groups makes no pairs by itself; groups of more than ``small`` items meet by single items. Sharing is counted whole."""
    rng = random.Random(small)
    groups = {g: {0} | {rng.randrange(1, 40) for _ in range(rng.randrange(6))} for g in range(80)}
    df = spark.createDataFrame([(g, i) for g, of in groups.items() for i in of] * 2, "g long, i long")
    got = joins._sharing(df, least, small)
    want = {(a, b): n for a in groups for b in groups if a < b and (n := len(groups[a] & groups[b])) >= least}
    assert {(r.a, r.b): r.shared for r in got.collect()} == want and want


def test_utilization_adds_exactly(spark):
    """0.1 and 0.2 in any order, with 0.3, are 0.6; as doubles they are 0.6000000000000001, over the limit."""
    for values in ((0.1, 0.2, 0.3), (0.3, 0.2, 0.1)):
        df = spark.createDataFrame([("a", v) for v in values], "resource string, busy double").coalesce(1)
        row = aggregates.utilization(df, "resource", "busy", 1.0, 0.1, 0.6).first()
        assert (row.busy, row["class"]) == (0.6, "normal")


@pytest.mark.parametrize("seed", range(3))
def test_graphs_with_cycles(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)})
    e = spark.createDataFrame(edges, "src string, dst string")
    depth, frontier = {"n0": 0}, ["n0"]
    for d in range(1, 40):
        frontier = sorted({b for a, b in edges if a in frontier} - set(depth))
        depth |= dict.fromkeys(frontier, d)
    assert {r.node: r.depth for r in graph.reach(e, spark.createDataFrame([("n0",)], "node string")).collect()} == depth


def test_long_chains_are_walked_to_the_end(spark):
    """A chain of 56 edges, past the 50 rounds of before, and guards that fail instead of leaving nodes out."""
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 0.5) for i in range(56)], "src string, dst string, weight double").coalesce(1)
    seed = spark.createDataFrame([("n0",)], "node string")
    assert {r.node: r.depth for r in graph.reach(e, seed).collect()} == {f"n{i}": i for i in range(57)}
    assert {r.node: r.effect for r in graph.impact(e, seed).collect()} == {f"n{i}": 0.5**i for i in range(57)}
    for late in (lambda: graph.reach(e, seed, max_depth=3), lambda: graph.impact(e, seed, 3), lambda: graph.levels(e, 3), lambda: graph.critical_path(e, seed.withColumn("duration", F.lit(1.0)).unionByName(e.select(F.col("dst").alias("node"), F.lit(1.0).alias("duration"))), 3)):
        with pytest.raises(RuntimeError, match="not done"):
            late()


def test_json_is_walked_to_the_end(spark):
    rows = docs(spark, '{"a":' * 9 + '{"issue":1}' + "}" * 9, "[" * 8 + '{"b":{}}' + "]" * 8)
    got = {(r.doc_id, r.path) for r in findings.walk_json(findings.parse_findings(rows, "doc_id", "text"), "doc_id").collect()}
    assert got == {(0, "root" + ".a" * i) for i in range(10)} | {(1, "root" + "[0]" * 8), (1, "root" + "[0]" * 8 + ".b")}
    assert [(r.path, r.problem) for r in text.check_findings(rows, "doc_id", "text").collect()] == [("root" + ".a" * 9, "missing: evidence, recommendation, severity")]
    with pytest.raises(RuntimeError, match="deeper than 3"):
        findings.walk_json(findings.parse_findings(rows, "doc_id", "text"), "doc_id", 3)


def test_levels_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z")], "src string, dst string")
    assert {r.node: r.level for r in graph.levels(e).collect()} == {"a": 0, "b": 1, "c": 2, "x": None, "y": None, "z": None}
    assert [tuple(r) for r in graph.redundant_edges(e.where("src IN ('a', 'b')")).collect()] == [("a", "c")]


def test_redundant_edges_query_takes_the_whole_graph(spark, monkeypatch):
    from tidewatch.plans import graph as plans

    taken = []
    monkeypatch.setattr(plans.graph, "redundant_edges", lambda edges: taken.append(edges) or edges)
    plans.g5(spark, "/root/testdata/sf0.001")
    kinds = {tuple(r) for r in taken[0].select(F.split_part("src", F.lit(":"), F.lit(1)), F.split_part("dst", F.lit(":"), F.lit(1))).distinct().collect()}
    assert {("region", "nation"), ("order", "part"), ("nation", "order")} <= kinds


@pytest.mark.parametrize("seed", range(2))
def test_concurrency_two_ways(spark, seed):
    rng = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(seconds=(s := rng.randrange(5000))), t0 + dt.timedelta(seconds=s + rng.randrange(1, 900))) for _ in range(200)]
    df = spark.createDataFrame(rows, "r long, a timestamp_ntz, b timestamp_ntz")
    points = sorted({x for _, a, b in rows for x in (a, b)})
    peak = max(sum(a <= p < b for _, a, b in rows) for p in points)
    assert windows.concurrency(df, "r", "a", "b").first().peak == peak == windows.concurrency_by_bucket(df, "a", "b", 300_000_000).first().peak


def test_synth_is_the_same_under_repartition(spark):
    spec = {"a": ("int", 1, 5), "b": ("null", 0.3, ("double", 0.0, 1.0)), "c": ("choice", ("x", "y"))}
    a = sorted(map(str, synth.synth(spark, spec, 500, 3).collect()))
    assert a == sorted(map(str, synth.synth(spark, spec, 500, 3).repartition(7).collect()))
    assert synth.synth(spark, spec, 500, 3).where("b IS NULL").count() > 50
    with pytest.raises(ValueError):
        synth.synth(spark, {"a": ("what",)}, 1)


def test_near_duplicates_have_no_false_pair(spark):
    rng = random.Random(1)
    base = [" ".join(f"w{rng.randrange(200)}" for _ in range(60)) for _ in range(20)]
    rows = docs(spark, *base, *[b.replace(b.split()[3], "changed", 1) for b in base[:10]], base[0], "", None)
    got = {(r.a, r.b): r.similarity for r in text.near_duplicates(rows, "doc_id", "text").collect()}

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    texts = [*base, *[b.replace(b.split()[3], "changed", 1) for b in base[:10]]]
    for (a, b), s in got.items():
        x, y = shingles(texts[a]), shingles(texts[b])
        assert s == pytest.approx(len(x & y) / len(x | y), abs=1e-6) and s >= 0.8
    want = {(i, j) for i in range(30) for j in range(i + 1, 30) if (x := shingles(texts[i])) and (y := shingles(texts[j])) and len(x & y) / len(x | y) >= 0.8}
    assert len(set(got) & want) >= 0.9 * len(want)


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_are_all_pairs(spark, seed):
    """Near copies of many degrees, copies that differ in case and a passage in all texts: the same pairs as brute force."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(12)]
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(30, 200))] + passage
        for edits in (0, 0, 1, 1, 2, 3, 4, 6):
            words = base[: len(base) - rng.randrange(4)]
            for _ in range(edits):
                words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    texts += [texts[0].upper(), texts[9].replace(" ", ", "), "two words", "Two words", "one"]
    got = [(r.a, r.b, r.similarity) for r in text.near_duplicates_of_all(docs(spark, *texts), "doc_id", "text").collect()]

    def shingles(t):
        w = t.lower().replace(",", "").split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    sets_, first = [shingles(t) for t in texts], {}
    for i, s in enumerate(sets_):
        first.setdefault(s, i)
    want = [(first[s], i, 1.0) for i, s in enumerate(sets_) if first[s] != i]
    heads = sorted(first.values())
    want += [(i, j, v) for i in heads for j in heads if i < j and (v := len(sets_[i] & sets_[j]) / len(sets_[i] | sets_[j])) >= 0.8]
    assert [(a, b) for a, b, _ in sorted(got)] == [(a, b) for a, b, _ in sorted(want)]
    assert [v for *_, v in sorted(got)] == pytest.approx([v for *_, v in sorted(want)], abs=1e-6)


def test_odd_inputs(spark):
    rows = spark.createDataFrame([(1, None, None), (None, "a", 2.0)], "k long, s string, v double")
    nothing = rows.limit(0)
    for df in (rows, nothing):
        assert quality.profile(df).count() == 3
        assert quality.null_check(df, ["k", "s"], 0.5).count() == 2
        quality.duplicate_check(df, ["k"]).collect()
        filters.redact(df, "s").collect()
        sets.parity({"a": df, "b": df}, ["k", "s"]).collect()
        windows.latest_state(df, "k", "v", "s", ["s"]).collect()
        forecast.fit_lines(df, "s", "v", "v").collect()
        aggregates.chargeback(df.select("k", F.col("v").alias("cost")), "k").collect()
    assert quality.validate_contract(nothing, {"required": ["k"], "unique": [["k"]]}).where("NOT passed").count() == 0


def test_contract_reference_needs_no_nested_loop(spark):
    child, parent = spark.createDataFrame([(1,), (2,), (None,)], "k long"), spark.createDataFrame([(1,)], "id long")
    out = quality.validate_contract(child, {"references": {"k": ("p", "id")}}, {"p": parent})
    assert [(r.failing, r.passed) for r in out.collect()] == [(1, False)]


def test_top_n_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    plan = windows.top_n(df, ["g"], [F.desc("id")], 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_write_and_route(spark, tmp_path):
    rows = spark.createDataFrame([("high", dt.datetime(2024, 1, 1), "a"), ("odd", dt.datetime(2024, 1, 2), "b")], "severity string, detected_at timestamp_ntz, entity string")
    findings.write_findings(rows, f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f").where("severity = 'high'").count() == 1
    routed = findings.route(rows, spark.createDataFrame([("high", "oncall", True)], "severity string, channel string, page boolean"))
    assert {r.entity: (r.channel, r.page) for r in routed.collect()} == {"a": ("oncall", True), "b": ("digest", False)}


def test_schema_diff_of_real_tables(spark):
    a, b = spark.sql("SELECT 1 AS x, 'a' AS y"), spark.sql("SELECT 1L AS x, 2 AS z")
    got = quality.schema_diff(quality.schema_table({"t": a}, "dev"), quality.schema_table({"t": b}, "prod")).collect()
    assert {r.column_name: (r.change, r.statement) for r in got} == {
        "x": ("retyped", "ALTER TABLE t ALTER COLUMN x TYPE bigint"),
        "y": ("dropped", "ALTER TABLE t DROP COLUMN y"),
        "z": ("added", "ALTER TABLE t ADD COLUMN z int"),
    }


def event(rng, i):
    ts = None if rng.random() < 0.05 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.choice([0, 1, 23, 24, 25, 100, 400]), minutes=rng.randrange(3))
    return (rng.choice([1, 1, 1, 2, None]), ts, i, rng.choice([True, False, False, None]), rng.choice([None, 1.0, 2.5, 7.0]))


EVENTS = "k long, ts timestamp_ntz, id long, bad boolean, v double"


def keyed(rows, place=0):
    out = {}
    for r in rows:
        out.setdefault(r[place], []).append(r)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_hot_keys_by_buckets(spark, seed):
    rng = random.Random(seed)
    rows = [event(rng, i) for i in range(80)]
    df = spark.createDataFrame(rows, EVENTS)
    timed = [r for r in rows if r[1] is not None]

    want = []
    for k, own in keyed(timed).items():
        streak = []
        for r in [*sorted(own, key=lambda r: (r[1], r[2])), (k, None, 0, False, None)]:
            if r[3]:
                streak.append(r[1])
            elif streak:
                want.append((k, len(streak), streak[0], streak[-1]))
                streak = []
    got = windows.streaks(df.where("ts IS NOT NULL"), "k", ["ts", "id"], F.col("bad")).select("k", "length", "first", "last").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))

    want = []
    for k, own in keyed(timed).items():
        times = sorted(r[1] for r in own)
        want += [(k, a, b) for a, b in zip(times, times[1:], strict=False) if b - a >= dt.timedelta(hours=20)]
    got = windows.idle_gaps(df, "k", "ts", 20, "id").select("k", "since", "until").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))

    got = {r.id: (r.rolling, r.rows) for r in windows.rolling(df, "k", "ts", "v", 1).collect()}
    assert len(got) == len(rows)
    for k, ts, i, _, _ in rows:
        near = [r for r in rows if r[0] == k and (r[1] is None if ts is None else r[1] is not None and dt.timedelta(0) <= ts - r[1] <= dt.timedelta(days=1))]
        values = [r[4] for r in near if r[4] is not None]
        assert got[i][1] == len(near) and got[i][0] == (pytest.approx(sum(values) / len(values)) if values else None)

    left, right = rows[:40], rows[40:]
    met = joins.as_of(spark.createDataFrame(left, EVENTS), spark.createDataFrame(right, EVENTS), "k", "ts", "v")
    assert met.columns == ["k", "ts", "id", "bad", "v"]
    got = {r.id: r.v for r in met.collect()}
    for k, ts, i, _, _ in left:
        past = [(r[1], r[4]) for r in right if r[0] == k and ts is not None and r[1] is not None and r[1] <= ts and r[4] is not None]
        assert got[i] == (max(past)[1] if past else None)


def test_quantiles_are_exact(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, 1.0, 1.0, 3.5, 10.0, -2.0])) for _ in range(300)] + [(9, None), (8, 4.0)]
    df = spark.createDataFrame(rows, "k long, v double")
    shares = {"low": 0.0, "q": 0.25, "mid": 0.5, "high": 0.95, "top": 1.0}
    exact = df.groupBy("k").agg(*[F.percentile("v", p).alias(n) for n, p in shares.items()])
    got = windows.with_quantiles(df.select("k").distinct(), df, ["k"], "v", shares)
    assert sorted(map(str, got.collect())) == sorted(map(str, exact.collect()))
    assert windows.quantiles(df.limit(0), ["k"], "v", shares).collect() == []


def test_quantiles_of_large_groups(spark):
    df = spark.range(150_000, numPartitions=7).select((F.col("id") % 50 == 0).cast("int").alias("k"), F.when(F.col("id") % 3 > 0, F.rand(7) * 1e6).otherwise(F.floor(F.rand(8) * 9) * 1e5).alias("v")).cache()
    shares = {"least": 0.0001, "q": 0.1, "mid": 0.5, "near": 0.5002, "high": 0.95, "most": 0.9999}
    got, exact = windows.quantiles(df, ["k"], "v", shares), df.groupBy("k").agg(*[F.percentile("v", p).alias(n) for n, p in shares.items()])
    for a, b in zip(got.orderBy("k").collect(), exact.orderBy("k").collect(), strict=True):
        assert tuple(a) == pytest.approx(tuple(b), rel=1e-12)


def test_running_sums_follow_ranges(spark):
    rows = [(i % 3 or None, i, i % 5) for i in range(200)]
    got = windows.running(spark.createDataFrame(rows, "k long, at long, n long"), ["k"], [F.asc("at")], F.col("n"), "sum").collect()
    for r in got:
        assert r.sum == sum(n for k, at, n in rows if k == r.k and at <= r.at)


def test_invalid_messages(spark):
    rows = [("r", i, m) for i, m in enumerate(["fix: x", "Fix: x", "feat(A b): x", None, "  ", "just words", "fix!(a): x", "fix: x\nAny: Thing", "two words: x", "feat(a)!: x"])]
    df = spark.createDataFrame(rows, "release string, id long, message string")
    got = {r.id: r.problem for r in aggregates.invalid_messages(df, "message", "release", "id").collect()}
    assert got == {1: "capitals in the type", 2: "malformed scope", 3: "empty", 4: "empty", 5: "no type", 6: "malformed scope", 8: "malformed type"}
    assert aggregates.invalid_messages(df.limit(0), "message", "release", "id").collect() == []


def test_quality_over_time_of_nothing(spark):
    """An empty table is neither stale nor unusual; a null series is one."""
    args = (["v"], ["id"], {"required": ["id"]}, "ts", "who", "kind", "v", dt.datetime(2024, 2, 1), 12.0, 2.0)
    schema = "id long, who string, kind string, ts timestamp_ntz, v double"
    empty = {r.check: r.passed for r in reports.quality_report_over_time(spark.createDataFrame([], schema), *args).collect()}
    assert empty["freshness"] and empty["anomalies"]
    rows = [(i, None, None, dt.datetime(2024, 1, 1 + i), 500.0 if i == 9 else 10.0 + i % 2) for i in range(10)]
    got = [(r.check, r.entity, r.day, r.passed) for r in reports.quality_report_over_time(spark.createDataFrame(rows, schema), *args).collect()]
    assert ("anomalies", None, dt.date(2024, 1, 10), False) in got and ("freshness", None, None, False) in got


def test_near_duplicates_with_frequent_shingles(spark, monkeypatch):
    """Shingles in many heads come last and lose no pair; a text whose set isn't told apart stands for its copies."""
    monkeypatch.setattr(text, "LATE_TEXTS", 2)
    common = " ".join(f"o{i}" for i in range(40))
    texts = [f"{common} " + " ".join(f"g{g}w{i}" for i in range(60 + g)) + f" last{k}" for g in range(6) for k in range(3)]
    rows = docs(spark, *texts, texts[0])
    got = {(r.a, r.b) for r in text.near_duplicates(rows, "doc_id", "text").collect()}
    keys = [r.doc_id for r in rows.orderBy("doc_id").collect()]
    assert got == {(keys[3 * g + i], keys[3 * g + j]) for g in range(6) for i in range(3) for j in range(i + 1, 3)}
    firsts = text._shingled(rows, "doc_id", "text", 5).select(text._same_set()).distinct().count()
    assert firsts == len(texts)


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    told = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(told.apply(i).totalShuffleWrite() for i in range(told.size()))


def crowd(rng, members, words):
    """Near copies of one text, of which some pairs are a little below 0.8."""
    base, out = [f"w{i}" for i in range(words)], []
    for k in range(members):
        own = list(base)
        for _ in range(rng.randrange(words // 120, words // 75)):
            own[rng.randrange(words)] = f"c{k}"
        out.append(" ".join(own))
    return out


def similar_pairs(texts):
    sets_ = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    return {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets_[i] & sets_[j]) >= 0.8 * len(sets_[i] | sets_[j])}


def test_near_duplicates_send_a_set_to_blocks_not_to_pairs(spark):
    """1,770 pairs of sets of some 12 KB would be 21 MB; the 60 sets are below 1 MB."""
    texts = crowd(random.Random(4), 60, 1500)
    rows, before, broadcast = docs(spark, *texts), shuffled(spark), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(broadcast, "-1")  # as if the table were large
    try:
        got = {(r.a, r.b) for r in text.near_duplicates(rows, "doc_id", "text").collect()}
    finally:
        spark.conf.unset(broadcast)
    want = similar_pairs(texts)
    assert got == want and 0 < len(want) < 1770
    assert shuffled(spark) - before < 6e6


@pytest.mark.parametrize("marks", [0, 1 << 21])
def test_near_duplicates_of_many_blocks(spark, monkeypatch, marks):
    """A crowd that is cut into blocks, pairs between blocks, and no broadcasts: the same pairs."""
    monkeypatch.setattr(text, "BLOCK_SHINGLES", 2000)
    monkeypatch.setattr(text, "MEMBER_SHINGLES", 8)
    monkeypatch.setattr(text, "MARKS", marks)
    texts = crowd(random.Random(6), 40, 260) + crowd(random.Random(7), 5, 300) + [" ".join(f"x{k}y{i}" for i in range(40)) for k in range(5)]
    texts += [texts[3].replace(" ", ", "), texts[-1]]
    got = [(r.a, r.b) for r in text.near_duplicates_of_all(docs(spark, *texts), "doc_id", "text").collect()]
    assert sorted(got) == sorted(similar_pairs(texts[:50]) | {(3, 50), (49, 51)})


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(2)
    sets_ = []
    for size in (1, 5, 64, 65, 300, 1024, 1025, 5000):
        base = rng.integers(-(2**63), 2**63 - 1, size)
        sets_ += [base, base[: max(1, int(size * 0.85))], np.concatenate([base, rng.integers(-(2**63), 2**63 - 1, size // 6)]), rng.integers(-(2**63), 2**63 - 1, size)]
    batch = pa.RecordBatch.from_pydict({"node": list(range(len(sets_))), "s": [s.tolist() for s in sets_]})
    members = pa.Table.from_batches(text._sketched([batch]))
    pairs = [(i, j) for i in range(len(sets_)) for j in range(i + 1, len(sets_)) if 0.8 <= len(sets_[i]) / len(sets_[j]) <= 1.25]
    kept = text._near(pa.table({"a": [i for i, _ in pairs], "b": [j for _, j in pairs]}), members, 0.2 / 1.8 + 1e-9).to_pydict()
    similar = lambda i, j: len(np.intersect1d(sets_[i], sets_[j])) >= 0.8 * len(np.union1d(sets_[i], sets_[j]))
    assert {p for p in pairs if similar(*p)} <= set(zip(kept["a"], kept["b"]))
    assert not [p for p in zip(kept["a"], kept["b"]) if len(sets_[p[0]]) > 50 and not similar(*p)]
