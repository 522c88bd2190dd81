"""Composite reports, built only from the other operators (R1-R10). All return findings or ranked tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import exact_sum
from ..sources import findings
from ..sources.scratch import written
from . import aggregates, filters, graph, joins, quality, sets, text, windows


def _finding(df: DataFrame, source: str, entity, issue, severity, evidence) -> DataFrame:
    return df.select(F.lit(source).alias("source"), entity.cast("string").alias("entity"), issue.alias("issue"), severity.alias("severity"), evidence.cast("string").alias("evidence"))


def daily_report(runs: DataFrame, events: DataFrame, now: datetime, max_hours: float, sla_hours: float) -> DataFrame:
    """Stuck or failed runs, unhealthy jobs and stale entities as one digest."""
    stuck = filters.failed_or_stuck(runs, now, max_hours).groupBy("job", "state").agg(F.count("*").alias("n"))
    health = aggregates.health_summary(runs, ["job"]).where("failure_rate > 0.3")
    stale = quality.freshness(events, "ts", ["user_id"], now, sla_hours).where("breach")
    return sets.merge_findings(
        _finding(stuck, "runs", F.col("job"), F.col("state"), F.lit("high"), F.col("n")),
        _finding(health, "health", F.col("job"), F.lit("failure rate"), F.lit("medium"), F.col("failed")),
        _finding(stale, "freshness", F.col("user_id"), F.lit("stale"), F.lit("low"), F.col("newest").cast("date")),
    )


def incident_triage(incidents: DataFrame, changes: DataFrame, edges: DataFrame, status: DataFrame, hours: float) -> tuple[DataFrame, DataFrame]:
    """R2: the nearest change before each incident, and failing nodes with their root failure."""
    return joins.correlate(incidents, changes, "entity", hours).where("rank = 1"), graph.root_failure(edges, status)


def incident_report(runs: DataFrame, changes: DataFrame, lines: DataFrame, now: datetime, max_hours: float, hours: float, causes: list[tuple[str, str]], noise: str, fail: str, cap: int = 5, context: int = 2) -> DataFrame:
    """R2 as a whole: failed or stuck runs (F2) with the nearest change before (J5), the category of their log (L3) and its failure block (L2).

    ``lines`` are those of the runs' logs: run_id, line_no, line. Runs without a log
    have null category and block, runs without a change a null change.
    """
    stuck = filters.failed_or_stuck(runs, now, max_hours).select("run_id", "job", "ts", "state")
    near = joins.correlate(stuck.select(F.col("run_id").alias("incident_id"), F.col("job").alias("entity"), "ts"), changes, "entity", hours).where("rank = 1")
    logs = lines.join(stuck.select("run_id"), "run_id", "left_semi")
    category = text.root_cause(logs, "run_id", causes)
    block = text.prefilter_log(logs, "run_id", noise, fail, cap, context).select("run_id", "first_line", "last_line", "suppressed", "noise")
    out = stuck.join(near.select(F.col("incident_id").alias("run_id"), "change_id"), "run_id", "left").join(category, "run_id", "left").join(block, "run_id", "left")
    return out.select("run_id", "job", "state", "change_id", "category", "first_line", "last_line", "suppressed", "noise")


def triage_chain(report: DataFrame, edges: DataFrame, status: DataFrame, node: Column) -> DataFrame:
    """R2 with G3: ``incident_report`` with the root failure of each run's node, the furthest one (ties: the last by name); null where the node isn't failing.

    node: the lineage node of a row of the report.
    """
    deepest = F.max(F.struct("depth", "root")).alias("m")
    roots = written(graph.root_failure(edges, status), "roots").groupBy(F.col("node").alias("at")).agg(deepest).select("at", "m.root")
    return report.join(roots, node == F.col("at"), "left").drop("at")


def daily_ops(report: DataFrame, daily: DataFrame, key: str, value: str, routing: DataFrame, k: float = 2.0) -> DataFrame:
    """R1 whole: the findings of ``daily_report`` with unusual days of each series (Q5), every one with the channel of its severity."""
    odd = quality.anomalies(daily, [key], "day", value, k=k)
    far = F.when(F.abs("score") > 2 * k, "high").otherwise("medium")
    found = _finding(odd, "anomaly", F.col(key), F.when(F.col("score") > 0, "unusually high").otherwise("unusually low"), far, F.col("day"))
    return findings.route(sets.merge_findings(report, found), routing)


def cost_findings(usage: DataFrame, load: DataFrame, resource: str, busy: str, span: float, low: float, high: float, k: float = 2.0) -> DataFrame:
    """R3 whole (what, entity, amount): cost of each service and in all (A1), idle and hot resources with their busy share (A2), months whose cost is unusual (Q5).

    usage: service, ts, cost; load: a row for each run with its resource and busy time over ``span``.
    """
    total = aggregates.cost_rollup(usage, ["service"]).select(F.lit("cost").alias("what"), F.coalesce("service", F.lit("all")).alias("entity"), F.col("cost").alias("amount"))
    used = aggregates.utilization(load, resource, busy, span, low, high).where("class <> 'normal'").select(F.col("class").alias("what"), F.col(resource).cast("string").alias("entity"), F.round("share", 6).alias("amount"))
    monthly = usage.groupBy("service", F.trunc(F.col("ts").cast("date"), "month").alias("month")).agg(F.sum("cost").cast("double").alias("cost"))
    odd = quality.anomalies(monthly, ["service"], "month", "cost", k=k)
    odd = odd.select(F.lit("unusual month").alias("what"), F.concat_ws(" ", "service", F.col("month").cast("string")).alias("entity"), F.col("cost").alias("amount"))
    return total.unionByName(used).unionByName(odd)


def cost_audit(usage: DataFrame, monthly: DataFrame, n: int = 5) -> DataFrame:
    """The most expensive resources and the largest monthly rises, one table."""
    top = usage.groupBy("resource").agg(F.sum("cost").cast("double").alias("amount")).orderBy(F.desc("amount"), "resource").limit(n)
    rises = windows.period_delta(monthly, ["series"], "month_no", "value")
    rises = windows.top_n(rises.where("delta IS NOT NULL"), ["series"], [F.desc("delta"), F.col("month_no")], 1)
    return top.select(F.lit("top resource").alias("what"), F.col("resource").cast("string").alias("entity"), "amount").unionByName(rises.select(F.lit("largest rise").alias("what"), "series", F.col("delta").alias("amount")).withColumnRenamed("series", "entity"))


def cost_anomaly_causes(daily: DataFrame, changes: DataFrame, key: str, k: float) -> DataFrame:
    """Unusual days of each key, with the number of its changes on that day or the day before."""
    odd = quality.anomalies(daily, [key], "day", "total", k=k)
    around = changes.select(F.col(key), F.explode(F.array(F.to_date("ts"), F.date_add(F.to_date("ts"), 1))).alias("day")).groupBy(key, "day").agg(F.count("*").alias("changes"))
    return odd.select(key, "day").join(around, [key, "day"], "left").fillna(0, ["changes"])


def quality_report(df: DataFrame, columns: list[str], keys: list[str], contract: dict) -> DataFrame:
    """Null shares, duplicate surplus and contract rules as checks with a result."""
    nulls = quality.null_check(df, columns, 0.0).select(F.concat(F.lit("nulls:"), F.col("column")).alias("check"), "passed")
    surplus = quality.duplicate_check(df, keys).agg(F.count("*").alias("n")).select(F.lit("duplicates").alias("check"), (F.col("n") == 0).alias("passed"))
    rules = quality.validate_contract(df, contract).select(F.col("rule").alias("check"), "passed")
    return nulls.unionByName(surplus).unionByName(rules)


def quality_report_over_time(df: DataFrame, columns: list[str], keys: list[str], contract: dict, ts: str, stale: str, series: str, value: str, now: datetime, max_hours: float, k: float = 3.0) -> DataFrame:
    """R5 with time: check, entity, day, measure, passed.

    The checks of ``quality_report``, then two more, ``freshness`` (Q4, by the column ``stale``) and
    ``anomalies`` (Q5, daily totals of ``value`` by the column ``series``), each with a row without an entity that tells
    whether it passed, and a failed row for each stale entity (measure: its age in hours) and each
    unusual day (measure: its score). An empty table is neither stale nor unusual.
    """
    none = lambda kind: F.lit(None).cast(kind)
    checks = quality_report(df, columns, keys, contract).select("check", none("string").alias("entity"), none("date").alias("day"), none("double").alias("measure"), "passed")
    old = quality.freshness(df, ts, [stale], now, max_hours).where("breach")
    daily = df.groupBy(series, F.to_date(ts).alias("day")).agg(exact_sum(F.col(value)).alias("total"))
    odd = quality.anomalies(daily, [series], "day", "total", k)
    found = [
        old.select(F.lit("freshness").alias("check"), F.col(stale).cast("string").alias("entity"), none("date").alias("day"), F.col("age_hours").alias("measure"), F.lit(False).alias("passed")),
        odd.select(F.lit("anomalies").alias("check"), F.col(series).cast("string").alias("entity"), "day", F.round("score", 3).alias("measure"), F.lit(False).alias("passed")),
    ]
    for rows, check in zip(found, ("freshness", "anomalies"), strict=True):
        verdict = rows.agg(F.count("*").alias("n")).select(F.lit(check).alias("check"), none("string").alias("entity"), none("date").alias("day"), none("double").alias("measure"), (F.col("n") == 0).alias("passed"))
        checks = checks.unionByName(verdict).unionByName(rows)
    return checks


def sla_impact(edges: DataFrame, seeds: DataFrame, deliverables: DataFrame) -> DataFrame:
    """Deliverables downstream of a failure, ranked by due date. deliverables: node, kind, due."""
    hit = graph.reach(edges, seeds).where("depth > 0").select("node").distinct()
    return joins.sla_due(hit, deliverables, "node")


def savings_roadmap(*lists: DataFrame) -> DataFrame:
    """One ranked list of the best saving of each entity."""
    return aggregates.merge_recommendations(*lists)


def governance_scorecard(signals: DataFrame, weights: dict[str, float]) -> DataFrame:
    """R8."""
    return aggregates.scorecard(signals, weights)


def release_readiness(runs: DataFrame, commits: DataFrame, message: str, release: str, limit: float) -> DataFrame:
    """Go unless the failure rate is above the limit or a breaking change is open."""
    rate = runs.agg(F.avg((F.col("status") == "failed").cast("double"))).scalar()
    log = aggregates.changelog(commits, message, release).groupBy(release).agg(F.sum("n").alias("commits"), F.sum("breaking").alias("breaking"))
    return log.select(release, "commits", "breaking", ((rate <= limit) & (F.col("breaking") == 0)).alias("go"))


def one_root_cause(findings: list[DataFrame], edges: DataFrame, status: DataFrame) -> DataFrame:
    """Findings of many detectors (entity = node), grouped by the root failure they lead to."""
    every = sets.merge_findings(*findings)
    roots = graph.root_failure(edges, status).select(F.col("node").alias("entity"), "root")
    return every.join(roots, "entity").groupBy("root").agg(F.count("*").alias("findings"), F.count_distinct("entity").alias("entities"))


