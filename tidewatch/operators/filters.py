"""Projections, filters and predicates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hours_between


def safe_query(df: DataFrame, limit: int = 100, order: tuple[str, ...] = ()) -> DataFrame:
    """Any ad-hoc result, cut at ``limit`` rows; with ``order`` the cut is stable (a distributed top-k)."""
    return (df.orderBy(*order) if order else df).limit(limit)


def failed_or_stuck(runs: DataFrame, now: datetime, max_hours: float) -> DataFrame:
    """Runs that failed, or run longer than allowed; paused jobs are left out."""
    age = hours_between(F.col("ts"), F.lit(now).cast("timestamp_ntz"))
    stuck = (F.col("status") == "running") & (age > max_hours)
    state = F.when(F.col("status") == "failed", "failed").when(stuck, "stuck")
    return runs.where(~F.col("paused")).withColumn("state", state).where("state IS NOT NULL")


def expiring(df: DataFrame, expiry_col: str, as_of: str, days: int) -> DataFrame:
    """Rows whose expiry lies in the next ``days`` days, with the days left."""
    left = F.datediff(F.col(expiry_col), F.lit(as_of).cast("date"))
    return df.withColumn("days_left", left).where(F.col("days_left").between(0, days))


def stale(df: DataFrame, last_used: str, as_of: str, days: int) -> DataFrame:
    """Rows not used for ``days`` days; a null last use means never used."""
    limit = F.date_sub(F.lit(as_of).cast("date"), days)
    return df.where(F.coalesce(F.col(last_used).cast("date") < limit, F.lit(True)))


def config_audit(inventory: DataFrame, kind: str, entity: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Long form of every rule (issue, severity, SQL predicate) that an inventory row breaks; one pass, no join."""
    checks = F.array(*[F.when(F.expr(test), F.struct(F.lit(issue).alias("issue"), F.lit(severity).alias("severity"))) for issue, severity, test in rules])
    return inventory.select(F.lit(kind).alias("kind"), F.col(entity).cast("string").alias("entity"), F.inline(F.filter(checks, lambda x: x.isNotNull())))


def aggregates_only(df: DataFrame, keys: list[str], aggs: list[Column], min_group: int = 5) -> DataFrame:
    """Group results only, and only groups of ``min_group`` rows or more."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *aggs).where(F.col("n") >= min_group)


#: What is masked before text reaches a finding: name and pattern.
SENSITIVE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("token", r"[0-9a-f]{32,}"),
    ("ip", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
)


def redact(df: DataFrame, text: str, rules: tuple[tuple[str, str], ...] = SENSITIVE) -> DataFrame:
    """Sensitive spans of a text column become [name]."""
    out = F.col(text)
    for name, pattern in rules:
        out = F.regexp_replace(out, pattern, f"[{name}]")
    return df.withColumn(text, out)


def forensic_slice(sources: list[DataFrame], start: datetime, end: datetime, actors: list | None = None) -> DataFrame:
    """One timeline of many sources (source, actor, ts, what) for a window, in order."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    out = out.where(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    return (out.where(F.col("actor").isin(actors)) if actors else out).orderBy("ts", "source", "actor")


def pattern_gate(findings: DataFrame, allowed: DataFrame) -> DataFrame:
    """Findings that match an approved pattern may be retried; all others are escalated."""
    approved = allowed.select("pattern").distinct().withColumn("ok", F.lit(True))
    joined = findings.join(approved, "pattern", "left")
    return joined.withColumn("action", F.when(F.col("ok"), "propose retry").otherwise("escalate")).drop("ok")
