"""Aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bucket, day, exact_sum, hours_between, ratio, signature
from .quality import anomalies
from .windows import ranked, same, with_quantiles


def cost_rollup(usage: DataFrame, dims: list[str], mode: str = "rollup") -> DataFrame:
    """Cost with subtotals; ``level`` is grouping_id, 0 for the finest rows."""
    grouped = {"rollup": usage.rollup, "cube": usage.cube, "group": usage.groupBy}[mode](*dims)
    level = F.lit(0) if mode == "group" else F.grouping_id()
    return grouped.agg(level.cast("long").alias("level"), F.sum("cost").cast("double").alias("cost"), F.count("*").alias("n"))


def utilization(usage: DataFrame, resource: str, busy: str, span: float, low: float, high: float) -> DataFrame:
    """Busy share of each resource over ``span`` and its class; long-running by the median run. Busy times are added exactly, so shares at a limit or a rounding tie don't depend on the order of the rows."""
    out = with_quantiles(usage.groupBy(resource).agg(exact_sum(F.col(busy)).alias("busy")), usage, [resource], busy, {"median_run": 0.5})
    share = F.col("busy") / span
    kind = F.when(share < low, "idle").when(share > high, "hot").otherwise("normal")
    return out.withColumn("share", share).withColumn("class", kind)


def health_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by status, failure rate, last failure and most frequent failing kind (ties: first by name)."""
    failed = F.col("status") == "failed"
    by_cause = runs.groupBy(*keys, "kind").agg(
        F.count("*").alias("n"),
        F.count_if(failed).alias("failed"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.max(F.when(failed, F.col("ts"))).alias("last_failure"),
        F.sum("duration_s").alias("total_s"),
    )
    top = F.min(F.struct((-F.col("n")).alias("o"), F.col("kind").alias("kind")))
    out = by_cause.groupBy(*keys).agg(
        F.sum("n").alias("runs"), F.sum("failed").alias("failed"), F.sum("ok").alias("ok"), F.max("last_failure").alias("last_failure"), top["kind"].alias("top_kind"), F.round(F.sum("total_s"), 2).alias("total_s")
    )
    return out.withColumn("failure_rate", F.round(ratio(F.col("failed"), F.col("runs")), 6))


def error_rates(calls: DataFrame, key: str, every: str = "1 day") -> DataFrame:
    """Failed and slow shares of each key in tumbling windows."""
    out = calls.groupBy(key, F.window("ts", every).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("errors"), F.count_if(F.col("duration_s") > 100).alias("slow"))
    return out.select(key, F.col("w.start").alias("start"), "n", "errors", "slow", F.round(ratio(F.col("errors"), F.col("n")), 6).alias("error_rate"))


def sla_report(runs: DataFrame, sla: float) -> DataFrame:
    """Misses and exact percentiles by week."""
    rows = runs.select(F.date_trunc("week", "ts").cast("date").alias("week"), "duration_s")
    out = rows.groupBy("week").agg(F.count("*").alias("n"), F.count_if(F.col("duration_s") > sla).alias("misses"), F.max("duration_s").alias("slowest"))
    out = with_quantiles(out, rows, ["week"], "duration_s", {"p50": 0.5, "p95": 0.95})
    return out.select("week", "n", "misses", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "slowest")


def usage_stats(views: DataFrame, entity: str, actor: str, approximate: bool = False) -> DataFrame:
    """Uses, distinct users and last use of each entity."""
    distinct = F.approx_count_distinct(actor) if approximate else F.count_distinct(actor)
    return views.groupBy(entity).agg(F.count("*").alias("uses"), distinct.alias("actors"), F.max("ts").alias("last_used"))


def usage_sketches(views: DataFrame, entity: str, actor: str) -> DataFrame:
    """Daily HLL sketches; union them with ``hll_union_agg`` for any range of days."""
    return views.groupBy(entity, day(F.col("ts")).alias("day")).agg(F.hll_sketch_agg(actor).alias("sketch"), F.count("*").alias("uses"))


def chargeback(costs: DataFrame, key: str) -> DataFrame:
    """Cost of each key and its share of the total; the total is a sum of the sums."""
    by_key = costs.groupBy(key).agg(F.sum("cost").alias("cost"))
    total = by_key.agg(F.sum("cost")).scalar()
    return by_key.select(key, F.col("cost").cast("double").alias("cost"), F.round(ratio(F.col("cost"), total), 8).alias("share"))


def dora(commits: DataFrame, deploys: DataFrame) -> DataFrame:
    """By month of deploy: deploys, median hours from commit, failure share. commits: id, ts; deploys: id, ts, failed."""
    joined = deploys.alias("d").join(commits.alias("c"), F.col("d.id") == F.col("c.id"))
    lead = hours_between(F.col("c.ts"), F.col("d.ts")).alias("lead")
    rows = joined.select(F.trunc(F.col("d.ts").cast("date"), "month").alias("month"), lead, F.col("d.failed").cast("double").alias("failed"))
    out = rows.groupBy("month").agg(F.count("*").alias("deploys"), F.round(F.avg("failed"), 6).alias("failure_rate"))
    out = with_quantiles(out, rows, ["month"], "lead", {"lead_hours": 0.5})
    return out.select("month", "deploys", F.round("lead_hours", 4).alias("lead_hours"), "failure_rate")


def dora_with_repair(commits: DataFrame, deploys: DataFrame, incidents: DataFrame) -> DataFrame:
    """``dora`` with the mean hours to repair of the incidents opened in the month (null: none). incidents: opened, resolved; open ones don't count."""
    hours = F.round(F.avg(hours_between(F.col("opened"), F.col("resolved"))), 4).alias("repair_hours")
    repair = incidents.where("resolved IS NOT NULL").groupBy(F.trunc(F.col("opened").cast("date"), "month").alias("month")).agg(F.count("*").alias("incidents"), hours)
    return dora(commits, deploys).join(repair, "month", "left").fillna(0, ["incidents"])


def dismissal_rates(findings: DataFrame, feedback: DataFrame, rule: str, on: str) -> DataFrame:
    """Share of dismissed findings of each rule."""
    return findings.join(feedback, on).groupBy(rule).agg(F.count("*").alias("judged"), F.round(F.avg(F.col("dismissed").cast("double")), 6).alias("dismissed"))


def effectiveness(cases: DataFrame, limit: float = 0.5) -> DataFrame:
    """Precision and recall of each category from (predicted, actual); stale below ``limit``."""
    both = F.array(F.struct(F.col("predicted").alias("category"), F.lit(1).alias("p"), (F.col("predicted") == F.col("actual")).cast("int").alias("tp"), F.lit(0).alias("a")), F.struct(F.col("actual").alias("category"), F.lit(0).alias("p"), F.lit(0).alias("tp"), F.lit(1).alias("a")))
    out = cases.select(F.inline(both)).groupBy("category").agg(F.sum("p").alias("predicted"), F.sum("a").alias("actual"), F.sum("tp").alias("hits"))
    precision = F.round(ratio(F.col("hits"), F.col("predicted")), 6)
    return out.withColumn("precision", precision).withColumn("recall", F.round(ratio(F.col("hits"), F.col("actual")), 6)).withColumn("stale", F.coalesce(F.col("precision") < limit, F.lit(True)))


def scorecard(signals: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of each entity's signals (0 to 1) and a go/no-go that any blocker turns. signals: entity, signal, score, blocker."""
    wide = signals.groupBy("entity").pivot("signal", list(weights)).agg(F.max("score"))
    blockers = signals.groupBy("entity").agg(F.bool_or("blocker").alias("blocked"))
    total = reduce(Column.__add__, [F.when(F.col(s).isNotNull(), w * F.col(s)).otherwise(0.0) for s, w in weights.items()])
    weight = reduce(Column.__add__, [F.when(F.col(s).isNotNull(), F.lit(w)).otherwise(0.0) for s, w in weights.items()])
    return wide.join(blockers, "entity").select("entity", F.round(ratio(total, weight), 6).alias("score"), "blocked", (~F.col("blocked") & (ratio(total, weight) >= 0.5)).alias("go"))


def repeated_queries(history: DataFrame, text: str, cost: str, least: int = 2) -> DataFrame:
    """Query templates that ran several times, with their total cost. Templates are grouped by digest, so keys are short."""
    template = signature(F.col(text))
    grouped = history.select(template.alias("template"), F.col(cost).alias("cost")).groupBy(F.sha2("template", 256).alias("digest"))
    return grouped.agg(F.first("template").alias("template"), F.count("*").alias("n"), F.sum("cost").alias("cost")).where(F.col("n") >= least).drop("digest")


def filter_usage(history: DataFrame, columns: str, weight: str) -> DataFrame:
    """How often each column filters, and the share of weight it filters: clustering candidates."""
    rows = history.select(F.explode(columns).alias("column"), F.col(weight).alias("w"))
    return rows.groupBy("column").agg(F.count("*").alias("n"), F.sum("w").cast("double").alias("weight"), F.round(F.avg("w"), 6).alias("mean_weight"))


def merge_recommendations(*lists: DataFrame) -> DataFrame:
    """One roadmap of many lists (entity, action, saving): the best action of each entity, ranked by saving (ties by entity)."""
    every = reduce(DataFrame.unionByName, lists)
    best = every.groupBy("entity").agg(F.max(F.struct("saving", "action")).alias("b")).select("entity", "b.action", "b.saving")
    return ranked(best, [], [F.desc("saving"), F.asc("entity")])


def size_buckets(changes: DataFrame, key: str, size: str, limits: tuple[int, ...]) -> DataFrame:
    """Changes by total size class; the last class is oversized."""
    total = changes.groupBy(key).agg(F.sum(size).alias("size"), F.count("*").alias("parts"))
    kind = reduce(lambda out, x: out + F.when(F.col("size") >= x, 1).otherwise(0), limits, F.lit(0))
    return total.groupBy(kind.alias("class")).agg(F.count("*").alias("changes"), F.sum("size").alias("size"), F.max("parts").alias("most_parts"))


def before_after(timings: DataFrame, workflow: str, phase: str, value: str) -> DataFrame:
    """Exact median before and after for each workflow, and the share saved; other phases don't count, a phase without values is null."""
    keys = [workflow, phase]
    medians = with_quantiles(timings.groupBy(*keys).agg(F.count("*").alias("_n")), timings, keys, value, {"_median": 0.5})
    of = lambda name: F.max(F.when(F.col(phase) == name, F.col("_median"))).alias(name)
    wide = medians.groupBy(workflow).agg(of("before"), of("after"))
    return wide.select(workflow, F.round("before", 4).alias("before"), F.round("after", 4).alias("after"), F.round(1 - ratio(F.col("after"), F.col("before")), 6).alias("saved"))


CONVENTIONAL = r"^([a-z]+)(?:\(([a-z0-9_-]+)\))?(!)?: (.+)$"


def changelog(commits: DataFrame, message: str, release: str) -> DataFrame:
    """Conventional commit messages by release, type and scope; others count as invalid."""
    part = lambda i: F.regexp_extract(message, CONVENTIONAL, i)
    kind = F.when(part(1) == "", "invalid").otherwise(part(1))
    rows = commits.select(release, kind.alias("type"), part(2).alias("scope"), (part(3) == "!").alias("breaking"))
    return rows.groupBy(release, "type", "scope").agg(F.count("*").alias("n"), F.count_if("breaking").alias("breaking"))


def invalid_messages(commits: DataFrame, message: str, release: str, commit: str) -> DataFrame:
    """Messages that aren't conventional, one row each: release, commit, first line, what is wrong. A null message is empty; other lines of a message may say anything."""
    line = F.split(F.coalesce(F.col(message), F.lit("")), "\n")[0]
    first = F.col("line")
    head = F.regexp_extract(first, r"^([^:]*): ", 1)
    problem = (
        F.when(F.trim(first) == "", "empty")
        .when(~F.contains(first, F.lit(": ")), "no type")
        .when(F.lower(first).rlike(CONVENTIONAL) & ~first.rlike(CONVENTIONAL), "capitals in the type")
        .when(F.contains(head, F.lit("(")), "malformed scope")
        .otherwise("malformed type")
    )
    rows = commits.select(release, commit, line.alias("line"))
    return rows.withColumn("problem", problem).where(~F.col("line").rlike(CONVENTIONAL))


def flow_anomalies(flows: DataFrame, source: str, peer: str, volume: str, fan_out: int, factor: float) -> DataFrame:
    """Sources whose daily number of peers or volume is unusual against their own mean.

    Volumes are summed as decimals, so reruns agree to the last digit. Null volumes don't count; a day without any has a null volume.
    """
    daily = flows.groupBy(source, day(F.col("ts")).alias("day")).agg(F.count_distinct(peer).alias("peers"), exact_sum(F.col(volume)).alias("volume"))
    means = daily.groupBy(source).agg((exact_sum(F.col("volume")) / F.count("volume")).alias("mean_volume"))
    odd = daily.alias("l").join(means.alias("r"), same("l", "r", [source])).where((F.col("peers") >= fan_out) | (F.col("volume") > factor * F.col("mean_volume")))
    return odd.select(f"l.{source}", "day", "peers", F.round("volume", 4).alias("volume"), F.round("mean_volume", 6).alias("mean_volume"))


def flow_surges(flows: DataFrame, source: str, peer: str, volume: str, k: float = 3.0, days: int = 7) -> DataFrame:
    """Days whose number of peers or volume is ``k`` deviations away from the ``days`` before (Q5), with what is unusual."""
    daily = flows.groupBy(source, day(F.col("ts")).alias("day")).agg(F.count_distinct(peer).cast("double").alias("peers"), exact_sum(F.col(volume)).alias("volume"))
    odd = [anomalies(daily, [source], "day", c, k, days).select(source, "day", F.lit(c).alias("what"), F.col(c).alias("value"), "base", "score") for c in ("peers", "volume")]
    return odd[0].unionByName(odd[1])


def storage_retention(tables: DataFrame, restores: DataFrame, key: str) -> DataFrame:
    """Days of history each table keeps against the oldest restore it ever needed. tables: key, kept_days, cost_per_day; restores: key, age_days."""
    need = restores.groupBy(key).agg(F.max("age_days").alias("needed_days"))
    out = tables.join(need, key, "left").withColumn("needed_days", F.coalesce("needed_days", F.lit(0)))
    return out.withColumn("saving", F.round(F.greatest(F.lit(0), F.col("kept_days") - F.col("needed_days")) * F.col("cost_per_day"), 4))


def job_skew(tasks: DataFrame, stage: str, value: str, factor: float = 2.0) -> DataFrame:
    """Per stage: largest against median task and a skew flag."""
    out = tasks.groupBy(stage).agg(F.count("*").alias("tasks"), F.max(value).cast("double").alias("largest"), F.sum(value).cast("double").alias("total"))
    out = with_quantiles(out, tasks, [stage], value, {"median": 0.5})
    return out.withColumn("skewed", F.col("largest") > factor * F.col("median"))


def histogram_counts(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    return df.groupBy(bucket(F.col(column), low, high, bins).alias("bin")).agg(F.count("*").alias("n"))
