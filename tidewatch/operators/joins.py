"""Joins (J1-J11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import micros, version_key
from ..sources.scratch import written
from .windows import ranked, same, time_bucket


def enrich(facts: DataFrame, dim: DataFrame, on: str | list[str]) -> DataFrame:
    """Attributes of a dimension for each fact. Spark broadcasts the dimension if its size allows."""
    return facts.join(dim, on, "left")


def orphans(parents: DataFrame, children: DataFrame, on: str | list[str]) -> DataFrame:
    """Parents that no child refers to."""
    return parents.join(children, on, "left_anti")


def referenced(parents: DataFrame, children: DataFrame, on: str | list[str]) -> DataFrame:
    """Parents with one child at least."""
    return parents.join(children, on, "left_semi")


def snapshot_join(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows that are missing on a side or differ in some value (nulls are equal), with what changed."""
    a = left.select(*keys, F.struct(*values).alias("a"))
    b = right.select(*keys, F.struct(*values).alias("b"))
    same = [F.when(~F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}")), F.lit(v)) for v in values]
    state = F.when(F.col("a").isNull(), "only_right").when(F.col("b").isNull(), "only_left").otherwise("changed")
    out = a.join(b, keys, "full_outer").withColumn("columns", F.array_join(F.array_compact(F.array(*same)), ","))
    return out.withColumn("state", state).where("columns <> ''  OR state <> 'changed'").select(*keys, "state", F.when(F.col("state") == "changed", F.col("columns")).otherwise("").alias("columns"))


def correlate(incidents: DataFrame, changes: DataFrame, by: str, hours: float) -> DataFrame:
    """All changes of the entity in the window before each incident, nearest first.

    The range predicate gets an equi key: time is cut into buckets as wide as the
    window and a change is looked for in its own bucket and the next, so the plan
    has no nested loop and a hot entity is spread over its buckets.
    """
    width = int(hours * 3_600_000_000)
    at = F.floor(micros(F.col("ts")) / width).cast("long")
    left = incidents.withColumn("bucket", at).withColumnRenamed("ts", "incident_ts")
    right = changes.withColumnRenamed("ts", "change_ts").withColumn("bucket", F.explode(F.array(F.floor(micros(F.col("change_ts")) / width).cast("long"), F.floor(micros(F.col("change_ts")) / width).cast("long") + 1)))
    gap = micros(F.col("incident_ts")) - micros(F.col("change_ts"))
    near = left.join(right, [by, "bucket"]).where((gap >= 0) & (gap <= width))
    order = Window.partitionBy("incident_id").orderBy(gap, "change_id")
    return near.select("incident_id", by, "incident_ts", "change_id", "change_ts", F.round(gap / 3.6e9, 6).alias("hours"), F.row_number().over(order).alias("rank"))


def as_of(left: DataFrame, right: DataFrame, by: str, ts: str, value: str, bucket_hours: float = 24) -> DataFrame:
    """The last ``value`` (not null) of the right side at or before each left row; of several at one time the largest.

    Both sides are united and sorted within time buckets; the last value of each
    bucket carries over to the next ones, so no task sorts a whole key. Null keys
    meet each other; left rows without a time get null.
    """
    a = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(dict(right.dtypes)[value]))
    b = right.where(F.col(ts).isNotNull()).select(by, ts, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_bucket", time_bucket(F.col(ts), bucket_hours))
    lasts = both.groupBy(by, "_bucket").agg(F.max(F.when(F.col("_v").isNotNull(), F.struct(ts, "_v"))).alias("_last"))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.withColumn("_carried", F.last("_last", ignorenulls=True).over(before))
    w = Window.partitionBy(by, "_bucket").orderBy(ts, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_in", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    met = filled.alias("l").join(carried.alias("r"), same("l", "r", [by, "_bucket"]))
    return met.select(*[F.col(f"l.{c}") for c in left.columns if c != value], F.coalesce("l._in", "r._carried._v").alias(value))


def pattern_join(lines: DataFrame, line: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Lines by the rules they match; patterns are literals, compiled once for each task, and no join is needed."""
    hits = F.filter(F.array(*[F.when(F.col(line).rlike(p), F.lit(r)) for r, p in rules]), lambda x: x.isNotNull())
    return lines.withColumn("rule_id", F.explode(hits))


#: Items up to which a group is met by pairs of its items, which are at most half as many times the rows.
SMALL_GROUP = 32


def overlap_pairs(items: DataFrame, group: str, item: str, least: int, hot: int) -> DataFrame:
    """Pairs of groups that share ``least`` items or more.

    An item of more than ``hot`` groups says nothing about two of them (``hot`` is
    the feature, like a stop word limit); such items are left out and are reported
    by ``hot_items``. ``all_overlap_pairs`` has no such limit.
    """
    rows = items.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    few = rows.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") <= hot).drop("n")
    return _sharing(rows.join(few, "i"), least)


def all_overlap_pairs(items: DataFrame, group: str, item: str, least: int) -> DataFrame:
    """Pairs of groups that share ``least`` items or more, with no limit on the groups of an item."""
    return _sharing(items.select(F.col(group).alias("g"), F.col(item).alias("i")), least)


def _sharing(rows: DataFrame, least: int, small: int | None = None) -> DataFrame:
    """(a, b, shared) over rows (g, i), repeats counted once.

    Groups that share s items, two or more, share the s (s - 1) / 2 pairs of them. So small groups meet by
    pairs of items, and only those that share two meet at all, however many groups an item has; the
    number of pairs tells that of items. Groups of more than ``small`` items, and all if one shared item is enough, meet by single items.
    """
    small = SMALL_GROUP if small is None else small
    rows = written(rows.select("g", "i").where("g IS NOT NULL AND i IS NOT NULL").repartition("g").distinct(), "overlap-rows")
    if least < 2:
        return _by_item(rows, rows, F.col("x.g") < F.col("y.g"), least)
    large = written(rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > small).select("g"), "overlap-large")
    if large.isEmpty():
        return _by_item_pairs(rows, least)
    few, many = rows.join(large, "g", "left_anti"), rows.join(large, "g")
    found = _by_item_pairs(few, least).unionByName(_by_item(many, many, F.col("x.g") < F.col("y.g"), least))
    return found.unionByName(_by_item(many, few, F.lit(True), least))


def _by_item(x: DataFrame, y: DataFrame, met: Column, least: int) -> DataFrame:
    pairs = x.alias("x").join(y.alias("y"), (F.col("x.i") == F.col("y.i")) & met)
    return pairs.groupBy(F.least("x.g", "y.g").alias("a"), F.greatest("x.g", "y.g").alias("b")).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def _by_item_pairs(rows: DataFrame, least: int) -> DataFrame:
    each = rows.groupBy("g").agg(F.sort_array(F.collect_list("i")).alias("of")).where(F.size("of") > 1).select("g", "of", F.posexplode("of").alias("at", "i"))
    twos = each.select("g", "i", F.explode(F.slice("of", F.col("at") + 2, F.size("of"))).alias("j"))
    x, y = twos.alias("x"), twos.alias("y")
    met = x.join(y, (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j")) & (F.col("x.g") < F.col("y.g")))
    counted = met.groupBy(F.col("x.g").alias("a"), F.col("y.g").alias("b")).agg(F.count("*").alias("twos"))
    shared = F.round((1 + F.sqrt(1 + 8 * F.col("twos"))) / 2).cast("long")
    return counted.select("a", "b", shared.alias("shared")).where(F.col("shared") >= least)


def hot_items(items: DataFrame, group: str, item: str, hot: int) -> DataFrame:
    return items.select(group, item).distinct().groupBy(item).agg(F.count("*").alias("groups")).where(F.col("groups") > hot)


def advisory_match(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies whose version lies in [introduced, fixed), with the version to move to."""
    v: Column = version_key(F.col("version"))
    hit = (v >= version_key(F.col("introduced"))) & (v < version_key(F.col("fixed")))
    return deps.join(advisories, "package").where(hit).withColumn("upgrade_to", F.col("fixed"))


def sla_due(impact: DataFrame, deliverables: DataFrame, on: str) -> DataFrame:
    """Impacted entities with their due date, ranked by it within each kind; kinds may be few and large."""
    return ranked(impact.join(deliverables, on), ["kind"], [F.asc("due"), F.asc(on)])
