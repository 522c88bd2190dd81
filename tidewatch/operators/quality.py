"""Data quality, contracts and drift (Q1-Q17)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import bucket, hours_between
from .graph import root_failure
from .windows import quantiles

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row for each column: rows, nulls, distinct, min, max, mean, stddev, median; one pass over the data.

    Distinct counts and medians are sketches unless ``exact``, which costs a
    shuffle of the distinct values.
    """
    parts = []
    for i, (name, kind) in enumerate(df.dtypes):
        c, number = F.col(f"`{name}`"), kind.startswith(NUMBERS)
        value = c.cast("double") if number else F.lit(None).cast("double")
        distinct = F.count_distinct(c) if exact else F.approx_count_distinct(c)
        median = F.percentile(value, 0.5) if exact else F.percentile_approx(value, 0.5)
        parts += [F.count_if(c.isNull()).alias(f"nulls{i}"), distinct.alias(f"distinct{i}"), F.min(c).cast("string").alias(f"min{i}") if not number else F.min(value).cast("string").alias(f"min{i}"), F.max(c).cast("string").alias(f"max{i}") if not number else F.max(value).cast("string").alias(f"max{i}"), F.avg(value).alias(f"mean{i}"), F.stddev_samp(value).alias(f"sd{i}"), median.alias(f"median{i}")]
    wide = df.agg(F.count("*").alias("n"), *parts)
    rows = F.array(*[F.struct(F.lit(name).alias("column"), F.col("n").alias("rows"), *[F.col(f"{k}{i}").alias(v) for k, v in (("nulls", "nulls"), ("distinct", "distinct"), ("min", "min"), ("max", "max"))], F.round(F.col(f"mean{i}"), 4).alias("mean"), F.round(F.col(f"sd{i}"), 4).alias("stddev"), F.round(F.col(f"median{i}").cast("double"), 4).alias("median")) for i, (name, _) in enumerate(df.dtypes)])
    return wide.select(F.inline(rows))


def null_check(df: DataFrame, columns: list[str], max_ratio: float) -> DataFrame:
    """Null share of each column against the limit."""
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.round(F.col(c), 6).alias("ratio"), (F.col(c) <= max_ratio).alias("passed")) for c in columns])))


def duplicate_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicated keys with their surplus rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").withColumn("surplus", F.col("n") - 1)


def freshness(df: DataFrame, ts: str, keys: list[str], as_of, max_hours: float) -> DataFrame:
    """Age of the newest row of each entity against its allowance."""
    out = df.groupBy(*keys).agg(F.max(ts).alias("newest"))
    age = hours_between(F.col("newest"), F.lit(as_of).cast("timestamp_ntz"))
    return out.withColumn("age_hours", F.round(age, 4)).withColumn("breach", age > max_hours)


def anomalies(df: DataFrame, keys: list[str], order: str, value: str, k: float = 3.0, n: int = 7, method: str = "z") -> DataFrame:
    """Rows away from their baseline: z over the ``n`` rows before, or MAD over the whole series of the key."""
    if method == "z":
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-n, -1)
        out = df.withColumn("base", F.avg(value).over(w)).withColumn("spread", F.stddev_samp(value).over(w))
    else:
        near = df.join(quantiles(df, keys, value, {"base": 0.5}), keys).withColumn("off", F.abs(F.col(value) - F.col("base")))
        spread = quantiles(near, keys, "off", {"spread": 0.5}).withColumn("spread", F.col("spread") * 1.4826)
        out = near.drop("off").join(spread, keys)
    score = F.round(F.try_divide(F.col(value) - F.col("base"), F.col("spread")), 4)
    return out.withColumn("score", score).where(F.abs("score") > k)


def validate_contract(df: DataFrame, contract: dict, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row for each rule: rule, failing, passed.

    contract: ``types`` {column: type}, ``required`` [columns], ``allowed``
    {column: values}, ``ranges`` {column: (low, high)}, ``unique`` [key lists],
    ``references`` {column: (parent, parent column)}. Row rules share one
    aggregation, each key and each reference has one of its own.
    """
    have = dict(df.dtypes)
    rules = [(f"type:{c}", F.lit(0 if have.get(c) == t else 1)) for c, t in contract.get("types", {}).items()]
    row_rules = [(f"required:{c}", F.col(c).isNull()) for c in contract.get("required", [])]
    row_rules += [(f"allowed:{c}", ~F.col(c).isin(list(v))) for c, v in contract.get("allowed", {}).items()]
    row_rules += [(f"range:{c}", ~F.col(c).between(*v)) for c, v in contract.get("ranges", {}).items()]
    sums = df.agg(*[F.count_if(test).alias(f"r{i}") for i, (_, test) in enumerate(row_rules)], F.lit(0).alias("none"))
    named = [F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("failing")) for i, (n, _) in enumerate(row_rules)] + [F.struct(F.lit(n).alias("rule"), v.cast("long").alias("failing")) for n, v in rules]
    results = [sums.select(F.inline(F.array(*named)))] if named else []
    for keys in contract.get("unique", []):
        surplus = df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("failing"))
        results.append(surplus.select(F.lit(f"unique:{','.join(keys)}").alias("rule"), "failing"))
    for column, (parent, key) in contract.get("references", {}).items():
        lost = df.where(F.col(column).isNotNull()).join((parents or {})[parent].select(F.col(key).alias(column)).distinct(), column, "left_anti")
        results.append(lost.agg(F.count("*").alias("failing")).select(F.lit(f"reference:{column}").alias("rule"), "failing"))
    return reduce(DataFrame.unionByName, results).withColumn("passed", F.col("failing") == 0)


def trace_to_roots(checked: DataFrame, edges: DataFrame) -> DataFrame:
    """Failing rules with the failing rules of the tables where the failure began: rule, failing, root, root_rule, depth.

    checked: node (a table), rule, failing (a count); edges: src, dst between tables.
    """
    bad = checked.where("failing > 0")
    status = bad.select("node").distinct().withColumn("failing", F.lit(True))
    roots = root_failure(edges, status).join(bad, "node").select("rule", "failing", "root", "depth")
    return roots.join(bad.select(F.col("node").alias("root"), F.col("rule").alias("root_rule")), "root").select("rule", "failing", "root", "root_rule", "depth")


def propose_rules(profiled: DataFrame, max_values: int = 20) -> DataFrame:
    """Candidate rules from a profile: not null, unique, range, enumeration."""
    rule = lambda test, text: F.when(test, text)
    named = F.array(
        rule(F.col("nulls") == 0, F.lit("not_null")),
        rule(F.col("distinct") == F.col("rows"), F.lit("unique")),
        rule(F.col("mean").isNotNull(), F.lit("range")),
        rule(F.col("distinct") <= max_values, F.lit("enum")),
    )
    return profiled.select("column", F.explode(F.array_compact(named)).alias("rule"))


def schema_table(tables: dict[str, DataFrame], env: str) -> DataFrame:
    """The schemas of tables as rows: env, table_name, column_name, data_type, pos."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(env, t, c, k, i) for t, df in tables.items() for i, (c, k) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "env string, table_name string, column_name string, data_type string, pos int")


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns added, dropped or retyped from left to right, with the statement that follows."""
    a, b = (d.select("table_name", "column_name", F.col("data_type").alias(n)) for d, n in ((left, "old_type"), (right, "new_type")))
    both = a.join(b, ["table_name", "column_name"], "full_outer")
    change = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "dropped").when(F.col("old_type") != F.col("new_type"), "retyped")
    table, column = F.col("table_name"), F.col("column_name")
    say = (
        F.when(F.col("change") == "added", F.concat(F.lit("ALTER TABLE "), table, F.lit(" ADD COLUMN "), column, F.lit(" "), F.col("new_type")))
        .when(F.col("change") == "dropped", F.concat(F.lit("ALTER TABLE "), table, F.lit(" DROP COLUMN "), column))
        .otherwise(F.concat(F.lit("ALTER TABLE "), table, F.lit(" ALTER COLUMN "), column, F.lit(" TYPE "), F.col("new_type")))
    )
    return both.withColumn("change", change).where("change IS NOT NULL").withColumn("statement", say)


def drift(base: DataFrame, current: DataFrame, columns: list[str], edges: dict[str, tuple[float, float]], bins: int = 10) -> DataFrame:
    """Population stability index and binned Kolmogorov-Smirnov distance of each column.

    Both sides are counted in shared bins; empty bins count as half a row.
    """
    out = []
    for c in columns:
        low, high = edges[c]
        counts = [d.where(F.col(c).isNotNull()).groupBy(bucket(F.col(c), low, high, bins).alias("bin")).agg(F.count("*").alias(n)) for d, n in ((base, "b"), (current, "k"))]
        both = counts[0].join(counts[1], "bin", "full_outer").fillna(0, ["b", "k"])  # at most bins + 2 rows
        every, running = Window.partitionBy(), Window.orderBy("bin")
        p, q = F.greatest(F.col("b"), F.lit(0.5)) / F.sum("b").over(every), F.greatest(F.col("k"), F.lit(0.5)) / F.sum("k").over(every)
        gap = F.abs(F.sum("b").over(running) / F.sum("b").over(every) - F.sum("k").over(running) / F.sum("k").over(every))
        out.append(both.select(((q - p) * F.log(q / p)).alias("psi"), gap.alias("ks")).agg(F.round(F.sum("psi"), 6).alias("psi"), F.round(F.max("ks"), 6).alias("ks")).withColumn("column", F.lit(c)))
    return reduce(DataFrame.unionByName, out)


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; ties by value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def classify_sensitivity(df: DataFrame, text: str, patterns: tuple[tuple[str, str], ...]) -> DataFrame:
    """Sensitive kinds met in a text column: rows and matches of each, patterns as literals in one pass."""
    hits = F.array(*[F.struct(F.lit(n).alias("tag"), F.regexp_count(text, F.lit(p)).alias("matches")) for n, p in patterns])
    return df.select(F.inline(hits)).where("matches > 0").groupBy("tag").agg(F.count("*").alias("rows"), F.sum("matches").alias("matches"))


def coverage_gaps(tags: DataFrame, framework: DataFrame) -> DataFrame:
    """Tags that no rule of the framework covers."""
    return tags.join(framework.select("tag").distinct(), "tag", "left_anti")


def regressions(previous: DataFrame, current: DataFrame, key: str, passed: str) -> DataFrame:
    """Cases that changed between two runs: regressed, fixed, lost, new."""
    a, b = previous.select(key, F.col(passed).alias("was")), current.select(key, F.col(passed).alias("now"))
    kind = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "lost").when(F.col("was") & ~F.col("now"), "regressed").when(~F.col("was") & F.col("now"), "fixed")
    return a.join(b, key, "full_outer").withColumn("change", kind).where("change IS NOT NULL").select(key, "change")


def opportunities(quality: DataFrame, uses: DataFrame, key: str, score: str, used: str, high: float = 0.75, low: float = 0.25) -> DataFrame:
    """Entities of high quality and little use, by quantiles of both."""
    rows = quality.join(uses, key, "left").fillna(0, [used])
    one = rows.withColumn("_one", F.lit(0))
    least, most = [quantiles(one, ["_one"], c, {"at": p}).select("at").scalar() for c, p in ((score, high), (used, low))]
    return rows.where((F.col(score) >= least) & (F.col(used) <= most))


def remediate(df: DataFrame, keys: list[str], order: list[str], fills: dict, max_attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """Tries fixes against duplicate and null rules, each attempt another one; returns the data and the log of attempts.

    Attempts are lazy plans; only their two failure counts come to the driver.
    """

    def failing(d: DataFrame) -> int:
        nulls = d.agg(F.coalesce(F.sum(sum((F.col(c).isNull().cast("long") for c in fills), F.lit(0))), F.lit(0))).first()[0]
        return nulls + d.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]

    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    attempts = [("fill", lambda d: d.fillna(fills)), ("deduplicate", lambda d: d.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")), ("drop_nulls", lambda d: d.dropna(subset=list(fills)))]
    log, n = [], failing(df)
    for k, (name, fix) in enumerate(attempts[:max_attempts], 1):
        if not n:
            break
        df = fix(df)
        before, n = n, failing(df)
        log.append((k, name, int(before), int(n), "fixed" if not n else "unfixable" if k == max_attempts else "retry"))
    return df, df.sparkSession.createDataFrame(log, "attempt int, fix string, failing_before long, failing_after long, outcome string")
