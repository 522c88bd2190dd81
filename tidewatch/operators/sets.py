"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINDING = ("source", "entity", "issue", "severity", "evidence", "recommendation")


def new_since(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Findings that the run before didn't have."""
    return current.join(previous.select(*keys).distinct(), keys, "left_anti")


def resolved_since(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Findings that are gone."""
    return previous.select(*keys).subtract(current.select(*keys))


def parity(environments: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Rows that aren't in every environment, and where they are."""
    tagged = [df.select(*columns).distinct().withColumn("env", F.lit(env)) for env, df in environments.items()]
    every = reduce(DataFrame.unionByName, tagged)
    out = every.groupBy(*columns).agg(F.array_join(F.array_sort(F.collect_set("env")), ",").alias("present_in"), F.count("*").alias("n"))
    return out.where(F.col("n") < len(environments)).drop("n")


def merge_findings(*findings: DataFrame) -> DataFrame:
    """One digest of many detectors; missing columns are null."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), findings)
    for c in FINDING:
        if c not in every.columns:
            every = every.withColumn(c, F.lit(None).cast("string"))
    return every.select(*FINDING)
