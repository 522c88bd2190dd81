"""Findings as JSON, their nested objects, durable findings and the outbox."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut

#: A guard: JSON nested deeper than this is an error, never left out.
DEPTH = 1000


def parse_findings(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, value (VARIANT, null if malformed), malformed."""
    value = F.try_parse_json(text)
    return df.select(key, value.alias("value"), value.isNull().alias("malformed"))


def _level(rows: DataFrame, key: str) -> DataFrame:
    """The members of every object and array of a level, with their paths."""
    nested = rows.where(F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)")).withColumn("is_object", F.schema_of_variant("value").startswith("OBJECT"))
    members = nested.lateralJoin(nested.sparkSession.tvf.variant_explode(F.col("value").outer())).toDF(*nested.columns, "pos", "name", "inner")
    step = F.when(F.col("is_object"), F.concat(F.lit("."), F.col("name"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
    return members.select(key, F.concat("path", step).alias("path"), F.col("inner").alias("value"))


def walk_json(parsed: DataFrame, key: str, depth: int = DEPTH) -> DataFrame:
    """key, path, value of every object at any level; paths look like ``root.a[0].b``. More than ``depth`` levels raise."""
    level = parsed.where("value IS NOT NULL").select(key, F.lit("root").alias("path"), "value")
    found = [level]
    for _ in range(depth + 1):
        level = cut(_level(level, key))
        if level.isEmpty():
            break
        found.append(level)
    else:
        raise RuntimeError(f"JSON is nested deeper than {depth} levels")
    every = reduce(DataFrame.unionByName, found)
    return every.where(F.schema_of_variant("value").startswith("OBJECT"))


def write_findings(df: DataFrame, path: str, mode: str = "append") -> None:
    """Findings partitioned by date and severity, one file for each of them and task."""
    dated = df.withColumn("detected_on", F.to_date("detected_at"))
    dated.repartition("detected_on", "severity").write.mode(mode).partitionBy("detected_on", "severity").parquet(path)


def route(findings: DataFrame, routing: DataFrame) -> DataFrame:
    """The outbox: each finding with the channel of its severity; unknown severities go to the default channel."""
    return findings.join(routing, "severity", "left").withColumn("channel", F.coalesce("channel", F.lit("digest"))).withColumn("page", F.coalesce("page", F.lit(False)))
