"""Comparing snapshots by digests (J4, X3): only parts that differ are read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import joins, sets

#: Rows with a null in their key: never equal in a join, so their range always counts as different.
NO_KEY = -1


def _hash(columns: list[str], seed: int) -> Column:
    """64 bits of the columns, nulls told apart (``xxhash64`` skips them)."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def keep(df: DataFrame, path: str, keys: list[str], values: list[str] = (), tops: int = 64, leaves: int = 64) -> None:
    """Writes a snapshot for comparison: its rows by range of key hash, and a tree of digests over the ranges.

    There are ``tops`` x ``leaves`` ranges; the digest of a range is the number of its rows
    and the sums of two 64-bit hashes of each (keys and values), so digests of ranges add
    up to that of a top and neither the order of rows nor that of files matters. Two snapshots
    can be compared if they have the same columns and shape. A range whose rows are many is
    written by several tasks. Columns must be hashable (no maps).
    """
    spark, columns = df.sparkSession, [*keys, *values]
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    ranged = df.select(*columns).withColumn("_range", F.when(known, F.pmod(_hash(keys, 0), F.lit(tops * leaves))).otherwise(NO_KEY).cast("int"))
    ranged = ranged.withColumn("_top", F.floor(F.col("_range") / leaves).cast("int"))
    ranged.hint("rebalance", "_range").write.mode("overwrite").partitionBy("_top", "_range").parquet(f"{path}/rows")
    stored = spark.read.schema(ranged.schema).parquet(f"{path}/rows")
    total = lambda seed: F.sum(_hash(columns, seed).cast("decimal(20,0)")).alias(f"h{seed}")
    leaf = stored.groupBy("_top", "_range").agg(F.count("*").alias("n"), total(1), total(2))
    leaf.repartition("_top").write.mode("overwrite").partitionBy("_top").parquet(f"{path}/leaves")
    stem = spark.read.schema(leaf.schema).parquet(f"{path}/leaves").groupBy("_top").agg(F.sum("n").alias("n"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2"))
    stem.coalesce(1).write.mode("overwrite").parquet(f"{path}/tops")
    shape = [(tops, leaves, ",".join(keys), ", ".join(f"`{c}` {t}" for c, t in df.select(*columns).dtypes))]
    spark.createDataFrame(shape, "tops int, leaves int, keys string, columns string").coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")


def _unequal(sides: list[DataFrame], node: str) -> list[int]:
    """Nodes that a side lacks or whose digests aren't all the same; at most ``tops`` or ``leaves`` times the open tops."""
    digest = F.struct("n", F.col("h1").cast("decimal(38,0)"), F.col("h2").cast("decimal(38,0)"))
    every = reduce(DataFrame.unionByName, [s.select(node, digest.alias("digest")) for s in sides])
    found = every.groupBy(node).agg(F.count("*").alias("sides"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    return sorted(r[0] for r in found.where((F.col("sides") < len(sides)) | (F.col("low") != F.col("high")) | (F.col(node) == NO_KEY)).select(node).collect())


def differing(spark: SparkSession, paths: list[str]) -> tuple[list[int], list[int]]:
    """(tops, ranges) in which the snapshots differ. Digests of ranges are read only below tops that differ."""
    shapes = {tuple(spark.read.parquet(f"{p}/shape").first()) for p in paths}
    if len(shapes) > 1:
        raise ValueError(f"snapshots of different shapes: {sorted(shapes)}")
    tops = _unequal([spark.read.parquet(f"{p}/tops") for p in paths], "_top")
    if not tops:
        return [], []
    return tops, _unequal([spark.read.schema("_range int, n long, h1 decimal(30,0), h2 decimal(30,0), _top int").parquet(f"{p}/leaves").where(F.col("_top").isin(tops)) for p in paths], "_range")


def _changed(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """The rows of each snapshot in the ranges that differ; the files of other ranges are neither listed for tasks nor read."""
    tops, ranges = differing(spark, paths)
    schema = spark.read.parquet(f"{paths[0]}/shape").first()["columns"] + ", _top int, _range int"
    return [spark.read.schema(schema).parquet(f"{p}/rows").where(F.col("_top").isin(tops) & F.col("_range").isin(ranges)).drop("_top", "_range") for p in paths]


def snapshot_join(spark: SparkSession, left: str, right: str, keys: list[str], values: list[str]) -> DataFrame:
    """``joins.snapshot_join`` of two kept snapshots, same rows; ``keys`` are those they were kept by and tell rows of a side apart."""
    a, b = _changed(spark, [left, right])
    return joins.snapshot_join(a, b, keys, values)


def parity(spark: SparkSession, environments: dict[str, str], columns: list[str]) -> DataFrame:
    """``sets.parity`` of snapshots that were kept by ``columns``, each row once."""
    sides = _changed(spark, list(environments.values()))
    return sets.parity(dict(zip(environments, sides, strict=True)), columns)
