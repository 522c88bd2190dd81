"""Split suggestions (A15): oversized changes cut into parts along their directories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import release, written
from .windows import running, same

SIZE = "decimal(28,6)"


def _parent(path: str):
    return F.regexp_replace(path, "(^|/)[^/]*$", "").alias("parent")


def split_parts(files: DataFrame, key: str, path: str, size: str, limit: float) -> DataFrame:
    """The fewest parts of each change along its directory tree: key, root, files, size, oversized.

    A part is what lies below its root but in no part further down; the root is a
    directory, a file, or ``''`` for the whole change. No part is larger than ``limit``
    but single files that are (``oversized``: they have to be split themselves). Of all
    such cuts of the tree this has the fewest parts: from the deepest level up, a
    directory keeps the smallest of what its entries leave over, by size and name, as long
    as they fit, and every other entry is a part.

    Paths are parts joined by ``/``; rows of one path are added up. A null path is ``''``; null
    and negative sizes are 0. The running sums go by ranges, so no directory, however
    full, is one task; rounds are the levels of the deepest path. Parts of a change are ordered
    by nothing; ``part_of`` tells the part of each file.
    """
    own = F.greatest(F.coalesce(F.col(size).cast(SIZE), F.lit(0).cast(SIZE)), F.lit(0).cast(SIZE))
    nodes = files.select(F.col(key).alias("change"), F.coalesce(F.col(path), F.lit("")).alias("node"), own.alias("size"))
    nodes = nodes.groupBy("change", "node").agg(F.sum("size").cast(SIZE).alias("size"), F.lit(1).cast("long").alias("files"))
    nodes = written(nodes.withColumn("depth", F.when(F.col("node") == "", 0).otherwise(F.size(F.split("node", "/")))), "split-nodes", "depth")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    columns = ["change", "node", "size", "files"]
    parts, levels, carried = [], [], nodes.where("depth < 0").select(*columns)
    for depth in range(deepest, 0, -1):
        entries = nodes.where(F.col("depth") == depth).select(*columns).unionByName(carried)
        entries = entries.groupBy("change", "node").agg(F.sum("size").cast(SIZE).alias("size"), F.sum("files").alias("files")).select("*", _parent("node"))
        room = nodes.where(F.col("depth") == depth - 1).select("change", F.col("node").alias("parent"), F.col("size").alias("taken"))
        filled = running(entries, ["change", "parent"], [F.asc("size"), F.asc("node")], F.col("size"), "upto").alias("l").join(room.alias("r"), same("l", "r", ["change", "parent"]), "left")
        fits = F.col("upto") + F.coalesce("taken", F.lit(0).cast(SIZE)) <= F.lit(limit).cast(SIZE)
        level = written(filled.select("l.change", "l.parent", "node", "l.size", "files", fits.alias("fits")), "split-level")
        levels.append(level)
        parts.append(level.where("NOT fits").select(*columns))
        carried = level.where("fits").groupBy("change", F.col("parent").alias("node")).agg(F.sum("size").cast(SIZE).alias("size"), F.sum("files").alias("files"))
    rest = nodes.where("depth = 0").select(*columns).unionByName(carried).groupBy("change", "node").agg(F.sum("size").cast(SIZE).alias("size"), F.sum("files").alias("files"))
    out = reduce(DataFrame.unionByName, parts, rest)
    out = written(out.select(F.col("change").alias(key), F.col("node").alias("root"), "files", F.col("size").cast("double").alias("size"), (F.col("size") > F.lit(limit).cast(SIZE)).alias("oversized")), "split-parts")
    release(nodes, *levels)
    return out


def part_of(files: DataFrame, parts: DataFrame, key: str, path: str) -> DataFrame:
    """key, path, root: the part of each file, the deepest root among its directories and itself. One equi join on (change, directory)."""
    name = F.coalesce(F.col(path), F.lit(""))
    names = F.split(name, "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, 1, i), "/")))
    asked = files.select(F.col(key), F.col(path).alias("_file"), F.explode(F.array_distinct(above)).alias("root")).distinct()
    met = asked.alias("l").join(parts.alias("r"), same("l", "r", [key, "root"]))
    return met.groupBy(f"l.{key}", F.col("_file").alias(path)).agg(F.max_by("l.root", F.length("l.root")).alias("root"))
