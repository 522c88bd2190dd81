"""Connected components of an edge table, as a loop of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); ``root`` is one node of its component.

    Randomised contraction: in each round every node moves to the neighbour (or
    itself) with the smallest hash under that round's seed, and edges are
    rewritten between the survivors. A round removes a constant share of the
    nodes on average, whatever the shape (paths, stars), so rounds grow with the
    logarithm of the nodes. Hubs are met by aggregation only.
    """
    left = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    moved = None
    for k in range(rounds):
        if left.isEmpty():
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = F.min(F.struct(F.xxhash64("b", F.lit(k)).alias("h"), F.col("b").alias("n")))
        step = both.groupBy(F.col("a").alias("node")).agg(lowest.alias("m")).select("node", F.when(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), F.col("node").alias("n")) < F.col("m"), F.col("node")).otherwise(F.col("m.n")).alias("root"))
        step = materialise(step, "step")
        to = lambda name: step.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
        done, left = left, materialise(
            left.join(to("a"), "a").join(to("b"), "b").where("a_root <> b_root").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(),
            "edges",
        )
        release(done)
        if moved is None:
            moved = step
        else:
            onward = step.select(F.col("node").alias("at"), F.col("root").alias("next"))
            old, moved = moved, materialise(moved.join(onward, moved["root"] == onward["at"], "left").select("node", F.coalesce("next", "root").alias("root")), "moved")
            release(old, step)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return moved if moved is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
