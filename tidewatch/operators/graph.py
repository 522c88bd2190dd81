"""Graph and lineage (G1-G8): loops of joins over edge tables (src, dst), cut by tables in the shared folder, whose sizes the planner knows: a small frontier is broadcast and the edges stay where they are."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import release, written


def _cut(df: DataFrame) -> DataFrame:
    return written(df, "graph")


def _rounds(most: int | None):
    """1, 2, ... as long as a loop needs; a loop that isn't done after ``most`` rounds fails, so no node is left out."""
    for k in count(1):
        if most is not None and k > most + 1:
            raise RuntimeError(f"not done after {most} rounds")
        yield k


def reach(edges: DataFrame, seeds: DataFrame, direction: str = "down", max_depth: int | None = None, together: bool = False) -> DataFrame:
    """(seed, node, depth) for every node reachable from a seed, with the least depth; seeds have depth 0.

    Only the last frontier is joined in a round and visited pairs are left out, so
    cycles end. ``seeds`` has one column, node. A frontier left after ``max_depth``
    rounds is an error. ``together``: seeds count as one, with an empty name.
    """
    a, b = ("src", "dst") if direction == "down" else ("dst", "src")
    steps = _cut(edges.select(F.col(a).alias("node"), F.col(b).alias("next")))
    frontier = _cut(seeds.select((F.lit("") if together else F.col("node")).alias("seed"), "node").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for depth in _rounds(max_depth):
        found = frontier.join(steps, "node").select("seed", F.col("next").alias("node")).distinct()
        frontier = _cut(found.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = _cut(seen.unionByName(frontier)) if depth % 8 == 0 else seen.unionByName(frontier)
    return seen


def impact(edges: DataFrame, seeds: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(node, effect): the strongest product of edge weights from a seed; weights lie in (0, 1]. edges: src, dst, weight. More than ``max_depth`` rounds raise."""
    edges = _cut(edges.select("src", "dst", "weight"))
    best = _cut(seeds.select("node").distinct().withColumn("effect", F.lit(1.0)))
    return _relaxed(best, best, edges, max_depth)[0]


def _relaxed(best: DataFrame, frontier: DataFrame, edges: DataFrame, max_depth: int) -> tuple[DataFrame, list[DataFrame]]:
    """(effects, frontiers met) once no edge out of the frontier improves a node any more."""
    met = [frontier]
    for _ in _rounds(max_depth):
        moved = frontier.join(edges, frontier["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.max(F.col("effect") * F.col("weight")).alias("effect"))
        frontier = _cut(_better(moved, best))
        if frontier.isEmpty():
            break
        met.append(frontier)
        best = _cut(best.unionByName(frontier).groupBy("node").agg(F.max("effect").alias("effect")))
    return best, met


def _better(moved: DataFrame, best: DataFrame) -> DataFrame:
    old = best.withColumnRenamed("effect", "was")
    return moved.join(old, "node", "left").where("was IS NULL OR effect > was").select("node", "effect")


def what_if(edges: DataFrame, seeds: DataFrame, effects: DataFrame, changes: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(node, before, after) of the nodes that changed edges may move; null: not reached. All others keep their ``effects`` (of ``impact``).

    changes: src, dst, weight; a null weight removes the edges from src to dst, a pair that
    has none gets one; one row for each pair. Nothing is computed anew from the seeds: nodes
    whose strongest path may use a weakened edge are cleared (behind edges
    that carry the whole effect, from node to node), get what unmoved neighbours give them, and
    only what improves goes on from there, as over strengthened edges. Rounds are as long as
    the paths that move; more than ``max_depth`` raise.
    """
    asked = changes.select("src", "dst", F.col("weight").alias("new"), F.lit(True).alias("asked"))
    every = edges.select("src", "dst", F.col("weight").alias("was")).join(asked, ["src", "dst"], "full_outer")
    every = _cut(every.select("src", "dst", "was", F.when(F.col("asked"), F.col("new")).otherwise(F.col("was")).alias("weight")))
    effects, fixed = _cut(effects.select("node", "effect")), seeds.select("node").distinct()
    sources, targets = effects.select(F.col("node").alias("src"), F.col("effect").alias("from")), effects.select(F.col("node").alias("dst"), F.col("effect").alias("have"))

    def carried(candidates: DataFrame) -> DataFrame:
        """Targets that owe their whole effect to one of the edges."""
        tight = candidates.join(sources, "src").join(targets, "dst").where(F.col("from") * F.col("was") >= F.col("have"))
        return tight.select(F.col("dst").alias("node")).distinct().join(fixed, "node", "left_anti")

    frontier = cleared = _cut(carried(every.where("was IS NOT NULL AND (weight IS NULL OR weight < was)")))
    for depth in _rounds(max_depth):
        behind = every.where("was IS NOT NULL").join(frontier.withColumnRenamed("node", "src"), "src")
        frontier = _cut(carried(behind).join(cleared, "node", "left_anti"))
        if frontier.isEmpty():
            break
        cleared = _cut(cleared.unionByName(frontier)) if depth % 8 == 0 else cleared.unionByName(frontier)
    cleared = _cut(cleared)
    usable = every.where("weight IS NOT NULL")
    entering = usable.join(cleared.withColumnRenamed("node", "dst"), "dst", "left_semi").unionByName(usable.where("was IS NULL OR weight > was"))
    best = _cut(effects.join(cleared, "node", "left_anti"))
    moved = best.join(entering, best["node"] == entering["src"]).groupBy(F.col("dst").alias("node")).agg(F.max(F.col("effect") * F.col("weight")).alias("effect"))
    start = _cut(_better(moved, best))
    best = _cut(best.unionByName(start).groupBy("node").agg(F.max("effect").alias("effect")))
    best, met = _relaxed(best, start, usable.select("src", "dst", "weight"), max_depth)
    visited = reduce(DataFrame.unionByName, [m.select("node") for m in met], cleared).distinct()
    return visited.join(effects.withColumnRenamed("effect", "before"), "node", "left").join(best.withColumnRenamed("effect", "after"), "node", "left")


def root_failure(edges: DataFrame, status: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, root): failing nodes with their deepest failing ancestors. status: node, failing."""
    bad = status.where("failing").select("node").distinct()
    broken = _cut(edges.join(bad.withColumnRenamed("node", "src"), "src").join(bad.withColumnRenamed("node", "dst"), "dst").select("src", "dst").distinct())
    up = reach(broken, bad, "up", max_depth)
    roots = bad.join(broken.select(F.col("dst").alias("node")), "node", "left_anti")
    return up.join(roots, "node").select(F.col("seed").alias("node"), F.col("node").alias("root"), "depth")


def levels(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, level): the longest path from a source in edges; nodes on or behind a cycle have level null.

    Nodes leave in rounds once all their predecessors have left.
    """
    left = _cut(edges.select("src", "dst"))
    nodes = _cut(left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct())
    out = None
    for level in _rounds(max_depth):
        ready = _cut(nodes.join(left.select(F.col("dst").alias("node")), "node", "left_anti").withColumn("level", F.lit(level - 1)))
        if ready.isEmpty():
            break
        out = ready if out is None else out.unionByName(ready)
        old = (nodes, left)
        nodes = _cut(nodes.join(ready, "node", "left_anti"))
        left = _cut(left.join(ready.select(F.col("node").alias("src")), "src", "left_anti"))
        release(*old)
    stuck = nodes.withColumn("level", F.lit(None).cast("int"))
    return stuck if out is None else out.unionByName(stuck)


def critical_path(edges: DataFrame, durations: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(node, finish): the earliest finish of each node of a DAG: its duration after the latest predecessor. durations: node, duration. More than ``max_depth`` rounds, or a cycle, raise."""
    edges = _cut(edges.select("src", "dst"))
    best = _cut(durations.select("node", "duration", F.col("duration").alias("finish")))
    frontier = best.select("node", "finish")
    for _ in _rounds(max_depth):
        came = frontier.join(edges, frontier["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.max("finish").alias("before"))
        later = _cut(best.join(came, "node").where(F.col("before") + F.col("duration") > F.col("finish")).select("node", (F.col("before") + F.col("duration")).alias("finish")))
        if later.isEmpty():
            break
        old, best = best, _cut(best.join(later.withColumnRenamed("finish", "new"), "node", "left").select("node", "duration", F.coalesce("new", "finish").alias("finish")))
        release(old, frontier)
        frontier = later
    return best


def slack(edges: DataFrame, durations: DataFrame) -> DataFrame:
    """(node, finish, slack): how long a node may be late without moving the end."""
    forward = critical_path(edges, durations)
    back = critical_path(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), durations).select("node", F.col("finish").alias("tail"))
    end = forward.agg(F.max("finish")).scalar()
    return forward.join(back, "node").select("node", "finish", (end - (F.col("finish") + F.col("tail") - F.col("duration"))).alias("slack"))


def redundant_edges(edges: DataFrame) -> DataFrame:
    """Edges that a longer path implies: src reaches dst from another successor (``reachability.redundant_edges``)."""
    from . import reachability

    return reachability.redundant_edges(edges)


def needless_order(edges: DataFrame, data_edges: DataFrame) -> DataFrame:
    """Ordering edges (src, dst) without a data dependency behind them: dst can't be reached from src over ``data_edges``."""
    from . import reachability

    e = edges.select("src", "dst").distinct()
    needed = reachability.reaches(data_edges, e.select(F.col("src").alias("x"), F.col("dst").alias("y")))
    return e.join(needed.select(F.col("x").alias("src"), F.col("y").alias("dst")), ["src", "dst"], "left_anti")


def affected(edges: DataFrame, packages: DataFrame, files: DataFrame) -> DataFrame:
    """Packages to rebuild: those that own a changed file and all that depend on them.

    packages: node, prefix (a folder, ``a/b``); files: path. A file is matched by
    its folders, as an equi join.
    """
    parts = F.split("path", "/")
    folders = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("prefix"))
    owners = folders.join(packages, "prefix").select("node").distinct()
    return nearest(edges, owners)


def freshness_chain(edges: DataFrame, status: DataFrame, ends: DataFrame) -> DataFrame:
    """(seed, node, depth): the furthest stale node above each end, the name deciding ties. status: node, stale."""
    up = reach(edges, ends, "up").join(status.where("stale"), "node")
    return up.groupBy("seed").agg(F.max(F.struct("depth", "node")).alias("m")).select("seed", "m.node", "m.depth")


def nearest(edges: DataFrame, seeds: DataFrame, direction: str = "down", max_depth: int | None = None) -> DataFrame:
    """(node, depth) for every node reachable from any seed, with the least depth; seeds are taken together, so a node is visited once. ``seeds``: node."""
    return reach(edges, seeds, direction, max_depth, together=True).select("node", "depth")


def effective_access(grants: DataFrame, role_edges: DataFrame, access: DataFrame | None = None) -> DataFrame:
    """(principal, object) by own grants and those of inherited roles; with an access log, whether it was used.

    grants: principal, object; role_edges: child, parent; access: principal, object. The search goes
    from those that hold grants to all who inherit from them, so every pair it visits is a row of the result.
    """
    edges = role_edges.select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    heirs = reach(edges, grants.select(F.col("principal").alias("node")), "up")
    out = heirs.join(grants, heirs["seed"] == grants["principal"]).select(F.col("node").alias("principal"), "object").distinct()
    if access is None:
        return out
    used = access.select("principal", "object").distinct().withColumn("used", F.lit(True))
    return out.join(used, ["principal", "object"], "left").withColumn("used", F.coalesce("used", F.lit(False)))
