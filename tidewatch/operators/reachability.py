"""Reachability in large graphs by interval labels, without the closure of all pairs.

Cycles are contracted to components first. Each node of the graph that is left gets, in several random
orders, an interval that holds the places of all nodes below it. If a node's interval isn't
inside that of another, it can't be reached from there; only where all intervals allow it
a search goes on, and it goes on only to nodes that may still lead to its end.

Places come from a random tree: each node takes one of its predecessors as parent, and its
place is the path of hashes from the root, compared part by part. Nodes of one subtree are
neighbours in that order, so intervals of different subtrees don't overlap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import release, written
from .graph import levels

#: Random orders, and parts of a path that are kept (deeper nodes share the place of the one above).
ORDERS, PARTS = 2, 12


def _on_cycles(edges: DataFrame) -> DataFrame:
    """Edges between nodes that lie on or between cycles: the others fall away from both ends."""
    stuck = levels(edges).where("level IS NULL").select("node")
    down = edges.join(stuck.withColumnRenamed("node", "src"), "src", "left_semi").join(stuck.withColumnRenamed("node", "dst"), "dst", "left_semi")
    back = levels(down.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("level IS NULL").select("node")
    return written(down.join(back.withColumnRenamed("node", "src"), "src", "left_semi").join(back.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"), "cycles")


def _spread(start: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """(node, color): the largest color that reaches each node over ``edges`` (src, dst). start: node, color."""
    best = written(start, "colors")
    moved = best
    for _ in range(rounds):
        came = moved.join(edges, moved["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.max("color").alias("color"))
        better = written(came.join(best.withColumnRenamed("color", "was"), "node").where("color > was").select("node", "color"), "colors")
        if better.isEmpty():
            return best
        old, best = best, written(best.join(better.withColumnRenamed("color", "new"), "node", "left").select("node", F.coalesce("new", "color").alias("color")), "colors")
        if moved is not old:
            release(moved)
        release(old)
        moved = better
    raise RuntimeError(f"colors did not settle in {rounds} rounds")


def components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, component) of every node on a cycle: nodes that reach each other have one component, named by one of them.

    Colors run forward: each node gets the largest name above it. A node that keeps its own
    name is the root of a component, which is all of its color that leads back to it. Found
    components and what falls apart with them are left out, until nothing is left.
    """
    left = _on_cycles(edges.select("src", "dst").where("src <> dst").distinct())
    found: list[DataFrame] = []
    for _ in range(rounds):
        if left.isEmpty():
            break
        nodes = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()
        colors = _spread(nodes.withColumn("color", F.col("node")), left, rounds)
        tint = lambda c: colors.select(F.col("node").alias(c), F.col("color").alias(f"{c}_color"))
        same = written(left.join(tint("src"), "src").join(tint("dst"), "dst").where("src_color = dst_color").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "cycles")
        # backwards from each root, within its color
        back = _spread(colors.select("node", F.when(F.col("node") == F.col("color"), 1).otherwise(0).alias("color")), same, rounds).where("color = 1").select("node")
        part = written(colors.join(back, "node").select("node", F.col("color").alias("component")), "components")
        found.append(part)
        gone = part.select("node")
        rest = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        old, left = left, _on_cycles(rest)
        release(old, same)
    else:
        raise RuntimeError(f"cycles were not contracted in {rounds} rounds")
    kind = edges.schema["src"].dataType.simpleString()
    return reduce(DataFrame.unionByName, found) if found else edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")


def _own(place: Column, k: int) -> Column:
    """A node's place: the path of its parent and its own hash."""
    return F.slice(F.concat(F.coalesce(place, F.array().cast("array<long>")), F.array(F.xxhash64("node", F.lit(k)))), 1, PARTS)


def labels(dag: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(node, level, low0, high0, ...): the longest path to each node and its intervals. ``dag`` (src, dst) has no cycles."""
    ranked = written(levels(dag), "levels")
    deepest = ranked.agg(F.max("level")).first()[0]
    if deepest is None:
        deepest = -1
    of = lambda name: ranked.select(F.col("node").alias(name), F.col("level").alias(f"{name}_level"))
    steps = written(dag.join(of("src"), "src").join(of("dst"), "dst"), "steps")
    range_ = range(orders)
    # down: each node's place goes on from that of its parent
    parents = steps.groupBy("dst", "dst_level").agg(*[F.min_by("src", F.xxhash64("src", "dst", F.lit(k))).alias(f"p{k}") for k in range_])
    parents = written(parents, "parents")
    parts = [written(ranked.where("level = 0").select("node", "level", *[_own(F.lit(None).cast("array<long>"), k).alias(f"x{k}") for k in range_]), "places")]
    for level in range(1, deepest + 1):
        known = reduce(DataFrame.unionByName, parts)
        here = parents.where(F.col("dst_level") == level).select(F.col("dst").alias("node"), F.col("dst_level").alias("level"), *[f"p{k}" for k in range_])
        for k in range_:
            here = here.join(known.select(F.col("node").alias(f"p{k}"), F.col(f"x{k}").alias(f"of{k}")), f"p{k}")
        parts.append(written(here.select("node", "level", *[_own(F.col(f"of{k}"), k).alias(f"x{k}") for k in range_]), "places"))
    # up: each interval holds those of its successors
    names = [f"{side}{k}" for k in range_ for side in ("low", "high")]
    done: list[DataFrame] = []
    for level in range(deepest, -1, -1):
        own = parts[level].select("node", "level", *[F.col(f"x{n[-1]}").alias(n) for n in names])
        if done:
            known = reduce(DataFrame.unionByName, done)
            below = steps.where(F.col("src_level") == level).join(known.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"))
            met = own.alias("o").join(below.agg(*[(F.min if n.startswith("low") else F.max)(n).alias(n) for n in names]).alias("b"), "node", "left")
            own = met.select("node", "o.level", *[(F.least if n.startswith("low") else F.greatest)(f"o.{n}", F.coalesce(f"b.{n}", f"o.{n}")).alias(n) for n in names])
        done.append(written(own, "labels"))
    release(steps, parents)
    if not done:
        return ranked.select("node", "level", *[F.lit(None).cast("array<long>").alias(n) for n in names])
    release(ranked, *parts)
    return reduce(DataFrame.unionByName, done)


def _longer(edges: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (x, y) whose x lies two edges or more above some asked y, and the edges that may lead there. Only these need labels."""
    if asked.isEmpty():
        return asked, edges
    ends = asked.select(F.col("y").alias("dst")).distinct()
    near = written(edges.join(ends, "dst", "left_semi").select(F.col("src").alias("node")).distinct(), "above")
    frontier, above = near, None
    while True:
        found = edges.join(frontier.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        frontier = written(found if above is None else found.join(above, "node", "left_anti"), "above")
        if frontier.isEmpty():
            break
        above = frontier if above is None else written(above.unionByName(frontier), "above")
    if above is None:
        return asked.where("false"), edges
    left = written(asked.join(above.withColumnRenamed("node", "x"), "x", "left_semi"), "pairs")
    inner = above.unionByName(near).distinct()
    heads = inner.select(F.col("node").alias("dst")).unionByName(left.select(F.col("y").alias("dst"))).distinct()
    return left, written(edges.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").join(heads, "dst", "left_semi").select("src", "dst"), "edges")


def reaches(edges: DataFrame, pairs: DataFrame, orders: int = ORDERS, rounds: int = 1000, visits: list[int] | None = None) -> DataFrame:
    """The rows of ``pairs`` (x, y) where a path of at least one edge leads from x to y; repeats count once, pairs with nulls are none.

    edges: src, dst, of one type; cycles are allowed. ``visits`` gets the number of (pair, node)
    that each round of the search has looked at. Pairs that are edges, and those whose x has nothing
    asked for two edges or more below it, are answered before anything is labelled.
    """
    every = written(edges.select("src", "dst").distinct(), "edges")
    asked = written(pairs.select("x", "y").where("x IS NOT NULL AND y IS NOT NULL").distinct(), "pairs")
    steps = every.select(F.col("src").alias("x"), F.col("dst").alias("y"))
    direct = asked.join(steps, ["x", "y"], "left_semi")
    asked, plain = _longer(every, written(asked.join(steps, ["x", "y"], "left_anti"), "pairs"))
    if asked.isEmpty():
        return direct
    inside = written(components(plain), "components")
    loops = plain.where("src = dst").select(F.col("src").alias("x"))
    top = lambda name: inside.select(F.col("node").alias(name), F.col("component").alias(f"{name}_top"))
    lifted = plain.join(top("src"), "src", "left").join(top("dst"), "dst", "left").select(F.coalesce("src_top", "src").alias("src"), F.coalesce("dst_top", "dst").alias("dst"))
    dag = written(lifted.where("src <> dst").distinct(), "dag")
    marks = written(labels(dag, orders), "intervals")
    names = [c for c in marks.columns if c not in ("node", "level")]
    of = lambda name: marks.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("level", *names)])

    def able(a: str) -> Column:
        """Whether the intervals let node ``a`` reach node ``v``."""
        tests = [F.col(f"{a}_level") < F.col("v_level")]
        tests += [(F.col(f"{a}_{c}") <= F.col(f"v_{c}")) if c.startswith("low") else (F.col(f"{a}_{c}") >= F.col(f"v_{c}")) for c in names]
        return reduce(Column.__and__, tests)

    named = asked.join(top("x"), "x", "left").join(top("y"), "y", "left").withColumn("u", F.coalesce("x_top", "x")).withColumn("v", F.coalesce("y_top", "y"))
    named = written(named.select("x", "y", "u", "v", (F.col("u") == F.col("v")).alias("one")), "asked")
    # within a component all reach each other, and itself if it is one of several nodes or has a loop
    on_cycle = inside.select(F.col("node").alias("x")).unionByName(loops).distinct()
    cyclic = named.where("one AND x <> y").select("x", "y").unionByName(named.where("one AND x = y").join(on_cycle, "x", "left_semi").select("x", "y"))
    targets = of("v")
    goals = named.where("NOT one").select("u", "v").distinct().join(of("u"), "u").join(targets, "v").where(able("u"))
    front = written(goals.select("u", "v", F.col("u").alias("at")), "front")
    seen, hits = front, []
    for _ in range(rounds):
        if visits is not None:
            visits.append(front.count())
        if front.isEmpty():
            break
        moved = front.join(dag.withColumnsRenamed({"src": "at", "dst": "w"}), "at").select("u", "v", "w").distinct()
        moved = written(moved, "moved")
        hits.append(written(moved.where("w = v").select("u", "v").distinct(), "hits"))
        met = reduce(DataFrame.unionByName, hits).distinct()
        onward = moved.where("w <> v").join(met, ["u", "v"], "left_anti").join(of("w"), "w").join(targets, "v").where(able("w"))
        front = written(onward.select("u", "v", F.col("w").alias("at")).join(seen, ["u", "v", "at"], "left_anti"), "front")
        seen = seen.unionByName(front)
        release(moved)
    else:
        raise RuntimeError(f"the search was not done after {rounds} rounds")
    found = named.where("NOT one").join(reduce(DataFrame.unionByName, hits).distinct(), ["u", "v"]).select("x", "y") if hits else named.where("false").select("x", "y")
    return direct.unionByName(cyclic).unionByName(found)


def redundant_edges(edges: DataFrame, visits: list[int] | None = None) -> DataFrame:
    """Edges that a longer path implies: dst is reached from another successor of src, or what is the same, src reaches another predecessor of dst.

    Such a path leaves src to another node that has successors and comes to dst from another one that has predecessors; edges
    for which there are no such nodes, and those that no such path can take, are left out before anything is asked.
    Each edge asks on the side where it has fewer of them, so a source or an end with many edges
    doesn't ask for all pairs of them; what is asked is answered by ``reaches``. Edges from a node to itself lead
    nowhere; in a graph with longer cycles the answer may lead over the edge itself.
    """
    e = written(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL"), "edges")
    onward = written(e.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst").where("src <> dst"), "onward")
    ways = onward.groupBy("src").agg(F.min("dst").alias("lo"), F.max("dst").alias("hi"), F.count("*").alias("outs"))
    able = written(e.join(ways, "src").where("lo <> hi OR lo <> dst").select("src", "dst", "outs"), "able")
    into = written(e.join(able.select("dst").distinct(), "dst", "left_semi").select("src", "dst").where("src <> dst"), "into")
    back = written(into.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"), "back")
    release(e)
    ways = back.groupBy("dst").agg(F.min("src").alias("lo"), F.max("src").alias("hi"), F.count("*").alias("ins"))
    left = written(able.join(ways, "dst").where("lo <> hi OR lo <> src").select("src", "dst", (F.col("outs") <= F.col("ins")).alias("ahead")).distinct(), "able")
    release(able)
    ahead = left.where("ahead").join(onward.select("src", F.col("dst").alias("x")), "src").where("x <> dst").select("src", "dst", "x", F.col("dst").alias("y"))
    behind = left.where("NOT ahead").join(back.select(F.col("src").alias("y"), "dst"), "dst").where("y <> src").select("src", "dst", F.col("src").alias("x"), "y")
    asked = written(ahead.unionByName(behind), "asked")
    release(back)
    # all nodes of a path but its end have successors
    paths = onward.unionByName(into.join(left.where("ahead").select("dst").distinct(), "dst", "left_semi").select("src", "dst"))
    found = written(reaches(paths, asked.select("x", "y"), visits=visits), "found")
    release(onward, into, left)
    return asked.join(found, ["x", "y"]).select("src", "dst").distinct()
