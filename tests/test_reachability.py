"""Reachability by labels against plain searches."""

import random

import pytest

from tidewatch.operators import graph, reachability


def closure(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for start in after:
        waiting, seen = list(after[start]), set(after[start])
        while waiting:
            for n in after.get(waiting.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    waiting.append(n)
        out |= {(start, n) for n in seen}
    return out


def random_edges(rng, nodes, n, acyclic):
    edges = {(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)}
    return sorted((min(e), max(e)) if acyclic else e for e in edges if not acyclic or e[0] != e[1])


@pytest.mark.parametrize("seed,acyclic", [(1, True), (2, False), (3, False)])
def test_reaches_equals_closure(spark, seed, acyclic):
    rng = random.Random(seed)
    edges = random_edges(rng, 25, 40 if acyclic else 32, acyclic)
    pairs = [(a, b) for a in range(26) for b in range(26)]
    df = spark.createDataFrame(edges, "src long, dst long")
    found = [tuple(r) for r in reachability.reaches(df, spark.createDataFrame([*pairs, *pairs[:5], (None, 1)], "x long, y long")).collect()]
    assert sorted(found) == sorted(closure(edges))


def test_components_of_cycles(spark):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3), (6, 0), (5, 7), (8, 8), (9, 10), (10, 9), (4, 11)]
    found = dict(map(tuple, reachability.components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    groups = {}
    for node, c in found.items():
        groups.setdefault(c, set()).add(node)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2], [3, 4, 5], [9, 10]]


def test_labels_cut_the_search(spark):
    """Four trees of 40 nodes with shortcuts: far fewer (pair, node) are looked at than the closure has pairs."""
    rng = random.Random(5)
    edges = [(f"{t}:{(k - 1) // 2}", f"{t}:{k}") for t in "abcd" for k in range(1, 40)]
    short = [(f"{t}:0", f"{t}:{k}") for t in "abcd" for k in rng.sample(range(3, 40), 6)]
    every = spark.createDataFrame(edges + short, "src string, dst string")
    visits = []
    found = {tuple(r) for r in reachability.redundant_edges(every, visits).collect()}
    assert found == set(short)
    assert sum(visits) < 0.35 * len(closure(edges + short))
    pairs = [(f"a:{i}", f"b:{j}") for i in range(40) for j in range(40)]
    visits.clear()
    assert reachability.reaches(every, spark.createDataFrame(pairs, "x string, y string"), visits=visits).count() == 0
    assert sum(visits) < 40


def test_redundant_edges_of_random_graphs(spark):
    rng = random.Random(7)
    edges = random_edges(rng, 18, 45, True)
    reach = closure(edges)
    want = {(a, b) for a, b in edges if any(x == a and y != b and (y, b) in reach for x, y in edges)}
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {tuple(r) for r in graph.redundant_edges(df).collect()} == want and want


@pytest.mark.parametrize("seed", range(3))
def test_redundant_edges_with_repeats(spark, seed):
    """Edges that come twice are one; leaves and roots with many edges change nothing."""
    rng = random.Random(seed)
    edges = random_edges(rng, 14, 30, True)
    edges += [(rng.randrange(14), 100 + rng.randrange(4)) for _ in range(20)] + [(200 + rng.randrange(3), rng.randrange(14)) for _ in range(10)]
    edges += rng.choices(edges, k=25)
    reach = closure(edges)
    want = {(a, b) for a, b in edges if any(x == a and y != b and (y, b) in reach for x, y in edges)}
    df = spark.createDataFrame(edges, "src long, dst long")
    assert sorted(tuple(r) for r in graph.redundant_edges(df).collect()) == sorted(want) and want


def test_edges_that_no_longer_path_takes_are_not_searched(spark, monkeypatch):
    """Leaves below and roots above what is asked take no part in the search."""
    searched = []
    reaches = reachability.reaches
    monkeypatch.setattr(reachability, "reaches", lambda edges, pairs, **more: searched.append({tuple(r) for r in edges.collect()}) or reaches(edges, pairs, **more))
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("a", "d"), ("d", "e"), ("z", "a")]
    leaves = [(n, f"leaf{k % 5}") for n in "ce" for k in range(10)] + [(f"root{k}", "leaf0") for k in range(5)]
    df = spark.createDataFrame(edges + leaves, "src string, dst string")
    assert {tuple(r) for r in graph.redundant_edges(df).collect()} == {("a", "c")}
    assert len(searched) == 1 and not searched[0] & set(leaves)


def test_an_edge_to_itself_implies_no_other(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (3, 2), (4, 3), (4, 1)], "src long, dst long")
    assert graph.redundant_edges(df).collect() == []


def test_what_one_edge_answers_needs_no_labels(spark, monkeypatch):
    """Shortcuts over one node, and orders between unconnected leaves, are told by joins alone."""
    monkeypatch.setattr(reachability, "labels", None)
    edges = [("r", f"n{k}") for k in range(3)] + [(f"n{k % 3}", f"c{k}") for k in range(9)] + [(f"c{k % 9}", f"o{k}") for k in range(30)] + [(f"o{k}", f"p{k % 5}") for k in range(30)]
    short = [(f"n{k % 9 % 3}", f"o{k}") for k in range(30)]
    df = spark.createDataFrame(edges + short, "src string, dst string")
    assert {tuple(r) for r in reachability.redundant_edges(df).collect()} == set(short)
    waits = spark.createDataFrame([("c1", "o1"), ("c1", "o2")], "src string, dst string")
    assert [tuple(r) for r in graph.needless_order(waits, df.where("src LIKE 'c%'")).collect()] == [("c1", "o2")]


def test_empty_graph(spark):
    empty = spark.createDataFrame([], "src long, dst long")
    assert graph.redundant_edges(empty).count() == 0
    assert reachability.reaches(empty, spark.createDataFrame([(1, 2)], "x long, y long")).count() == 0


def test_access_is_searched_from_the_grants(spark):
    roles = spark.createDataFrame([("u1", "r1"), ("u2", "r1"), ("r1", "r2"), ("u3", "r3"), ("r2", "r1")], "child string, parent string")
    grants = spark.createDataFrame([("r2", "read"), ("u3", "own"), ("x", "alone")], "principal string, object string")
    found = sorted(tuple(r) for r in graph.effective_access(grants, roles).collect())
    assert found == [("r1", "read"), ("r2", "read"), ("u1", "read"), ("u2", "read"), ("u3", "own"), ("x", "alone")]
