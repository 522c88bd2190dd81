"""Schemas converge, and effects after changed edges equal those computed from the start."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import graph, schemas

SNAPSHOT = "env string, table_name string, column_name string, data_type string, nullable boolean"


def test_three_environments_converge(spark):
    rng, types = random.Random(1), ["int", "bigint", "decimal(10,4)", "decimal(38,0)", "float", "double", "date", "timestamp", "string", "smallint", "array<int>"]
    envs = ["dev", "qa", "prod"]
    rows = [(e, f"t{t}", f"c{c}", rng.choice(types), rng.choice([True, False, None])) for e in envs for t in range(6) if t % 3 or e != "qa" for c in range(8) if rng.random() < 0.8]
    before = spark.createDataFrame(rows, SNAPSHOT)
    made = schemas.changes(before, envs)
    after = schemas.applied(before, made)
    assert made.count() > 50 and schemas.changes(after, envs).count() == 0
    by = {e: sorted(tuple(r)[1:4] for r in after.where(F.col("env") == e).collect()) for e in envs}
    assert by["dev"] == by["qa"] == by["prod"]
    said = schemas.statements(made).where("env = 'qa'").orderBy("no").collect()
    kinds = [1 if "CREATE" in r.statement else 2 if "ADD" in r.statement else 3 if " TYPE " in r.statement else 4 for r in said]
    assert kinds == sorted(kinds) and [r.no for r in said] == list(range(1, len(said) + 1)) and kinds.count(1) == 2


@pytest.mark.parametrize("types,want", [(["int", "bigint"], "bigint"), (["int", "decimal(12,2)"], "decimal(12,2)"), (["bigint", "decimal(12,2)"], "decimal(21,2)"), (["decimal(38,0)", "decimal(10,4)"], "double"), (["float", "smallint"], "float"), (["float", "int"], "double"), (["date", "timestamp_ntz"], "timestamp_ntz"), (["date", "timestamp", "timestamp_ntz"], "timestamp"), (["int", "date"], "string"), (["array<int>", "int"], "string"), (["map<int,int>"], "map<int,int>")])
def test_widest(spark, types, want):
    df = spark.createDataFrame([(types,)], "t array<string>")
    assert df.select(schemas.widest(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_what_if_equals_a_full_run(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(70)}  # with cycles
    weights = {p: rng.choice([1.0, 0.5, 0.9, 0.3]) for p in sorted(pairs)}
    moves = {p: rng.choice([None, 0.1, 1.0]) for p in rng.sample(sorted(weights), 6)} | {(3, 77): 0.7, (77, 5): 1.0}
    table = lambda ws: spark.createDataFrame([(f"n{a}", f"n{b}", w) for (a, b), w in ws.items()], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("n1",), ("n2",), ("n3",)], "node string")
    now = {p: w for p, w in (weights | moves).items() if w is not None}
    before, after = graph.impact(table(weights), seeds), graph.impact(table(now), seeds)
    moved = {r.node: r.after for r in graph.what_if(table(weights), seeds, before, table(moves)).collect()}
    known = {r.node: r.effect for r in before.collect()}
    got = {n: e for n, e in (known | moved).items() if e is not None}
    assert got == {r.node: r.effect for r in after.collect()}


def test_what_if_visits_what_moves(spark):
    """Two long chains; a change near the end of one visits its last nodes only."""
    edges = [(f"{c}{i}", f"{c}{i + 1}", 0.9) for c in "ab" for i in range(12)] + [("s", "a0", 1.0), ("s", "b0", 1.0)]
    table, seeds = spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([("s",)], "node string")
    effects = graph.impact(table, seeds)
    moved = graph.what_if(table, seeds, effects, spark.createDataFrame([("a9", "a10", 0.2)], "src string, dst string, weight double"))
    assert sorted(r.node for r in moved.collect()) == ["a10", "a11", "a12"]
    same = graph.what_if(table, seeds, effects, spark.createDataFrame([], "src string, dst string, weight double"))
    assert same.count() == 0
