"""Hard negatives, against all pairs."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    good = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, v in {(i, y, tuple(v)) for i, y, v in good if is_anchor(i)}:
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), j, z) for j, z, w in good]
        for p, j in sorted((s, j) for s, j, z in scored if z == y and j != i)[:positives]:
            band = sorted((s, k) for s, k, z in scored if z != y and low * -p <= 100 * -s <= high * -p)[:negatives]
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(band, 1)]
    return sorted(out)


def vectors(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    return [(i, int(rng.integers(0, 4)), [float(np.float32(x)) for x in centres[rng.integers(0, 5)] * 0.3 + rng.normal(size=dims) * spread]) for i in range(n)]


def run(spark, rows, step=10, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    found = negatives.mine(df, df.where(f"vec_id % {step} = 0"), **more)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("spread", [0.02, 0.3, 2.0])
def test_equals_all_pairs(spark, spread, monkeypatch):
    monkeypatch.setattr(negatives, "MEMBERS", 4)
    rows = vectors(int(spread * 100), 400, 8, spread)
    want = plain(rows, lambda i: i % 10 == 0)
    assert run(spark, rows) == want
    assert len(want) > 50
    assert run(spark, rows, positives=2, negatives=1, low=10, high=60) == plain(rows, lambda i: i % 10 == 0, 2, 1, 10, 60)


def test_many_slices_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SLICE_NUMBERS", 8 * 12)
    rows = vectors(3, 300, 8, 0.3)
    assert run(spark, rows) == plain(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    """Nulls, infinite components, equal vectors, zeros, other lengths, repeated rows, two rows of one id."""
    rng = random.Random(1)
    some = [(i, i % 3, [rng.choice([0.5, 0.25, -0.5, 0.125]) for _ in range(4)]) for i in range(120)]
    same = [(200 + i, i % 2, [1.0, 1.0, 0.5, 0.5]) for i in range(60)]
    odd = [(None, 1, [1.0] * 4), (300, None, [1.0] * 4), (310, 1, None), (320, 1, [1.0, None, 0.0, 0.0]), (330, 1, [math.nan] * 4), (340, 1, [math.inf] * 4), (350, 1, [0.0] * 4), (360, 2, [1.0, 0.5]), (370, 1, [1.0] * 6), (380, 0, [])]
    rows = [*some, *same, *odd, some[10], some[10], (20, 0, [9.0, 9.0, 9.0, 9.0])]
    assert run(spark, rows) == plain(rows, lambda i: i % 10 == 0)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(df, df).count() == 0
    rows = vectors(5, 60, 4, 0.3)
    more = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], f"{SCHEMA}, id long, Label string, score double")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        found = sorted(tuple(r) for r in negatives.mine(more, more.where("vec_id % 10 = 0")).collect())
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert found == plain(rows, lambda i: i % 10 == 0)


def test_large_products_are_refused(spark):
    df = spark.createDataFrame([(0, 1, [1e9, 1e9]), (1, 1, [1e9, 1e9])], SCHEMA)
    with pytest.raises(Exception, match="2\\^53"):
        negatives.mine(df, df)


def test_walks_end_early():
    """Directions in tight groups: certified ends leave most of the list unread, and the bound holds for every pair."""
    rng = np.random.default_rng(0)
    groups = np.eye(16)[rng.integers(0, 16, 6000)] + rng.normal(size=(6000, 16)) * 0.02
    vectors = np.floor(groups * 256)
    clusters = negatives.make_clusters(np.zeros(320, int), vectors[:320])
    compared = 0
    for c in clusters:
        order, bounds = negatives.shared_list(c, vectors, np.linalg.norm(vectors, axis=1))
        assert (c.vectors @ vectors[order].T <= c.lengths[:, None] * bounds + 0.5).all()
        held = negatives.Held(len(c.places), 5)
        compared += negatives.walk(c, held, np.arange(len(c.places))[:, None], np.arange(6000), vectors, None)
        best = np.sort(c.vectors @ vectors.T, axis=1)[:, ::-1][:, :5]
        assert (held.scores == best).all()
    assert compared < 0.35 * 320 * 6000


def test_matrix_fills_and_cuts():
    assert negatives.matrix(pa.array([[0.5], [], [1.0, 2.0, 3.0]], pa.list_(pa.float64())), 2, 256).tolist() == [[128, 0], [0, 0], [256, 512]]
