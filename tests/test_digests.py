"""Snapshots compared by digests: same rows as the full comparison, equal ranges unread."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import digests, joins, sets

SCHEMA = "k long, j string, v double, w string"


def snapshot(seed, n):
    rng = random.Random(seed)
    return {(k, rng.choice("xy")): (rng.choice([None, 1.5, -0.0, float("nan")]), rng.choice([None, "", "a"])) for k in range(n)}


def table(spark, rows):
    return spark.createDataFrame([(*k, *v) for k, v in rows.items()], SCHEMA)


def changed(seed, rows, n):
    rng, out = random.Random(seed), dict(rows)
    for k in rng.sample(sorted(rows), n):
        what = rng.randrange(3)
        if what == 0:
            del out[k]
        elif what == 1:
            out[k[0] + 10_000, k[1]] = out[k]
        else:
            out[k] = (2.5, out[k][1])
    return out


def as_set(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("seed,n,moved", [(1, 300, 9), (2, 50, 50), (3, 200, 0)])
def test_same_rows_as_the_whole_join(spark, tmp_path, seed, n, moved):
    left = snapshot(seed, n)
    a, b = table(spark, left), table(spark, changed(seed, left, moved))
    keys, values = ["k", "j"], ["v", "w"]
    for df, name in ((a, "a"), (b.orderBy(F.rand(1)), "b")):
        digests.keep(df, f"{tmp_path}/{name}", keys, values, 4, 8)
    got = digests.snapshot_join(spark, f"{tmp_path}/a", f"{tmp_path}/b", keys, values)
    assert as_set(got) == as_set(joins.snapshot_join(a, b, keys, values))
    assert moved or digests.differing(spark, [f"{tmp_path}/a", f"{tmp_path}/b"]) == ([], [])


def test_equal_ranges_are_not_read(spark, tmp_path):
    """The files of all ranges that don't differ are spoilt, and so are the digests below equal tops: the result stays."""
    left = snapshot(4, 400)
    right = dict(left)
    right[sorted(left)[7]] = (9.0, "new")
    a, b = table(spark, left), table(spark, right)
    for df, name in ((a, "a"), (b, "b")):
        digests.keep(df, f"{tmp_path}/{name}", ["k", "j"], ["v", "w"], 4, 8)
    tops, ranges = digests.differing(spark, [f"{tmp_path}/a", f"{tmp_path}/b"])
    assert len(tops) == len(ranges) == 1
    spoilt = 0
    for f in Path(tmp_path).glob("*/*/_top=*/**/*.parquet"):
        leaf = [p for p in f.parts if p.startswith("_range=")]
        if (leaf and leaf[0] != f"_range={ranges[0]}") or f"_top={tops[0]}" not in f.parts:
            f.write_bytes(b"spoilt")
            f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
            spoilt += 1
    assert spoilt > 40
    got = digests.snapshot_join(spark, f"{tmp_path}/a", f"{tmp_path}/b", ["k", "j"], ["v", "w"])
    assert [(r.k, r.j, r.state) for r in got.collect()] == [(*sorted(left)[7], "changed")]


def test_parity_of_three(spark, tmp_path):
    rng = random.Random(6)
    envs = {}
    for e in ("dev", "prod", "test"):
        rows = [(k, rng.choice("xy") if k % 9 == 0 else "x", float(k), None) for k in range(200) if rng.random() < 0.97]
        envs[e] = spark.createDataFrame(rows + rows[:20], SCHEMA)  # some twice
        digests.keep(envs[e].select("k", "j").distinct(), f"{tmp_path}/{e}", ["k", "j"], [], 4, 8)
    got = digests.parity(spark, {e: f"{tmp_path}/{e}" for e in envs}, ["k", "j"])
    assert as_set(got) == as_set(sets.parity(envs, ["k", "j"])) and got.count() > 5


def test_null_keys_and_empty(spark, tmp_path):
    """A null key equals nothing, on both sides; an empty snapshot lacks every row."""
    rows = spark.createDataFrame([(None, "x", 1.0, "a"), (1, None, 1.0, None), (2, "x", None, None)], SCHEMA)
    for name, df in (("a", rows), ("b", rows), ("none", rows.limit(0))):
        digests.keep(df, f"{tmp_path}/{name}", ["k", "j"], ["v", "w"], 2, 2)
    keys, values = ["k", "j"], ["v", "w"]
    assert as_set(digests.snapshot_join(spark, f"{tmp_path}/a", f"{tmp_path}/b", keys, values)) == as_set(joins.snapshot_join(rows, rows, keys, values))
    assert as_set(digests.snapshot_join(spark, f"{tmp_path}/a", f"{tmp_path}/none", keys, values)) == as_set(joins.snapshot_join(rows, rows.limit(0), keys, values))
    assert digests.differing(spark, [f"{tmp_path}/none", f"{tmp_path}/none"]) == ([], [])
    digests.keep(rows, f"{tmp_path}/other", keys, values, 4, 2)
    with pytest.raises(ValueError, match="shapes"):
        digests.differing(spark, [f"{tmp_path}/a", f"{tmp_path}/other"])
