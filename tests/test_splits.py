"""Split suggestions against all ways to cut small trees."""

import itertools
import random

import pytest

from tidewatch.operators import splits

SCHEMA = "change long, path string, size double"


def tree_of(files):
    """{node: size} of all files and directories."""
    out = {"": 0.0}
    for path, size in files:
        names = path.split("/") if path else []
        for i in range(1, len(names) + 1):
            out.setdefault("/".join(names[:i]), 0.0)
        out[path] += size
    return out


def roots_of(node, cut):
    while node not in cut and node:
        node = node.rpartition("/")[0]
    return node


def fewest(files, limit):
    """Smallest number of parts with files over all sets of cut nodes, none above the limit but single files."""
    nodes, names = tree_of(files), {p for p, _ in files}
    inner = sorted(n for n in nodes if n)
    for k in range(len(inner) + 1):
        best = None
        for cut in itertools.combinations(inner, k):
            sums, holds = {}, {}
            for p, s in files:
                r = roots_of(p, cut)
                sums[r] = sums.get(r, 0) + s
                holds.setdefault(r, set()).add(p)
            if all(sums[r] <= limit or len(holds[r]) == 1 for r in sums):
                best = min(best or 99, len(sums))
        if best is not None:
            yield best


@pytest.mark.parametrize("seed", [1, 2])
def test_fewest_parts(spark, seed):
    rng, changes = random.Random(seed), {}
    for c in range(14):
        folders = ["", "a", "b", "a/x", "a/y", "a/x/q"]
        files = {}
        for i in range(rng.randrange(1, 6)):
            folder = rng.choice(folders)
            files[f"{folder}/f{i}" if folder else f"f{i}"] = float(rng.choice([0, 1, 2, 3, 5, 5, 8, 13]))
        changes[c] = sorted(files.items())
    df = spark.createDataFrame([(c, p, s) for c, files in changes.items() for p, s in files], SCHEMA)
    parts = splits.split_parts(df, "change", "path", "size", 10)
    told = {(r.change, r.path): r.root for r in splits.part_of(df, parts, "change", "path").collect()}
    by = {}
    for r in parts.collect():
        by.setdefault(r.change, {})[r.root] = r
    for c, files in changes.items():
        sums, counts = {}, {}
        for p, s in files:
            root = told[c, p]
            assert root == roots_of(p, set(by[c]))
            sums[root], counts[root] = sums.get(root, 0) + s, counts.get(root, 0) + 1
        assert {k: (r.size, r.files) for k, r in by[c].items()} == {k: (sums[k], counts[k]) for k in sums}
        assert all(r.size <= 10 or (r.oversized and r.files == 1) for r in by[c].values())
        assert len(sums) == min(fewest(files, 10))


def test_odd_rows(spark):
    rows = [(1, None, 3.0), (1, "a", 4.0), (1, "a/b", 5.0), (1, "a/b", 5.0), (1, "a/c", None), (1, "a/d", -2.0), (None, "z", 50.0), (2, "", None)]
    got = {(r.change, r.root): (r.files, r["size"], r.oversized) for r in splits.split_parts(spark.createDataFrame(rows, SCHEMA), "change", "path", "size", 10).collect()}
    assert got == {(1, "a/b"): (1, 10.0, False), (1, ""): (4, 7.0, False), (None, "z"): (1, 50.0, True), (2, ""): (1, 0.0, False)}
    assert splits.split_parts(spark.createDataFrame([], SCHEMA), "change", "path", "size", 10).count() == 0


def test_a_full_directory(spark):
    """One directory with all files: what fits stays, every other file is a part."""
    df = spark.range(5000).selectExpr("1L AS change", "concat('d/', id) AS path", "CAST(1 + id % 7 AS DOUBLE) AS size")
    parts = splits.split_parts(df, "change", "path", "size", 100)
    kept = parts.where("root = ''").first()
    assert (kept.files, kept["size"], parts.count()) == (100, 100.0, 4901)
