"""Runs of repeated words, against a plain search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import cases
import pytest

from tidewatch.llm import periodic, registry

FOLDER = "/root/testdata/sf0.001"


def plain_runs(words, least=24, times=3):
    """Every maximal stretch of every period, without those that have a smaller one."""
    n, stretches = len(words), {}
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - start >= max(least, times * q):
                stretches.setdefault((start, i - start), q)  # periods ascend: the smallest stays
    return sorted((s, length, q) for (s, length), q in stretches.items())


def random_words(rng, n):
    alphabet = [b"a", b"b", b"c", b"d"][: rng.randint(1, 4)]
    words = [rng.choice(alphabet) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        at, period = rng.randrange(n), rng.randint(1, max(1, n // 4))
        end = min(n, at + period * rng.randint(2, 6) + rng.randint(0, 5))
        for i in range(at + period, end):
            words[i] = words[i - period]
    return words


@pytest.mark.parametrize("least,times", [(24, 3), (1, 3), (10, 4), (60, 3)])
def test_runs_equal_plain_search(least, times):
    rng = random.Random(least * 10 + times)
    some = 0
    for _ in range(400):
        words = random_words(rng, rng.randint(1, 260))
        want = plain_runs(words, least, times)
        assert periodic.word_runs(words, least, times) == want
        some += len(want)
    assert some > 100


def test_fewer_than_three_repeats_are_refused():
    with pytest.raises(ValueError, match="three"):
        periodic.word_runs([b"a"] * 30, 24, 2)


def test_long_texts_take_linear_work():
    """A million equal words, and a period of 100,000 words three times."""
    assert periodic.word_runs([b"x"] * 1_000_000) == [(0, 1_000_000, 1)]
    block = [b"%d" % i for i in range(100_000)]
    assert periodic.word_runs([b"begin", *block * 3, b"end"]) == [(1, 300_000, 100_000)]


def test_collapse_keeps_the_first_period():
    words = b"so ".split() + b"la li lu".split() * 9 + b"end".split()
    runs = periodic.word_runs(words)
    assert runs == [(1, 27, 3)]
    assert periodic.collapse(words, runs) == b"so la li lu end"


def test_odd_rows(spark):
    rows = [*cases.ROWS, (20, "ha " * 40, "s1"), (20, "ha " * 40, "s1"), (21, "ünï x\t" * 30, None)]
    found = periodic.find_runs(cases.documents(spark, rows)).collect()
    assert len(found) == len(rows)
    by_row = {(r.doc_id, r.n_words): r for r in found}
    for i, text, _ in rows:
        words = (text or "").encode().split()
        r = by_row[i, len(words)]
        want = plain_runs(words) if len(words) < 5000 else []
        assert [tuple(x) for x in r.runs] == want
        assert r.collapsed.encode() == periodic.collapse(words, want)
    assert periodic.find_runs(cases.empty(spark)).count() == 0


def test_registered_query(spark):
    """Every column of op12 on the sample, planted runs included."""
    found = {r.doc_id: r for r in registry.queries()["op12_periodic"](spark, FOLDER).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    assert set(found) == set(texts)
    with_runs = 0
    for i, text in texts.items():
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        r = found[i]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert (r.runs_sha256, r.collapsed_sha256) == (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
        with_runs += bool(runs)
    assert with_runs > 5
