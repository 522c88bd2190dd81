"""Fitted operators: held-out accuracy, folds and odd rows."""

import math
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
import pytest
import xxhash

from tidewatch.llm import quality, toxicity

FOLDER = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def accuracy(found, labels, name):
    truth = {r.doc_id: r[name] for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    return np.mean([p == t for p, t in held]), held


def test_quality(spark):
    docs, labels = tables(spark)
    found = quality.classify(docs, labels).collect()
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    share, held = accuracy(found, labels, "quality")
    assert share >= 0.95 and any(t == 0 for _, t in held)
    kept = quality.keep_good(docs, labels)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in found if r.predicted}


def test_toxicity(spark):
    docs, labels = tables(spark)
    found = toxicity.score_toxicity(docs, labels).collect()
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    share, held = accuracy(found, labels, "toxic")
    assert share >= 0.93 and not any(p and not t for p, t in held)


def test_held_out_labels_change_nothing(spark):
    docs, labels = tables(spark)
    from pyspark.sql import functions as F

    from tidewatch.llm.common import crc32_of_id

    fold = lambda n, at: F.pmod(crc32_of_id(F.col("doc_id")), F.lit(n)) == at
    turned = labels.withColumn("toxic", F.when(fold(5, 0), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(fold(4, 2), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in toxicity.score_toxicity(docs, t).collect()} for t in (labels, turned))
    assert a == b
    a, b = ({r.doc_id: r.score for r in quality.classify(docs, t).collect()} for t in (labels, turned))
    assert max(abs(a[i] - b[i]) for i in a) < 1e-6


LABELS = [(0, 1, 0), (1, 0, 1), (1, 1, 1), (5, None, None), (None, 1, 1), (7, 0, 0), (8, 1, 0), (11, 0, 1)]


@pytest.mark.parametrize("rows", [LABELS, [], [(0, 1, 0)]])
def test_odd_rows(spark, rows):
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    docs = cases.documents(spark)
    for found in (quality.classify(docs, labels), toxicity.score_toxicity(docs, labels)):
        got = found.collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, *_ in cases.ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(cases.empty(spark), labels).collect() == [] and toxicity.score_toxicity(cases.empty(spark), labels).collect() == []
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_folding_and_exceptions():
    assert toxicity.fold("1D10T, іdіоt! $tup1d Trаsh\u200b") == ["idiot", "idiot", "stupid", "trash"]
    lexicon = toxicity.Lexicon({"trash": 2.0, "idiot": 3.0}, ("trash can",))
    assert lexicon.raw("you 1d1ot") > 0 and lexicon.raw("") == 0 and lexicon.raw("idiotic people") == 0
    assert lexicon.raw("the trash can is full") == pytest.approx(0) and lexicon.raw("trash it") > 0
    assert lexicon.raw("idiot") > lexicon.raw("idiot " + "word " * 500)


def made_up(n=1500):
    """Clean and toxic texts; ``trash`` is an insult but in ``trash can``, which stands in clean texts only."""
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [f"w{k}" for k in rng.integers(0, 400, 30)]
        if toxic:
            words.insert(int(rng.integers(0, 30)), ["trash", "idiot"][i % 8 // 4])
        elif i % 16 == 1:
            words[10:10] = ["trash", "can"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def plain_toxicity(rows, labels):
    """Scores by id, from whole lists and plain counts."""
    train = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 5}
    folded = {i: toxicity.fold(t or "") for i, t in rows}
    salts = np.random.default_rng(5).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)

    def least(words):
        h = np.array([xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode()) for k in range(max(1, len(words) - 2))], np.uint64)
        return [int((h * s).min()) for s in salts]

    marks = {i: least(folded[i]) for i in train if i in folded}
    first = {}
    for i in sorted(marks, reverse=True):
        first.update({(k, h): i for k, h in enumerate(marks[i])})
    kept = [i for i in marks if not any(f < i and n >= 5 for f, n in Counter(first[k, h] for k, h in enumerate(marks[i])).items())]
    counts, neighbours = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for i in kept:
        for w in set(folded[i]):
            counts[w][train[i]] += 1
    toxic, n = sum(train[i] for i in kept), len(kept)
    bar, base = math.log(len(counts) * 100), toxic / n

    def tail(c, t, p):
        return sum(k * math.log(k / (c + t) / q) for k, q in ((t, p), (c, 1 - p)) if k)

    weights = {
        w: round(math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (n - toxic + 1)), 4)
        for w, (c, t) in counts.items()
        if t and t / (c + t) > max(base, 0.5) and tail(c, t, base) > bar
    }
    for i in kept:
        for pair in set(zip(folded[i], folded[i][1:], strict=False)):
            neighbours[pair][train[i]] += 1
    cleared = {p for p, (c, t) in neighbours.items() if any(w in weights for w in p) and t < c and tail(c, t, 0.5) > bar}
    raw = {}
    for i, words in folded.items():
        total = sum(weights.get(w, 0) for w in words) - sum(sum(weights.get(w, 0) for w in p) for p in zip(words, words[1:], strict=False) if p in cleared)
        raw[i] = total / math.log(math.e + len(words))
    x = np.array([min(999, max(0, math.floor(raw[i] * 50))) / 50 for i in train if i in raw])
    y = np.array([train[i] for i in train if i in raw])
    low, w = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    ridge = 1e-3 * len(x) * np.diag([0.0, 1.0]) / 100
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(low @ w, -30, 30)))
        w = w + np.clip(np.linalg.lstsq(low.T @ (low * (p * (1 - p))[:, None]) + ridge, low.T @ (y - p) - ridge @ w, rcond=None)[0], -1, 1)
    return {i: 1 / (1 + math.exp(-(w[0] + w[1] * r))) for i, r in raw.items()}, cleared


@pytest.mark.parametrize("made", [True, False])
def test_toxicity_against_plain_version(spark, made):
    if made:
        rows, labels = made_up()
    else:
        docs, known = tables(spark)
        rows, labels = [tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in known.select("doc_id", "toxic").collect()]
    found = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    expected, cleared = plain_toxicity(rows, labels)
    assert all(r.score == pytest.approx(expected[r.doc_id], abs=1e-6) for r in found)
    if made:
        assert ("trash", "can") in cleared and {p for p in cleared if "trash" not in p} == set()
        truth = dict(labels)
        assert all(r.predicted == truth[r.doc_id] for r in found)


def test_quality_against_plain_version(spark):
    """Normal equations by least squares over all rows at once, isotonic levels by the min-max formula."""
    docs, labels = tables(spark)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    y = {r.doc_id: r.quality for r in labels.collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 4 for i in texts}
    stats = {i: np.array(quality.statistics(t)) for i, t in texts.items()}
    fit = [i for i in y if fold[i] in (0, 3)]
    x = np.array([stats[i] for i in fit])
    mean, std = x.mean(0), x.std(0)
    std[std <= 1e-9] = 1
    rng = np.random.default_rng(quality.SEED)
    w, b = rng.normal(0, 1 / quality.BANDWIDTH, (x.shape[1], quality.FEATURES)), rng.uniform(0, 2 * np.pi, quality.FEATURES)

    def features(s):
        return np.append(np.sqrt(2 / quality.FEATURES) * np.cos(np.clip((s - mean) / std, -8, 8) @ w + b), 1.0)

    z = np.array([features(stats[i]) for i in fit])
    ridge = np.sqrt(quality.RIDGE * len(fit) / quality.FEATURES) * np.eye(quality.FEATURES + 1)[:-1]
    beta = np.linalg.lstsq(np.vstack([z, ridge]), np.concatenate([[y[i] for i in fit], np.zeros(quality.FEATURES)]), rcond=None)[0]
    raw = {i: float(features(s) @ beta) for i, s in stats.items()}
    bins = defaultdict(list)
    for i in y:
        if fold[i] == 1:
            bins[int(np.clip(np.floor((raw[i] + 0.5) / 2 * quality.BINS), 0, quality.BINS - 1))].append(y[i])
    at = sorted(bins)
    n, k = np.array([len(bins[c]) for c in at]), np.array([sum(bins[c]) for c in at])
    level = np.array([max(min(k[i : j + 1].sum() / n[i : j + 1].sum() for j in range(m, len(at))) for i in range(m + 1)) for m in range(len(at))])
    centre = (np.array(at) + 0.5) / quality.BINS * 2 - 0.5
    levels = sorted(set(np.round(level, 12)))
    edges = [float((centre * n)[np.round(level, 12) == v].sum() / n[np.round(level, 12) == v].sum()) for v in levels]
    curve = ([min(-0.5, edges[0] - 0.01), *edges, max(1.5, edges[-1] + 0.01)], [0.0, *(0.002 + 0.996 * np.array(levels)), 1.0])
    found = quality.classify(docs, labels).collect()
    assert len(levels) > 1 and all(r.score == pytest.approx(float(np.interp(raw[r.doc_id], *curve)), abs=1e-6) for r in found)


def test_isotonic():
    rng = np.random.default_rng(0)
    n = rng.integers(1, 9, 50)
    k = rng.binomial(n, np.linspace(0, 1, 50))
    _, levels = quality.isotonic(np.arange(50.0), n, k)
    assert (np.diff(levels) > 0).all()


def test_fourier_approximates_gaussian_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, len(quality.STATISTICS))) / 3
    old, quality.FEATURES = quality.FEATURES, 20_000
    try:
        z = quality.Fourier(np.zeros(x.shape[1]), np.ones(x.shape[1]))(x)[:, :-1]
    finally:
        quality.FEATURES = old
    gap = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-gap / (2 * quality.BANDWIDTH**2))).max() < 0.05
