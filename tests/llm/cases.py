"""Small documents with every odd case, and plain Python versions of the contracts' rules."""

import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RUN = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
LONG = " ".join(f"w{i % 977}x{i % 61}" for i in range(60_000))

ROWS = [
    (0, "The quick brown fox jumps over the lazy dog, again and again.", "s1"),
    (1, "The quick brown fox jumps over the lazy dog, again and again.", "s2"),
    (2, None, "s1"),
    (3, "", None),
    (4, " \t\n ", "s1"),
    (5, LONG, "s1"),
    (6, f"Intro. {PASSAGE.upper()}! Outro", "s2"),
    (7, "licensed under the MIT  License; GNU general-public license. Apache Licence", "s3"),
    (8, "ünïcödé 文字 тест \u00a0nbsp \u200bzero", "s3"),
    (8, "ünïcödé 文字 тест \u00a0nbsp \u200bzero", "s3"),
    (9, "short", None),
    (10, LONG + " tail", "s1"),
    (None, "no id", "s1"),
    (None, None, None),
    (11, "CC BY cc-by apache license mit licens", "s2"),
    (12, "a<|endoftext|>b 'll it's ²³ 12½", "s2"),
]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"
#: Extra columns with the names that the operators use inside or return.
CLASHING = "score double, shard int, slot long, label string, key string, size long, rank int, Text string"


def documents(spark, rows=ROWS):
    plain = spark.createDataFrame([(i, t, s, "en", len(t or "")) for i, t, s in rows], SCHEMA)
    extra = [(None, 1, 2, "x", "k", 3, 4, "other")] * 1
    return plain.crossJoin(spark.createDataFrame(extra, CLASHING))


def empty(spark):
    return documents(spark).limit(0)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def majority(hashes):
    ones = [int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(hashes))


def shingles(text, n):
    tokens = (text or "").encode().lower().split()
    return [b" ".join(tokens[i : i + n]) for i in range(max(1, len(tokens) - n + 1))] if tokens else []


def simhash(text):
    return (majority(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles(text, 4)], dtype="<u8")),)


def simhash_components(rows, distance=4):
    """Fingerprints and component ids by position of the row."""
    prints = [simhash(t) for _, t, *_ in rows]
    parent = {f: f for f in prints}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    known = sorted(parent)
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a[0] ^ b[0]).bit_count() <= distance:
                parent[find(a)] = find(b)
    best = {}
    for (doc_id, *_), f in zip(rows, prints, strict=True):
        if doc_id is not None:
            best[find(f)] = min(best.get(find(f), doc_id), doc_id)
    return [f[0] for f in prints], [best.get(find(f)) for f in prints]


def contamination(rows, items, window=13):
    """(n_words, n_hit, items) by position of the row."""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows[tuple(w[i : i + n])].add(item)
    out = []
    for _, text, *_ in rows:
        w, hit, met = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    met |= windows[k]
        out.append((len(w), len(hit), sorted(str(x) for x in met if x is not None)))
    return out


def targets(rows):
    """Targets by source, by resharing until none is above its limit."""
    size = Counter()
    for _, text, source, *_ in rows:
        size[source] += len(RUN.findall(text or ""))
    order = sorted(s for s in size if s is not None) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(size.values()), set()
    while True:
        left = budget - sum(2 * size[s] for s in full)
        open_ = sum(weight[s] for s in order if s not in full)
        out = {s: 2.0 * size[s] if s in full else left * weight[s] / open_ for s in order}
        over = {s for s in order if s not in full and out[s] > 2 * size[s]}
        if not over:
            return size, out
        full |= over


def smallest_capacity(sizes, shards):
    """The least capacity for which greedy needs at most ``shards`` contiguous parts."""

    def enough(c):
        n, held = 1, 0
        for s in sizes:
            if s > c:
                return False
            if held + s > c:
                n, held = n + 1, 0
            held += s
        return n <= shards

    low, high = 1, max(1, sum(sizes))
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle + 1, high)
    return low
