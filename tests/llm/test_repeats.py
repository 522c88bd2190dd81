"""Removal of repeated strings and the suffix arrays behind it, against plain versions."""

import hashlib
import random

import cases
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tidewatch.llm import registry, repeats, suffixes

FOLDER = "/root/testdata/sf0.001"


def plain_cut(rows, length):
    """(n_bytes, spans, kept) by position of the row, from the places of every string of ``length`` bytes."""
    texts = [(t or "").encode() if not isinstance(t, bytes) else t for _, t, *_ in rows]
    first, own = {}, [{} for _ in rows]
    for n, ((i, *_), text) in enumerate(zip(rows, texts, strict=True)):
        order = (i is None, i or 0)
        for at in range(len(text) - length + 1):
            w = text[at : at + length]
            first[w] = min(first.get(w, order), order)
            own[n].setdefault(w, at)
    out = []
    for n, ((i, *_), text) in enumerate(zip(rows, texts, strict=True)):
        gone = bytearray(len(text))
        for at in range(len(text) - length + 1):
            w = text[at : at + length]
            if first[w] < (i is None, i or 0) or own[n][w] < at:
                gone[at : at + length] = b"\1" * length
        edges = [k for k in range(len(text) + 1) if (gone[k - 1] if k else 0) != (gone[k] if k < len(text) else 0)]
        out.append((len(text), [(a, b - a) for a, b in zip(edges[::2], edges[1::2], strict=True)], bytes(b for b, g in zip(text, gone, strict=True) if not g)))
    return out


def run(spark, rows, length, df=None):
    df = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string") if df is None else df
    return [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in repeats.remove_repeats(df, length).collect()]


def expected(rows, length):
    return [(i, *x) for (i, *_), x in zip(rows, plain_cut(rows, length), strict=True)]


def in_order(found):
    return sorted(found, key=str)


def test_suffix_arrays_equal_sorting():
    rng = random.Random(1)
    for _ in range(150):
        problems = [[bytes(rng.choice(b"abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 6))]
        problems.append([bytes([0, 255, 0]), bytes([255])])
        symbols, bases, sizes = suffixes.join(problems)
        found = suffixes.suffix_arrays(symbols, bases, sizes)
        for b, n in zip(bases, sizes, strict=True):
            own = symbols[b : b + n].tolist()
            assert (found[b : b + n] - b).tolist() == sorted(range(n), key=lambda i: own[i:])


def test_groups_and_emission_take_linear_work():
    """Texts of one letter, of a period and of Fibonacci's kind are ordered too, in time that doesn't explode."""
    a, b = b"a", b"ab"
    while len(b) < 20_000:
        a, b = b, b + a
    for text in (b"a" * 3000, b"ab" * 3000, b):
        symbols, bases, sizes = suffixes.join([[text]])
        found = suffixes.suffix_arrays(symbols, bases, sizes)
        rank = np.empty(len(symbols), np.int64)
        rank[found[1:]] = np.arange(len(symbols) - 1)
        x, y = found[1:-1], found[2:]
        # each pair of neighbours is in order: by the first symbol, then by the rank of what follows
        last = bases[0] + sizes[0] - 1
        assert all(symbols[i] < symbols[j] or (symbols[i] == symbols[j] and i != last and rank[i + 1] < rank[j + 1]) for i, j in zip(x.tolist(), y.tolist(), strict=True))


def random_rows(rng, alphabet, n, longest):
    passages = ["".join(rng.choice(alphabet) for _ in range(rng.randint(10, longest))) for _ in range(6)]
    rows = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(rng.randint(0, 6))]
        rows.append((rng.choice([None, *range(n)]), "".join(parts)))
    return rows


@pytest.mark.parametrize("seed,alphabet,length", [(1, "abcdefgh", 16), (2, "ab", 20), (3, "aü文😀x", 24), (4, "a", 16), (5, "abcdefghijklmnopqrstuvwxyz ", 40)])
def test_equals_plain_search(spark, seed, alphabet, length):
    rows = random_rows(random.Random(seed), alphabet, 60, 90)
    want = expected(rows, length)
    assert in_order(run(spark, rows, length)) == in_order(want)
    assert sum(bool(w[2]) for w in want) > 10


@pytest.mark.parametrize("hot,many,slice_bytes", [(2, 48, 1 << 21), (1 << 30, 2, 300), (4, 3, 1 << 21)])
def test_split_anchors_change_nothing(spark, monkeypatch, hot, many, slice_bytes):
    """A line in every text, equal texts by the hundred, and limits so low that everything is split."""
    rng = random.Random(hot)
    line = "This line stands in each of the texts, whatever else there is in it. "
    rows = [(i, "".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) + line + "".join(rng.choice("abcd") for _ in range(rng.randint(0, 60)))) for i in range(120)]
    rows += [(1000 - i, rows[3][1]) for i in range(100)] + [(5000, line * 5), (None, line), (None, line * 2)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "MANY", many)
    monkeypatch.setattr(repeats, "SLICE_BYTES", slice_bytes)
    assert in_order(local(texts, 32)) == in_order(expected(rows, 32))


def local(df, length):
    """The same steps in this process, so that patched limits hold."""
    rows = df.collect()
    k = length * 2 // 5
    buckets = [pa.table({"doc_id": pa.array([r.doc_id for r in part], pa.int64()), "row_key": pa.array([hash((r.doc_id, r.text)) for r in part], pa.int64()), "bucket": pa.array([b] * len(part), pa.int32()), "raw": pa.array([r.text.encode() for r in part])}) for b in range(3) if (part := rows[b::3])]
    found = pa.concat_tables([repeats.report_anchors(t, k, length) for t in buckets]).sort_by("h")
    wanted = pa.Table.from_batches(list(repeats.repeated_anchors(iter(found.to_batches(max_chunksize=17)))))
    sent = pa.concat_tables([repeats.pieces_of(t, wanted.filter(pc.equal(wanted["bucket"], b)), k, length) for b, t in enumerate(buckets)]).sort_by("key")
    cuts = pa.Table.from_batches(list(repeats.find_cuts(iter(sent.to_batches(max_chunksize=50)), length)))
    out = pa.concat_tables([repeats.cut(t, cuts.filter(pc.equal(cuts["bucket"], b)), length) for b, t in enumerate(buckets)])
    return [(r["doc_id"], r["n_bytes"], [(s["start"], s["length"]) for s in r["spans"]], r["kept"]) for r in out.to_pylist()]


def test_odd_rows(spark):
    again = "twice the same sentence of some sixty bytes, to be cut once. "
    rows = [*cases.ROWS, (30, again * 2), (30, again * 3), (31, again + "x"), (None, again), (None, again), (None, again)]
    found = run(spark, rows, 40, cases.documents(spark, [(i, t, "s") for i, t, *_ in rows]))
    assert in_order(found) == in_order(expected(rows, 40))
    assert run(spark, [], 40, cases.empty(spark)) == []
    with pytest.raises(ValueError, match="16"):
        repeats.remove_repeats(cases.empty(spark), 10)


def test_documents_are_exchanged_once(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = repeats.remove_repeats(df)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("+- == Initial Plan ==")[0]
    assert final.count("ReusedExchange") >= 2


def test_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    found = {r.doc_id: r for r in registry.queries()["op13_repeats"](spark, FOLDER).collect()}
    assert set(found) == {i for i, _ in rows}
    for (i, _), (n, spans, kept) in zip(rows, plain_cut(rows, 100), strict=True):
        r = found[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    assert sum(r.n_removed for r in found.values()) > 1000
