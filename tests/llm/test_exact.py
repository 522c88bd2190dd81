"""Operators whose results are fixed by rule, against plain Python versions."""

import hashlib
import json
import os
import random
import zipfile
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import cases
import compare
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import components, decontam, licenses, media, mixing, registry, sharding, simhash, tokens, urls

FOLDER = "/root/testdata/sf0.001"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def sample(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "source").collect()
    return [tuple(r) for r in rows]


# --- media


@pytest.mark.parametrize("rows", [cases.ROWS, cases.ROWS[:1]])
def test_media_round_trip(spark, rows):
    found = media.media_features(cases.documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_bytes, bytes(r.payload)) for r in found) == Counter((i, len((t or "").encode()), media.pad((t or "").encode())) for i, t, _ in rows)
    by_text = defaultdict(set)
    for r in found:
        by_text[bytes(r.payload)].add((bytes(r.media), r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    assert all(bytes(r.media)[:8] == b"\x89PNG\r\n\x1a\n" for r in found)


def test_registered_media_query(spark):
    """Every column of op1 on the sample: digests from the texts, features by a plain Fourier sum."""
    turns = np.exp(-2j * np.pi * np.outer(np.arange(1, 33), np.arange(64)) / 64)
    found = {r.doc_id: r for r in registry.queries()["op1_media"](spark, FOLDER).collect()}
    assert set(found) == {i for i, *_ in sample(spark)}
    for i, text, _ in sample(spark):
        raw, r = (text or "").encode(), found[i]
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        image = media.encode_image(payload, len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest())
        x = [float(b) for b in payload]
        mean = sum(x) / len(x)
        crossings = [(a - mean < 0) != (b - mean < 0) for a, b in zip(x, x[1:], strict=False)]
        power = [sum(abs(sum(t * (v - 128) for t, v in zip(row, x[k : k + 64], strict=True))) ** 2 for k in range(0, len(x), 64)) for row in turns] if len(x) < 4000 else None
        got = json.loads(r.feature)
        assert (got["mean"], got["std"], got["zcr"]) == pytest.approx((mean, (sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5, sum(crossings) / len(crossings)), abs=1e-4)
        if power:
            assert got["bands"] == pytest.approx([sum(power[k : k + 4]) / sum(power) for k in range(0, 32, 4)], abs=1e-4)


def test_media_text_ids(spark):
    ids = ["a_1", "", None, "null", "x/y_2.png", "ü\n", "a\0b", "long " * 20_000]
    docs = spark.createDataFrame([(i, "text") for i in ids], "doc_id string, text string")
    assert Counter(r.doc_id for r in media.media_features(docs).collect()) == Counter(ids)


def test_media_empty_table(spark):
    assert media.media_features(cases.empty(spark)).collect() == []


def test_archive_ranges_and_retries(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/archives"
    media.write_archives(cases.documents(spark), folder, archive_bytes=200_000)
    found = media.read_archives(spark, folder, rangebytes=3000, batchbytes=100)
    assert found.count() == len(cases.ROWS)
    reader = media.ArchiveReader({"path": folder, "rangebytes": "3000", "batchbytes": "100"})
    parts = reader.partitions()
    assert len(parts) > 3
    failures, real = Counter(), media.ArchiveReader._member

    def unsteady(self, store, path, row):
        failures[path, row["offset"]] += 1
        if failures[path, row["offset"]] < 3:
            raise OSError("gone")
        return real(self, store, path, row)

    monkeypatch.setattr(media, "PAUSE", 0)
    monkeypatch.setattr(media.ArchiveReader, "_member", unsteady)
    rows = [m for p in parts for b in reader.read(p) for m in b.column("member").to_pylist()]
    assert len(rows) == len(set(zip(rows, range(len(rows)), strict=True))) == len(cases.ROWS)
    assert set(failures.values()) == {3}  # each member by itself


def test_damaged_member_fails(spark, tmp_path):
    folder = f"{tmp_path}/archives"
    media.write_archives(cases.documents(spark), folder)
    name = next(f for f in os.listdir(folder) if f.endswith(".zip") and zipfile.ZipFile(f"{folder}/{f}").infolist())
    with open(f"{folder}/{name}", "r+b") as f:
        f.seek(zipfile.ZipFile(f"{folder}/{name}").infolist()[0].header_offset + 60)
        f.write(b"\xff\x00\xff")
    with pytest.raises(Exception, match="damaged"):
        media.read_archives(spark, folder, tries=1).count()


# --- tokens


@pytest.mark.parametrize("path", [TOKENIZER, "/opt/tokenizers/word_bpe_49k.json"])
def test_tokens_against_library(spark, path):
    """Also for a tokenizer with another rule, whose texts must go through the library whole."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    assert (tokens.Encoder(path).split is None) == (path != TOKENIZER)
    rows = sorted([*sample(spark), (10**6, "It's  <|endoftext|> Déjà VU 12½", None)])
    found = {r.doc_id: r for r in tokens.tokenise(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), path).collect()}
    start = 0
    for i, text, _ in rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_special_text_as_the_library_gives_it():
    """With the contract's call alone, the library meets added tokens in a text."""
    from tokenizers import Tokenizer

    text = "a <|endoftext|> b"
    (ids,) = tokens.Encoder(TOKENIZER)([text])
    assert np.frombuffer(ids, "<u4").tolist() == Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids == [64, 220, 50256, 275]


def test_shards_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    """Many more ranges than shuffle partitions where the text is large, equal rows of one key dealt too."""
    monkeypatch.setattr(tokens, "SHARD_BYTES", 2000)
    docs = spark.createDataFrame([(7, "the same text again")] * 3000 + [(i, f"text {i}") for i in range(500)], "doc_id long, text string").repartition(6)
    manifest = tokens.write_tokens(docs, str(tmp_path), TOKENIZER)
    assert manifest.count() > 20 and manifest.agg({"rows": "max"}).first()[0] < 1000
    found = tokens.read_tokens(manifest, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in found) == Counter([7] * 3000 + list(range(500)))
    assert [r.start for r in sorted(found, key=lambda r: r.start)] == np.cumsum([0, *[r.n_tokens for r in sorted(found, key=lambda r: r.start)]])[:-1].tolist()


def test_tokens_odd_rows(spark):
    found = tokens.tokenise(cases.documents(spark), TOKENIZER).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, *_ in cases.ROWS)
    spans = sorted((r.start, r.start + r.n_tokens) for r in found)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    assert tokens.tokenise(cases.empty(spark), TOKENIZER).collect() == []


def test_rows_without_a_key(spark, tmp_path):
    """Null keys come first and read back as null; the smallest long is a key like any other."""
    low = -(1 << 63)
    docs = spark.createDataFrame([(None, "a"), (low, "b"), (None, "c c"), (low, "d"), (5, None)], "doc_id long, text string").coalesce(1)
    found = tokens.tokenise(docs, TOKENIZER, folder=str(tmp_path)).collect()
    assert [r.doc_id for r in sorted(found, key=lambda r: r.start)] == [None, None, low, low, 5]
    only = tokens.write_tokens(docs.where("doc_id IS NULL"), f"{tmp_path}/nulls", TOKENIZER)
    assert [r.doc_id for r in tokens.read_tokens(only, f"{tmp_path}/nulls").collect()] == [None, None]
    assert tokens.lookup(docs, only, f"{tmp_path}/nulls").collect() == []


def test_keyed_lookup(spark, tmp_path):
    rows = sorted(sample(spark))
    docs = spark.createDataFrame([(i * 3, t) for i, t, _ in rows], "doc_id long, text string").repartition(5)
    manifest = tokens.write_tokens(docs, str(tmp_path), TOKENIZER)
    encode = tokens.Encoder(TOKENIZER)
    wanted = [3 * i for i, *_ in rows[::7]] + [1, -5, 10**9]
    got = {r.key: r.ids for r in tokens.lookup(spark.createDataFrame([(k,) for k in [*wanted, None]], "doc_id long"), manifest, str(tmp_path)).collect()}
    assert got == {3 * i: [*np.frombuffer(encode([t or ""])[0], "<u4").tolist(), 0] for i, t, _ in rows[::7]}


def test_split_rule_matches_library():
    encode = tokens.Encoder(TOKENIZER)
    rng = random.Random(3)
    chars = [chr(c) for c in (*range(0x1C), *range(0x20, 0x250), 0x4E00, 0x1F600)]
    made = ["".join(rng.choice(chars) if rng.random() < 0.4 else rng.choice(" 's'llve  d1\n\t") for _ in range(rng.randrange(30))) for _ in range(2000)]
    whole = tokens.Encoder(TOKENIZER, parts=False)
    assert encode.split and encode(made) == whole(made)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(-(1 << 63), 1 << 62, n))
    index = tokens.PerfectHash.build(keys)
    slots = index.slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    if n:
        prints = np.empty(len(keys), np.uint32)
        prints[slots] = tokens.fingerprint32(keys)
        others = np.setdiff1d(np.random.default_rng(n + 1).integers(0, 1 << 62, 1000), keys)
        at = index.slots(others)
        assert np.mean((at >= 0) & (prints[np.maximum(at, 0)] == tokens.fingerprint32(others))) < 0.01


# --- decontamination

ITEMS = [(1, cases.PASSAGE), (2, "short"), (2, "short"), (3, None), (4, ""), (None, "no id"), (5, "the lazy dog")]


def test_contamination(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontam.decontaminate(cases.documents(spark), items).collect()
    expected = Counter()
    for (i, *_), (n, hit, met) in zip(cases.ROWS, cases.contamination(cases.ROWS, ITEMS), strict=True):
        expected[i, n, hit, len(met), hashlib.sha256(",".join(met).encode()).hexdigest(), hit > 0 and 20 * hit >= n] += 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found) == expected


def test_contamination_on_sample_and_in_blocks(spark):
    docs, items = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    rows, listed = sample(spark), [tuple(r) for r in items.select("item_id", "text").collect()]
    expected = {i: (n, hit, len(met)) for (i, *_), (n, hit, met) in zip(rows, cases.contamination(rows, listed), strict=True)}
    assert any(v[1] for v in expected.values())
    for most, held in ((1 << 30, 1), (2000, 1 << 24), (2000, 50_000)):  # one broadcast set; blocks in the shared folder
        found = decontam.decontaminate(docs, items, most_bytes=most, held_bytes=held).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in found} == expected


def test_windows_of_very_many_items_in_blocks(spark):
    """A passage that all items share is cut over blocks by item; every item is named once."""
    items = spark.createDataFrame([(k, f"{cases.PASSAGE} and {k} more") for k in range(3000)], "item_id long, text string")
    docs = cases.documents(spark)
    expected = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in decontam.decontaminate(docs, items).collect()}
    found = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in decontam.decontaminate(docs, items, most_bytes=200_000).collect()}
    assert found == expected and found[6][1] == 3000


def test_texts_are_gathered_up_to_a_bound():
    batches = [pa.RecordBatch.from_pydict({"text": ["x" * 1000] * 10}) for _ in range(30)]
    parts = list(decontam.gathered(iter(batches), 100_000))
    assert len(parts) == 3 and sum(p.num_rows for p in parts) == 300
    assert [p.num_rows for p in decontam.gathered(iter([pa.RecordBatch.from_pydict({"text": ["y" * 5000, None, ""]})]), 10)] == [1, 2]


def test_remove_spans_and_documents(spark):
    items = spark.createDataFrame([(1, cases.PASSAGE)], "item_id long, text string")
    docs = cases.documents(spark)
    cut = {r[0]: r[1] for r in decontam.remove_spans(docs, items).collect()}
    assert cut[6] == "Intro. ! Outro" and cut[0] == cases.ROWS[0][1] and cut[2] is None
    kept = decontam.remove_documents(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(cases.ROWS) - 1
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontam.remove_documents(docs, nothing).count() == len(cases.ROWS)
    assert decontam.decontaminate(cases.empty(spark), items).collect() == []


# --- sharding


def check_shards(rows, found, shards=16):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    sizes, slots, of_digest = Counter(), defaultdict(list), defaultdict(set)
    for r in found:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        of_digest[r.digest].add(r.shard)
    assert all(len(s) == 1 for s in of_digest.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for r in found:
        groups[r.digest] += r.size
    order = [groups[d] for d in sorted(groups)]
    assert max(sizes.values()) == cases.smallest_capacity(order, shards)
    return sizes


def test_shards(spark):
    rows = sample(spark)
    found = sharding.shard_documents(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")).collect()
    sizes = check_shards(rows, found)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in found)
    check_shards(cases.ROWS, sharding.shard_documents(cases.documents(spark)).collect())
    assert sharding.shard_documents(cases.empty(spark)).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_shards_random(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("abcdefgh") * int(rng.paretovariate(0.7)) if rng.random() < 0.4 else f"{i} " * rng.randrange(1, 9)) for i in range(rng.choice((5, 80, 400)))]
    rows = [(i, t[:20_000]) for i, t in rows]
    shards = rng.choice((1, 3, 16))
    check_shards(rows, sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=shards).collect(), shards)


def test_slots_of_equal_rows(spark, monkeypatch):
    """A ranking cell that one repeated row fills is cut into parts; slots stay gapless."""
    monkeypatch.setattr(sharding, "CELL_ROWS", 10)
    rows = [(None, "same")] * 3000 + [(i, f"text {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check_shards(rows, sharding.shard_documents(docs).collect())


def test_deep_splits(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST", 1)
    monkeypatch.setattr(sharding, "STEP", 1)
    rows = [(i, f"text {i} " * (i % 7 + 1)) for i in range(500)]
    check_shards(rows, sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())


# --- licenses


def test_license_places(spark):
    rows = [*cases.ROWS, *sample(spark)]
    found = licenses.scan_licenses(cases.documents(spark, rows)).collect()
    expected = Counter()
    for i, text, *_ in rows:
        w, places, labels = cases.words(text), [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    places.append(k)
                    labels.add(label)
        expected[i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found) == expected
    for r in found:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert (r.score == 1) or not r.base_labels


def test_license_places_in_large_and_no_texts(spark):
    assert licenses.scan_licenses(cases.empty(spark)).collect() == []
    text = "mit license x " * 30_000 + "mit licence"
    (found,) = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (found.n_words, found.n_base, found.first_word, found.last_word, found.base_labels) == (90_002, 30_000, 0, 89_997, "mit")
    assert [p.first for p in found.places if p.edits] == [90_000]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_labels_against_edit_distance():
    """A label is found if and only if some run of whole words is within the notice's edits."""
    rng = random.Random(5)
    wanted = licenses.notices()
    patterns = [w.pattern() for w in wanted]
    for _ in range(300):
        notice = rng.choice(wanted)
        text = list(notice.text.decode())
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(text))
            text[k : k + rng.randrange(2)] = rng.choice(["", "x", "e", "qq"])
        line = f"foo {''.join(text)} bar baz"
        words = cases.words(line)
        found = {p[2] for p in licenses.scan_text(line.encode(), wanted, patterns)[1]}
        expected = set()
        for w in wanted:
            target = w.text.decode()
            runs = [" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)]
            if any(levenshtein(r, target) <= w.edits for r in runs if abs(len(r) - len(target)) <= w.edits):
                expected.add(w.label)
        assert found == expected, line


# --- simhash


def test_simhash(spark):
    rows = [*sample(spark), *[(i, f"{cases.LONG} {i}", None) for i in range(10_000, 10_040)]]
    found = simhash.near_duplicates(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")).collect()
    prints, roots = cases.simhash_components(rows)
    assert sorted((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found) == sorted((i, f, c) for (i, *_), f, c in zip(rows, prints, roots, strict=True))
    assert len(set(roots)) < len(rows)


def test_simhash_odd_rows(spark):
    docs = cases.documents(spark)
    found = simhash.near_duplicates(docs).collect()
    prints, roots = cases.simhash_components(cases.ROWS)
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found) == Counter((i, f, c) for (i, *_), f, c in zip(cases.ROWS, prints, roots, strict=True))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.collect() if r[0] is not None) == sorted({c for c in roots if c is not None})
    assert simhash.near_duplicates(cases.empty(spark)).collect() == [] and simhash.keep_one(cases.empty(spark)).collect() == []


def test_keep_one_of_each_component(spark):
    """Rows without an id and rows of one id in different components don't stand for each other."""
    rng = random.Random(5)
    alone = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(7)]
    rows = [(None, alone[0], "a"), (None, alone[1], "a"), (None, alone[2], "a"), (9, alone[2], "a"), (3, alone[3], "a"), (3, alone[4], "a"), (2, alone[4], "b"), (3, alone[5], "a"), (3, alone[5], "a"), (3, alone[5], "b"), (None, alone[6], None), (None, alone[6], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in simhash.keep_one(docs).collect()]
    assert sorted((t, i) for i, t, _ in got) == sorted(zip(alone, [None, None, 9, 3, 2, 3, None], strict=True))
    assert Counter(got) == Counter(tuple(r) for r in simhash.keep_one(docs.repartition(7)).collect())


def test_links_random_fingerprints(spark, monkeypatch):
    """Clouds of near fingerprints and noise: the same components as all pairs, at every grid."""
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for c in [rng.getrandbits(64) for _ in range(20)]:
        for _ in range(20):
            f = c
            for _ in range(rng.randrange(6)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    nodes = spark.createDataFrame([(f, f) for f in signed], "node long, fp0 long").cache()
    parent = {f: f for f in signed}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                parent[find(a)] = find(b)
    expected = {frozenset(f for f in signed if find(f) == r) for r in {find(f) for f in signed}}
    for extra, hot in ((1, 1 << 14), (1, 30), (2, 3), (3, 5)):
        monkeypatch.setattr(simhash, "BLOCKS", ((1 << 62, extra),))
        monkeypatch.setattr(simhash, "HOT_MEMBERS", hot)
        roots = dict(map(tuple, components.components(simhash.links(nodes)).collect()))
        groups = defaultdict(set)
        for f in signed:
            groups[roots.get(f, f)].add(f)
        assert {frozenset(g) for g in groups.values()} == expected


@pytest.mark.parametrize("small,large,crowded", [(32, 8192, 4), (2, 8192, 4), (2, 8192, 0), (2, 2, 4), (1000, 8192, 4)])
def test_cells_in_each_way(monkeypatch, small, large, crowded):
    """Small cells, all pairs of large ones and walked crowds connect the same members."""
    for name, value in (("SMALL", small), ("LARGE", large), ("CROWDED", crowded)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(small + large + crowded)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fp = np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for c in centres])
    key = np.sort(rng.integers(0, 6, len(fp)))
    a, b = simhash._compare_cells({"key": key, "fp": fp.view(np.int64), "node": np.arange(len(fp))}, simhash.Likeness())
    parts = []
    for pairs in (zip(a.tolist(), b.tolist(), strict=True), ((i, j) for i in range(len(fp)) for j in range(i) if key[i] == key[j] and int(fp[i] ^ fp[j]).bit_count() <= 4)):
        parent = list(range(len(fp)))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in pairs:
            parent[find(x)] = find(y)
        parts.append({frozenset(i for i in range(len(fp)) if find(i) == r) for r in {find(i) for i in range(len(fp))}})
    assert parts[0] == parts[1]


def shingle_sets(texts, n=5):
    return [frozenset(cases.shingles(t, n)) for t in texts]


def jaccard(x, y):
    return len(x & y) / max(1, len(x | y))


def test_no_drop_without_a_similar_text(spark):
    """All documents of sf0.1: nine tenths of the pairs of 0.8 or more are linked, and no row is in a component without such a text in it."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r.text for r in docs.collect()}
    root = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, simhash.SIMILAR).collect()}
    sets = dict(zip(rows, shingle_sets(rows.values()), strict=True))
    same, members = defaultdict(list), defaultdict(list)
    for i, s in sets.items():
        same[s].append(i)
        members[root[i]].append(i)
    assert all(len({root[i] for i in ids}) == 1 for ids in same.values())
    distinct = {ids[0]: s for s, ids in same.items() if s}
    often = Counter(x for s in distinct.values() for x in s)
    firsts = defaultdict(list)
    for i, s in distinct.items():
        for x in sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-8 * len(s) // 10) + 1]:
            firsts[x].append(i)
    pairs = {(a, b) for ids in firsts.values() for k, a in enumerate(ids) for b in ids[k + 1 :] if jaccard(distinct[a], distinct[b]) >= 0.8}
    assert len(pairs) > 40 and sum(root[a] == root[b] for a, b in pairs) >= 0.9 * len(pairs)
    for ids in members.values():
        if len({sets[i] for i in ids}) > 1:
            assert all(any(jaccard(sets[i], sets[j]) >= 0.8 for j in ids if i != j) for i in ids)


@pytest.mark.parametrize("broadcast,hot_rows", [(1 << 21, 1 << 14), (0, 2)])
def test_each_way_of_removal(spark, monkeypatch, broadcast, hot_rows):
    """Broadcast ids and the merge join, hot nodes or not, keep the same rows."""
    monkeypatch.setattr(simhash, "BROADCAST_IDS", broadcast)
    monkeypatch.setattr(simhash, "HOT_ROWS", hot_rows)
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(12)]
    rows = [(i, rng.choice(base)) for i in range(80)] + [(None, "")] * 5 + [(200, base[0] + " x")] * 3 + [(-1, "alone it stands")] * 3
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), simhash.SIMILAR).collect()
    used = {t for _, t in rows if t in base}
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([*((min(i for i, u in rows if u == t and i is not None), t) for t in used), (None, ""), (-1, "alone it stands")], key=str)


def test_similar_texts_stay_once(spark):
    """Edited copies of a similarity of 0.8 or more are mostly found, less similar texts (below 0.6) never linked."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    texts, similar, apart = [], [], []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(120, 400))]
        copy, changed = list(base), list(base)
        for _ in range(rng.randrange(1, max(2, len(base) // 50))):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        for _ in range(len(base) // 8):
            changed[rng.randrange(len(changed))] = rng.choice(words)
        texts += [" ".join(base), " ".join(copy), " ".join(changed)]

    def likeness(a, b):
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
        return len(x & y) / len(x | y)

    for i in range(0, len(texts), 3):
        similar += [(i, i + 1)] if likeness(texts[i], texts[i + 1]) >= 0.8 else []
        apart += [(i, i + 2)] if likeness(texts[i], texts[i + 2]) < 0.6 else []
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, simhash.SIMILAR).collect()}
    assert len(similar) > 40 and sum(root[a] == root[b] for a, b in similar) >= 0.9 * len(similar)
    assert len(apart) > 40 and not any(root[a] == root[b] for a, b in apart)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000)]
    roots = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert len({roots[i] for i in range(201)}) == 1 and len({roots[1000 + i] for i in range(50)}) == 1 and len(set(roots.values())) == 2


# --- mixing


@pytest.mark.parametrize("odd", [False, True])
def test_mix(spark, odd):
    rows = cases.ROWS if odd else sample(spark)
    found = mixing.mix(cases.documents(spark, rows)).collect()
    size, target = cases.targets(rows)
    assert Counter((r.doc_id, r.size, r.source) for r in found) == Counter((i, len(cases.RUN.findall(t or "")), s) for i, t, s in rows)
    taken = Counter()
    for r in found:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    largest = max(len(cases.RUN.findall(t or "")) for _, t, _ in rows)
    for s in target:
        assert abs(taken[s] - target[s]) <= (largest if odd else max(60, 0.01 * target[s]))
    assert sorted(map(str, mixing.mix(cases.documents(spark, rows)).collect())) == sorted(map(str, found))


def test_mix_tilts_and_empty(spark):
    assert mixing.mix(cases.empty(spark)).collect() == []
    docs = cases.documents(spark)
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    counts = Counter(r[0] for r in mixed.collect())
    assert all(counts[i] == c for i, c in copies.items() if i not in (None, 8))


def test_mix_by_rows(spark):
    """Null ids and ids with several texts are rated row by row, and every source meets its target."""
    rng = random.Random(3)
    rows = [(rng.choice([None, None, 1, 2, i]), " ".join("w" * rng.randrange(1, 60)), rng.choice(["a", "b", "c", "d", None])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size, target = cases.targets(rows)
    copies = Counter(tuple(r) for r in mixing.apply_mix(docs).collect())
    assert copies == Counter(tuple(r) for r in mixing.apply_mix(docs.repartition(5)).collect())
    had, taken = Counter(rows), Counter()
    for (i, text, source), n in copies.items():
        assert n <= 2 * had[i, text, source]
        taken[source] += n * len(cases.RUN.findall(text))
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)


def test_mix_ties_do_not_depend_on_order(spark):
    """Rows of one id with sizes of one class: the larger and the smaller one keep their copies on every run."""
    rows = [(i % 3 or None, "w " * (1030 + i % 4), "ab"[i % 2]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, *others = (Counter(map(str, mixing.mix(docs.repartition(n, "text") if n else docs).collect())) for n in (0, 3, 7))
    assert all(o == first for o in others)


@pytest.mark.parametrize("lot_rows", [4096, 7])
def test_mix_of_equal_rows(spark, monkeypatch, lot_rows):
    """30,000 equal rows of 31,000: as many as are due take one more, in the mix and in the table of sizes, and no task holds them."""
    monkeypatch.setattr(mixing, "LOT_ROWS", lot_rows)
    rng = random.Random(9)
    rows = [(1, "the same ten words in thirty thousand rows of one", "a")] * (30_000 if lot_rows > 7 else 900) + [(i, "w " * rng.randrange(1, 40), rng.choice(["a", "b", None])) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(9)
    size, target = cases.targets(rows)
    found, taken, copies = mixing.mix(docs).collect(), Counter(), Counter()
    assert len(found) == len(rows)
    for r in found:
        taken[r.source] += r.taken
        copies[r.doc_id, r.size, r.source] += r.copies
        assert 0 <= r.copies <= 2
    assert all(abs(taken[s] - target[s]) <= 40 for s in target)
    mixed = Counter((r.doc_id, len(r.text.split()), r.source) for r in mixing.apply_mix(docs).collect())
    assert mixed == +copies


def test_texts_are_not_moved_by_the_mix(spark):
    """No exchange of the plan holds the text; sources may be numbers."""
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 30 + 1), i % 4) for i in range(800)], "doc_id long, text string, source int")
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns and mixed.count() > 800
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "SortMergeJoin" not in plan
    assert {r.source for r in mixing.mix(docs).collect()} == {0, 1, 2, 3}


def test_targets_of_many_sources(spark):
    rng = random.Random(4)
    sizes = {f"s{i:05d}": rng.randrange(1, 50) ** 3 for i in range(20_000)} | {None: 7}
    classes = spark.createDataFrame([(s, n, n, 1) for s, n in sizes.items()], "source string, class long, tokens long, n long")
    order = [*sorted(s for s in sizes if s is not None), None]
    weight, budget, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), set()
    while True:
        level = (budget - sum(2 * sizes[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        over = {s for s in order if s not in full and level * weight[s] >= 2 * sizes[s]}
        if not over:
            break
        full |= over
    found = mixing.source_targets(classes).collect()
    assert len(found) == len(sizes)
    assert all(r.target == pytest.approx(2.0 * sizes[r.source] if r.source in full else level * weight[r.source]) for r in found)


def test_rates_are_the_optimum(spark):
    """The multipliers against bisection on the dual, and the rounds against a limit that is too small."""
    rng = random.Random(6)
    classes = [(s, c, n, c * n) for s in "abc" for c in rng.sample(range(1, 900), 30) for n in [rng.randrange(1, 9)]]
    df = spark.createDataFrame(classes, "source string, class long, n long, tokens long").cache()
    goals = mixing.source_targets(df)
    target = {r.source: r.target for r in goals.collect()}
    rates = {(r.source, r["class"]): r.rate for r in mixing.balance(df, goals).collect()}
    for s in "abc":
        mine = [(c, n, t) for x, c, n, t in classes if x == s]
        size, docs = sum(t for *_, t in mine), sum(n for _, n, _ in mine)
        if target[s] >= 2 * size:
            assert all(rates[s, c] == 2 for c, *_ in mine)
            continue
        low, high = -100.0, 100.0
        for _ in range(200):
            lam = (low + high) / 2
            rate = {c: 2 / (1 + np.exp(-np.clip(lam * c / (size / docs), -60, 60))) for c, *_ in mine}
            low, high = (lam, high) if sum(t * rate[c] for c, _, t in mine) < target[s] else (low, lam)
        assert all(rates[s, c] == pytest.approx(rate[c], abs=1e-4) for c, *_ in mine)
    with pytest.raises(RuntimeError):
        mixing.balance(df, goals, rounds=1)


# --- urls


def test_urls_against_sql(spark):
    con = compare.connect(FOLDER)
    assert compare.difference(registry.queries()["op10_urls"](spark, FOLDER), con, registry.oracle_sql()["op10_urls"]) is None


@pytest.mark.parametrize("most", [1 << 20, 1 << 10])
def test_cascade_is_exact(spark, most):
    keys = spark.range(40_000).selectExpr("concat('host', id, '.example') AS key", "id % 5 = 0 AS listed").cache()
    parts, n = urls.build_parts(keys, first_rate=0.3, part_keys=5000)
    assert n == 8 and all(len(r.levels) > 3 for r in parts.collect())
    assert urls.with_listed(keys.withColumnRenamed("listed", "expected"), "key", parts, n, most).where("listed <> expected").count() == 0
    none, one = urls.build_parts(keys.where("not listed"))
    assert not urls.with_listed(keys.select("key"), "key", none, one, most).where("listed").count()


def test_a_million_hosts_within_a_bound(spark):
    """A list of 10^6 hosts over a universe of 1.5 * 10^6: exactly the listed ones are blocked, in parts of bounded size."""
    pages = spark.range(1_500_000).selectExpr("id AS page_id", "concat('http://H', id, '.test/x') AS url")
    hosts = spark.range(500_000, 2_000_000).selectExpr("concat('h', id, '.TEST') AS host").where("host NOT LIKE '%7.TEST'")
    found = urls.judge(pages, (), hosts, most_bytes=1 << 20, part_keys=200_000)
    wrong = found.where("(verdict = 'block') <> (page_id >= 500000 AND page_id % 10 <> 7)")
    assert wrong.count() == 0 and found.where("verdict = 'block'").count() == 900_000


def test_listed_hosts_from_a_table(spark):
    pages = spark.createDataFrame([(1, "http://a.test/x"), (2, "http://b.test"), (3, None)], "page_id long, url string")
    hosts = spark.createDataFrame([("B.test", 1), ("c.test", 2), (None, 3)], "name string, key long")
    assert {r.page_id: r.verdict for r in urls.judge(pages, (), hosts).collect()} == {1: "allow", 2: "block", 3: "allow"}


ODD_URLS = [(1, None), (2, "no scheme"), (3, "http://"), (4, "HTTP://WWW.Example.ORG"), (5, "http://a.example.org/es/x?y#z"), (6, "http://example.org/en/12"), (7, "x://notexample.org/es/"), (8, "http://ads.shop.test/p"), (8, "http://ads.shop.test/p"), (None, "http://b.com/de/"), (9, "a://b://c.com/fr/")]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_urls_odd_rows(spark, most):
    pages = spark.createDataFrame([(i, u, "other") for i, u in ODD_URLS], "page_id long, url string, host string")
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in urls.judge(pages, most_bytes=most).collect()}
    assert got == {
        (1, "", ""): (None, "allow"), (2, "", ""): (None, "allow"), (3, "", ""): (None, "allow"), (4, "www.example.org", ""): (None, "allow"),
        (5, "a.example.org", "/es/x"): ("example.org/es/", "block"), (6, "example.org", "/en/12"): ("example.org/en/1", "block"),
        (7, "notexample.org", "/es/"): ("org/", "allow"), (8, "ads.shop.test", "/p"): (None, "block"), (None, "b.com", "/de/"): ("com/de/", "block"),
        (9, "b:", "//c.com/fr/"): (None, "allow"),
    }
    assert urls.judge(pages.limit(0)).collect() == []


def test_crowds_lose_no_link(spark, monkeypatch):
    """Eight groups of three texts around one template: a walk that meets every text by the first one only leaves seven groups to the search by shingles."""
    words = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    rows = [(3 * g + k, " ".join(words("base", 60) + words(f"own{g}x", 40) + [f"last{k}"])) for g in range(8) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def walked(nodes, like):
        first = nodes.selectExpr("min(node) AS a")
        return first.crossJoin(nodes.selectExpr("node AS b")).where("a <> b").unionByName(nodes.selectExpr("node AS a", "node AS b"))

    monkeypatch.setattr(simhash, "links", walked)
    root = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, simhash.SIMILAR).collect()}
    assert root == {i: i // 3 * 3 for i, _ in rows}


def test_crowds_are_told(monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 2)
    monkeypatch.setattr(simhash, "LARGE", 0)
    one = np.zeros(5, np.int64)
    cells = {"key": np.array([1, 1, 1, 1, 2]), "fp": one, "w0": one, "w1": one, "node": np.arange(5)}
    a, b = simhash._compare_cells(cells, simhash.SIMILAR)
    assert {int(x) for x, y in zip(a, b, strict=True) if x == y} == {0, 1, 2, 3}


def test_heads_of_crowds(spark, monkeypatch):
    """Crowds meet by a fifth of their shingles: those in many heads come last, and all similar pairs of different roots are still told."""
    monkeypatch.setattr(simhash, "LATE_MEMBERS", 3)
    rng = random.Random(8)
    often = [f"o{i}" for i in range(40)]
    rows = []
    for g in range(12):
        own = [f"g{g}w{i}" for i in range(rng.randrange(60, 200))]
        for k in range(4):
            copy = list(own)
            copy[rng.randrange(len(copy))] = f"c{g}x{k}"
            rows.append((len(rows), " ".join(copy[:30] + often + copy[30:])))
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    plain, key, prints, _ = simhash._scanned(docs, simhash.SIMILAR, "doc_id", "text")
    first = F.min(F.struct(F.isnull("doc_id").alias("last"), F.col("doc_id").alias("id"), F.col("h").alias("h"))).alias("first")
    nodes = prints.groupBy("node").agg(first, F.count("*").alias("copies")).localCheckpoint()
    name = {r.node: r.first.id for r in nodes.collect()}
    read = lambda met, columns, of: simhash._scanned_nodes(met, nodes, plain, key, "c1", columns, of)
    heads = simhash._heads(nodes.select("node"), read, simhash.SIMILAR)
    assert len(heads) == 4
    sets = dict(enumerate(shingle_sets(t for _, t in rows)))
    told = [r for t in heads[:2] for r in t.collect()]
    assert sorted(name[r.node] for r in told) == list(range(len(rows)))
    assert all(r.size == len(sets[name[r.node]]) and len(r.head) <= 0.2 * r.size + 1 for r in told)
    root = spark.createDataFrame([(n, n) for n in name], "node long, root long")
    got = {frozenset((name[r.a], name[r.b])) for r in simhash._apart_in_crowds(heads, root, 0.8).collect()}
    assert got >= {frozenset((a, b)) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8}
    one = root.withColumn("root", F.lit(7))
    assert simhash._apart_in_crowds(heads, one, 0.8).collect() == []


def test_near_misses_of_a_crowd_are_no_rows(spark, monkeypatch):
    """Ninety texts around one template, in pairs of 0.8 that are 0.6 or so from all others: told by blocks, without a row for each of the 4,000 pairs."""
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 2000)
    words = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    rows = [(2 * g + k, " ".join(words("base", 80) + words(f"own{g}x", 20) + [f"last{k}"])) for g in range(45) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def walked(nodes, like):
        first = nodes.selectExpr("min(node) AS a")
        return first.crossJoin(nodes.selectExpr("node AS b")).where("a <> b").unionByName(nodes.selectExpr("node AS a", "node AS b"))

    written, pairs = simhash.materialise, []

    def counted(df, kind):
        out = written(df, kind)
        if {"a", "b"} <= set(out.columns):
            pairs.append(out.count())
        return out

    monkeypatch.setattr(simhash, "links", walked)
    monkeypatch.setattr(simhash, "materialise", counted)
    root = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, simhash.SIMILAR).collect()}
    assert root == {i: i // 2 * 2 for i, _ in rows} and max(pairs) <= 2 * len(rows)


@pytest.mark.parametrize("sides", [1, 2])
def test_linked_sets(sides):
    """Sets around three templates connect as all their similar pairs do; of two sides, as those across."""
    rng = np.random.default_rng(sides)
    sets = []
    for k in range(90):
        base = np.arange(100) + 1000 * (k % 3)
        gone = rng.choice(100, rng.integers(0, 25), replace=False)
        sets.append(np.concatenate((np.delete(base, gone), 10_000 + 100 * k + np.arange(rng.integers(0, 15)))))
    side, root = rng.integers(0, sides, 90), np.where(np.arange(90) < 20, np.arange(90) % 3, np.arange(90) + 100)
    same = {}

    def find(x):
        while same.setdefault(x, x) != x:
            x = same[x]
        return x

    def parts(pairs):
        same.clear()
        for a, b in pairs:
            same[find(root[a])] = find(root[b])
        return {frozenset(i for i in range(90) if find(root[i]) == r) for r in {find(x) for x in root}}

    size = np.array([len(s) for s in sets])
    got = simhash.linked_sets(np.concatenate(sets), size, root, side, 0.8)
    like = [(a, b) for a in range(90) for b in range(a) if jaccard(set(sets[a]), set(sets[b])) >= 0.8]
    want = [(a, b) for a, b in like if sides == 1 or side[a] != side[b]]
    assert set(got) <= {(b, a) for a, b in want} and len(got) < 90
    assert parts(got) == parts(want) and 3 < len(parts(got)) < 73


def test_only_dense_members_are_a_crowd():
    """A cell of one dense group, one near pair and others that only share their words: the group and the pair are told, the others aren't."""
    wide = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, (2, 300))
    wide[:, :60] = wide[:, :1]
    wide[:, 299] = wide[:, 298]
    cells = {"key": np.ones(300, np.int64), "fp": np.full(300, 5), "w0": wide[0], "w1": wide[1], "node": np.arange(300)}
    a, b = simhash._compare_cells(cells, replace(simhash.SIMILAR, roomy=34))
    pairs = {(int(x), int(y)) for x, y in zip(a, b, strict=True)}
    dense = {*range(60), 298, 299}
    assert {x for x, y in pairs if x == y} == dense == {i for p in pairs if p[0] != p[1] for i in p}
    assert len(simhash._compare_cells({k: cells[k] for k in ("key", "fp", "node")}, simhash.Likeness(distance=6))[0]) == 299
