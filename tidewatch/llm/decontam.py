"""Benchmark decontamination: a broadcast set of n-gram hashes, scanned over all texts and verified.

Words are hashed with a polynomial over their bytes and windows with a
polynomial over their words, both as numpy prefix sums, so a text costs a few
passes over its bytes. A window whose hash is in the set is compared word by
word with the benchmark's.

The window set is broadcast while it is below ``most_bytes``. A larger benchmark
is cut into blocks of that size in the shared folder; each task then reads block
after block against some ``HELD_BYTES`` of text, whose words are hashed once, so
memory stays bounded. A window and one of its items is one entry, so a window of very
many items is cut as well.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialise, pieces, scratch, take, texts

WINDOW, PERCENT = 13, 5
#: Size of a window set, and bytes that an entry takes beyond its words and item.
MOST_BYTES, ENTRY_BYTES = 64 << 20, 100
#: Bytes of text that are scanned together: for a broadcast set, and for blocks.
PIECE_BYTES, HELD_BYTES = 1 << 21, 24 << 20
_SPAN = 1 << 18  # bytes whose words are hashed at once
_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, _SPAN), _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), _SPAN)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of some texts: start and end byte, text number and hash of each."""

    def __init__(self, items: list[bytes]):
        self.data = np.frombuffer(b" ".join(items), np.uint8)
        is_word = np.concatenate(([False], _WORD[self.data], [False]))
        edge = np.flatnonzero(is_word[1:] != is_word[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]
        firsts = np.cumsum([0, *[len(t) + 1 for t in items]])
        self.first_byte = firsts[:-1]
        self.of = np.searchsorted(firsts, self.starts, "right") - 1
        self.count = np.bincount(self.of, minlength=len(items))
        self.lower = _LOWER[self.data]
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out, i = np.empty(len(self.starts), np.uint64), 0
        while i < len(self.starts):
            at = self.starts[i]
            j = int(np.searchsorted(self.ends, at + _SPAN, "right"))
            if j <= i:  # one word longer than a span
                out[i] = np.frombuffer(hashlib.sha256(self.lower[at : self.ends[i]].tobytes()).digest()[:8], np.uint64)[0]
                i += 1
                continue
            part = self.lower[at : self.ends[j - 1]]
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[part] * _UP[: len(part)], dtype=np.uint64)))
            a, b = self.starts[i:j] - at, self.ends[i:j] - at
            out[i:j] = _mixed((sums[b] - sums[a]) * _DOWN[a])
            i = j
        return out

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of n words, and whether it lies in one text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h = h * _STEP + self.hash[k : k + m]
        return _mixed(h), self.of[:m] == self.of[n - 1 :]

    def text(self, first: int, n: int) -> bytes:
        return b" ".join(self.lower[a:b].tobytes() for a, b in zip(self.starts[first : first + n], self.ends[first : first + n], strict=True))


class WindowSet:
    """Benchmark windows by length and hash, as sorted arrays: a window has its words and a run of item ids."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks().sort_by([("n", "ascending"), ("hash", "ascending"), ("words", "ascending")])
        n, words = rows["n"].to_numpy(), rows["words"].combine_chunks() if rows.num_rows else pa.array([], pa.binary())
        self.item_ids = rows["item"].combine_chunks() if rows.num_rows else pa.array([], pa.string())
        new = np.ones(rows.num_rows, bool)
        if rows.num_rows > 1:
            same = pc.equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)
            new[1:] = ~(same & (n[1:] == n[:-1]))
        first = np.flatnonzero(new)
        self.runs = np.append(first, rows.num_rows)  # item ids of window w: runs[w] to runs[w + 1]
        self.words = words.take(pa.array(first, pa.int64()))
        hashes = rows["hash"].to_numpy().view(np.uint64)[first]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]] = {}
        for length in np.unique(n[first]).tolist():
            at = np.flatnonzero(n[first] == length)
            at = at[np.argsort(hashes[at], kind="stable")]  # signed order isn't that of unsigned hashes
            keys = hashes[at]
            bits = max(10, min(28, int(len(keys) * 64).bit_length()))
            seen = np.zeros(1 << bits, bool)
            seen[keys >> np.uint64(64 - bits)] = True
            self.by_length[length] = keys, at, seen, np.uint64(64 - bits)

    def items(self, w: int) -> list[str]:
        return self.item_ids[int(self.runs[w]) : int(self.runs[w + 1])].to_pylist()

    def find(self, words: Words) -> Iterator[tuple[int, int, int]]:
        """(first word, length, window number) of every verified occurrence."""
        for n, (keys, at, seen, shift) in self.by_length.items():
            h, whole = words.windows(n)
            maybe = np.flatnonzero(seen[h >> shift] & whole) if len(h) else ()
            if not len(maybe):
                continue
            low, high = (np.searchsorted(keys, h[maybe], side) for side in ("left", "right"))
            for first, a, b in zip(maybe[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                text = words.text(first, n)
                for w in at[a:b].tolist():
                    if self.words[w].as_py() == text:
                        yield first, n, w


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """hash, n, words, item for every window of every item; short items are one window, empty ones none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                words = Words(texts(part))
                ids, rows = part.column("item").to_pylist(), []
                at = 0
                for item, count in zip(ids, words.count.tolist(), strict=True):
                    n = min(window, count)
                    if n:
                        h, _ = words.windows(n)
                        rows += [(int(h[i].astype(np.int64)), n, words.text(i, n), item) for i in range(at, at + count - n + 1)]
                    at += count
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.string()), strict=True)], ["hash", "n", "words", "item"])

    rows = take(benchmark, item=id_col, text=text_col).withColumn("item", F.col("item").cast("string"))
    return rows.mapInArrow(cut, "hash long, n int, words binary, item string")


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches with about ``most`` bytes of text each, over the borders of the incoming ones."""
    waiting, size = [], 0
    for batch in batches:
        for part in pieces(batch, most=min(most, PIECE_BYTES)):
            n = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if waiting and size + n > most:
                yield pa.concat_batches(waiting)
                waiting, size = [], 0
            waiting.append(part)
            size += n
    if waiting:
        yield pa.concat_batches(waiting)


def _blocks(path: str) -> Iterator[WindowSet]:
    store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    for found in sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet")):
        yield WindowSet(ds.dataset(found, filesystem=store).to_table())


SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    most_bytes: int = MOST_BYTES,
    held_bytes: int = HELD_BYTES,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans of every row (and the columns in ``keep``).

    ``contaminated``: some word is hit, and hit words are at least ``percent``
    per cent of all. ``spans`` are the hit byte ranges of the UTF-8 text. Null
    and empty texts have no words. Items without an id count for hits but aren't
    named; repeated items count once. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    windows = materialise(benchmark_windows(benchmark, window).distinct(), "windows")
    bytes_ = windows.agg(F.sum(F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0)) + ENTRY_BYTES)).first()[0] or 0
    if bytes_ <= most_bytes:
        shared, folder, held = spark.sparkContext.broadcast(WindowSet(windows.toArrow())), None, PIECE_BYTES
    else:
        shared, folder, held = None, scratch(spark, "window-blocks"), held_bytes
        windows.repartitionByRange(int(bytes_ // most_bytes) + 1, "hash", "item").write.parquet(folder)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, held):
            yield _scan(part, [shared.value] if shared else _blocks(folder), percent, keep)

    rows = take(docs, **{"doc_id": id_col, "text": text_col, **{f"keep{i}": c for i, c in enumerate(keep)}})
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL(SCHEMA).fields, *rows.schema.fields[2:]])
    return rows.mapInArrow(scan, schema)


def _scan(part: pa.RecordBatch, sets: list[WindowSet] | Iterator[WindowSet], percent: int, keep: tuple[str, ...]) -> pa.RecordBatch:
    words = Words(texts(part))
    turns, items = np.zeros(len(words.starts) + 1, np.int64), defaultdict(set)
    for known in sets:
        met: dict[int, list[str]] = {}
        for first, n, w in known.find(words):
            turns[first] += 1
            turns[first + n] -= 1
            if w not in met:
                met[w] = known.items(w)
            items[int(words.of[first])].update(met[w])
    hit = np.cumsum(turns[:-1]) > 0
    n_hit = np.bincount(words.of[hit], minlength=part.num_rows)
    spans: list[list] = [[] for _ in range(part.num_rows)]
    for i in np.flatnonzero(hit).tolist():
        k = int(words.of[i])
        a, b = int(words.starts[i] - words.first_byte[k]), int(words.ends[i] - words.first_byte[k])
        if spans[k] and i and hit[i - 1] and words.of[i - 1] == k:
            spans[k][-1]["end"] = b
        else:
            spans[k].append({"start": a, "end": b})
    named = [sorted(x for x in items.get(k, ()) if x is not None) for k in range(part.num_rows)]
    columns = [
        part.column("doc_id"),
        pa.array(words.count, pa.int64()),
        pa.array(n_hit, pa.int64()),
        pa.array([len(x) for x in named], pa.int64()),
        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in named]),
        pa.array((n_hit > 0) & (100 * n_hit >= percent * words.count)),
        pa.array(spans, _SPANS),
        *[part.column(f"keep{i}") for i in range(len(keep))],
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", *[f"keep{i}" for i in range(len(keep))]])


def remove_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated rows; the columns ride through the scan, so nothing is joined. Null and empty texts stay."""
    found = decontaminate(docs, benchmark, id_col=id_col, text_col=text_col, keep=tuple(docs.columns), **options)
    return found.where(~F.col("contaminated")).select(*[F.col(f"keep{i}").alias(c) for i, c in enumerate(docs.columns)])


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every hit span cut out of the text; all rows stay, and null texts stay null."""
    found = decontaminate(docs, benchmark, id_col=id_col, text_col=text_col, keep=tuple(docs.columns), **options)
    text = f"keep{docs.columns.index(text_col)}"

    @F.udf("string", useArrow=True)
    def without(value, spans):
        if value is None:
            return None
        raw, out, at = value.encode(), [], 0
        for s in spans:
            out.append(raw[at : s["start"]])
            at = s["end"]
        return b"".join([*out, raw[at:]]).decode()

    return found.withColumn(text, without(text, "spans")).select(*[F.col(f"keep{i}").alias(c) for i, c in enumerate(docs.columns)])
