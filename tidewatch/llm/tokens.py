"""Token ids in binary shards, with a minimal perfect hash index for keyed access.

A shard is three files: ``.bin`` holds the raw ids of its documents one after
another, ``.keys`` the document keys in row order (rows without a key come first, and the
index says how many), and ``.idx`` a minimal perfect hash over
the distinct keys. The hash maps a key to a slot; the slot has the key's
fingerprint, its first row and number of rows, and the rows' offsets give the
place in ``.bin``. A lookup reads a few words whatever the shard holds, and a key that
isn't stored is met by its fingerprint.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, pieces, scratch, take

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
LOAD = 2.0  # bits of a level for each key it gets
#: Letters, numbers and white space below U+0250 without the four information separators (fixed values).
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
#: Splits a text of such characters as the byte-level tokenizers do before they merge: no token spans two parts.
PARTS = f" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+| ?[{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
_LATIN = re.compile("[\x00-\x1b\x20-\u024f]*")
SHARD_BYTES = 256 << 20  # text of a shard on average, at most
MOST_PARTS = 1 << 20  # parts whose ids a Python worker remembers, some 150 MB


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys.view(np.uint64) + np.uint64(seed + 1) * _MIX[2]
        h = (h ^ (h >> np.uint64(30))) * _MIX[0]
        h = (h ^ (h >> np.uint64(27))) * _MIX[1]
        return h ^ (h >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct int64 keys.

    Level by level, keys are hashed into a bit array; a key that is alone on its
    bit is placed there, the others go on to the next level. A key's slot is the
    number of set bits before its own.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # boolean arrays
        counts = np.cumsum([0, *[int(x.sum()) for x in levels]])
        self.size = int(counts[-1])
        self.before = [np.cumsum(x, dtype=np.int64) - x + c for x, c in zip(levels, counts, strict=False)]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            bits = max(8, int(LOAD * len(left)))
            at = (_hash(left, len(levels)) % np.uint64(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(alone)
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has a bit for it."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, level in enumerate(self.levels):
            if not len(open_):
                break
            at = (_hash(keys[open_], k) % np.uint64(len(level))).astype(np.int64)
            met = level[at]
            out[open_[met]] = self.before[k][at[met]]
            open_ = open_[~met]
        return out


def fingerprint32(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


class Shard:
    """A shard that was opened for lookups; ids are read from the file by offset."""

    def __init__(self, folder: str, name: str):
        from .media import open_store

        self.store, root = open_store(folder)
        self.path = f"{root}/{name}"
        with self.store.open_input_file(f"{self.path}.idx") as file:
            n = int.from_bytes(file.read(8), "little")
            head = json.loads(file.read(n))
            self.dtype, self.nulls = np.dtype(head["dtype"]), head["nulls"]
            self.hash = PerfectHash([np.unpackbits(np.frombuffer(file.read(-(-b // 8)), np.uint8), count=b).astype(bool) for b in head["bits"]])
            self.prints = np.frombuffer(file.read(4 * head["keys"]), np.uint32)
            self.first = np.frombuffer(file.read(8 * (head["keys"])), np.int64)
            self.rows = np.frombuffer(file.read(8 * (head["keys"])), np.int64)
            self.offsets = np.frombuffer(file.read(8 * (head["rows"] + 1)), np.int64)
        self.file = self.store.open_input_file(f"{self.path}.bin")

    def keys(self) -> np.ndarray:
        """The keys of the rows after those without one."""
        with self.store.open_input_file(f"{self.path}.keys") as file:
            return np.frombuffer(file.read(), np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; 0 rows for keys that aren't stored."""
        slots = self.hash.slots(keys)
        safe = np.maximum(slots, 0)
        if not len(self.prints):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        met = (slots >= 0) & (self.prints[safe] == fingerprint32(keys))
        return np.where(met, self.first[safe], 0), np.where(met, self.rows[safe], 0)

    def ids(self, row: int) -> np.ndarray:
        a, b = int(self.offsets[row]), int(self.offsets[row + 1])
        size = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((b - a) * size, a * size), self.dtype)

    def many(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each row; runs of neighbours are read at once."""
        ends = np.flatnonzero(np.append(np.diff(rows) != 1, True)) + 1
        for first, last in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):
            a, b = int(self.offsets[rows[first]]), int(self.offsets[rows[last - 1] + 1])
            size = self.dtype.itemsize
            block = np.frombuffer(self.file.read_at((b - a) * size, a * size), self.dtype)
            for r in rows[first:last]:
                yield block[self.offsets[r] - a : self.offsets[r + 1] - a]


class Encoder:
    """Whole texts to ids with a ``tokenizers`` file, as the library gives them without special tokens added; those that a text holds are met.

    A tokenizer that cuts texts by the byte-level rule before it merges treats the
    parts independently. Parts of Latin texts repeat, so each distinct part goes
    through the library once and its ids are remembered. Other texts, texts that hold an added
    token's content, and all texts of a tokenizer with any other rule, go through the library whole.
    """

    def __init__(self, path: str, dtype: str = "<u4", parts: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.split = re.compile(PARTS) if parts and cuts_by_parts(self.model) else None
        added = [re.escape(t.content) for t in self.model.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)")
        self.dtype = np.dtype(dtype)
        if self.model.get_vocab_size() > np.iinfo(self.dtype).max + 1:
            raise ValueError(f"ids don't fit {dtype}")
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Encodes parts, many in a call that keeps them apart and tells whose each id is."""
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            found = self.model.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids, counts = np.array(found.ids, self.dtype).tobytes(), np.bincount(np.array(found.word_ids, np.int64), minlength=len(some))
            cuts = [0, *(np.cumsum(counts) * self.dtype.itemsize).tolist()]
            self.known.update(zip(some, [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, in the encoder's type."""
        if self.split is None:
            return self._encode(texts)
        if len(self.known) > MOST_PARTS:
            self.known.clear()
        plain = [_LATIN.fullmatch(t) is not None and self.added.search(t) is None for t in texts]
        parts = [self.split.findall(t) if p else () for t, p in zip(texts, plain, strict=True)]
        self._learn(list(set().union(*parts) - self.known.keys()))
        whole = iter(self._encode([t for t, p in zip(texts, plain, strict=True) if not p]))
        get = self.known.__getitem__
        return [b"".join(map(get, p)) if is_plain else next(whole) for p, is_plain in zip(parts, plain, strict=True)]


def cuts_by_parts(model) -> bool:
    """Whether the file's own rule is the byte-level one of ``PARTS``: nothing else changes, cuts or matches text before the merges."""
    found = json.loads(model.to_str())
    before, merges = found["pre_tokenizer"] or {}, found["model"]
    return (
        (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) == ("ByteLevel", False, True)
        and found["normalizer"] is None
        and merges["type"] == "BPE"
        and not merges.get("dropout")
        and all(t["special"] for t in found["added_tokens"])
    )


@lru_cache(maxsize=2)
def encoder(path: str, dtype: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path, dtype)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, dtype: str = "<u4", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shards in ascending key order and returns the manifest: shard, part, rows, tokens, keys, start.

    Rows are dealt to tasks by ranges of (key, text hash, place) and sorted within each,
    so shards in order of ``part`` are the corpus in ascending key order, null keys
    first; equal rows in any number are dealt too. There are as many ranges as shuffle partitions,
    more if they would have over ``SHARD_BYTES`` of text on average. Only shards of committed tasks are in the manifest. ``start`` is the
    number of ids in all shards before. Repeated keys are neighbours and share a slot. Keys are whole
    numbers, also as text; other keys raise.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .media import open_store

        encode, (store, root), end = encoder(tokenizer, dtype), open_store(folder), np.array([end_id], dtype).tobytes()
        part_id, name, out, nulls, keys, lengths = TaskContext.get().partitionId(), uuid.uuid4().hex, None, 0, [], []
        for batch in batches:
            for part in pieces(batch, most=1 << 21):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}.bin")
                nulls += part.column("key").null_count
                keys.append(part.column("key").drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
                ended = [ids + end for ids in encode([t or "" for t in part.column("text").to_pylist()])]
                lengths += [len(x) // len(end) for x in ended]
                out.write(b"".join(ended))
        if out is None:
            return
        out.close()
        known = np.concatenate(keys)
        tokens = _write_index(store, f"{root}/{name}", nulls, known, np.array(lengths, np.int64), dtype)
        columns = {"shard": [name], "part": [part_id], "rows": [len(lengths)], "tokens": [tokens], "first_key": known[:1].tolist() or [None], "last_key": known[-1:].tolist() or [None]}
        yield pa.RecordBatch.from_pydict(columns, pa.schema([("shard", pa.string()), *[(c, pa.int64()) for c in list(columns)[1:]]]))

    rows = take(docs, key=id_col, text=text_col).withColumn("key", F.col("key").cast("long")).withColumn("h", F.xxhash64("text")).withColumn("at", F.monotonically_increasing_id())
    ranges = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES)
    order = ["key", "h", "at"]
    dealt = rows.repartitionByRange(ranges, *order) if ranges > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartitionByRange(*order)
    ordered = dealt.sortWithinPartitions(*order).select("key", "text")
    manifest = materialise(ordered.mapInArrow(write, "shard string, part long, rows long, tokens long, first_key long, last_key long"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    return materialise(manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "token-manifest")


def _write_index(store, path: str, nulls: int, keys: np.ndarray, lengths: np.ndarray, dtype: str) -> int:
    distinct, first, rows = np.unique(keys, return_index=True, return_counts=True)
    index = PerfectHash.build(distinct)
    slots = index.slots(distinct)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    prints, firsts, counts = np.empty(len(distinct), np.uint32), np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
    prints[slots], firsts[slots], counts[slots] = fingerprint32(distinct), first + nulls, rows
    head = json.dumps({"dtype": dtype, "keys": len(distinct), "nulls": nulls, "rows": len(lengths), "bits": [len(x) for x in index.levels]}).encode()
    with store.open_output_stream(f"{path}.idx") as file:
        file.write(len(head).to_bytes(8, "little") + head)
        for level in index.levels:
            file.write(np.packbits(level).tobytes())
        for column in (prints, firsts, counts, offsets):
            file.write(column.tobytes())
    with store.open_output_stream(f"{path}.keys") as file:
        file.write(keys.astype(np.int64).tobytes())
    return int(offsets[-1])


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, each met through its shard's index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = Shard(folder, name)
                distinct = np.unique(shard.keys())
                first, count = shard.find(distinct)
                rows = np.repeat(first, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
                rows, keys = np.concatenate((np.arange(shard.nulls), rows)), np.concatenate((np.zeros(shard.nulls, np.int64), np.repeat(distinct, count)))
                for at in range(0, len(rows), 1000):
                    some = rows[at : at + 1000]
                    sums = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in shard.many(some)]
                    null = np.arange(at, at + len(some)) < shard.nulls
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[at : at + 1000], pa.int64(), mask=null), pa.array(start + shard.offsets[some]), pa.array(shard.offsets[some + 1] - shard.offsets[some]), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = max(1, min(manifest.count(), manifest.sparkSession.sparkContext.defaultParallelism * 8))
    spread = manifest.select("shard", "start").repartition(n)  # a fixed number: shards are few rows but much work
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(keys: DataFrame, manifest: DataFrame, folder: str, key_col: str = "doc_id", most_shards: int = 1 << 20) -> DataFrame:
    """key, start, ids of every stored document with one of the given keys; unknown keys give no row.

    Keys are routed to the shards whose range holds them by the shards' bounds
    (24 bytes a shard, ``most_shards`` at most) and meet each shard's index once.
    """
    bounds = manifest.where("first_key IS NOT NULL").select("shard", "start", "first_key", "last_key").orderBy("part").toArrow()
    if bounds.num_rows > most_shards:
        raise ValueError(f"{bounds.num_rows} shards; write larger ones")
    first, last = bounds["first_key"].to_numpy(), bounds["last_key"].to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast((first, last, bounds["shard"].to_pylist(), bounds["start"].to_numpy()))

    @F.pandas_udf("array<int>")
    def shards_of(key: pd.Series) -> pd.Series:
        k, (first, last, *_) = key.to_numpy(np.int64), shared.value
        return pd.Series([list(range(a, b)) for a, b in zip(np.searchsorted(last, k, "left"), np.searchsorted(first, k, "right"), strict=True)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, Shard] = {}
        _, _, names, starts = shared.value
        for batch in batches:
            wanted, at = batch.column("key").to_numpy(), batch.column("at").to_numpy()
            for i in np.unique(at).tolist():
                if i not in opened:
                    opened.clear()  # keys come in order of shards
                    opened[i] = Shard(folder, names[i])
                shard, some = opened[i], wanted[at == i]
                rows = [(k, r) for k, f, n in zip(some.tolist(), *shard.find(some), strict=True) for r in range(f, f + n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in rows], pa.int64()), pa.array([int(starts[i] + shard.offsets[r]) for _, r in rows], pa.int64()), pa.array([shard.ids(r).astype(np.int64) for _, r in rows], pa.list_(pa.int64()))], ["key", "start", "ids"]
                )

    routed = take(keys, key=key_col).where("key IS NOT NULL").select(F.col("key").cast("long").alias("key")).withColumn("at", F.explode(shards_of("key")))
    return routed.repartition("at").sortWithinPartitions("at", "key").mapInArrow(read, "key long, start long, ids array<long>")


def tokenise(docs: DataFrame, tokenizer: str, end_id: int = 0, dtype: str = "<u2", folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards and reads every document back through the index.

    Null and empty texts are one end id. Null ids keep their rows, come first and
    read back as null. An empty table writes no shard.
    """
    folder = folder or scratch(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer, end_id, dtype, id_col, text_col), folder)
