"""Removal of repeated byte strings across documents, by suffix arrays.

Every string of ``length`` bytes (a window) that also starts earlier is cut out. Equal windows
must meet in one task to be compared, so windows are dealt by an anchor: the ``k`` bytes in it
with the smallest hash (the first, if several). Neighbouring windows mostly share it and
travel as one piece of text. Only anchors that occur twice can hold repeats; the others, most
of the corpus, aren't moved at all. The pieces of an anchor are ordered as suffixes
(``suffixes``), where equal windows are neighbours; all but the earliest are cut.

1. Documents are dealt to buckets of some MB. Each bucket reports its anchors; those with two
   occurrences or more come back to the buckets that hold them.
2. A bucket sends the pieces of those anchors. A piece that a smaller document of the bucket
   has too, byte for byte, is a repeat as a whole and stays. Anchors with more than ``HOT``
   occurrences are split: their pieces are cut by anchors of ``length - 1`` bytes, so texts
   that differ go to different tasks, and those that don't are one piece for each bucket.
3. The places to cut go back to the buckets.

All three read the same exchange of the documents, which Spark does once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffixes
from .common import take

LENGTH = 100
#: Bytes of text in a bucket, and buckets for each shuffle partition at least.
BUCKET_BYTES, BUCKETS_EACH = 8 << 20, 4
#: Occurrences from which an anchor's pieces are split before they are sent, and different pieces from which a task splits them.
HOT, MANY = 1024, 48
#: Bytes that are hashed, and symbols whose suffixes are ordered, at a time.
SLICE_BYTES, BATCH_SYMBOLS = 1 << 21, 1 << 21
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_SPLIT = 0x5851F42D4C957F2D

_ANCHORS = pa.schema([("h", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64())])
_PIECES = pa.schema([("key", pa.int64()), ("piece", pa.binary()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("bucket", pa.int32()), ("start", pa.int64()), ("n", pa.int64())])
_CUTS = pa.schema([(name, _PIECES.field(name).type) for name in ("bucket", "doc_id", "row_key", "start", "n")])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("kept", pa.binary())])
#: A document of a piece: (no id, id, row key, bucket, first window); smaller ids first, null ids last.
Place = tuple[bool, int, int, int, int]


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names.get(f.type, 'array<struct<start: long, length: long>>')}" for f in schema)


def _powers(n: int, base: int) -> np.ndarray:
    return np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)


def anchors(texts: list[bytes], k: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first window, windows) of each longest stretch of windows of a text that have one anchor of ``k`` bytes."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(len(raw), _STEP), dtype=np.uint64)))
    h = (sums[k:] - sums[:-k]) * _powers(len(sums) - k, _BACK)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    least, span, width = h, 1, length - k + 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    within = np.zeros(n + 1, np.int64)  # windows that lie in one text
    some = sizes >= length
    np.add.at(within, begins[some], 1)
    np.add.at(within, np.minimum(begins + sizes - length + 1, n)[some], -1)
    within = np.cumsum(within[:-1]) > 0
    cut = np.ones(n, bool)
    cut[1:] = (least[1:] != least[:-1]) | (h[: n - 1] == least[:-1])  # another anchor, or the same bytes at another place
    cut[begins[begins < n]] = True
    first = np.flatnonzero(cut | ~within)
    many = np.diff(np.append(first, n))
    keep = within[first]
    first, many = first[keep], many[keep]
    text = np.searchsorted(begins, first, "right") - 1
    return least[first], text, first - begins[text], many


class Bucket:
    """The distinct documents of a bucket, by id (nulls last) and row key."""

    def __init__(self, rows: pa.Table):
        seen = {}
        for i, key, text in zip(rows["doc_id"].to_pylist(), rows["row_key"].to_pylist(), rows["raw"].to_pylist(), strict=True):
            seen[i is None, i or 0, key] = text or b""
        self.names = sorted(seen)
        self.texts = [seen[name] for name in self.names]

    def anchors(self, k: int, length: int) -> Iterator[tuple[list[bytes], int, tuple[np.ndarray, ...]]]:
        """(texts, place of the first, their anchors) of slices of some ``SLICE_BYTES``."""
        start = size = 0
        for i, text in enumerate([*self.texts, None]):
            if text is None or (i > start and size + len(text) > SLICE_BYTES):
                part = self.texts[start:i]
                if size >= length:
                    yield part, start, anchors(part, k, length)
                start, size = i, 0
            size += len(text or b"")


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _cuts(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_CUTS)], schema=_CUTS)


class Marks:
    """Windows to cut, as rows of ``_CUTS``; neighbours of a document that come one after the other are joined."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, place: Place, n: int, shift: int = 0) -> None:
        empty, i, key, bucket, start = place
        row = (bucket, None if empty else i, key, start + shift, n)
        if self.rows and self.rows[-1][:3] == row[:3] and self.rows[-1][3] + self.rows[-1][4] == row[3]:
            row = (*row[:3], self.rows[-1][3], self.rows.pop()[4] + n)
        self.rows.append(row)


def meet(places: list[Place], new: Place, n: int, marks: Marks) -> list[Place]:
    """The places of equal texts that stay once ``new`` has come; all n windows of the others are marked.

    Only a smaller id is earlier, or a place before in the same document. So rows of one id
    with different texts stay beside each other, and so do rows without id.
    """
    if places[0][:2] < new[:2]:
        marks.add(new, n)
        return places
    if places[0][:2] > new[:2]:
        for place in places:
            marks.add(place, n)
        return [new]
    for k, place in enumerate(places):
        if place[2:4] == new[2:4]:
            if place[4] != new[4]:
                marks.add(max(place, new), n)
            return [*places[:k], min(place, new), *places[k + 1 :]]
    return [*places, new]


def report_anchors(rows: pa.Table, k: int, length: int) -> pa.Table:
    """The anchors of a bucket with their number of occurrences."""
    found = [h for _, _, (h, *_) in Bucket(rows).anchors(k, length)]
    h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    bucket = rows["bucket"][0].as_py() if rows.num_rows else 0
    return pa.Table.from_arrays([pa.array(_signed(h)), pa.array(np.full(len(h), bucket, np.int32)), pa.array(n.astype(np.int64))], schema=_ANCHORS)


def repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, h, hot) of anchors with two occurrences or more; rows come in order of h, so only the last h is carried on."""
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))

    def of(h: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        total = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(h)))) if len(h) else n
        some = total > 1
        return pa.RecordBatch.from_arrays([pa.array(bucket[some]), pa.array(h[some]), pa.array(total[some] > HOT)], ["bucket", "h", "hot"])

    held = empty
    for batch in batches:
        if not batch.num_rows:
            continue
        h, bucket, n = (np.concatenate((a, batch.column(c).to_numpy())) for a, c in zip(held, ("h", "bucket", "n"), strict=True))
        last = np.searchsorted(h, h[-1])
        held = h[last:], bucket[last:], n[last:]
        yield of(h[:last], bucket[:last], n[:last])
    yield of(*held)


def pieces_of(rows: pa.Table, wanted: pa.Table, k: int, length: int) -> pa.Table:
    """Pieces of the wanted anchors, and as rows without a piece the windows that the bucket itself knows to be repeats."""
    columns: list[list] = [[] for _ in _PIECES]
    marks = Marks()
    seen: dict[bytes, Place] = {}

    def send(key: int, piece: bytes, place: Place) -> None:
        first = seen.setdefault(piece, place)
        if first is not place and (first[:2] < place[:2] or first[2:4] == place[2:4]):
            marks.add(place, len(piece) - length + 1)
            return
        empty, i, row_key, home, start = place
        for column, value in zip(columns, (key, piece, None if empty else i, row_key, home, start, len(piece) - length + 1), strict=True):
            column.append(value)

    if wanted.num_rows:
        hs, hot = wanted["h"].to_numpy().view(np.uint64), wanted["hot"].to_numpy(zero_copy_only=False)
        order = np.argsort(hs)
        hs, hot = hs[order], hot[order]
        bucket, home = Bucket(rows), rows["bucket"][0].as_py()
        split: dict[bytes, list[Place]] = {}
        for texts, at, (h, text, start, many) in bucket.anchors(k, length):
            where = np.minimum(np.searchsorted(hs, h), len(hs) - 1)
            mine = np.flatnonzero(hs[where] == h)
            names = [(*name, home) for name in bucket.names[at : at + len(texts)]]
            for key, t, s, m, is_hot in zip(_signed(h[mine]).tolist(), text[mine].tolist(), start[mine].tolist(), many[mine].tolist(), hot[where[mine]].tolist(), strict=True):
                piece, place = texts[t][s : s + m + length - 1], (*names[t], s)
                if not is_hot:
                    send(key, piece, place)
                elif piece in split:
                    split[piece] = meet(split[piece], place, m, marks)
                else:
                    split[piece] = [place]
        seen.clear()
        whole = list(split)
        for at in range(0, len(whole), 1 << 13):
            some = whole[at : at + (1 << 13)]
            h, text, start, many = anchors(some, length - 1, length)
            for key, t, s, m in zip(_signed(h ^ np.uint64(_SPLIT)).tolist(), text.tolist(), start.tolist(), many.tolist(), strict=True):
                for place in split[some[t]]:
                    send(key, some[t][s : s + m + length - 1], (*place[:4], place[4] + s))
    for home, i, row_key, start, n in marks.rows:
        for column, value in zip(columns, (row_key, None, i, row_key, home, start, n), strict=True):
            column.append(value)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)


Group = dict[bytes, list[Place]]


def _finer(group: Group, k: int, length: int, marks: Marks) -> list[Group]:
    """The group by anchors of ``k`` bytes; pieces that are equal then meet."""
    out: dict[int, Group] = {}
    whole = list(group)
    h, text, start, many = anchors(whole, k, length)
    for key, t, s, m in zip(h.tolist(), text.tolist(), start.tolist(), many.tolist(), strict=True):
        piece, own = whole[t][s : s + m + length - 1], out.setdefault(key, {})
        for place in group[whole[t]]:
            place = (*place[:4], place[4] + s)
            own[piece] = meet(own[piece], place, m, marks) if piece in own else [place]
    return list(out.values())


def compare(groups: list[Group], length: int) -> pa.RecordBatch:
    """The windows to cut in groups of pieces: all but the earliest of each class of equal ones."""
    symbols, bases, sizes = suffixes.join([list(g) for g in groups])
    texts = [t for g in groups for t in g]
    lengths = np.array([len(t) for t in texts], np.int64)
    of_group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    starts = np.cumsum(lengths + 1) - (lengths + 1) + 1 + of_group  # an END between groups
    full = np.zeros(len(symbols) + 1, np.int64)
    full[starts] += 1
    full[starts + lengths - length + 1] -= 1
    at, kind = suffixes.equal_windows(symbols, suffixes.suffix_arrays(symbols, bases, sizes), np.cumsum(full[:-1]) > 0, length)
    text = np.searchsorted(starts, at, "right") - 1
    shift = at - starts[text]

    places = [p for g in groups for some in g.values() for p in some]
    each = np.array([len(some) for g in groups for some in g.values()], np.int64)
    first = np.cumsum(each) - each
    many = each[text]
    kind, shift = np.repeat(kind, many), np.repeat(shift, many)
    of = np.repeat(first[text] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    empty, ids, row_key, home, start = (np.array([p[i] for p in places], np.int64)[of] for i in range(5))
    start = start + shift
    order = np.lexsort((start, home, row_key, ids, empty, kind))
    kind, empty, ids, row_key, home, start = (x[order] for x in (kind, empty, ids, row_key, home, start))

    def changes(*columns: np.ndarray) -> np.ndarray:
        return np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0))) if len(kind) else np.zeros(0, bool)

    lead = np.flatnonzero(changes(kind))
    lead = np.repeat(lead, np.diff(np.append(lead, len(kind))))
    later = (ids != ids[lead]) | (empty != empty[lead])
    later |= ~changes(kind, row_key, home, ids, empty)  # not the first place of its document
    empty, ids, row_key, home, start = (x[later] for x in (empty, ids, row_key, home, start))
    order = np.lexsort((start, home, row_key, ids, empty))
    kind = empty, ids, row_key, home, start = tuple(x[order] for x in (empty, ids, row_key, home, start))
    begin = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in kind[:4]], axis=0) | (start[1:] != start[:-1] + 1)))) if len(start) else np.zeros(0, np.int64)
    n = np.diff(np.append(begin, len(start)))
    columns = [pa.array(home[begin], pa.int32()), pa.array(ids[begin], pa.int64(), mask=empty[begin] > 0), pa.array(row_key[begin]), pa.array(start[begin]), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, schema=_CUTS)


def find_cuts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Windows to cut, from pieces in order of their key; rows without a piece go on as they are."""
    waiting: list[Group] = []
    marks, size = Marks(), 0
    group: Group = {}
    last = None

    def close() -> None:
        nonlocal group, size
        todo = [(group, (length * 4 // 5, length - 1))]
        while todo:
            own, finer = todo.pop()
            if len(own) < 2:
                continue
            if len(own) > MANY and finer and any(len(t) > length + 1 for t in own):
                todo += [(g, finer[1:]) for g in _finer(own, finer[0], length, marks)]
            else:
                waiting.append(own)
                size += sum(len(t) + 1 for t in own)
        group = {}

    def solved() -> Iterator[pa.RecordBatch]:
        nonlocal size
        if waiting:
            yield compare(waiting, length)
        if marks.rows:
            yield from _cuts(marks.rows).to_batches()
        waiting.clear()
        marks.rows.clear()
        size = 0

    for batch in batches:
        bare = batch.column("piece").is_null()
        yield batch.filter(bare).select(_CUTS.names)
        batch = batch.filter(pc.invert(bare))
        for key, piece, i, row_key, home, start, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key != last:
                close()
                last = key
                if size >= BATCH_SYMBOLS:
                    yield from solved()
            place = (i is None, i or 0, row_key, home, start)
            group[piece] = meet(group[piece], place, n, marks) if piece in group else [place]
    close()
    yield from solved()


def cut(rows: pa.Table, cuts: pa.Table, length: int) -> pa.Table:
    """Spans that are cut, and what is left, of every document of a bucket."""
    keys = cuts["row_key"].to_numpy()
    order = np.argsort(keys, kind="stable")
    keys, start, n = keys[order], cuts["start"].to_numpy()[order], cuts["n"].to_numpy()[order]
    ids = cuts["doc_id"].take(pa.array(order)).to_pylist()
    sizes, spans, kept = [], [], []
    for i, key, text in zip(rows["doc_id"].to_pylist(), rows["row_key"].to_pylist(), rows["raw"].to_pylist(), strict=True):
        text = text or b""
        low, high = np.searchsorted(keys, [key, key + 1]) if key < np.iinfo(np.int64).max else (np.searchsorted(keys, key), len(keys))
        mine = [x for x in range(low, high) if ids[x] == i]
        sizes.append(len(text))
        if not mine:
            spans.append([])
            kept.append(text)
            continue
        change = np.zeros(len(text) + 1, np.int64)
        np.add.at(change, start[mine], 1)
        np.add.at(change, start[mine] + n[mine] - 1 + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
        spans.append([{"start": a, "length": b - a} for a, b in edge.reshape(-1, 2).tolist()])
        kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
    return pa.Table.from_arrays([rows["doc_id"].combine_chunks(), pa.array(sizes, pa.int64()), pa.array(spans, _KEPT.field("spans").type), pa.array(kept, pa.binary())], schema=_KEPT)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (start and length in bytes of what is cut, by start) and kept (the bytes left) of every row.

    Texts are UTF-8 bytes, null ones empty. A byte is cut if a string of ``length`` bytes that
    covers it also starts earlier: in a row with a smaller id, or before in the same row; a
    null id is larger than all others. Rows of one id aren't earlier than each other, nor
    are rows without id, so repeated rows all have the result of one. Strings are judged on
    the input, not on what is left. Shorter texts stay whole. Ids are whole numbers; other
    columns aren't read. ``length`` is 16 at least.
    """
    if length < 16:
        raise ValueError("strings are 16 bytes at least")
    spark, k = docs.sparkSession, length * 2 // 5
    rows = take(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("raw"))
    total = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    buckets = max(BUCKETS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    row_key = F.xxhash64("doc_id", F.coalesce("raw", F.lit(b"")))
    # rows that may be equal in great numbers and needn't meet are dealt by where they are read
    alone = F.col("doc_id").isNull() | F.col("raw").isNull() | (F.octet_length("raw") < length)
    home = F.pmod(F.when(alone, F.xxhash64("row_key", F.spark_partition_id())).otherwise(F.col("row_key")), F.lit(buckets)).cast("int")
    dealt = rows.withColumn("row_key", row_key).select("doc_id", "row_key", home.alias("bucket"), "raw").repartition("bucket")
    by_bucket = dealt.groupBy("bucket")

    found = by_bucket.applyInArrow(lambda t: report_anchors(t, k, length), _ddl(_ANCHORS))
    wanted = found.repartition("h").sortWithinPartitions("h").mapInArrow(repeated_anchors, "bucket int, h long, hot boolean")
    sent = by_bucket.cogroup(wanted.groupBy("bucket")).applyInArrow(lambda t, w: pieces_of(t, w, k, length), _ddl(_PIECES))
    cuts = sent.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: find_cuts(batches, length), _ddl(_CUTS))
    return by_bucket.cogroup(cuts.groupBy("bucket")).applyInArrow(lambda t, c: cut(t, c, length), _ddl(_KEPT))
