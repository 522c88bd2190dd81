"""SimHash near-duplicates by segment popcounts, a grid join and an exact check.

A 64-bit fingerprint is embedded as 32 counts: the set bits of each 2-bit
segment. One flipped bit changes one count by one, so the Manhattan distance of
two embeddings is a lower bound of the Hamming distance. Counts are kept in
unary (00, 01, 11), which makes the Manhattan distance ``bit_count(u xor v)``.

The range join "distance at most d" uses a grid: the 32 dimensions form ``b``
blocks, and two embeddings within d differ in at most d blocks, so they agree on
some ``b - d`` of them. Each choice of blocks is one grid; its cells are the
counts in those blocks. Every fingerprint is placed once in each grid, and a cell's members
are compared where they meet: by the bound first, then bit by bit.

A link may ask for more than near fingerprints: that the sets of word shingles have a
similarity. Then fingerprints (several, so that few pairs are missed) and a print of
128 bits over the shingles only propose pairs; the shingles of the proposed texts are read
and counted, and pairs below the similarity are no links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, pieces, release, row_hash, take, texts
from .components import components

LOW_BITS = 0x5555555555555555
#: Ids of documents are broadcast up to this number (16 bytes each, with the hash of the row).
BROADCAST_IDS = 1 << 21
SEGMENTS, WORDS, SEED, DISTANCE = 32, 4, 42, 4
#: Up to so many nodes, this many blocks beyond ``distance``: more blocks, smaller cells, more grids.
BLOCKS = ((1 << 19, 1), (1 << 24, 2), (1 << 28, 3), (1 << 62, 4))
#: Members from which a cell is split by further segments; up to which it is compared without a loop over cells; with all pairs at once.
HOT_MEMBERS, SMALL, LARGE = 1 << 14, 32, 1 << 14
#: Near pairs a member from which a cell is a crowd, in which each member is linked once. Rows that are compared at a time.
CROWDED, CHUNK_ROWS = 4, 1 << 17
#: Tasks that the nodes of one component are dealt to, and rows of a node from which they look it up where they are.
SALTS, HOT_ROWS = 16, 1 << 14
#: Heads from which a shingle that so many hold comes behind the others, and the most such shingles (the order decides what is compared, never what is found).
LATE_MEMBERS, MOST_LATE = 64, 1 << 16
#: Shingles of the sets of a block, in which members of crowds are compared (8 bytes each; a task holds two blocks), and the fewest blocks.
BLOCK_SHINGLES, LEAST_BLOCKS = 1 << 20, 4
_SALTS = np.array([0, 0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A, 0xDAA66D2C7DDF743F], np.uint64)


@dataclass(frozen=True)
class Likeness:
    """When two texts link: a fingerprint over ``words``-word shingles (``distinct``: repeats count once) within ``distance``.

    With ``set_words``, the Jaccard similarity of the sets of shingles of so many words decides: it must be ``similarity`` or
    more. Of ``prints`` fingerprints one must be near then, and the wide print of the sets within ``wide_distance`` of 128 bits
    (``roomy`` in cells of more than ``SMALL``); in a crowd, a pair within ``tight`` is taken to be a link that others needn't repeat.
    """

    words: int = WORDS
    distance: int = DISTANCE
    distinct: bool = False
    seed: int = SEED
    prints: int = 1
    set_words: int = 0
    similarity: float = 0.0
    wide_distance: int = 128
    tight: int = 128
    roomy: int = 128

    @property
    def fps(self) -> list[str]:
        return [f"fp{k}" for k in range(self.prints)]

    @property
    def wide(self) -> list[str]:
        return ["w0", "w1"] if self.set_words else []


#: Shingles of five words and a similarity of 0.8. Fingerprints of the set of words change least from one copy to the next: of
#: two, one is within 6 bits for 96 to 99 % of such pairs. Their wide prints differ in 19 bits on average.
SIMILAR = Likeness(words=1, distance=6, distinct=True, prints=2, set_words=5, similarity=0.8, wide_distance=34, tight=16, roomy=42)


def _hashes(text: bytes, words: int, seed: int, distinct: bool) -> Iterator[np.ndarray]:
    """Hashes of all word shingles (fewer words: the whole sequence; none: nothing), in blocks; distinct ones in one block."""
    tokens = text.lower().split()  # ASCII only: A-Z and the six ASCII spaces
    if not tokens:
        return
    digest = xxhash.xxh64_intdigest
    if distinct and words == 1:
        yield np.array([digest(w, seed) for w in set(tokens)], dtype="<u8")
        return
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    lasts = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    blocks = []
    for at in range(0, len(lasts), 1 << 16):
        spans = zip(starts[at : min(len(lasts), at + (1 << 16))].tolist(), lasts[at : at + (1 << 16)].tolist(), strict=True)
        blocks.append(np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8"))
        if not distinct:
            yield blocks.pop()
    if distinct:
        yield np.unique(np.concatenate(blocks))


def _votes(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Another hash of the same shingles; the first is the hash itself."""
    if not k:
        return hashes
    h = (hashes ^ _SALTS[k]) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def fingerprints_of(blocks: Iterator[np.ndarray], prints: int = 1, first: int = 0) -> list[int]:
    """SimHashes over shingle hashes; a bit is set if more than half of them have it."""
    n, votes = 0, np.zeros((prints, 64), np.int64)
    for hashes in blocks:
        n += len(hashes)
        for at in range(0, len(hashes), 1 << 16):
            for k in range(prints):
                votes[k] += _votes(_mixed(hashes[at : at + (1 << 16)], first + k))
    return np.packbits(votes * 2 > n, axis=1, bitorder="little").view("<u8").ravel().tolist()


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED, distinct: bool = False) -> int:
    return fingerprints_of(_hashes(text, words, seed, distinct))[0]


def shingle_set(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; none for a text without words."""
    found = list(_hashes(text, words, seed, True))
    return np.unique(found[0]) if found else np.zeros(0, np.uint64)


def _prints(text: bytes, like: Likeness) -> list[int]:
    """node, fingerprints and, with sets, the wide print. A node is a fingerprint, or the 64-bit hash of a set."""
    fps = fingerprints_of(_hashes(text, like.words, like.seed, like.distinct), like.prints)
    if not like.set_words:
        return [fps[0], *fps]
    shingles = shingle_set(text, like.set_words, like.seed)
    return [xxhash.xxh64_intdigest(shingles.tobytes()), *fps, *fingerprints_of([shingles], 2, 1)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: Likeness = Likeness(), **more: str) -> DataFrame:
    """doc_id, node and prints (64 bits each, as signed longs) of every row. Null and empty texts have fingerprints zero. ``more``: columns to keep, as new_name=old_name."""
    kept, names = ["doc_id", *more], ["node", *like.fps, *like.wide]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                found = np.array([_prints(t, like) for t in texts(part)], np.uint64)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in found.T]], [*kept, *names])

    rows = take(docs, doc_id=id_col, text=text_col, **more)
    return rows.mapInArrow(scan, ", ".join([*[f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept], *[f"{c} long" for c in names]]))


def unary_counts(fp: Column) -> Column:
    """Popcount of each 2-bit segment, in unary: at least one bit set, and both set."""
    high = F.shiftrightunsigned(fp, 1)
    some, all_ = fp.bitwiseOR(high).bitwiseAND(F.lit(LOW_BITS)), fp.bitwiseAND(high).bitwiseAND(F.lit(LOW_BITS))
    return some.bitwiseOR(F.shiftleft(all_, 1))


def _unary(fp: np.ndarray) -> np.ndarray:
    high, low = fp >> np.uint64(1), np.uint64(LOW_BITS)
    return ((fp | high) & low) | ((fp & high & low) << np.uint64(1))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def grid_masks(blocks: int, chosen: int) -> list[int]:
    """A signed 64-bit mask for each choice of blocks of whole segments."""
    sizes = [SEGMENTS // blocks + (i < SEGMENTS % blocks) for i in range(blocks)]
    firsts = [sum(sizes[:i]) for i in range(blocks)]
    block = [sum(3 << 2 * s for s in range(f, f + n)) for f, n in zip(firsts, sizes, strict=True)]
    return [_signed(sum(block[i] for i in c)) for c in combinations(range(blocks), chosen)]


def _apart(fp: np.ndarray, u: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Which of the pairs of places are near: by the Manhattan distance of the embeddings, then by all bits."""
    near = np.flatnonzero(np.bitwise_count(u[a] ^ u[b]) <= distance)
    return near[np.bitwise_count(fp[a[near]] ^ fp[b[near]]) <= distance]


def _wide_apart(wide: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(wide[:, a] ^ wide[:, b]).sum(axis=0, dtype=np.int64) if len(wide) else np.zeros(np.broadcast(a, b).shape, np.int64)


def _near_pairs(fp: np.ndarray, u: np.ndarray, wide: np.ndarray, like: Likeness, most: int) -> tuple[tuple[np.ndarray, np.ndarray] | None, np.ndarray]:
    """All near pairs of a cell whose wide prints are within ``roomy``, or none if there are more than ``most``; and the members that have such a pair."""
    n, found, met = 0, [], np.zeros(len(fp), bool)

    def close(rows: np.ndarray, after: int) -> tuple[np.ndarray, np.ndarray]:
        at, b = np.nonzero(np.bitwise_count(u[rows, None] ^ u[None, after:]) <= like.distance)
        a, b = rows[at], b + after
        exact = (np.bitwise_count(fp[a] ^ fp[b]) <= like.distance) & (a != b)
        a, b = a[exact], b[exact]
        good = _wide_apart(wide, a, b) <= like.roomy
        return a[good], b[good]

    for at in range(0, len(fp), 128):
        a, b = close(np.arange(at, min(at + 128, len(fp))), at)
        met[a] = met[b] = True
        ahead = b > a
        found.append((a[ahead], b[ahead]))
        n += len(found[-1][0])
        if n > most:  # others need only be asked whether they have a pair
            rest = np.flatnonzero(~met)
            for k in range(0, len(rest), 128):
                a, b = close(rest[k : k + 128], 0)
                met[a] = met[b] = True
            return None, np.flatnonzero(met)
    return (np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])), np.flatnonzero(met)


def _crowd(fp: np.ndarray, u: np.ndarray, wide: np.ndarray, like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect the near members of a cell, one for each: a member that is met tightly is asked no more, others at the end by their nearest.

    Without wide prints every near pair is tight, so the connected parts are those of all near pairs.
    """
    n = len(fp)
    nearest, least = np.full(n, -1), np.full(n, like.wide_distance + 1)
    left, out = np.arange(n), []
    waiting: list[int] = []
    while len(left):
        if waiting:
            at = waiting.pop()
        else:
            at, left = int(left[0]), left[1:]
            if nearest[at] >= 0:
                out.append((nearest[at : at + 1], np.array([at])))
        here = left[_apart(fp, u, np.full(len(left), at), left, like.distance)]
        apart = _wide_apart(wide, np.full(len(here), at), here)
        closer = apart < least[here]
        least[here[closer]], nearest[here[closer]] = apart[closer], at
        met = here[apart <= like.tight]
        if len(met):
            out.append((np.full(len(met), at), met))
            left = np.setdiff1d(left, met, assume_unique=True)
            waiting += met.tolist()
    return (np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])) if out else (left, left)


def _compare_cells(rows: dict[str, np.ndarray], like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs to link, of whole cells in order of their key; with sets, members of a crowd are also told, as pairs with themselves."""
    key, fp = rows["key"], rows["fp"].view(np.uint64)
    u, wide = _unary(fp), np.array([rows[w].view(np.uint64) for w in like.wide], np.uint64).reshape(len(like.wide), len(key))
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(begin, len(key)))
    found = []
    size_of = np.repeat(size, size)
    small = size_of <= SMALL
    after = np.repeat(begin + size, size) - np.arange(len(key)) - 1  # members of the cell behind each
    at = np.flatnonzero(small & (after > 0))
    step = 1
    while len(at):  # each member with the one ``step`` places behind it, of all small cells at once
        near = at[_apart(fp, u, at, at + step, like.distance)]
        found.append((near, near + step))
        step += 1
        at = at[after[at] >= step]
    for first, n in zip(begin[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        part = slice(first, first + n)
        pairs, met = _near_pairs(fp[part], u[part], wide[:, part], like, CROWDED * n) if n <= LARGE else (None, np.arange(n))
        if pairs is not None:
            found.append((pairs[0] + first, pairs[1] + first))
            continue
        met += first
        a, b = _crowd(fp[met], u[met], wide[:, met], like)
        found.append((met[a], met[b]))
        if like.set_words:
            found.append((met, met))
    a, b = (np.concatenate([pair[i] for pair in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
    good = _wide_apart(wide, a, b) <= np.where(size_of[a] > SMALL, like.roomy, like.wide_distance)
    return a[good], b[good]


def links(nodes: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """(a, b) edges of ``nodes`` (node and prints), whose components are those of all pairs that are near; with sets, the pairs to verify, and (a, a) for members of crowds that have a near one.

    Every node is placed once in each grid and compared in its cells, which are dealt to
    tasks by a hash. Cells of ``HOT_MEMBERS`` or more are split by further segments: two members within
    ``distance`` agree on all segments of one of ``distance + 1`` classes. Few pairs of a cell are all
    taken; a crowd of near members is walked through, so that it isn't expanded into its pairs.
    """
    n = nodes.count()
    extra = next(k for most, k in BLOCKS if n <= most)
    masks, columns = grid_masks(like.distance + extra, extra), ["node", "fp", *like.wide]
    grids = [F.struct(F.col(fp).alias("fp"), F.xxhash64(F.lit(k * len(masks) + i), unary_counts(F.col(fp)).bitwiseAND(F.lit(m))).alias("key")) for k, fp in enumerate(like.fps) for i, m in enumerate(masks)]
    placed = nodes.withColumn("c", F.explode(F.array(*grids))).select("c.key", "node", "c.fp", *like.wide)
    hot = materialise(placed.groupBy("key").count().where(F.col("count") >= HOT_MEMBERS).select(F.col("key").alias("hot")), "simhash-hot")
    if not hot.isEmpty():
        classes = [_signed(sum(3 << 2 * s for s in range(k, SEGMENTS, like.distance + 1))) for k in range(like.distance + 1)]
        parts = F.array(*[F.xxhash64("key", F.lit(k), unary_counts(F.col("fp")).bitwiseAND(F.lit(m))) for k, m in enumerate(classes)])
        placed = placed.join(hot, F.col("key") == F.col("hot"), "left").withColumn("key", F.explode(F.when(F.col("hot").isNull(), F.array("key")).otherwise(parts))).drop("hot")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting = most = 0

        def compared(table: pa.Table) -> pa.RecordBatch:
            rows = {c: table[c].to_numpy() for c in table.column_names}
            a, b = _compare_cells(rows, like)
            x, y = rows["node"][a], rows["node"][b]
            pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y))), axis=1) if len(a) else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            if waiting >= max(CHUNK_ROWS, most):
                table = pa.Table.from_batches(held)
                key = table["key"].to_numpy()
                last = int(np.searchsorted(key, key[-1]))  # the last cell may go on
                if last:
                    yield compared(table.slice(0, last))
                held = table.slice(last).to_batches()
                waiting = len(key) - last
                most = 2 * waiting
        if waiting:
            yield compared(pa.Table.from_batches(held))

    met = placed.select("key", *columns).repartition("key").sortWithinPartitions("key").mapInArrow(scan, "a long, b long")
    found = materialise((met if like.set_words else met.where("a <> b")).distinct(), "simhash-links")
    release(hot)
    return found


def _chosen(rows: DataFrame, marks: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` joined with (of_id, of_h) marks; up to ``BROADCAST_IDS`` marks texts stay where they are, beyond both sides are shuffled by id and hash."""
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_IDS else marks.hint("merge")
    return rows.join(marks, rows[key].eqNullSafe(F.col("of_id")) & (rows["h"] == F.col("of_h")), how)


def verified(edges: DataFrame, nodes: DataFrame, rows: DataFrame, key: str, text: str, like: Likeness) -> DataFrame:
    """The edges whose sets of shingles have a similarity of ``like.similarity`` or more, counted on one text of each node, and those that connect what is similar in crowds."""
    read = lambda met, columns, of: _scanned_nodes(met, nodes, rows, key, text, columns, of)
    pairs, crowd = edges.where("a <> b"), edges.where("a = b").select(F.col("a").alias("node"))
    good = _similar(pairs, read, like)
    if not crowd.isEmpty():  # a crowd's own walk links each member once; what that left apart meets by shingles
        good = good.unionByName(_linked_in_crowds(_heads(crowd, read, like), components(good), read, like))
    return good


def _scanned_nodes(met: DataFrame, nodes: DataFrame, rows: DataFrame, key: str, text: str, columns: dict[str, pa.DataType], of: Callable[[bytes], tuple]) -> DataFrame:
    """node and ``columns`` made by ``of`` from one text of each node ``met``."""
    marked = nodes.join(met, "node").select("node", F.col("first.id").alias("of_id"), F.col("first.h").alias("of_h"), (F.col("copies") > 1).alias("again"))
    marks = materialise(marked, "simhash-texts")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                found = list(zip(*map(of, texts(part)), strict=True))
                made = [pa.array(values, kind) for values, kind in zip(found, columns.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("again"), *made], ["node", "again", *columns])

    kinds = ", ".join(f"{c} {'array<long>' if pa.types.is_list(kind) else 'long'}" for c, kind in columns.items())
    chosen = _chosen(rows, marks, key, "inner").select("node", "again", F.col(text).alias("text"))
    told = materialise(chosen.mapInArrow(scan, f"node long, again boolean, {kinds}"), "simhash-sets")
    release(marks)
    # only rows of which there are several can give a node twice
    out = told.where("NOT again").unionByName(told.where("again").dropDuplicates(["node"])).drop("again")
    out.written_to = told.written_to
    return out


def _similar(pairs: DataFrame, read: Callable[..., DataFrame], like: Likeness) -> DataFrame:
    """The pairs that have the similarity."""
    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = read(met, {"shingles": pa.list_(pa.int64())}, lambda t: (shingle_set(t, like.set_words, like.seed).view(np.int64),))
    a, b = (sets.select(F.col("node").alias(side), F.col("shingles").alias(f"s{side}")) for side in ("a", "b"))
    common = F.size(F.array_intersect("sa", "sb"))
    similarity = F.try_divide(common.cast("double"), (F.size("sa") + F.size("sb") - common).cast("double"))
    good = materialise(pairs.join(a, "a").join(b, "b").where(similarity >= like.similarity).select("a", "b"), "simhash-verified")
    release(sets)
    return good


def head_of(shingles: np.ndarray, late: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in the order of their hash, those of ``late`` (sorted) behind all others by their rank: sets of the similarity have one of them in common."""
    if len(late):
        at = np.minimum(np.searchsorted(late, shingles), len(late) - 1)
        known = late[at] == shingles
        shingles = np.concatenate((shingles[~known], shingles[known][np.argsort(rank[at[known]])]))
    n = len(shingles)
    return shingles[: n - math.ceil((similarity - 1e-9) * n) + 1]


def _heads(met: DataFrame, read: Callable[..., DataFrame], like: Likeness) -> tuple[DataFrame, ...]:
    """Tables (node, size, head) of the nodes ``met``: only the first fifth of the shingles, by one order for all.

    The order is that of the hashes; shingles that many of these heads hold come behind the
    others, rare first, and only texts whose heads hold them are read again.
    """
    columns = {"size": pa.int64(), "head": pa.list_(pa.int64())}

    def of(late: np.ndarray, rank: np.ndarray) -> Callable[[bytes], tuple]:
        def head(text: bytes) -> tuple:
            shingles = shingle_set(text, like.set_words, like.seed)
            return len(shingles), head_of(shingles, late, rank, like.similarity).view(np.int64)

        return head

    none = np.zeros(0, np.uint64)
    first = read(met, columns, of(none, none))
    each = first.select("node", F.explode("head").alias("x"))
    often = materialise(each.groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") > LATE_MEMBERS).orderBy(F.desc("n"), "x").limit(MOST_LATE), "simhash-late")
    behind = sorted((r.n, r.x) for r in often.collect())
    if not behind:
        release(often)
        return (first,)
    late = np.array([x for _, x in behind], np.int64).view(np.uint64)
    rank = np.argsort(late)
    again = materialise(each.join(F.broadcast(often.select("x")), "x").select("node").distinct(), "simhash-again")
    second = read(again, columns, of(late[rank], rank))
    rest = first.join(again, "node", "left_anti")
    rest.written_to = first.written_to
    return rest, second, often, again


def _shared_heads(heads: tuple[DataFrame, ...], root: DataFrame) -> DataFrame:
    """(x, node, size, at, root, weight) of the head shingles that nodes of different roots share; weight: shingles of all sets whose heads have x."""
    whole = reduce(DataFrame.unionByName, heads[:2]).select("node", "size", F.posexplode("head").alias("at", "x"))
    often = materialise(whole.groupBy("x").agg(F.count("*").alias("n"), F.sum("size").alias("weight")).where("n > 1").select("x", "weight"), "simhash-shared")
    met = whole.join(often, "x").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    met = materialise(met, "simhash-heads")
    release(often)
    return met.join(met.groupBy("x").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("x"), "x", "left_semi")


def _apart_in_crowds(heads: tuple[DataFrame, ...], root: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of all nodes of different roots that can have the similarity: such a pair shares a shingle of its heads,
    their sizes are near, and enough of them lies behind that shingle. ``_linked_in_crowds`` links them without a row for each pair."""
    met = _shared_heads(heads, root)
    t = F.lit(similarity - 1e-9)
    a, b = met.alias("a"), met.alias("b")
    behind = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))
    near = (F.least("a.size", "b.size") >= t * F.greatest("a.size", "b.size")) & (behind >= t / (1 + t) * (F.col("a.size") + F.col("b.size")))
    able = (F.col("a.root") != F.col("b.root")) & near
    return a.join(b, (F.col("a.x") == F.col("b.x")) & (F.col("a.node") < F.col("b.node")) & able).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def linked_sets(flat: np.ndarray, size: np.ndarray, root: np.ndarray, side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Places of similar sets of different roots, as many as connect all that such pairs connect; of two sides, only pairs across.

    Sets (none empty) lie one behind the other in ``flat``. Rare shingles come first, so that
    few sets meet by their heads; those that meet and aren't connected yet are counted whole.
    """
    n, begin, t = len(size), np.cumsum(size) - size, similarity - 1e-9
    _, ids, often = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.empty(len(often), np.int64)
    place[np.argsort(often, kind="stable")] = np.arange(len(often))
    owner = np.repeat(np.arange(n), size)
    ids = place[ids]
    ids = ids[np.lexsort((ids, owner))]
    heads = size - np.ceil(t * size).astype(np.int64) + 1
    there = np.arange(len(ids)) - begin[owner] < heads[owner]
    order = np.argsort(ids[there], kind="stable")
    who, first = owner[there][order], np.searchsorted(ids[there][order], np.arange(len(often) + 1))
    group = np.unique(root, return_inverse=True)[1]
    members: dict[int, list[int]] = {}
    for i, g in enumerate(group.tolist()):
        members.setdefault(g, []).append(i)
    across, seen, mine, out = bool((side != side[0]).any()), np.zeros(n, bool), np.zeros(len(often), bool), []
    for i in range(n):
        own = ids[begin[i] : begin[i] + size[i]]
        for x in own[: heads[i]].tolist():
            seen[who[first[x] : first[x + 1]]] = True
        j = np.flatnonzero(seen[i + 1 :]) + i + 1
        seen[:] = False
        j = j[(group[j] != group[i]) & (np.minimum(size[j], size[i]) >= t * np.maximum(size[j], size[i]))]
        j = j[side[j] != side[i]] if across else j
        if not len(j):
            continue
        ends = np.cumsum(size[j])
        mine[own] = True
        common = np.add.reduceat(mine[ids[np.repeat(begin[j] + size[j] - ends, size[j]) + np.arange(ends[-1])]], ends - size[j], dtype=np.int64)
        mine[own] = False
        for k in j[common / (size[i] + size[j] - common) >= similarity].tolist():
            into, gone = sorted((int(group[i]), int(group[k])), key=lambda g: -len(members[g]))
            if into != gone:
                out.append((i, k))
                group[members[gone]] = into
                members[into] += members.pop(gone)
    return out


def _linked_in_crowds(heads: tuple[DataFrame, ...], root: DataFrame, read: Callable[..., DataFrame], like: Likeness) -> DataFrame:
    """Verified pairs (a, b) that connect similar nodes of different roots; ``heads`` are deleted.

    Near misses of a large crowd are too many to be rows. A node lies in the block of that shingle of its head that
    most sets have; large ones are split by a hash, small ones share blocks of some ``BLOCK_SHINGLES``. Each two blocks that share a
    shingle of heads meet in one group of a task, which counts its pairs in arrays and returns
    what it connects: a set is sent once for each block that its own one meets.
    """
    met = materialise(_shared_heads(heads, root).select("x", "node", "root", "size", "weight"), "simhash-met")
    release(*heads)
    most = F.max(F.struct("weight", "x")).alias("most")
    homes = materialise(met.groupBy("node", "root", "size").agg(most).select("node", "root", "size", "most.*"), "simhash-homes")
    total = homes.agg(F.sum("size")).first()[0] or 0
    blocks = max(LEAST_BLOCKS, math.ceil(total / BLOCK_SHINGLES))
    part = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.col("weight") * F.lit(blocks) / F.lit(total or 1))))
    home = homes.select("node", "root", F.pmod(F.pmod(F.xxhash64("x"), F.lit(blocks)) + part, F.lit(blocks)).alias("block"))
    together = met.join(home.select("node", "block"), "node").groupBy("x").agg(F.array_sort(F.collect_set("block")).alias("blocks")).select("blocks").distinct()
    mixed = home.groupBy(F.col("block").alias("p")).agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    cells = together.select("blocks", F.explode("blocks").alias("p")).select("p", F.explode("blocks").alias("q")).where("p <= q").distinct()
    cells = materialise(cells.join(mixed, "p").where("p < q OR lo <> hi").select("p", "q"), "simhash-cells")
    sets = read(home.select("node"), {"shingles": pa.list_(pa.int64())}, lambda t: (shingle_set(t, like.set_words, like.seed).view(np.int64),))
    placed = home.join(cells, home["block"] == cells["p"]).select("node", "root", "p", "q", F.lit(0).alias("side"))
    placed = placed.unionByName(home.join(cells.where("p < q"), home["block"] == cells["q"]).select("node", "root", "p", "q", F.lit(1).alias("side")))

    def compared(rows: pa.Table) -> pa.Table:
        shingles = rows["shingles"].combine_chunks()
        node, of, side = (rows[c].to_numpy() for c in ("node", "root", "side"))
        pairs = linked_sets(shingles.flatten().to_numpy(), np.diff(shingles.offsets.to_numpy()).astype(np.int64), of, side, like.similarity)
        return pa.table({c: pa.array(node[[p[k] for p in pairs]] if pairs else node[:0]) for k, c in enumerate(("a", "b"))})

    found = materialise(placed.join(sets, "node").groupBy("p", "q").applyInArrow(compared, "a long, b long"), "simhash-crowd-links")
    release(met, homes, cells, sets)
    return found


def _components_of(prints: DataFrame, rows: DataFrame, key: str, text: str, like: Likeness) -> DataFrame:
    """of (a node), root, component_id, copies (rows) for every node of ``prints``; only root is different for each component."""
    first = F.min(F.struct(F.isnull("doc_id").alias("last"), F.col("doc_id").alias("id"), F.col("h").alias("h"))).alias("first")
    nodes = materialise(prints.groupBy("node", *like.fps, *like.wide).agg(first, F.count("*").alias("copies")), "simhash-nodes")
    edges = links(nodes, like)
    if like.set_words:
        edges = verified(edges, nodes, rows, key, text, like)
    placed = nodes.join(components(edges).withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").select("node", "copies", F.col("first.id").alias("first_id"), F.coalesce("root", "node").alias("root_node"))
    # a large component's nodes are dealt to many tasks; single nodes need no look-up
    smallest = placed.groupBy("root_node").agg(F.min("first_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    smallest = smallest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("root_node", "top")
    met = (F.col("root_node") == F.col("top")) & (F.pmod(F.xxhash64("node"), F.lit(SALTS)) == F.col("salt"))
    named = placed.join(smallest, met, "left").withColumn("component_id", F.when(F.col("top").isNull(), F.col("first_id")).otherwise(F.col("least")))
    return materialise(named.select(F.col("node").alias("of"), F.col("root_node").alias("root"), "component_id", "copies"), "simhash-components")


def _with_components(prints: DataFrame, known: DataFrame) -> DataFrame:
    """Every row with its node's component. Nodes of ``HOT_ROWS`` rows (one in so many rows at most) are broadcast, so equal texts don't meet in one task."""
    hot = known.where(F.col("copies") >= HOT_ROWS)
    if hot.isEmpty():
        return prints.join(known, prints["node"] == known["of"])
    names = hot.select(F.col("of").alias("hot"))
    there = prints.join(F.broadcast(hot), prints["node"] == hot["of"])
    rest = prints.join(F.broadcast(names), prints["node"] == names["hot"], "left_anti")
    return there.unionByName(rest.join(known, rest["node"] == known["of"]))


def _scanned(docs: DataFrame, like: Likeness, id_col: str, text_col: str) -> tuple[DataFrame, str, DataFrame, DataFrame]:
    """(rows with hash h under plain names, the id's name, prints, components)."""
    plain = [f"c{i}" for i in range(len(docs.columns))]
    key, text = plain[docs.columns.index(id_col)], plain[docs.columns.index(text_col)]
    rows = docs.toDF(*plain)
    rows = rows.withColumn("h", row_hash(rows))
    prints = materialise(fingerprints(rows, key, text, like, h="h"), "simhash-prints")
    return rows, key, prints, _components_of(prints, rows, key, text, like)


def near_duplicates(docs: DataFrame, like: Likeness = Likeness(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row; component_id is the smallest doc_id reachable over links.

    Null and empty texts have fingerprint zero and link like any other, or are one set.
    Repeated rows and equal fingerprints (or sets) are one node. A null doc_id keeps its row; it
    never is a component's smallest id unless all its ids are null.
    """
    _, _, prints, known = _scanned(docs, like, id_col, text_col)
    return _with_components(prints, known).select("doc_id", F.col("fp0").alias("fp"), "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, like: Likeness = Likeness(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns of ``docs``: the smallest by (id, nulls last, then hash of the row).

    A row is known by its id and hash, so rows of one id in different components
    don't stand for each other, and neither do rows without an id. Of equal rows one stays.
    Null and empty texts are one component.
    """
    rows, key, prints, known = _scanned(docs, like, id_col, text_col)
    least = F.min(F.struct(F.isnull("doc_id").alias("last"), F.col("doc_id").alias("id"), F.col("h").alias("h")))
    stays = _with_components(prints, known).groupBy("root").agg(least.alias("m")).select(F.col("m.id").alias("s_id"), F.col("m.h").alias("s_h"), F.lit(True).alias("stays"))
    ids = prints.groupBy(F.col("doc_id").alias("of_id"), F.col("h").alias("of_h")).agg(F.count("*").alias("n"))
    ids = materialise(ids.join(stays, F.col("of_id").eqNullSafe(F.col("s_id")) & (F.col("of_h") == F.col("s_h")), "left").select("of_id", "of_h", "n", "stays"), "simhash-ids")
    gone, again = ids.where("stays IS NULL"), ids.where("stays AND n > 1")
    plain = rows.columns[:-1]
    if again.isEmpty():
        kept = _chosen(rows, gone.select("of_id", "of_h"), key, "left_anti")
    else:  # of rows that are kept and repeated one stays; only these are shuffled
        kept = _chosen(rows, gone.unionByName(again).select("of_id", "of_h"), key, "left_anti").select(*plain)
        kept = kept.unionByName(_chosen(rows, again.select("of_id", "of_h"), key, "left_semi").dropDuplicates([key, "h"]).select(*plain))
    return kept.select(*plain).toDF(*docs.columns)
