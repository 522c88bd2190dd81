"""Sharding: minimax contiguous partition over ordered atomic groups (DataFrame functions only).

Rows with equal texts form one atomic group. Groups are ordered by the SHA-256
of their text, so a shard is one contiguous range of digests and a row's shard
follows from its digest by comparing it with the cuts: no join, and no group is
ever gathered.

The smallest feasible capacity is found by binary search with a greedy check.
The search does not need every group: it works on cells of the digest order
(4 hex digits first). A cell with one group is exact; for the others the greedy
check gives a lower and an upper bound. Cells in which a cut may fall are split
further by Spark until both bounds meet. The driver holds at most 65,536 cells
plus 256 for each open one, whatever the number of rows.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, take

#: Hex digits of the first cells, and how many each split adds.
FIRST, STEP, DIGITS = 4, 2, 48
#: Rows that one ranking cell holds on average, and the most ranking cells of a shard.
CELL_ROWS, MOST_CELLS = 2000, 4096
#: Parts of a ranking cell that equal rows have made larger than ``HOT`` times the average.
SALTS, HOT = 16, 8


@dataclass(frozen=True)
class Cell:
    """A range of groups: the start of its first digest, its bytes, whether it is a single group, and its digits."""

    first: str
    size: int
    single: bool
    depth: int


def _feasible(ends: list[int], capacity: int, shards: int) -> bool:
    """Greedy check with every cell as an atom: do ``shards`` bins of ``capacity`` hold all?"""
    at, total = 0, ends[-1]
    for _ in range(shards):
        i = bisect_right(ends, at + capacity) - 1
        if i < 0 or ends[i] <= at:
            return False
        at = ends[i]
        if at >= total:
            return True
    return False


def _relaxed(ends: list[int], cells: list[Cell], capacity: int, shards: int) -> list[int] | None:
    """The furthest that greedy can get if unsplit cells may be cut anywhere; None if that is too little."""
    at, total, found = 0, ends[-1], []
    for _ in range(shards):
        to = at + capacity
        if to >= total:
            return [*found, total]
        i = bisect_right(ends, to)  # the cell that holds position `to`
        begin = ends[i - 1] if i else 0
        to = begin if cells[i].single else to
        if to <= at:
            return None
        found.append(to)
        at = to
    return None  # the shards are used up


def _smallest(test, low: int, high: int) -> int:
    while low < high:
        middle = (low + high) // 2
        if test(middle):
            high = middle
        else:
            low = middle + 1
    return low


def _greedy(ends: list[int], capacity: int, shards: int) -> list[int]:
    at, found = 0, []
    for _ in range(shards):
        i = bisect_right(ends, at + capacity) - 1
        at = max(at, ends[i] if i >= 0 else 0)
        found.append(at)
    return found


def _cells(sized: DataFrame, depth: int) -> list[Cell]:
    """One row for each prefix of ``depth`` digits; the next 15 digits, as a number, tell groups apart."""
    after = F.conv(F.substring("digest", depth + 1, 15), 16, 10).cast("long")
    rows = sized.groupBy(F.substring("digest", 1, depth).alias("cell")).agg(F.sum("size").alias("size"), F.min(after).alias("lo"), F.max(after).alias("hi")).collect()
    return [Cell(f"{r['cell']}{r['lo']:015x}", r["size"], r["lo"] == r["hi"], depth) for r in rows]


def minimax_cuts(sized: DataFrame, shards: int) -> tuple[int, list[str]]:
    """Smallest capacity and the first digest of each shard after the first.

    ``sized`` has ``digest`` (64 hex digits) and ``size``; it is read again for
    every split, so pass a written table. Fewer cuts than ``shards - 1`` mean
    that the last shards are empty. Once the capacity is known, cuts are put as
    near to an even share as that capacity allows, so that one group above the
    even share doesn't leave the last shards empty.
    """
    cells = sorted(_cells(sized, FIRST), key=lambda c: c.first)
    if not cells:
        return 0, []
    while True:
        ends, at = [], 0
        for c in cells:
            at += c.size
            ends.append(at)
        total = at
        least = max(-(-total // shards), max(c.size for c in cells if c.single) if any(c.single for c in cells) else 1)
        high = _smallest(lambda c: _feasible(ends, c, shards), least, total)
        low = _smallest(lambda c: _relaxed(ends, cells, c, shards) is not None, least, high)
        if low == high:
            break
        near, far = _greedy(ends, low, shards), _relaxed(ends, cells, high, shards)
        wide: set[int] = set()
        for k, start in enumerate(near):
            stop = far[k] if k < len(far) else total
            i = bisect_right(ends, start)
            while i < len(cells) and (ends[i - 1] if i else 0) <= stop:
                if not cells[i].single and cells[i].depth < DIGITS:
                    wide.add(i)
                i += 1
        if not wide:
            break
        split: list[Cell] = []
        for depth in sorted({cells[i].depth for i in wide}):
            prefixes = [cells[i].first[:depth] for i in wide if cells[i].depth == depth]
            split += _cells(sized.where(F.substring("digest", 1, depth).isin(prefixes)), min(DIGITS, depth + STEP))
        cells = sorted([c for i, c in enumerate(cells) if i not in wide] + split, key=lambda c: c.first)
    return high, _even_cuts(cells, ends, high, shards)


def _even_cuts(cells: list[Cell], ends: list[int], capacity: int, shards: int) -> list[str]:
    def needed(at: int) -> int:
        n = 0
        while at < ends[-1]:
            at = ends[bisect_right(ends, at + capacity) - 1]
            n += 1
        return n

    at, cuts = 0, []
    for left in range(shards, 1, -1):
        if at >= ends[-1]:
            break
        furthest = bisect_right(ends, at + capacity) - 1
        even = min(furthest, max(bisect_right(ends, at + (ends[-1] - at) / left) - 1, bisect_right(ends, at)))
        if even < furthest and abs(ends[even + 1] - at - (ends[-1] - at) / left) < abs(ends[even] - at - (ends[-1] - at) / left):
            even += 1
        i = even if needed(ends[even]) <= left - 1 else furthest
        at = ends[i]
        if i + 1 < len(cells):
            cuts.append(cells[i + 1].first)
    return cuts


def shard_of(digest: Column, cuts: list[str]) -> Column:
    """The number of cuts at or before a digest."""
    return sum((F.when(digest >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and digest of every row; a null text has size 1 and a group of its own."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return take(docs, doc_id=id_col, text=text_col).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        # a prefix keeps nulls apart from empty texts
        F.sha2(F.when(F.col("text").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("text"))), 256).alias("digest"),
    )


def with_slots(rows: DataFrame, n_rows: int, shards: int) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each ``shard``, without sorting a shard in one task.

    Rows of a shard are dealt to cells by a hash of (doc_id, digest); a cell's
    first slot is the row count of the cells before it. A cell that many equal rows
    have made large is cut into parts by the row's ``salt``. The cell table has at
    most ``shards * MOST_CELLS * SALTS`` rows of some 30 bytes, so it is broadcast.
    """
    per_shard = max(1, min(MOST_CELLS, n_rows // (shards * CELL_ROWS)))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(per_shard)).cast("int"))
    counts = rows.groupBy("shard", "cell", "salt").agg(F.count("*").alias("n"))
    large = F.sum("n").over(Window.partitionBy("shard", "cell")) > HOT * CELL_ROWS
    counts = counts.withColumn("part", (F.col("cell") * SALTS + F.when(large, F.col("salt")).otherwise(0)).cast("long"))
    before = Window.partitionBy("shard").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", "salt", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "digest")
    return (
        rows.join(F.broadcast(starts), ["shard", "cell", "salt"])
        .withColumn("slot", (F.col("base") + F.row_number().over(within) - 1).cast("long"))
        .drop("cell", "base", "salt", "part")
    )


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, digest, shard, slot of every row.

    The largest shard is as small as any contiguous partition of the groups
    allows. Null texts: size 1, crc32 of no bytes, one group. Null ids keep
    their rows. Repeated rows and equal texts share a shard and get slots of
    their own. An empty table gives an empty result.
    """
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    sized = materialise(digests(docs, id_col, text_col).withColumn("salt", salt), "sharding")
    _, cuts = minimax_cuts(sized, shards)
    rows = sized.withColumn("shard", shard_of(F.col("digest"), cuts))
    return with_slots(rows, sized.count(), shards)
