"""J7 with rules as a table: many patterns matched against lines without testing every pair."""

from __future__ import annotations

import re
import re._constants as op
import re._parser as parser
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Characters of a piece, rules without one that are tested on all lines, and pieces that are broadcast (some 30 bytes each).
PIECE, WITHOUT, BROADCAST = 4, 200, 1 << 20
_SAME_PLACE = {op.AT, op.ASSERT, op.ASSERT_NOT}
_REPEATS = {op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT}


def _weight(pieces: list[str] | None) -> int:
    return min(map(len, pieces)) if pieces else 0


def _needed(items: Iterator, piece: int) -> list[str] | None:
    """Texts of which each match holds one at least; the longest such choice of a sequence."""
    best: list[str] | None = None
    run = ""

    def better(found: list[str] | None) -> None:
        nonlocal best
        if _weight(found) >= piece and _weight(found) > _weight(best):
            best = found

    for kind, value in items:
        if kind is op.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if kind in _SAME_PLACE:
            continue
        better([run])
        run = ""
        if kind is op.SUBPATTERN:
            better(_needed(value[3], piece))
        elif kind in _REPEATS and value[0] > 0:
            better(_needed(value[2], piece))
        elif kind is op.ATOMIC_GROUP:
            better(_needed(value, piece))
        elif kind is op.BRANCH:
            found = [_needed(branch, piece) for branch in value[1]]
            better(None if None in found else [t for f in found for t in f or []])
    better([run])
    return best


def needed_pieces(pattern: str, piece: int = PIECE) -> list[str]:
    """Lower-case ASCII texts of ``piece`` characters or more of which every match of the pattern holds one; none if that can't be told.

    Patterns are those of the engine. What Python's parser doesn't know counts as not told.
    """
    try:
        return sorted(set(_needed(parser.parse(pattern), piece) or []))
    except (re.error, OverflowError, RecursionError):
        return []


def _grams(text: Column, n: int) -> Column:
    """All pieces of ``n`` characters, by one pass of a look-ahead (``substring`` starts from the left at every place)."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def match_rules(lines: DataFrame, line: str, rules: DataFrame, key: list[str], piece: int = PIECE) -> DataFrame:
    """(key, rule_id) of every line and each rule whose pattern it holds and whose exempt pattern it doesn't.

    rules: rule_id, pattern and, if there is one, exempt_pattern; null patterns match nothing. ``key``
    names the lines; null lines match nothing, repeated rules and lines count once.

    From each pattern the texts are taken of which a match must hold one, and of these the piece of
    ``piece`` characters that the fewest lines have. Lines are joined with these pieces, and a pattern is
    tested only on lines that have its piece and the text around it. Rules without such a text are tested on all
    lines; more than ``WITHOUT`` of them raise.
    """
    exempt = F.col("exempt_pattern") if "exempt_pattern" in rules.columns else F.lit(None).cast("string")
    rules = written(rules.select("rule_id", "pattern", exempt.alias("exempt")).where("pattern IS NOT NULL").distinct(), "rules")

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.rule_id, r.pattern, r.exempt, t) for r in batch.itertuples() for t in needed_pieces(r.pattern, piece) or [None]]
            yield pd.DataFrame(rows, columns=["rule_id", "pattern", "exempt", "text"])

    kind = rules.schema["rule_id"].dataType.simpleString()
    told = written(rules.mapInPandas(taken, f"rule_id {kind}, pattern string, exempt string, text string"), "rule-texts")
    bare = told.where("text IS NULL").select("rule_id", "pattern", "exempt").limit(WITHOUT + 1).collect()
    if len(bare) > WITHOUT:
        raise ValueError(f"more than {WITHOUT} patterns have no text of {piece} characters that a match must hold")

    rows = lines.select(*key, F.col(line).alias("line")).where("line IS NOT NULL").distinct()
    grams = told.where("text IS NOT NULL").select("rule_id", "pattern", "exempt", "text", F.explode(_grams(F.col("text"), piece)).alias("gram"))
    low = F.lower("line")
    pieces = rows.where(F.length(low) >= piece).select("*", F.explode(_grams(low, piece)).alias("gram"))
    known = _side(written(grams.select("gram").distinct(), "grams"))
    often = pieces.select("gram").join(known, "gram").groupBy("gram").agg(F.count("*").alias("n"))
    best = F.min_by("gram", F.struct("n", "gram")).alias("gram")
    index = grams.join(often, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0))).groupBy("rule_id", "pattern", "exempt", "text").agg(best, F.min("n").alias("n"))
    index = written(index.where("n > 0").drop("n"), "rule-index")

    def holds(pattern: Column, exempt: Column) -> Column:
        return F.rlike(F.col("line"), pattern) & ~F.coalesce(F.rlike(F.col("line"), exempt), F.lit(False))

    hits = pieces.join(_side(index), "gram").where(F.contains(low, F.col("text")) & holds(F.col("pattern"), F.col("exempt"))).select(*key, "rule_id")
    for rule_id, pattern, unless in bare:
        hits = hits.unionByName(rows.where(holds(F.lit(pattern), F.lit(unless).cast("string"))).select(*key, F.lit(rule_id).cast(kind).alias("rule_id")))
    return hits.distinct()


def _side(table: DataFrame) -> DataFrame:
    """Pieces are broadcast up to ``BROADCAST`` of them; beyond, lines meet them by a shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST else table
