"""URL filters: longest-suffix rules, then a Bloom filter cascade over hosts.

The cascade encodes a list of keys exactly with respect to a known universe of
keys: level 1 holds the listed keys, level 2 those other keys of the universe
that level 1 lets pass, level 3 the listed keys that level 2 lets pass, and so on
until no false positive is left. A key is listed if the first level that
doesn't hold it is even.

Keys are dealt by hash to parts of bounded size, and each part is a cascade of
its own, built in one task from its keys' hashes. Together they take a few bits
for each listed key. Up to a measured size all parts are broadcast; beyond, urls go
to the parts (many tasks for each), so no task holds more than one part and a batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialise, release, scratch, take
from .media import open_store

#: (host, path, verdict) of the site's rules; the longest fitting rule wins.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Host labels that put a host on the list: names of ad and tracking services, alone or between hyphens.
LISTED = r"(^|[.-])(ads?|adserver|track|tracker|tracking|banner|spam|casino|click|pixel)([.-]|$)"
#: All parts are broadcast up to this size; keys of a part, and tasks that a part's urls are dealt to.
MOST_BYTES, PART_KEYS, SPREAD = 256 << 20, 1 << 20, 64
#: False positive rates of the first level and of the others.
FIRST_RATE, RATE = 0.05, 0.5
_SCHEMA = "part long, bytes long, levels array<struct<bits:long,hashes:int,words:binary>>"


@dataclass(frozen=True)
class Level:
    """A Bloom filter over pairs of 64-bit hashes, mixed anew for each level."""

    salt: int
    bits: int
    hashes: int
    words: np.ndarray  # uint64

    @staticmethod
    def of(salt: int, h: np.ndarray, g: np.ndarray, rate: float) -> Level:
        bits = max(64, -(-math.ceil(-len(h) * math.log(rate) / math.log(2) ** 2) // 64) * 64)
        level = Level(salt, bits, max(1, round(bits / len(h) * math.log(2))), np.zeros(bits // 64, np.uint64))
        for at in level.places(h, g):
            np.bitwise_or.at(level.words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        return level

    def places(self, h: np.ndarray, g: np.ndarray) -> Iterator[np.ndarray]:
        """Double hashing; the step is never 0."""
        first = (_mixed(h, 2 * self.salt) % np.uint64(self.bits)).astype(np.int64)
        step = (_mixed(g, 2 * self.salt + 1) % np.uint64(self.bits - 1)).astype(np.int64) + 1
        for i in range(self.hashes):
            yield (first + step * i) % self.bits

    def holds(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in self.places(h, g):
            out &= (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
        return out


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h.view(np.uint64) + np.uint64(salt + 1) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def cascade(h: np.ndarray, g: np.ndarray, listed: np.ndarray, first_rate: float = FIRST_RATE, rate: float = RATE) -> list[Level]:
    """The levels for keys given by two hashes; every key is put through every level it reaches, so the answer is exact for all."""
    levels: list[Level] = []
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    while len(inside):
        if len(levels) > 200:
            raise ValueError("a listed and another key have the same hashes")
        level = Level.of(len(levels), h[inside], g[inside], rate if levels else first_rate)
        levels.append(level)
        inside, outside = outside[level.holds(h[outside], g[outside])], inside
    return levels


def is_listed(levels: list[Level], h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Whether the first level (from 1) that doesn't hold a key is an even one."""
    answer, open_ = np.zeros(len(h), bool), np.arange(len(h))
    for k, level in enumerate(levels):
        held = level.holds(h[open_], g[open_])
        answer[open_[~held]] = k % 2 == 1
        open_ = open_[held]
    answer[open_] = len(levels) % 2 == 1
    return answer


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key, F.lit(0)).alias("h"), F.xxhash64(key, F.lit(1)).alias("g")]


def _part(n: int) -> Column:
    return F.pmod(F.xxhash64("h", F.lit("part")), F.lit(n)).alias("part")


def build_parts(keys: DataFrame, first_rate: float = FIRST_RATE, rate: float = RATE, part_keys: int = PART_KEYS) -> tuple[DataFrame, int]:
    """part, bytes, levels of every part, and the number of parts, for the distinct ``key`` of ``keys`` with boolean ``listed``."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        levels = cascade(rows["h"].to_numpy(), rows["g"].to_numpy(), rows["listed"].to_numpy(bool), first_rate, rate)
        found = [{"bits": x.bits, "hashes": x.hashes, "words": x.words.tobytes()} for x in levels]
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "bytes": [sum(len(x["words"]) for x in found)], "levels": [found]})

    hashed = materialise(keys.select("listed", *_hashes(F.col("key"))), "cascade-keys")
    n = max(1, -(-hashed.count() // part_keys))
    parts = materialise(hashed.select("listed", "h", "g", _part(n)).groupBy("part").applyInPandas(build, _SCHEMA), "cascade")
    release(hashed)
    return parts, n


def _levels(rows: pa.Table) -> dict[int, list[Level]]:
    levels = [[Level(k, x["bits"], x["hashes"], np.frombuffer(x["words"], np.uint64)) for k, x in enumerate(row)] for row in rows["levels"].to_pylist()]
    return dict(zip(rows["part"].to_pylist(), levels, strict=True))


def with_listed(rows: DataFrame, key: str, parts: DataFrame, n: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``rows`` with ``listed``, whether the column ``key`` is on the list; exact for keys of the universe, and no join."""
    placed = rows.select(*rows.columns, *_hashes(F.col(key))).select(*rows.columns, "h", "g", _part(n))
    schema = placed.drop("h", "g", "part").withColumn("listed", F.lit(True)).schema
    if (parts.agg(F.sum("bytes")).first()[0] or 0) <= most_bytes:
        all_levels, folder = rows.sparkSession.sparkContext.broadcast(_levels(parts.toArrow())), None
    else:
        all_levels, folder = None, scratch(rows.sparkSession, "cascade-parts")
        parts.repartition(n, "part").write.partitionBy("part").parquet(folder)
        salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD))
        placed = placed.repartition(F.col("part"), salt).sortWithinPartitions("part")

    def read(part: int) -> list[Level]:
        store, root = open_store(folder)
        found = ds.dataset(f"{root}/part={part}", filesystem=store, format="parquet").to_table().append_column("part", pa.array([part]))
        return _levels(found)[part]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, list[Level]] = (-1, [])
        for batch in batches:
            h, g, part = (batch.column(c).to_numpy() for c in ("h", "g", "part"))
            answer = np.zeros(batch.num_rows, bool)
            for p in np.unique(part).tolist():
                if all_levels is None and held[0] != p:
                    held = p, read(p)
                at = part == p
                answer[at] = is_listed(all_levels.value[p] if all_levels else held[1], h[at], g[at])
            kept = batch.select(range(batch.num_columns - 3))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(answer)], [*kept.schema.names, "listed"])

    return placed.mapInArrow(judge, schema)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.when(F.instr(url, "://") > 0, lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Length: host labels first, then path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0], r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, listed: str | DataFrame = LISTED, id_col: str = "page_id", url_col: str = "url", most_bytes: int = MOST_BYTES, part_keys: int = PART_KEYS) -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every url.

    ``listed`` is a pattern or a table of hosts (its first column; A-Z are lower-cased,
    nulls skipped). The hosts it names are the listed keys and all hosts of ``pages``
    the universe; a url that no rule fits is blocked if its host is listed.
    Null urls and urls without ``://`` have an empty host, which is not listed.
    Repeated rows keep their rows. Empty hosts and paths fit no rule but one with
    an empty path start.
    """
    rows = take(pages, page_id=id_col, url=url_col).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = rows.select(F.col("host").alias("key")).distinct()
    if isinstance(listed, DataFrame):
        named = listed.toDF(*[f"c{i}" for i in range(len(listed.columns))]).select(lower_ascii(F.col("c0").cast("string")).alias("key"), F.lit(True).alias("listed"), F.lit(False).alias("met"))
        every = named.where("key <> ''").unionByName(hosts.select("key", F.lit(False).alias("listed"), F.lit(True).alias("met")))
        keys = every.groupBy("key").agg(F.bool_or("listed").alias("listed"), F.bool_or("met").alias("met")).where("met")
    else:
        keys = hosts.withColumn("listed", F.col("key").rlike(listed))
    parts, n = build_parts(keys, part_keys=part_keys)
    rows = with_listed(rows, "host", parts, n, most_bytes)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed")
