"""Toxicity: a weighted lexicon, learned from labels and matched by Aho-Corasick over folded text.

Folding lower-cases a text and maps look-alike letters and digit substitutions
to the letters they stand for. Words whose document counts in toxic texts are far
above chance form the lexicon; a word's weight is its log-odds. Pairs of words with
a lexicon word that stand in clean texts far above chance are exception phrases. A text's
weights are summed over all matches, less those inside exception phrases, divided by the
logarithm of its length and turned into a probability by a logistic fit.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, materialise, pieces, release, take

HELD_OUT, FOLDS = 0, 5
THRESHOLD = 0.5
#: Bounds of the fit: labelled rows used, bins of the logistic fit.
MAX_FIT_ROWS, BINS = 200_000, 1000
#: A word enters if chance would bring so many toxic texts for it less than once in this many vocabularies.
VOCABULARIES = 100
#: Look-alike characters and what they stand for.
LOOKALIKES = {
    "a": "аαɑ@4", "b": "Ьь8", "c": "сϲ", "d": "ԁ", "e": "еεє3", "g": "ɡ9", "h": "һ", "i": "іιı1!|", "j": "ј", "k": "кκ", "l": "ӏⅼ", "m": "м",
    "n": "ո", "o": "оοσ0", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ5$", "t": "тτ7", "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ2",
}
_TABLE = {ord(c): to for to, chars in LOOKALIKES.items() for c in chars if c not in "!|$@"}
_TABLE |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
#: Signs that stand for letters only inside a word.
_SIGNS = {"!": "i", "|": "i", "$": "s", "@": "a"}
_LETTERS = str.maketrans(_SIGNS)
#: ASCII characters that end a word.
_BREAKS = {c: " " for c in range(128) if not chr(c).isalnum() and chr(c) not in _SIGNS}
_ALL = _TABLE | _BREAKS
_ASCII = bytes(ord(_ALL.get(ord(c), c)) for c in map(str.lower, map(chr, range(128)))) + bytes(range(128, 256))


def fold(text: str) -> list[str]:
    """Words of a text with case, look-alikes and substitutions folded."""
    words = (text.encode().translate(_ASCII).decode() if text.isascii() else text.lower().translate(_ALL)).split()
    if any(s in text for s in _SIGNS):
        words = [w if w.isalnum() else w.rstrip("!|$@").lstrip("!|").translate(_LETTERS) for w in words]
        return [w for w in words if w]
    return words


class Lexicon:
    """Aho-Corasick automaton over words between spaces, with weights; exception phrases count against them."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = ()):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for word, weight in weights.items():
            self.machine.add_word(f" {word} ", weight)
        for phrase in exceptions:
            folded = fold(phrase)
            inside = sum(weights.get(w, 0.0) for w in folded)
            if inside and len(folded) > 1:
                self.machine.add_word(f" {' '.join(folded)} ", -inside)
        self.empty = not len(self.machine)
        if not self.empty:
            self.machine.make_automaton()

    def raw(self, text: str) -> float:
        """Summed weights over the logarithm of the length."""
        words = fold(text)
        if self.empty or not words:
            return 0.0
        total = sum(weight for _, weight in self.machine.iter(f" {' '.join(words)} "))
        return total / math.log(math.e + len(words))


SKETCHES, SHINGLE, SAME = 8, 3, 5


def sketches(words: list[str]) -> list[int]:
    """The smallest hashes of a text's word shingles, under ``SKETCHES`` multipliers."""
    shingles = {" ".join(words[i : i + SHINGLE]).encode() for i in range(max(1, len(words) - SHINGLE + 1))}
    hashes = np.array([xxhash.xxh64_intdigest(x) for x in shingles], np.uint64)
    return [int((hashes * salt).min().view(np.int64)) for salt in _SALTS]


_SALTS = np.random.default_rng(5).integers(1, 1 << 63, SKETCHES, dtype=np.uint64) | np.uint64(1)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, y, the folded text and its sketches: the one pass in which labelled texts are folded for the fit."""
    for batch in batches:
        for part in pieces(batch):
            words = [fold(t or "") for t in part.column("text").to_pylist()]
            columns = [part.column("doc_id"), part.column("y"), pa.array([" ".join(w) for w in words]), pa.array([sketches(w) for w in words], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "y", "folded", "m"])


def _counted(units_of) -> object:
    """A scan that counts in how many toxic and clean texts each unit of ``units_of(words)`` stands, for each batch before the shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "folded"):
                seen: tuple[Counter, Counter] = Counter(), Counter()
                for folded, y in zip(part.column("folded").to_pylist(), part.column("y").to_pylist(), strict=True):
                    seen[y].update(set(units_of(folded.split())))
                units = list(seen[0] | seen[1])
                yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), *[pa.array([seen[y][u] for u in units], pa.int64()) for y in (1, 0)]], ["unit", "toxic", "clean"])

    return scan


def training_labels(labels: DataFrame, label: str = "toxic", max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """doc_id, y of labelled rows outside the held-out fold; at most about ``max_rows``, chosen by a hash of the id."""
    fold_of = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(FOLDS))
    known = take(labels, doc_id="doc_id", y=label).where("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.max("y").cast("int").alias("y")).where(fold_of != HELD_OUT).where("y IN (0, 1)")
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < int(max_rows / n * (1 << 20)))
    return materialise(known, "toxic-labels")


def without_copies(labelled: DataFrame) -> DataFrame:
    """``labelled`` without the texts that share ``SAME`` or more of their ``SKETCHES`` sketches with one text of smaller id.

    Copies of a toxic text would make all its words look toxic. Each sketch is
    compared with the smallest id that has it, so groups of copies aren't expanded.
    """
    mine = labelled.select("doc_id", F.posexplode("m").alias("k", "s"))
    first = mine.groupBy("k", "s").agg(F.min("doc_id").alias("first"))
    copies = mine.join(first, ["k", "s"]).where("first < doc_id").groupBy("doc_id", "first").agg(F.count("*").alias("n")).where(F.col("n") >= SAME)
    copies = materialise(copies.select("doc_id").distinct(), "toxic-copies")
    return labelled.join(F.broadcast(copies), "doc_id", "left_anti")  # ids of labelled rows, at most about MAX_FIT_ROWS


def _beyond_chance(share: Column, base: float) -> Column:
    """KL divergence of a share from the base: n times it is the logarithm of the Chernoff bound of the binomial tail."""
    hit = F.when(share > 0, share * F.log(share / base)).otherwise(0.0)
    return hit + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)


def learn(docs: DataFrame, known: DataFrame) -> tuple[dict[str, float], tuple[str, ...]]:
    """Weights of words that stand in significantly many toxic texts, and phrases that clear such words; ``docs`` has doc_id and text.

    ``known`` has at most about ``MAX_FIT_ROWS`` rows of 12 bytes, so it is
    broadcast; texts aren't shuffled, only counts. The test against chance bounds the
    lexicon. A phrase is a pair of neighbours, one of them in the lexicon, that
    stands in so many clean texts that chance would bring as many less than once in
    ``VOCABULARIES`` vocabularies if its texts were as toxic as half of all.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    labelled = docs.join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")
    folded = materialise(labelled.mapInArrow(_folded, f"doc_id {kind}, y int, folded string, m array<long>"), "toxic-folded")
    kept = without_copies(folded).select("y", "folded")
    totals = kept.agg(F.sum("y"), F.count("*")).first()
    toxic, n = totals[0] or 0, totals[1]
    if not 0 < toxic < n:
        return {}, ()
    schema = "unit string, toxic long, clean long"

    def sums(units_of, name: str) -> DataFrame:
        counts = kept.mapInArrow(_counted(units_of), schema).groupBy("unit").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
        return materialise(counts.withColumn("share", F.col("t") / (F.col("t") + F.col("c"))), name)

    words = sums(set, "toxic-words")
    bar = math.log(max(2, words.count()) * VOCABULARIES)
    base = max(toxic / n, 1e-9)
    weight = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (n - toxic + 1))
    found = words.where((F.col("t") > 0) & (F.col("share") > max(base, 0.5)) & ((F.col("t") + F.col("c")) * _beyond_chance(F.col("share"), base) > bar))
    weights = {r["unit"]: r["weight"] for r in found.select("unit", F.round(weight, 4).alias("weight")).toArrow().to_pylist()}
    release(words)
    if not weights:
        return {}, ()

    def pairs(words: list[str]) -> Iterator[str]:
        return (f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a in weights or b in weights)

    phrases = sums(pairs, "toxic-phrases")
    cleared = phrases.where((F.col("share") < 0.5) & ((F.col("t") + F.col("c")) * _beyond_chance(F.col("share"), 0.5) > bar))
    return weights, tuple(sorted(r["unit"] for r in cleared.select("unit").toArrow().to_pylist()))


def raw_scores(docs: DataFrame, weights: dict[str, float], exceptions: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, raw of every row of ``docs`` (doc_id, text); null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # bounded by the labelled rows of the fit

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value, exceptions)
        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([lexicon.raw(t or "") for t in part.column("text").to_pylist()], pa.float64())], ["doc_id", "raw"])

    return docs.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, raw double")


def logistic(bins: np.ndarray, n: np.ndarray, k: np.ndarray, prior: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope by Newton steps on binned counts; a weak prior keeps separable data finite."""
    x, w = np.stack([np.ones_like(bins), bins], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (k - n * p) - prior * n.sum() * np.array([0.0, w[1]]) / 100
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + prior * n.sum() * np.diag([1e-6, 1.0]) / 100
        step = np.linalg.solve(hessian, gradient)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    threshold: float = THRESHOLD,
    max_rows: int = MAX_FIT_ROWS,
    exceptions: tuple[str, ...] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts match nothing and have the score of a clean text. A null
    id counts as the empty text for the fold. Repeated labels count once (the
    highest). Without labels of both classes every score is 0.5, and predicted is
    0 then. ``exceptions``: phrases that clear their words, beside the learned ones.
    """
    rows = take(docs, doc_id=id_col, text=text_col)
    known = training_labels(labels, label, max_rows)
    weights, learned = learn(rows, known)
    raws = materialise(raw_scores(rows, weights, (*exceptions, *learned)), "toxic-raw")
    at = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(F.col("raw") * 50).cast("int")))  # bins of 0.02
    bins = raws.join(F.broadcast(known), "doc_id").groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("k")).orderBy("bin").toArrow().to_pandas()
    held = (F.pmod(crc32_of_id(F.col("doc_id")), F.lit(FOLDS)) == HELD_OUT).alias("held_out")
    if not len(bins) or not 0 < bins["k"].sum() < bins["n"].sum():
        return raws.select("doc_id", held, F.lit(0.5).alias("score"), F.lit(0).alias("predicted"))
    intercept, slope = logistic(bins["bin"].to_numpy() / 50, bins["n"].to_numpy(float), bins["k"].to_numpy(float))
    score = F.lit(1.0) / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * F.col("raw"))))
    return raws.select("doc_id", held, score.alias("score")).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
