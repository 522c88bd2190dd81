"""Runs of repeated words in a text, by a sparse dynamic program over diagonals.

A run is a stretch of consecutive words with smallest period q that repeats at least
``times`` times, has at least ``least`` words and can't be extended. Words that match the
word q places before them lie on diagonal q of the table of word pairs. The program goes
through the words once: each word's earlier occurrences lengthen the active diagonals, and a
diagonal that isn't lengthened ends and is a run if it is long enough.

A common word occurs far too often for all its pairs. So an occurrence counts only with the
words before it: for lags up to L, those where the last L words are the same, and of these
the nearest. Nothing is lost, as both follow from the definition of a run. A diagonal of lag
q with a run has at least 2q matches in a row, so L of them for the lags (L/2, L]; and if the
same L words ended at a lag r < q too, these words and those between would have the periods
q and r, hence (being L + r >= q + r words) their greatest common divisor, and q wouldn't be
the smallest period. Each word then has one lag for each L, and there are log n of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, take, texts

#: Fewest words of a run, and how often its period is repeated at least (3 or more).
LEAST, TIMES = 24, 3
Run = tuple[int, int, int]
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)


def _all_differ(names: np.ndarray) -> bool:
    return len(names) == 0 or int(names.max()) + 1 == len(names)


def _lengthened(ids: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(last words, lags, L) of each L: where the last L words occur before, at the nearest place, at a lag of that L."""
    n, size, low = len(ids), 2 * max(1, least // 3), 0
    names, span = ids, 1
    while span < size:  # equal numbers for equal stretches of ``span`` words, by their first word
        step = min(span, size - span)
        if n < span + step or (span > 1 and _all_differ(names)):
            return
        names, span = _pairs(names[:-step], names[step:]), span + step
    while low * times < n and not _all_differ(names):
        order = np.argsort(names, kind="stable")
        same = names[order[1:]] == names[order[:-1]]
        at, lag = order[1:][same], (order[1:] - order[:-1])[same]
        fits = (lag > low) & (lag <= size)
        yield at[fits] + size - 1, lag[fits], size
        low = size
        if n < 2 * size:
            return
        names, size = _pairs(names[:-size], names[size:]), 2 * size


def word_runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """(start, length, period) of all runs, by start and period."""
    if times < 3:
        raise ValueError("a period must be repeated three times at least")
    if len(words) < max(least, times):
        return []
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    found = list(_lengthened(ids, least, times))
    if not found:
        return []
    places = np.concatenate([at for at, _, _ in found])
    lags = np.concatenate([lag for _, lag, _ in found])
    sizes = np.concatenate([np.full(len(at), size) for at, _, size in found])
    order = np.argsort(places, kind="stable")
    runs: list[Run] = []
    active: dict[int, list[int]] = {}  # lag: last word, matches in a row

    def end(lag: int) -> None:
        last, matches = active.pop(lag)
        if matches + lag >= max(least, times * lag):
            runs.append((last - matches - lag + 1, matches + lag, lag))

    before = -1
    for i, lag, size in zip(places[order].tolist(), lags[order].tolist(), sizes[order].tolist(), strict=True):
        if i != before:
            for other in [q for q, (last, _) in active.items() if last < i - 1]:
                end(other)
            before = i
        if lag in active:
            active[lag] = [i, active[lag][1] + 1]
        else:
            active[lag] = [i, size]
    for lag in list(active):
        end(lag)
    return sorted((s, n, q) for s, n, q in runs)


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and period) and collapsed (the text without repeats) of every row.

    Words are split at the six ASCII spaces. Null and empty texts have no words, no runs and
    an empty collapsed text. Rows stay as they are, with repeats and null ids; columns other
    than id and text aren't read. Memory is a few arrays of the words of one text.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                counts, runs, kept = [], [], []
                for text in texts(part):
                    words = text.split()
                    own = word_runs(words, least, times)
                    counts.append(len(words))
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                    kept.append(collapse(words, own).decode())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, _RUNS), pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = take(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
