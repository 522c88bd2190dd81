"""License scans: short notices with a bounded number of edits.

A notice of length n may be met with k = n // 10 edits. Split into k + 1 pieces,
one piece must stand in the text unchanged (pigeonhole), so exact searches for
the pieces give candidate places. The regex library then matches the whole
notice with at most k errors in a window around each candidate.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import pieces, take, texts

#: Phrases with exact places, and their labels (fixed values).
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Further notices that only the fuzzy search looks for.
MORE = (
    ("all rights reserved", "all-rights-reserved"),
    ("bsd license", "bsd"),
    ("creative commons attribution", "cc-by"),
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license", "mpl"),
    ("permission is hereby granted free of charge", "mit"),
    ("public domain", "public-domain"),
)
LETTERS = 10  # letters of a notice for each edit it may have
#: Every ASCII character outside a-z and 0-9 becomes a space; A-Z becomes a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Notice:
    text: bytes
    label: str
    base: bool
    edits: int
    seeds: tuple[tuple[bytes, int], ...]  # piece, its place in the notice

    @staticmethod
    def of(text: str, label: str, base: bool, letters: int = LETTERS) -> Notice:
        raw = text.encode()
        k = len(raw) // letters
        cuts = [len(raw) * i // (k + 1) for i in range(k + 2)]
        return Notice(raw, label, base, k, tuple((raw[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)))

    def pattern(self):
        """Whole words only, at most ``edits`` errors, improved to the fewest at the place that is met."""
        text = regex.escape(self.text.decode("latin-1")).encode("latin-1")
        return regex.compile(b"(?<= )(?:%b){e<=%d}(?= )" % (text, self.edits), regex.ENHANCEMATCH)


def notices(base=BASE, more=MORE, letters: int = LETTERS) -> list[Notice]:
    return [Notice.of(t, label, True, letters) for t, label in base] + [Notice.of(t, label, False, letters) for t, label in more]


def normalise(text: bytes) -> list[bytes]:
    """Words of a text; after the table, spaces are the only ASCII characters left between them."""
    return text.translate(_TABLE).split()


def _all(haystack: bytes, needle: bytes) -> Iterator[int]:
    at = haystack.find(needle)
    while at >= 0:
        yield at
        at = haystack.find(needle, at + 1)


def scan_text(text: bytes, wanted: list[Notice], patterns: list) -> tuple[int, list[tuple[int, int, str, bool, int, int]]]:
    """Number of words, and (first word, end word, label, is a base place, edits, letters) of every place, sorted."""
    words = normalise(text)
    line = b" " + b" ".join(words) + b" "
    found: set[tuple[int, int, str, bool, int, int]] = set()
    spaces: list[int] = []

    def word_at(place: int) -> int:
        """The number of spaces before a place; they are listed once, for the first place that is met."""
        if not spaces:
            spaces.extend(np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist())
        return bisect_left(spaces, place)

    for notice, pattern in zip(wanted, patterns, strict=True):
        n = notice.text.count(b" ") + 1
        for at in _all(line, b" " + notice.text + b" "):
            first = word_at(at)
            found.add((first, first + n, notice.label, notice.base, 0, len(notice.text)))
        if not notice.edits:
            continue
        spans: list[list[int]] = []
        for a, b in sorted({(max(0, at - place - notice.edits - 1), at - place + len(notice.text) + notice.edits + 1) for seed, place in notice.seeds for at in _all(line, seed)}):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        for a, b in spans:
            for m in pattern.finditer(line, a, min(b, len(line)), overlapped=True):
                edits = sum(m.fuzzy_counts)
                if edits:
                    first = word_at(m.start()) - 1
                    found.add((first, first + m.group().count(b" ") + 1, notice.label, False, edits, len(notice.text)))
    return len(words), sorted(found)


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<first:long,end:long,label:string,base:boolean,edits:int>>"


def scan_licenses(docs: DataFrame, base=BASE, more=MORE, letters: int = LETTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places of every row.

    ``score`` is the best place's share of unedited letters (1 for an exact
    place), 0 without any place. Null texts count as empty: no words, no places,
    empty label strings. ``places`` are spans of words, the end excluded. Repeated rows and
    null ids keep their rows; an empty table gives an empty result.
    """
    wanted = notices(base, more, letters)
    place = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("base", pa.bool_()), ("edits", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [w.pattern() for w in wanted]
        for batch in batches:
            for part in pieces(batch):
                out: list[list] = [[] for _ in range(8)]
                for text in texts(part):
                    n, found = scan_text(text, wanted, patterns)
                    exact = [p for p in found if p[3]]
                    score = max((1 - p[4] / p[5] for p in found), default=0.0)
                    values = (
                        n,
                        len(exact),
                        exact[0][0] if exact else None,
                        exact[-1][0] if exact else None,
                        ",".join(sorted({p[2] for p in exact})),
                        ",".join(sorted({p[2] for p in found})),
                        score,
                        [{"first": a, "end": b, "label": c, "base": d, "edits": e} for a, b, c, d, e, _ in found],
                    )
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(place)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(v, t) for v, t in zip(out, kinds, strict=True)]], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"])

    rows = take(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
