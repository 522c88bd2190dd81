"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

Statistics of each whole text (no ids, languages or sources) are standardised
and mapped to random Fourier features, whose inner products approximate a
Gaussian kernel. Each partition sums its part of the normal equations; the
driver adds a fixed number of such sums and solves one system of fixed size. Raw scores are
calibrated by isotonic regression over a histogram of a part of the training
rows that the ridge fit didn't see.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, materialise, pieces, take, texts

STATISTICS = (
    "log_words", "word_length", "distinct", "top_share", "repeats", "compressed", "upper", "digit", "symbol", "punctuation",
    "other", "space", "capital_words", "lines", "distinct_lines", "longest_word", "symbol_words", "hapax",
)
FEATURES, BANDWIDTH, RIDGE, SEED = 256, 4.0, 1e-3, 11
#: Bounds of the fit: labelled rows used, partitions that sum equations, bins of the calibration.
MAX_FIT_ROWS, FIT_PARTS, BINS = 200_000, 16, 512
HELD_OUT, FOLDS, CALIBRATION = 2, 4, 1
THRESHOLD = 0.7

_BYTES = np.zeros((256, 6))
for _b in range(256):
    _c = chr(_b)
    _kind = 0 if "A" <= _c <= "Z" else 1 if "0" <= _c <= "9" else 2 if _c in "!#$%&*+<=>@\\^_`{|}~" else 3 if _c in "\"'(),-./:;?[]" else 4 if _b >= 128 else 5 if _b in b" \t\n\r\x0b\x0c" else -1
    if _kind >= 0:
        _BYTES[_b, _kind] = 1


def statistics(text: bytes) -> list[float]:
    """One value for each name in ``STATISTICS``; all zero for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    counts, lines = Counter(words), [x for x in text.split(b"\n") if x.strip()]
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _BYTES / len(text)
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        np.log1p(n),
        lengths.mean(),
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        min(2.0, len(zlib.compress(text, 1)) / len(text)),
        *kinds.tolist(),
        sum(map(bytes.isupper, words)) / n,
        np.log1p(len(lines)),
        len(set(lines)) / max(1, len(lines)),
        np.log1p(lengths.max()),
        sum(w[-1] in b"!#$%&*" for w in words) / n,
        sum(c == 1 for c in counts.values()) / n,
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``stats`` (array of doubles) of every row; null texts count as empty."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([statistics(t) for t in texts(part)], pa.list_(pa.float64()))], ["doc_id", "stats"])

    rows = take(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, stats array<double>")


class Fourier:
    """Standardised statistics to ``FEATURES`` cosines and a constant."""

    def __init__(self, mean: np.ndarray, std: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w, self.b = rng.normal(0, 1 / BANDWIDTH, (len(STATISTICS), FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.std, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ self.w + self.b), np.ones((len(x), 1))])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("stats").flatten()).reshape(batch.num_rows, len(STATISTICS))


class Model:
    """A fitted scorer. ``edges`` and ``levels`` are the calibration curve, rising from 0 to 1."""

    def __init__(self, fourier: Fourier, beta: np.ndarray, edges: np.ndarray, levels: np.ndarray):
        self.fourier, self.beta, self.edges, self.levels = fourier, beta, edges, levels

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.fourier(stats) @ self.beta if len(stats) else np.zeros(0)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.edges, self.levels)


def isotonic(values: np.ndarray, counts: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins; returns block centres and their shares of ones."""
    blocks: list[list[float]] = []
    for v, n, k in zip(values, counts, ones, strict=True):
        blocks.append([v * n, n, k])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([(b[2] + 0.5) / (b[1] + 1) if len(blocks) < 2 else b[2] / b[1] for b in blocks])


def training_labels(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """doc_id, y of labelled rows outside the held-out fold; at most about ``max_rows``, chosen by a hash of the id.

    Labels that are null or have no id are skipped; repeated ones count once (the highest).
    """
    known = take(labels, doc_id="doc_id", y=label).where("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.max("y").cast("double").alias("y"))
    known = known.where(F.pmod(crc32_of_id(F.col("doc_id")), F.lit(FOLDS)) != HELD_OUT)
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < int(max_rows / n * (1 << 20)))
    return materialise(known, "quality-labels")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fits on labelled rows outside the held-out fold; None if they don't show both classes.

    The labels used, at most about ``max_rows`` rows of 16 bytes, are broadcast to
    the documents, so texts aren't shuffled and only labelled ones are measured.
    """
    known = training_labels(labels, label, max_rows)
    labelled = take(docs, doc_id=id_col, text=text_col).join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    stats = document_statistics(labelled).join(F.broadcast(known), "doc_id")
    calibrates = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(FOLDS)) == CALIBRATION
    rows = materialise(stats.withColumn("calibrates", calibrates).repartition(FIT_PARTS, "doc_id").sortWithinPartitions("doc_id"), "quality-fit")
    size = len(STATISTICS)
    fitted = rows.where("NOT calibrates")
    moments = fitted.agg(F.count("*"), F.sum("y"), *[F.avg(F.col("stats")[i]) for i in range(size)], *[F.stddev_pop(F.col("stats")[i]) for i in range(size)]).first()
    if not moments[0] or not 0 < moments[1] < moments[0]:
        return None
    fourier = Fourier(np.array(moments[2 : 2 + size]), np.array(moments[2 + size :]))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            z, y = fourier(_matrix(batch)), np.array(batch.column("y"))
            a += z.T @ z
            b += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([a.ravel()]), pa.array([b])], ["a", "b"])

    sums = fitted.coalesce(FIT_PARTS).select("stats", "y").mapInArrow(equations, "a array<double>, b array<double>").toArrow()  # FIT_PARTS rows of fixed size
    order = sorted(range(sums.num_rows), key=lambda i: sums["b"][i].as_py())
    a = sum(np.array(sums["a"][i].as_py()) for i in order).reshape(FEATURES + 1, -1)
    b = sum(np.array(sums["b"][i].as_py()) for i in order)
    beta = np.round(np.linalg.solve(a + RIDGE * moments[0] * np.diag([*[1.0] * FEATURES, 0.0]) / FEATURES, b), 9)

    @F.pandas_udf("int")
    def bin_of(s: pd.Series) -> pd.Series:
        raw = fourier(np.stack(s.to_numpy())) @ beta if len(s) else np.zeros(0)
        return pd.Series(np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32))

    bins = rows.where("calibrates").groupBy(bin_of("stats").alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("k")).orderBy("bin").toArrow().to_pandas()
    if not len(bins):
        return Model(fourier, beta, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    edges, levels = isotonic((bins["bin"].to_numpy() + 0.5) / BINS * 2 - 0.5, bins["n"].to_numpy(), bins["k"].to_numpy())
    # beyond the outer blocks the curve goes on to 0 and 1, so that scores keep their order there
    low, high = min(-0.5, edges[0] - 0.01), max(1.5, edges[-1] + 0.01)
    return Model(fourier, beta, np.concatenate(([low], edges, [high])), np.concatenate(([0.0], 0.002 + 0.996 * levels, [1.0])))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, max_rows: int = MAX_FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts have all statistics zero and a score like any other. A null
    id counts as the empty text for the fold. Without labels of both classes
    every score is 0.5.
    """
    model = fit(docs, labels, label, max_rows, id_col, text_col)
    held = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(FOLDS)) == HELD_OUT
    scored = take(docs, doc_id=id_col, text=text_col).select("doc_id", held.alias("held_out"), _scorer(model)("text").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def _scorer(model: Model | None):
    """A function of a text column: its score, 0.5 without a model."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.full(len(text), 0.5))
        rows = [statistics(b"" if t is None else t.encode()) for t in text]
        return pd.Series(model.score(np.array(rows).reshape(len(rows), len(STATISTICS))))

    return score


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` that are predicted good; all rows without labels of both classes. Texts aren't shuffled."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    if model is None:
        return docs
    plain = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*plain)
    return rows.where(_scorer(model)(F.col(plain[docs.columns.index(text_col)])) >= threshold).toDF(*docs.columns)
