"""Hard negatives of anchors by shared candidate lists (exact maximum inner product search).

Anchors are grouped into clusters of one label with near directions. For a cluster, every
candidate v has an angular bound: with centroid c and radius r (the largest angle of a member
to c), a member a has ``a.v <= |a| |v| cos(max(0, angle(v, c) - r))``. Candidates are sorted
once by ``|v| cos(...)``, largest first, and all members walk this one list. A member stops
as soon as the bound at its place is below the worst row it holds, which certifies that no
later candidate can enter. Clusters decide only how long the walks are, never the result.

Candidates stay where they are: each task builds the lists of its own blocks of rows and
carries what its members hold from block to block. Anchors are the small side; they go out in
slices of a bounded size, and a slice's rows meet again in a top-k over the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, take

#: Numbers in the vectors of a slice of anchors (64 MB), and of a block of candidates.
SLICE_NUMBERS, BLOCK_NUMBERS = 1 << 23, 1 << 20
#: Members of a cluster on average, rounds of clustering, and candidates that a walk takes at a step.
MEMBERS, ROUNDS, STEP = 64, 5, 256
_NOBODY = np.iinfo(np.int64).max


@dataclass
class Cluster:
    """Anchors of one label: their places in the slice, integer vectors and lengths; ``centre`` has length 1 (or 0)."""

    label: int
    places: np.ndarray
    vectors: np.ndarray
    lengths: np.ndarray
    centre: np.ndarray
    radius: float


@dataclass
class Slice:
    ids: np.ndarray
    dims: int
    largest: float
    clusters: list[Cluster]


def matrix(lists: pa.Array, dims: int, scale: float) -> np.ndarray:
    """floor(scale * x) of every component as whole doubles; short vectors are filled with zeros, long ones cut at ``dims``."""
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = np.floor(pc.list_flatten(lists).to_numpy(zero_copy_only=False) * scale)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    row = np.repeat(np.arange(len(lengths)), lengths)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row[column < dims], column[column < dims]] = flat[column < dims]
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)


def make_clusters(labels: np.ndarray, vectors: np.ndarray) -> list[Cluster]:
    """Clusters of near directions within each label (spherical k-means, with first centres at even steps)."""
    out = []
    for label in np.unique(labels).tolist():
        places = np.flatnonzero(labels == label)
        own, unit = vectors[places], _unit(vectors[places])
        k = math.ceil(len(places) / MEMBERS)
        centres = unit[np.linspace(0, len(places) - 1, k).astype(int)]
        for _ in range(ROUNDS if k > 1 else 1):
            nearest = np.argmax(unit @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, unit)
            centres = _unit(sums)
        for c in np.unique(nearest).tolist():
            mine = nearest == c
            lengths = np.linalg.norm(own[mine], axis=1)
            angles = np.arccos(np.clip(unit[mine] @ centres[c], -1, 1))[lengths > 0]
            out.append(Cluster(label, places[mine], own[mine], lengths, centres[c], float(angles.max(initial=0.0)) + 1e-6))
    return out


def shared_list(cluster: Cluster, vectors: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds) of candidates: ``|a| * bounds`` is at least the score of a member of length ``|a|`` with any later one."""
    cosines = np.divide(vectors @ cluster.centre, lengths, out=np.zeros(len(lengths)), where=lengths > 0)
    angles = np.maximum(0.0, np.arccos(np.clip(cosines, -1, 1)) - cluster.radius)
    bounds = lengths * np.cos(angles)
    order = np.argsort(-bounds, kind="stable")
    return order, bounds[order]


class Held:
    """The best ``k`` rows of some queries, by score and then smaller id, among rows with a score from ``low`` to ``high``."""

    def __init__(self, queries: int, k: int, low: np.ndarray | None = None, high: np.ndarray | None = None):
        self.scores, self.ids = np.full((queries, k), -np.inf), np.full((queries, k), _NOBODY)
        self.low = np.full(queries, -np.inf) if low is None else low
        self.high = np.full(queries, np.inf) if high is None else high

    def open(self, some: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which of ``some`` queries may still take a row with a score of at most ``bounds``: equal scores can have smaller ids."""
        return np.maximum(self.low[some], self.scores[some, -1]) <= bounds

    def offer(self, some: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: of each of ``some`` queries with each row; minus infinity keeps a row out."""
        least = np.maximum(self.low[some], self.scores[some, -1])[:, None]
        at, row = np.nonzero((scores >= least) & (scores <= self.high[some][:, None]) & (scores > -np.inf))
        if not len(at):
            return
        touched, at = np.unique(at, return_inverse=True)
        k = self.scores.shape[1]
        query = np.concatenate([np.repeat(np.arange(len(touched)), k), at])
        value = np.concatenate([self.scores[some[touched]].ravel(), scores[touched[at], row]])
        name = np.concatenate([self.ids[some[touched]].ravel(), ids[row]])
        order = np.lexsort((name, -value, query))
        first = np.searchsorted(query[order], np.arange(len(touched)))
        best = order[first[:, None] + np.arange(k)]
        self.scores[some[touched]], self.ids[some[touched]] = value[best], name[best]


def walk(cluster: Cluster, held: Held, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, not_self: np.ndarray | None) -> int:
    """Each member walks the shared list until none of its queries is open; returns the compared pairs.

    queries: (members, queries of each) places in ``held``. not_self: ids of the members, which their own rows don't count for.
    """
    order, bounds = shared_list(cluster, vectors, np.linalg.norm(vectors, axis=1))
    compared, going = 0, np.arange(len(cluster.places))
    for at in range(0, len(order), STEP):
        # rounding of the bound is far below this margin
        bound = cluster.lengths[going] * bounds[at] + 1e-9 * cluster.lengths[going] * abs(bounds).max() + 0.5
        going = going[held.open(queries[going].ravel(), np.repeat(bound, queries.shape[1])).reshape(len(going), -1).any(axis=1)]
        if not len(going):
            break
        rows = order[at : at + STEP]
        scores = cluster.vectors[going] @ vectors[rows].T
        compared += scores.size
        if not_self is not None:
            scores[not_self[going][:, None] == ids[rows]] = -np.inf
        for k in range(queries.shape[1]):
            held.offer(queries[going, k], scores, ids[rows])
    return compared


def _blocks(batches: Iterator[pa.RecordBatch], anchors: Slice, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of at most some ``BLOCK_NUMBERS`` components, whatever the size of Arrow's batches."""
    rows = max(1, BLOCK_NUMBERS // max(1, anchors.dims))
    waiting: list[pa.RecordBatch] = []
    n = 0

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(waiting).combine_chunks()
        vectors = matrix(table["v"].chunk(0), anchors.dims, scale)
        if anchors.dims * anchors.largest * np.abs(vectors).max(initial=0.0) >= 2**53:
            raise ValueError("inner products of 2^53 or more aren't exact; take a smaller scale")
        return table["id"].to_numpy(), table["label"].to_numpy(), vectors

    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            if waiting and n + part.num_rows > rows:
                yield block()
                waiting, n = [], 0
            waiting.append(part)
            n += part.num_rows
    if n:
        yield block()


def _search(candidates: DataFrame, anchors: Slice, scale: float, k: int, same_label: bool, low: np.ndarray | None = None, high: np.ndarray | None = None) -> DataFrame:
    """(anchor, query, score, id): the k best rows of each query of each anchor (its place in the slice), over all candidates.

    low, high: (anchors, queries) bounds of the score; without them an anchor has one query.
    """
    each = 1 if low is None else low.shape[1]
    sent = candidates.sparkSession.sparkContext.broadcast((anchors, low, high))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, lowest, highest = sent.value
        held = Held(len(mine.ids) * each, k, *(None if x is None else x.ravel() for x in (lowest, highest)))
        for ids, labels, vectors in _blocks(batches, mine, scale):
            for cluster in mine.clusters:
                rows = (labels == cluster.label) == same_label
                queries = cluster.places[:, None] * each + np.arange(each)
                if rows.any():
                    walk(cluster, held, queries, ids[rows], vectors[rows], mine.ids[cluster.places] if same_label else None)
        query, place = np.nonzero(held.ids != _NOBODY)
        for at in range(0, len(query), 1 << 16):
            q, p = query[at : at + (1 << 16)], place[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(q // each, pa.int64()), pa.array(q % each, pa.int64()), pa.array(held.scores[q, p].astype(np.int64)), pa.array(held.ids[q, p])], ["anchor", "query", "score", "id"])

    found = candidates.mapInArrow(scan, "anchor long, query long, score long, id long")
    best = Window.partitionBy("anchor", "query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every row of ``anchors``.

    A score is the inner product of floor(scale * x); larger ones come first, ties by smaller
    id. An anchor's positives are its first ``positives`` rows of the same label with another
    id; the negatives of each are the first ``negatives`` rows of another label with
    ``low * positive_score <= 100 * score <= high * positive_score``.

    Rows whose id, label or vector is null, or that have a null or non-finite component, take no
    part, neither as anchors. Repeated rows count as often as they are there; equal anchors are
    one. Vectors of different lengths are filled with zeros. An anchor without positives, or a
    positive without such negatives, gives no row. Ids and labels are whole numbers. Scores
    of 2^53 or more are refused, as they wouldn't be exact.
    """

    def valid(df: DataFrame) -> DataFrame:
        some = take(df, id=id_col, label=label_col, v=vector_col).select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("v").cast("array<double>"))
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        return some.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)

    spark, candidates = rows.sparkSession, valid(rows)
    chosen = materialise(valid(anchors).distinct(), "anchors")
    n, dims = chosen.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    slices = max(1, math.ceil(n * max(1, dims) / SLICE_NUMBERS))
    found = []
    for k in range(slices):
        part = chosen.where(F.pmod(F.xxhash64("id", "label", "v"), F.lit(slices)) == k).toArrow().combine_chunks()
        if not part.num_rows:
            continue
        vectors = matrix(part["v"].chunk(0), dims, scale)
        ids, labels = part["id"].to_numpy(), part["label"].to_numpy()
        own = Slice(ids, dims, float(np.abs(vectors).max(initial=0.0)), make_clusters(labels, vectors))
        # of a bounded slice, so a bounded table: ``positives`` rows for each anchor
        first = _search(candidates, own, scale, positives, True).select("anchor", "rank", "score", "id").toArrow()
        at, rank = first["anchor"].to_numpy(), first["rank"].to_numpy() - 1
        score, name = np.zeros((len(ids), positives), np.int64), np.full((len(ids), positives), -1)
        score[at, rank], name[at, rank] = first["score"].to_numpy(), first["id"].to_numpy()
        lowest, highest = np.full(score.shape, np.inf), np.full(score.shape, -np.inf)
        lowest[at, rank], highest[at, rank] = -(-low * score[at, rank] // 100), high * score[at, rank] // 100
        lowest[lowest > highest] = np.inf
        names = spark.createDataFrame(pa.table({"anchor": at, "query": rank.astype(np.int64), "anchor_id": ids[at], "positive_id": name[at, rank], "positive_score": score[at, rank]}))
        near = _search(candidates, own, scale, negatives, False, lowest, highest).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
        found.append(materialise(near.join(names, ["anchor", "query"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives"))
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, found)
