"""Approximate nearest neighbours by collision-counting hashing.

Every vector is projected on a number of random directions, and each projection is kept as one sorted
array.  A query opens a window around its own value in every array; radius by radius (virtual
rehashing, over the powers of one number) the windows grow, and only the new ends are read.  A vector
that lies in enough windows is verified by its distance.  The search ends when k verified vectors lie
within the radius.

Vectors are indexed in shards of about index_rows; a block of queries meets a shard in a task of its
own, whatever the number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of one index, and queries that meet it in one task, about.
INDEX_ROWS, QUERY_ROWS = 8192, 4096
#: Partitions at most; a task takes several pairs of a shard and a block beyond that, one after another.
MOST_TASKS = 10_000


def threshold(projections: int, share: float = 0.6827, miss: float = 0.06) -> int:
    """Collisions asked of a candidate: a vector at the radius itself, which collides with probability share, has fewer with probability at most miss."""
    p, total = (1 - share) ** projections, 0.0
    for k in range(projections + 1):
        total += p
        if total > miss:
            return k
        p *= (projections - k) / (k + 1) * share / (1 - share)
    return projections


class CollisionIndex:
    def __init__(self, vectors: np.ndarray, projections: int = 60, growth: float = 1.15, miss: float = 0.06, seed: int = 3):
        largest = float(np.abs(vectors).max(initial=0))
        self.exact, self.scale = vectors, largest if largest > 1e15 else 1.0  # squares of larger floats overflow
        self.x = (vectors / np.float32(self.scale)).astype(np.float32)
        self.square = (self.x.astype(np.float64) ** 2).sum(1)
        r = np.random.default_rng(seed)
        self.a = r.standard_normal((vectors.shape[1], projections)).astype(np.float32)
        p = self.x @ self.a
        self.order = [np.argsort(p[:, j], kind="stable") for j in range(projections)]
        self.sorted = [np.ascontiguousarray(p[o, j]) for j, o in enumerate(self.order)]
        self.growth, self.asked = growth, threshold(projections, miss=miss)
        spread = float(np.sqrt(2 * self.x.astype(np.float64).var(0).sum())) if len(self.x) else 0.0
        self.first = math.floor(math.log(spread / 4, growth)) if spread > 0 else 0

    def search(self, queries: np.ndarray, k: int, skip: np.ndarray | None = None, at_once: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, distances) of up to k neighbours of each query, nearest first, ties by row; skip has the query's own row, or -1."""
        n = len(self.x)
        skip = np.full(len(queries), -1) if skip is None else skip
        for at in range(0, len(queries), at_once):
            q = (queries[at : at + at_once] / self.scale).astype(np.float32)
            h = q @ self.a
            if n:
                far = max(float(max(np.abs(h[:, j] - s[0]).max(), np.abs(h[:, j] - s[-1]).max())) for j, s in enumerate(self.sorted))
                steps = max(0, math.ceil(math.log(max(far, 1e-30), self.growth)) - self.first) + 1
                radii = self.growth ** (self.first + np.arange(steps, dtype=float))
                lo = np.stack([np.searchsorted(s, (h[:, j, None] - radii).astype(np.float32), "left") for j, s in enumerate(self.sorted)], 2)
                hi = np.stack([np.searchsorted(s, (h[:, j, None] + radii).astype(np.float32), "right") for j, s in enumerate(self.sorted)], 2)
            for i in range(len(q)):
                own = int(skip[at + i])
                most = min(k, n - (own >= 0))
                yield self._one(q[i], queries[at + i], most, own, radii, lo[i], hi[i]) if most > 0 else (np.zeros(0, np.int64), np.zeros(0))

    def _one(self, q: np.ndarray, given: np.ndarray, k: int, skip: int, radii: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.x)
        count, dist, seen = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n, bool)
        if skip >= 0:
            seen[skip] = True
        square = float((q.astype(np.float64) ** 2).sum())
        left = right = None
        for t, radius in enumerate(radii):
            a, b = lo[t].tolist(), hi[t].tolist()
            if left is None:
                parts = [o[x:y] for o, x, y in zip(self.order, a, b)]
            else:
                parts = [o[x:y] for o, x, y in zip(self.order, a, left)] + [o[x:y] for o, x, y in zip(self.order, right, b)]
            left, right = a, b
            count += np.bincount(np.concatenate(parts), minlength=n)
            last = t == len(radii) - 1  # every window holds all vectors: whatever is left is verified
            new = np.flatnonzero(~seen if last else (count >= self.asked) & ~seen)
            if len(new):
                seen[new] = True
                dist[new] = np.sqrt(np.maximum(self.square[new] + square - 2.0 * (self.x[new] @ q), 0))
            if np.count_nonzero(dist <= radius) >= k:
                break
        near = np.argpartition(dist, k - 1)[:k] if k < n else np.arange(n)
        near = np.flatnonzero(dist <= dist[near].max())
        near = near[np.isfinite(dist[near])]
        exact = np.sqrt(((self.exact[near].astype(np.float64) - given.astype(np.float64)) ** 2).sum(1))
        top = np.lexsort((near, exact))[:k]
        return near[top], exact[top]


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v")).where("vec_id is not null and size(v) > 0")
    return own.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))).groupBy("vec_id").agg(F.min("v").alias("v"))


def _by_width(ids: np.ndarray, col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, matrix) of the vectors of each length."""
    width = pc.list_value_length(col).to_numpy(zero_copy_only=False)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        yield int(w), ids[own], np.asarray(col.take(pa.array(own)).flatten(), np.float32).reshape(len(own), int(w))


def _search_pass(k: int, **options):
    """Rows (vec_id, neighbour_id, distance) of the queries; input is sorted by group, vectors of the shard first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, index = None, [], {}
        for b in batches:
            of, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.r_[0, np.flatnonzero((of[1:] != of[:-1]) | (kind[1:] != kind[:-1])) + 1, len(of)] if len(of) else [0]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if of[x] != group:
                    group, held, index = of[x], [], {}
                ids, col = b.column(2).to_numpy()[x:y], b.column(3).slice(x, y - x)
                if not kind[x]:
                    held.append((ids, col))
                    continue
                if held:
                    for w, i, m in _by_width(np.concatenate([h[0] for h in held]), pa.concat_arrays([h[1] for h in held])):
                        order = np.argsort(i, kind="stable")
                        index[w] = (i[order], CollisionIndex(m[order], **options))
                    held = []
                for w, i, m in _by_width(ids, col):
                    if w in index:
                        known, own = index[w]
                        at = np.minimum(np.searchsorted(known, i), len(known) - 1)
                        found = list(own.search(m, k, np.where(known[at] == i, at, -1)))
                        near = np.concatenate([f[0] for f in found])
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i, [len(f[0]) for f in found])), pa.array(known[near]), pa.array(np.concatenate([f[1] for f in found]))], ["vec_id", "neighbour_id", "distance"])

    return run


def neighbours(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, *, projections: int = 60, miss: float = 0.06, index_rows: int = INDEX_ROWS, query_rows: int = QUERY_ROWS, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, neighbour_id, rank, distance): the k nearest other vectors of every query, by Euclidean distance.

    queries is a table like vectors, by default vectors itself; a query's own id is no answer.  rank counts
    from 1; ties go to the smaller id.  miss bounds the probability with which a vector at the final radius
    is overlooked in a shard; nearer ones are overlooked less.  Every vector is indexed, and every shard
    answers every query, so that the answers of a shard are merged by rank only.

    Defined cases: rows with a null id or vector, no element, or a null or non-finite element, are left out;
    vectors are compared with those of their own length only; rows that repeat an id are one vector, the
    first by its elements; equal vectors under different ids are neighbours at distance 0; with k or fewer
    other vectors every one is an answer; an empty table gives an empty result; very long vectors take as
    many numbers as they have; other columns are not read.
    """
    own = _clean(vectors, id_col, vector_col)
    asked = own if queries is None else _clean(queries, id_col, vector_col)
    n, m = own.count(), asked.count() if queries is not None else None
    shards, blocks = max(1, -(-n // index_rows)), max(1, -(-(n if m is None else m) // query_rows))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("long")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = own.select("vec_id", "v", shard.alias("shard"), every(blocks).alias("block"), F.lit(0).alias("asked"))
    right = asked.select("vec_id", "v", every(shards).alias("shard"), block.alias("block"), F.lit(1).alias("asked"))
    rows = left.unionByName(right).select((F.col("shard") * blocks + F.col("block")).alias("grp"), "asked", "vec_id", "v")
    parts = min(shards * blocks, MOST_TASKS)
    rows = rows.repartitionById(parts, F.pmod("grp", F.lit(parts)).cast("int")).sortWithinPartitions("grp", "asked")
    found = rows.mapInArrow(_search_pass(k, projections=projections, miss=miss, seed=seed), "vec_id long, neighbour_id long, distance double")
    order = Window.partitionBy("vec_id").orderBy("distance", "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("vec_id", "neighbour_id", "rank", "distance")
