"""Packing documents into sequences as a cutting-stock problem, by column generation.

Documents, cut at the capacity, are counted in a histogram of length classes.  A linear program over
patterns (how many pieces of each class share a sequence) is solved by the revised simplex method, and
a knapsack dynamic program prices new patterns; patterns are rounded down, the rest is filled greedily.
Then pieces are ranked within their class, and a rank says which copy of which pattern a piece goes to.
Only the histogram, whose size doesn't depend on the documents, comes to the driver.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.mixing import with_tokens
from tarnwick.llm.ranks import ranks
from tarnwick.llm.session import cut


def knapsack(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items that fits, by dynamic programming over the capacity; items may repeat."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    good = np.flatnonzero(value > 1e-12)
    good = good[np.argsort(size[good], kind="stable")]
    s, v = size[good], value[good]
    for w in range(1, capacity + 1):
        best[w], pick[w] = best[w - 1], -1
        n = int(np.searchsorted(s, w, side="right"))
        if n:
            total = v[:n] + best[w - s[:n]]
            k = int(total.argmax())
            if total[k] > best[w] + 1e-12:
                best[w], pick[w] = total[k], good[k]
    out = np.zeros(len(size), np.int64)
    w = capacity
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            out[pick[w]] += 1
            w -= size[pick[w]]
    return float(best[capacity]), out


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse by elimination with row pivots.  (LAPACK's threads have been seen to stop for good in a driver that had started a JVM.)"""
    n = len(a)
    x = np.concatenate([a.astype(float), np.eye(n)], 1)
    for k in range(n):
        p = k + int(np.abs(x[k:, k]).argmax())
        if x[p, k] == 0:
            raise np.linalg.LinAlgError("singular matrix")
        x[[k, p]] = x[[p, k]]
        x[k] /= x[k, k]
        f = x[:, k].copy()
        f[k] = 0
        x -= f[:, None] * x[k]
    return x[:, n:]


def column_generation(size: np.ndarray, demand: np.ndarray, capacity: int, patience: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """(patterns [pattern, class], how often, bound) of the linear program: as few sequences as possible, each class met exactly.

    It ends when no pattern is worth more than a sequence, when the bound is met, or when patience rounds in
    a row (of degenerate steps) gained less than a millionth.  Of the patterns that may leave, the one of the
    largest pivot does, so that rounding errors stay small.  bound is never above the program's optimum, however it ends: the greatest of
    the duals' value over the worth of the best pattern.
    """
    m = len(size)
    pattern = np.diag(capacity // size).astype(np.int64)
    inverse = np.diag(1.0 / np.diag(pattern))
    x = demand / np.diag(pattern)
    bound, best, idle, k = 0.0, np.inf, 0, 0
    while idle < patience:
        dual = inverse.sum(0)
        worth, new = knapsack(dual, size, capacity)
        bound = max(bound, float(np.maximum(dual, 0) @ demand) / max(worth, 1.0) if (dual >= -1e-9).all() else 0.0)
        if worth <= 1 + 1e-7:
            break
        d = inverse @ new
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-9, x / d, np.inf)
        step = float(ratio.min())
        if not np.isfinite(step):  # only a rounding error
            break
        may = np.flatnonzero(ratio <= step + 1e-9 * (1 + abs(step)))
        out = int(may[d[may].argmax()])
        x = x - step * d
        x[out] = step
        pattern[out] = new
        row = inverse[out] / d[out]
        inverse -= np.outer(d, row)
        inverse[out] = row
        k += 1
        if k % 50 == 0:
            inverse = inverted(pattern.T)
            x = np.maximum(inverse @ demand, 0)
        now = float(x.sum())
        if now <= bound * (1 + 1e-9):
            break
        best, idle = (now, 0) if now < best * (1 - 1e-6) else (best, idle + 1)
    return pattern, np.maximum(x, 0) if m else x, max(bound, float(demand @ size) / capacity)


def integer_patterns(size: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(patterns, copies, bound): whole numbers that hold every piece; no other way takes fewer than bound."""
    size, demand = np.asarray(size, np.int64), np.asarray(demand, np.int64)
    if not len(size):
        return np.zeros((0, 0), np.int64), np.zeros(0, np.int64), 0.0
    pattern, x, bound = column_generation(size, demand, capacity)
    times = np.floor(x + 1e-6).astype(np.int64)
    left = demand - pattern.T @ times
    for k in np.flatnonzero(times > 0):  # only a rounding error above could overfill a class
        while times[k] and (left < 0).any() and (pattern[k][left < 0] > 0).any():
            times[k] -= 1
            left = left + pattern[k]
    more = []
    order = np.argsort(-size, kind="stable")
    while left.any():
        room, own = capacity, np.zeros(len(size), np.int64)
        for c in order:
            n = min(int(left[c]), room // int(size[c]))
            own[c] += n
            room -= n * int(size[c])
        copies = int(min(left[c] // own[c] for c in range(len(size)) if own[c]))
        more.append((own, copies))
        left = left - copies * own
    keep = times > 0
    patterns = np.concatenate([pattern[keep], np.array([p for p, _ in more], np.int64).reshape(-1, len(size))])
    return patterns, np.r_[times[keep], np.array([n for _, n in more], np.int64)], bound


def pack(docs: DataFrame, *, capacity: int = 2048, classes: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, doc_start, length, sequence, position): where every piece of every document goes.

    A document is its tokens and an end mark; it is cut into pieces of capacity tokens and a rest, and
    every piece lies whole in one sequence, from position on.  Lengths are rounded up to a multiple of
    capacity / classes for the program only, so a sequence never holds more than its capacity.  The
    table of patterns that is broadcast has at most 2 * classes rows of classes numbers, for any input.

    Defined cases: an empty text is one piece of length 1, its end mark; a null text has no piece; a very
    long text has as many pieces as it takes; a null id is carried as it is; repeated rows are packed
    each, and pieces of one length and id go in no particular order; an empty table gives an empty result;
    other columns, whatever their names, are not read.
    """
    classes = min(classes, capacity)
    own = with_tokens(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")).select("doc_id", (F.col("n_tokens") + 1).alias("total"))
    pieces = own.select("doc_id", "total", F.explode(F.sequence(F.lit(0), F.ceil(F.col("total") / capacity) - 1)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * capacity).alias("doc_start"), F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).cast("int").alias("length"))
    pieces = cut(pieces.withColumn("class", F.ceil(F.col("length") * classes / capacity).cast("int")))
    rows = sorted((r["class"], r["count"]) for r in pieces.groupBy("class").count().collect())
    size, demand = (np.array([r[k] for r in rows], np.int64) for k in range(2))
    patterns, copies, _ = integer_patterns(size, demand, classes)
    first = np.cumsum(copies) - copies
    table = docs.sparkSession.sparkContext.broadcast((size, patterns, first, np.cumsum(patterns * copies[:, None], 0)))

    def place(cls: pa.Array, rank: pa.Array) -> pa.Array:
        size, patterns, first, ends = table.value
        c, r = np.searchsorted(size, cls.to_numpy(zero_copy_only=False)), rank.to_numpy(zero_copy_only=False)
        sequence = np.empty(len(c), np.int64)
        for k in np.unique(c):
            of = np.flatnonzero(c == k)
            p = np.searchsorted(ends[:, k], r[of], side="right")
            before = np.where(p > 0, ends[p - 1, k], 0)
            sequence[of] = first[p] + (r[of] - before) // patterns[p, k]
        return pa.array(sequence)

    ranked = ranks(pieces, "class", ["doc_id", "piece"], total=int(demand.sum()))
    placed = ranked.withColumn("sequence", F.arrow_udf(place, "long")("class", "rank"))
    order = Window.partitionBy("sequence").orderBy(F.desc("class"), "rank")
    return placed.withColumn("position", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).select("doc_id", F.col("piece").cast("int"), F.col("doc_start").cast("long"), "length", "sequence", F.col("position").cast("int"))
