"""Sharding by longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.ranks import join_unique, ranks
from tarnwick.llm.session import cut


def schedule(sizes: np.ndarray, counts: np.ndarray, shards: int) -> np.ndarray:
    """[size, shard] number of groups of each size that go to each shard.

    Sizes are taken from the largest; each group goes to the least loaded shard, the first of equals,
    through a heap.  Groups of one size are alike: where there are more of them than shards, those that
    certainly fit under a common level are given out at once, and the heap takes the last few; the loads
    are the same as with one step for each group.
    """
    out = np.zeros((len(sizes), shards), np.int64)
    load = np.zeros(shards, np.int64)
    for k in np.argsort(-np.asarray(sizes), kind="stable"):
        s, c = int(sizes[k]), int(counts[k])
        if s == 0:
            out[k, 0] += c
            continue
        if c > 2 * shards:
            low, high = int(load.min()), int(load.max()) + s * (c // shards + 2)
            while low < high:  # the highest level under which at most c groups start
                mid = (low + high + 1) // 2
                if int(np.maximum(0, -((load - mid) // s)).sum()) <= c:
                    low = mid
                else:
                    high = mid - 1
            n = np.maximum(0, -((load - low) // s))
            out[k] += n
            load += n * s
            c -= int(n.sum())
        heap = [(int(x), i) for i, x in enumerate(load)]
        heapq.heapify(heap)
        for _ in range(c):
            x, i = heap[0]
            heapq.heapreplace(heap, (x + s, i))
            out[k, i] += 1
            load[i] += s
    return out


#: Bits of a group's size that count, from its highest on.
SIZE_BITS = 9


def size_class(size: Column) -> Column:
    """size rounded up to SIZE_BITS binary digits: itself below 512, at most 1/256 more above."""
    drop = F.greatest(F.lit(0), F.length(F.bin(size)) - SIZE_BITS)
    return F.when(size < 1 << SIZE_BITS, size).otherwise(F.call_function("shiftleft", F.call_function("shiftright", size + F.call_function("shiftleft", F.lit(1).cast("long"), drop) - 1, drop), drop))


def shard(docs: DataFrame, group: Column, size: Column, *, shards: int = 64, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, group_id, shard): the shard of every row; rows with the same group are in one shard.

    Sizes of groups are rounded up to 9 binary digits (see size_class), so the driver gets how many groups each
    of less than 512 + 55 * 256 sizes has, however many groups there are, and the plan that it broadcasts has as many
    rows of shards numbers.  The scheduling is exact for the rounded sizes, and a load is above its rounded
    one by nothing and below by 1/256 at most.  Groups of one rounded size fill the shards in order of their id.

    Defined cases: rows with a null group are one group each row's id apart, that is, grouped by id; a null
    or negative size counts 0; groups of size 0 go to the first shard; rows that repeat stay together, with
    their sizes summed; a null id is carried as it is; a very long text only has a large size; an empty table
    gives an empty result; columns of docs are read only by the given expressions.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(group.cast("string"), F.concat(F.lit("id:"), F.col(id_col).cast("string")), F.lit("")).alias("group_id"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("__size"))
    rows = cut(rows)
    groups = cut(rows.groupBy("group_id").agg(size_class(F.sum("__size")).alias("total")))
    hist = sorted((r["total"], r["count"]) for r in groups.groupBy("total").count().collect())
    sizes, counts = (np.array([h[k] for h in hist], np.int64) for k in range(2))
    ends = np.cumsum(schedule(sizes, counts, shards), 1)
    plan = docs.sparkSession.createDataFrame(pa.table({"__total": pa.array(sizes, pa.int64()), "__ends": pa.array(list(ends), pa.list_(pa.int64()))}))
    ranked = ranks(groups, "total", ["group_id"], total=int(counts.sum()))
    placed = ranked.join(F.broadcast(plan), F.col("total") == F.col("__total"))
    placed = placed.select(F.col("group_id").alias("__group"), F.size(F.filter("__ends", lambda e: e <= F.col("rank"))).cast("int").alias("shard"))
    return join_unique(rows, placed, "group_id", "__group", broadcast_bytes=0).select("doc_id", "group_id", "shard")
