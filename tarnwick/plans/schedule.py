"""When updates become visible: modes, the bounded-staleness clock, and replays of progress reports."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from enum import Enum

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Mode(Enum):
    """BSP: all parts start an iteration from one snapshot.  ASGD: round r works on batch r of every part
    against the newest snapshot.  SSP: a part may read a snapshot up to max_lag iterations old."""

    BSP = "bsp"
    ASGD = "asgd"
    SSP = "ssp"
    SSGD = "ssgd"


class Levels:
    """How many workers there are at each iteration; least is the lowest that has one.  A change takes about logarithmic time."""

    def __init__(self):
        self.n: dict[int, int] = {}
        self.heap: list[int] = []

    def add(self, level: int, n: int = 1) -> None:
        if not self.n.get(level):
            heapq.heappush(self.heap, level)
        self.n[level] = self.n.get(level, 0) + n

    def drop(self, level: int) -> None:
        self.n[level] -= 1
        if not self.n[level]:
            del self.n[level]

    def least(self) -> int:
        while self.heap[0] not in self.n:
            heapq.heappop(self.heap)
        return self.heap[0]


@dataclass
class StalenessClock:
    """Who waits, and who is released, as workers report that they ended an iteration.

    All workers are known from the start, at -1; where it isn't known who they are, their number will do.  A worker
    waits when it is ahead of the slowest by max_lag or more, unless max_lag is 0 and all are level.  A report costs
    about the logarithm of the number of iterations, and a release that of its own: nothing looks at all workers.
    """

    workers: list[int] | int
    max_lag: int
    at: dict[int, int] = field(default_factory=dict)
    waiting: set[int] = field(default_factory=set)

    def __post_init__(self):
        n = self.workers if isinstance(self.workers, int) else len(set(self.workers))
        self._levels, self._held, self._held_levels = Levels(), {}, []
        if n:
            self._levels.add(-1, n)

    def _free(self, level: int, slowest: int) -> bool:
        return level <= slowest or level - slowest < self.max_lag

    def progress(self, worker: int, iteration: int) -> tuple[bool, list[int]]:
        """(whether worker waits, the workers that are released), furthest ahead first."""
        old, before = self.at.get(worker, -1), self._levels.least()
        new = self.at[worker] = max(old, iteration)
        if new != old:
            self._levels.add(new)
            self._levels.drop(old)
        if worker in self.waiting:
            self.waiting.remove(worker)
            self._held[old].remove(worker)
        slowest = self._levels.least()
        if not self._free(new, slowest):
            self.waiting.add(worker)
            if new not in self._held:
                self._held[new] = set()
                heapq.heappush(self._held_levels, new)
            self._held[new].add(worker)
        free: list[int] = []
        if slowest != before:  # else who was held still is
            while self._held_levels and self._free(self._held_levels[0], slowest):
                free[:0] = sorted(self._held.pop(heapq.heappop(self._held_levels)))
            self.waiting.difference_update(free)
        return worker in self.waiting, free


def snapshot_versions(clock: int, max_lag: int, newest: int, policy: str = "freshest") -> int:
    """The snapshot that a part at clock reads: the newest, or with "stalest" the oldest that the bound allows."""
    return newest if policy == "freshest" else max(0, min(newest, clock - max_lag))


def lags(reports: DataFrame, order: list[str], piece: Column) -> DataFrame:
    """Progress reports (worker, iter, ...) with slowest and lag: the least of the latest iterations of all workers that reported so far.

    piece is a whole number that doesn't fall along the order; the pieces of the sequence are worked on in
    parallel, each from the latest iteration of every worker in the pieces before it.  A task reads its rows in
    order, a batch at a time, and holds one number for each worker.
    """
    spark, fields = reports.sparkSession, reports.schema.fieldNames()
    own = reports.withColumn("__p", piece.cast("long"))
    top = own.groupBy(F.col("__p").alias("__q"), F.col("worker").cast("long").alias("worker")).agg(F.max("iter").cast("long").alias("iter"))
    pieces = top.select(F.col("__q").alias("__p")).distinct()
    grid = top.select("worker").distinct().crossJoin(pieces).join(top.withColumnRenamed("__q", "__p"), ["worker", "__p"], "left")
    before = Window.partitionBy("worker").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    start = grid.select("__p", "worker", F.max("iter").over(before).alias("iter")).where("iter is not null")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in reports.schema.fields), "slowest long", "lag long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, latest, levels = None, {}, Levels()
        for b in batches:
            slowest = []
            for p, k, w, i in zip(*(b.column(c).to_pylist() for c in ("__p", "__k", "worker", "iter"))):
                if p != at:
                    at, latest, levels = p, {}, Levels()
                old = latest.get(w)
                if old is None or i > old:
                    latest[w] = i
                    levels.add(i)
                    if old is not None:
                        levels.drop(old)
                if k:
                    slowest.append(levels.least())
            out = b.filter(pc.equal(b.column("__k"), 1)).select(fields)
            low = pa.array(slowest, pa.int64())
            yield pa.RecordBatch.from_arrays([*out.columns, low, pc.subtract(out.column("iter").cast(pa.int64()), low)], [*fields, "slowest", "lag"])

    none = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("worker", "iter") else F.col(f.name).cast(f.dataType) for f in reports.schema.fields]
    rows = own.withColumn("__k", F.lit(1)).unionByName(start.select("__p", *none, F.lit(0).alias("__k")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionById(n, F.pmod("__p", F.lit(n)).cast("int")).sortWithinPartitions("__p", "__k", *order).mapInArrow(run, schema)


def replay(reports: DataFrame, max_lag: int, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """(order, worker, iter, waits, released) of the clock over all reports in the order of some whole numbers.

    The clock is one sequence of events by nature; it gets only these numbers of a report.  Spark sorts them, on disk
    where they don't fit, and the clock's task reads a batch at a time and holds two numbers for each worker.
    """
    one = reports.select(*(F.col(c).cast("long") for c in (*order, "worker", "iter")))
    workers = one.agg(F.countDistinct("worker")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clock = StalenessClock(workers, max_lag)
        for b in batches:
            waits, released, ends = [], [], [0]
            for w, i in zip(b.column("worker").to_pylist(), b.column("iter").to_pylist()):
                wait, free = clock.progress(w, i)
                waits.append(wait)
                released += free
                ends.append(len(released))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(waits, pa.bool_()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(released, pa.int64()))], [*b.schema.names, "waits", "released"])

    schema = ", ".join(f"`{c}` long" for c in (*order, "worker", "iter")) + ", waits boolean, released array<long>"
    return one.repartition(1).sortWithinPartitions(*order).mapInArrow(run, schema)
