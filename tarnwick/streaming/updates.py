"""Parameter tables fed by a stream of deltas with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnwick.operators.params import ParamTable


def pushed_totals(deltas: DataFrame) -> DataFrame:
    """(key, value): running sums of a stream of (key, value) deltas, for output mode "update" or "complete"."""
    return deltas.groupBy("key").agg(F.sum("value").alias("value"))


def current(table: ParamTable, totals: DataFrame) -> ParamTable:
    """The table with the running totals of a stream added."""
    return table.push(totals)


def write_snapshots(deltas: DataFrame, table: ParamTable, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes the whole table after each micro-batch of deltas to path/batch=N.

    A batch that is run again overwrites its own snapshot and starts from the stream's own state, so no
    delta counts twice.
    """

    def write(totals: DataFrame, batch: int) -> None:
        current(table, totals).df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return pushed_totals(deltas).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def windowed_rates(events: DataFrame, time: str = "ts", key: str = "worker", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, end, key, reports) of progress events in event-time windows; later ones than late are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), F.col(key)).agg(F.count("*").alias("reports")).select("window.start", "window.end", key, "reports")
