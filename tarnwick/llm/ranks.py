"""Ranks within classes that no single task has to sort, and semi-joins that check a size before they broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.session import BROADCAST_BYTES

#: Rows of a class that one task sorts, about.
RANK_ROWS = 1_000_000


def ranks(df: DataFrame, by: str, order: list[str], name: str = "rank", total: int | None = None) -> DataFrame:
    """df with the rank, from 0, of every row among those of the same class.

    Rows go by a hash of the order columns to pieces of a class, are ranked there, and get the number of
    rows in the pieces before; so a class of any size is ranked in parallel.  Rows that are alike in all
    order columns get different ranks in no defined order.
    """
    pieces = max(1, -(-(df.count() if total is None else total) // RANK_ROWS))
    cut = df.withColumn("__piece", F.pmod(F.xxhash64(*order), F.lit(pieces)))
    before = cut.groupBy(F.col(by).alias("__class"), F.col("__piece").alias("__of")).count()
    before = before.withColumn("__before", F.sum("count").over(Window.partitionBy("__class").orderBy("__of")) - F.col("count")).drop("count")
    ranked = cut.withColumn("__rank", F.row_number().over(Window.partitionBy(by, "__piece").orderBy(*order)) - 1)
    joined = ranked.join(before, (F.col(by) == F.col("__class")) & (F.col("__piece") == F.col("__of")))
    return joined.withColumn(name, (F.col("__rank") + F.col("__before")).cast("long")).drop("__piece", "__class", "__of", "__before", "__rank")


def only_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of docs whose id is in ids, a table of one column.  ids is broadcast only if it is small enough."""
    ids = ids.toDF("__kept")
    small = ids.count() * 16 <= broadcast_bytes
    return docs.join(F.broadcast(ids) if small else ids, docs[id_col] == ids["__kept"], "left_semi")


#: A key is hot that has more than one in so many of the rows; so there are no more hot keys than this.
HOT_SHARE = 1000


def join_unique(left: DataFrame, right: DataFrame, key: str, other: str, how: str = "inner", row_bytes: int = 48, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """left joined (inner or left) with right, which has one row for each value of other, where key = other.

    right is broadcast if it is small enough.  Otherwise hot keys of left, of which there are HOT_SHARE at
    most, are joined with a broadcast of their rows in right, and all others by a shuffle.  right is read
    more than once, and left is when right is large.
    """
    if broadcast_bytes and right.count() * row_bytes <= broadcast_bytes:
        return left.join(F.broadcast(right), F.col(key) == F.col(other), how)
    most = max(1, left.count() // HOT_SHARE)
    hot = [r[0] for r in left.groupBy(key).count().where(F.col("count") > most).where(F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return left.join(right, F.col(key) == F.col(other), how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return left.where(is_hot).join(F.broadcast(right.where(F.col(other).isin(hot))), F.col(key) == F.col(other), how).unionByName(left.where(~is_hot).join(right, F.col(key) == F.col(other), how))
