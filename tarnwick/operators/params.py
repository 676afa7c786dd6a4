"""Parameter tables and models: keyed tables that are read by key set and updated by adding deltas.

A table is an immutable DataFrame with a key column; every update gives a new table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions import columns as C
from tarnwick.operators.keys import KeySet, hash_part, linear_part

SCALARS = {"int", "long", "float", "double"}


@dataclass(frozen=True)
class ParamTable:
    """rows keys from 0; cols is 0 for one value by key, else the width of values.

    A table of one value has the columns (key, value); a wide one has (key, values), and with AdaGrad state
    also alphas and deltas.
    """

    df: DataFrame
    rows: int
    cols: int = 0
    value_type: str = "double"
    key_type: str = "long"
    adagrad: dict | None = None
    partitioning: str = "linear"

    # -- making one

    @classmethod
    def create(cls, spark: SparkSession, rows: int, cols: int = 0, value_type: str = "double", key_type: str = "long", partitioning: str = "linear") -> ParamTable:
        """All keys at zero."""
        if value_type not in SCALARS or key_type not in ("int", "long"):
            raise ValueError(f"no table of {key_type} keys and {value_type} values")
        zero = F.lit(0).cast(value_type)
        keys = spark.range(rows).select(F.col("id").cast(key_type).alias("key"))
        df = keys.withColumn("values", F.array_repeat(zero, cols)) if cols else keys.withColumn("value", zero)
        return cls(df, rows, cols, value_type, key_type, partitioning=partitioning)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def column(self) -> str:
        return "values" if self.cols else "value"

    def with_df(self, df: DataFrame) -> ParamTable:
        return replace(self, df=df)

    # -- reading

    def fetch(self, keys: KeySet | DataFrame, strict: bool = False) -> DataFrame:
        """Rows of the given keys: a filter for a key set, a semi-join for a DataFrame of keys.

        Keys outside the table are left out; with strict they raise when the rows are read.
        """
        if isinstance(keys, KeySet):
            return self.df.where(keys.column(F.col("key")))
        wanted = keys.select(F.col(keys.columns[0]).cast(self.key_type).alias("key")).distinct()
        if not strict:
            return self.df.join(wanted, "key", "left_semi")
        found = wanted.join(self.df.withColumn("__there", F.lit(True)), "key", "left")
        return found.where(F.coalesce("__there", F.raise_error(F.concat(F.lit("no key "), F.col("key").cast("string"))).cast("boolean"))).drop("__there")

    def fetch_columns(self, keys: KeySet, first: int, last: int) -> DataFrame:
        """(key, values) with the columns first to last alone."""
        return self.fetch(keys).select("key", F.slice("values", first + 1, last - first + 1).alias("values"))

    def collect(self) -> DataFrame:
        return self.df.select("key", self.column)

    # -- updating

    def push(self, delta: DataFrame, guarded: bool = False) -> ParamTable:
        """Adds delta, with the columns (key, value) or (key, values), to the rows of its keys.

        A key may come any number of times; deltas of one key are summed first, on the map side where they
        are.  Keys outside the table are ignored.  guarded: a result below 0 raises when the table is read.
        """
        if not self.cols:
            total = delta.groupBy(F.col("key").cast(self.key_type).alias("key")).agg(F.sum("value").alias("__d"))
            value = (F.col("value") + F.coalesce(F.col("__d"), F.lit(0))).cast(self.value_type)
            if guarded:
                value = F.when(value >= 0, value).otherwise(F.raise_error(F.concat(F.lit("counter below zero at key "), F.col("key").cast("string"))).cast(self.value_type))
            return self.with_df(self.df.join(total, "key", "left").select("key", value.alias("value")))
        cells = delta.select("key", F.posexplode("values").alias("col", "value")) if "values" in delta.columns else delta
        return self.push_cells(cells, guarded)

    def push_cells(self, cells: DataFrame, guarded: bool = False) -> ParamTable:
        """Adds (key, col, value) cells to a wide table; columns that aren't listed stay."""
        total = cells.groupBy(F.col("key").cast(self.key_type).alias("key"), "col").agg(F.sum("value").alias("v"))
        rows = total.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("int"), "v"))).alias("__d"))
        own = self.df.join(rows, "key", "left")

        def cell(v, i):
            out = (v + F.coalesce(F.element_at("__d", i), F.lit(0))).cast(self.value_type)
            return F.when(out >= 0, out).otherwise(F.raise_error(F.lit("counter below zero")).cast(self.value_type)) if guarded else out

        values = F.when(F.col("__d").isNull(), F.col("values")).otherwise(F.transform("values", cell))
        return self.with_df(own.withColumn("values", values).drop("__d"))

    def set_alpha(self, alpha: float, least: float, factor: float) -> ParamTable:
        """Gives a wide table AdaGrad state: learning rates at alpha and no squared updates yet."""
        if not self.cols:
            raise ValueError("only a wide table has learning rates")
        t = self.value_type
        df = self.df.select("key", "values", F.array_repeat(F.lit(alpha).cast(t), self.cols).alias("alphas"), F.array_repeat(F.lit(0).cast(t), self.cols).alias("deltas"))
        return replace(self, df=df, adagrad={"alpha": alpha, "least": least, "factor": factor})

    def push_adagrad(self, delta: DataFrame) -> ParamTable:
        """Adds updates (key, values) or cells (key, col, value), their squares to deltas, and sets the rates.

        A rate follows from the final sum of squares only, so one summed push equals many.
        """
        if self.adagrad is None:
            raise ValueError("set_alpha comes first")
        cells = delta.select("key", F.posexplode("values").alias("col", "value")) if "values" in delta.columns else delta
        total = cells.groupBy("key", "col").agg(F.sum("value").alias("u"), F.sum(F.col("value") * F.col("value")).alias("s"))
        rows = total.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("int"), F.struct("u", "s")))).alias("__d"))
        own, t = self.df.join(rows, "key", "left"), self.value_type
        get = lambda i, f: F.coalesce(F.element_at("__d", i)[f], F.lit(0.0))
        known = F.col("__d").isNotNull()
        own = own.withColumn("values", F.when(known, F.transform("values", lambda v, i: (v + get(i, "u")).cast(t))).otherwise(F.col("values")))
        own = own.withColumn("deltas", F.when(known, F.transform("deltas", lambda v, i: (v + get(i, "s")).cast(t))).otherwise(F.col("deltas")))
        rate = F.zip_with("alphas", "deltas", lambda a, d: adagrad_rate(a, d, self.adagrad["alpha"], self.adagrad["least"], self.adagrad["factor"]).cast(t))
        return self.with_df(own.withColumn("alphas", F.when(known, rate).otherwise(F.col("alphas"))).drop("__d"))

    def zero(self) -> ParamTable:
        return self.init(0)

    def init(self, value) -> ParamTable:
        v = F.lit(value).cast(self.value_type)
        return self.with_df(self.df.withColumn(self.column, F.array_repeat(v, self.cols) if self.cols else v))

    def randomise(self, spread: float | None = None) -> ParamTable:
        """Deterministic values around 0 from key and column, within spread (1 / cols by default)."""
        spread = 1.0 / max(1, self.cols) if spread is None else spread
        if self.cols:
            row = F.transform(F.sequence(F.lit(0), F.lit(self.cols - 1)), lambda c: C.initial(F.col("key"), c, spread).cast(self.value_type))
            return self.with_df(self.df.withColumn("values", row))
        return self.with_df(self.df.withColumn("value", C.initial(F.col("key"), 0, spread).cast(self.value_type)))

    # -- layout and functions

    def partitioned(self, n: int) -> DataFrame:
        """df with part_id, by contiguous ranges of keys or by remainder."""
        key = F.col("key")
        return self.df.withColumn("part_id", linear_part(key, 0, self.rows - 1, n) if self.partitioning == "linear" else hash_part(key, n))

    def apply_by_part(self, n: int, f: Callable[[int, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        """f(part, rows) on every part of the table: the hook for user code beside the data."""

        def run(key, pdf):
            return f(int(key[0]), pdf.drop(columns="part_id"))

        return self.partitioned(n).groupBy("part_id").applyInPandas(run, schema)

    def iterate(self) -> Iterator[tuple]:
        """Rows one by one, one partition at a time."""
        return ((r["key"], r[self.column]) for r in self.collect().toLocalIterator())


def adagrad_rate(alpha: Column, delta: Column, start: float, least: float, factor: float) -> Column:
    """The learning rate after a sum of squares delta: it shrinks only once delta is above 1."""
    return F.when(delta > 1, F.greatest(F.lit(float(start)) / (F.lit(float(factor)) * F.sqrt(delta)), F.lit(float(least)))).otherwise(alpha)


class Model:
    """A catalogue of named tables, with comments; saved as one folder with a table of what it holds."""

    def __init__(self, comments: dict[str, str] | None = None):
        self.tables: dict[str, ParamTable] = {}
        self.comments = dict(comments or {})

    def register(self, name: str, table: ParamTable) -> ParamTable:
        if name in self.tables:
            raise ValueError(f"there is a table named {name}")
        self.tables[name] = table
        return table

    def __getitem__(self, name: str) -> ParamTable:
        return self.tables[name]

    def __setitem__(self, name: str, table: ParamTable) -> None:
        if name not in self.tables:
            raise KeyError(name)
        self.tables[name] = table

    def save(self, path: str) -> None:
        meta = []
        for name, t in self.tables.items():
            t.df.write.mode("overwrite").parquet(f"{path}/{name}")
            meta.append((name, t.rows, t.cols, t.value_type, t.key_type, t.partitioning, json.dumps(t.adagrad), json.dumps(self.comments)))
        spark = next(iter(self.tables.values())).spark
        spark.createDataFrame(meta, "name string, rows long, cols int, value_type string, key_type string, partitioning string, adagrad string, comments string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        out = cls()
        for r in spark.read.parquet(f"{path}/_model").collect():
            out.comments = json.loads(r["comments"])
            out.register(r["name"], ParamTable(spark.read.parquet(f"{path}/{r['name']}"), r["rows"], r["cols"], r["value_type"], r["key_type"], json.loads(r["adagrad"]), r["partitioning"]))
        return out
