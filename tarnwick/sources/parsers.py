"""Text sources and line parsers, as projections over spark.read.text, and the IDX image converter."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): one row for each line."""
    return spark.read.text(path)


def _last_wins(pairs: Column) -> Column:
    """Map of pairs (k, v) in which the last of equal keys stays."""
    n = F.size(pairs)
    later = lambda p, i: F.exists(F.slice(pairs, i + 2, n), lambda q: q["k"] == p["k"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~later(p, i)))


def sparse_rows(lines: DataFrame, label: str = "int", col: str = "value") -> DataFrame:
    """lines with label and features, from "label key:value key:value ..." with single blanks.

    label "int" is read as a whole number, "float" as a number that is truncated.  A bad number raises;
    of a key that comes twice the last value stays.
    """
    parts = F.split(F.col(col), " ")
    first = F.element_at(parts, 1)
    y = first.cast("int") if label == "int" else F.floor(F.abs(first.cast("float"))).cast("int") * F.signum(first.cast("float")).cast("int")
    pairs = F.transform(F.filter(F.slice(parts, 2, F.size(parts)), lambda p: p != ""), lambda p: F.struct(F.split(p, ":")[0].cast("int").alias("k"), F.split(p, ":")[1].cast("double").alias("v")))
    return lines.withColumn("label", y).withColumn("features", _last_wins(pairs)).drop(col)


def dense_rows(lines: DataFrame, classes: int, col: str = "value") -> DataFrame:
    """lines with features and label_vec, from "p0 p1 ... label": zeros are dropped, the label is one-hot."""
    parts = F.transform(F.split(F.col(col), " "), lambda p: p.cast("double"))
    width = F.size(parts) - 1
    pairs = F.transform(F.slice(parts, 1, width), lambda v, i: F.struct(i.cast("long").alias("k"), v.alias("v")))
    label = F.element_at(parts, -1).cast("int")
    one = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == label).cast("double"))
    return lines.withColumn("features", F.map_from_entries(F.filter(pairs, lambda p: p["v"] != 0))).withColumn("label_vec", one).drop(col)


def ratings(lines: DataFrame, col: str = "value") -> DataFrame:
    """(uid, pid, rating) from "uid,pid,rating", with ids from 1 made ids from 0."""
    p = F.split(F.col(col), ",")
    return lines.select((p[0].cast("int") - 1).alias("uid"), (p[1].cast("int") - 1).alias("pid"), p[2].cast("double").alias("rating"))


def idx_lines(images: bytes, labels: bytes) -> list[str]:
    """"p p ... label" lines of an IDX pair; a wrong magic number or count raises ValueError."""
    magic, n, rows, cols = struct.unpack(">iiii", images[:16])
    label_magic, m = struct.unpack(">ii", labels[:8])
    if magic != 2051 or label_magic != 2049:
        raise ValueError("not an IDX image and label pair")
    if n != m:
        raise ValueError(f"{n} images, but {m} labels")
    x = np.frombuffer(images, np.uint8, n * rows * cols, 16).reshape(n, -1)
    y = np.frombuffer(labels, np.uint8, n, 8)
    return [" ".join(map(str, [*a, b])) for a, b in zip(x.tolist(), y.tolist())]


def idx_images(spark: SparkSession, images: str, labels: str) -> DataFrame:
    """(value): the lines of idx_lines, from one pair of files read by an executor."""
    pair = spark.read.format("binaryFile").load(images).select(F.col("content").alias("x")).crossJoin(spark.read.format("binaryFile").load(labels).select(F.col("content").alias("y")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x, y in zip(b["x"], b["y"]):
                yield pd.DataFrame({"value": idx_lines(bytes(x), bytes(y))})

    return pair.mapInPandas(run, "value string")
