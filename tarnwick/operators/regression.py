"""Sparse logistic and softmax regression by sequential steps of gradient descent inside parts."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.functions.kernels import sigmoid, softmax
from tarnwick.operators.params import ParamTable
from tarnwick.operators.training import Trained, train
from tarnwick.plans.schedule import Mode

_CLAMP = 1e-15


def as_samples(features: DataFrame, labels: DataFrame) -> DataFrame:
    """(sample_id, label, keys, vals) from (sample_id, key, value) rows and (sample_id, label); samples without features keep empty arrays."""
    rows = features.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct(F.col("key").cast("long").alias("key"), F.col("value").cast("double").alias("value")))).alias("__f"))
    own = labels.select("sample_id", "label").join(rows, "sample_id", "left")
    none = F.array().cast("array<struct<key:bigint,value:double>>")
    own = own.withColumn("__f", F.coalesce("__f", none))
    return own.select("sample_id", "label", F.col("__f.key").alias("keys"), F.col("__f.value").alias("vals"))


def from_map(rows: DataFrame, label: str = "label") -> DataFrame:
    """(sample_id, label, keys, vals) from rows with a map column features."""
    return rows.select("sample_id", F.col(label).alias("label"), F.map_keys("features").cast("array<bigint>").alias("keys"), F.map_values("features").cast("array<double>").alias("vals"))


def logistic_pass(w: np.ndarray, index: list[np.ndarray], value: list[np.ndarray], y: np.ndarray, eta: float) -> float:
    """One step for each sample in turn, on w itself; the summed cost, each term by the weights of its moment."""
    cost = 0.0
    for i, x, label in zip(index, value, y):
        h = sigmoid(float(w[i] @ x))
        p = min(max(h, _CLAMP), 1 - _CLAMP)
        cost -= np.log(p) if label == 1 else np.log1p(-p)
        w[i] -= eta * (h - label) * x
    return float(cost)


def softmax_pass(w: np.ndarray, index: list[np.ndarray], value: list[np.ndarray], y: np.ndarray, rate: float) -> float:
    """The same for classes: w is [key, class], y the class of each sample, and the step an ascent."""
    cost = 0.0
    for i, x, label in zip(index, value, y):
        p = softmax(x @ w[i])
        cost -= np.log(max(p[int(label)], _CLAMP))
        g = -p
        g[int(label)] += 1
        w[i] += rate * x[:, None] * g
    return float(cost)


def fit_logistic(samples: DataFrame, *, dim: int, eta: float = 1e-4, iterations: int = 100, parts: int = 8, mode: Mode = Mode.ASGD, batch_size: int = 100, max_lag: int = 2, policy: str = "freshest", init: ParamTable | None = None) -> Trained:
    """Weights of keys 0 to dim, at zero or from init, after iterations passes; see training.train for the modes."""
    table = init or ParamTable.create(samples.sparkSession, dim + 1)
    return train(samples, table, partial(logistic_pass, eta=eta), mode=mode, iterations=iterations, parts=parts, batch_size=batch_size, max_lag=max_lag, policy=policy)


def fit_softmax(samples: DataFrame, *, dim: int, classes: int, rate: float = 0.1, iterations: int = 500, parts: int = 8, mode: Mode = Mode.ASGD, batch_size: int = 100, one_more: bool = False, init: ParamTable | None = None) -> Trained:
    """Weights [key, class]; one_more makes iterations + 1 passes."""
    table = init or ParamTable.create(samples.sparkSession, dim, classes)
    return train(samples, table, partial(softmax_pass, rate=rate), mode=mode, iterations=iterations + one_more, parts=parts, batch_size=batch_size)
