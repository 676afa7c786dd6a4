"""Scalar, array and text functions as Spark columns, all built of JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLAMP = 1e-15


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def table_sigmoid(x: Column) -> Column:
    """Sigmoid from a table of 1000 entries over [-6, 6] whose index steps by whole 83rds; null outside, where no update is made."""
    at = F.floor((x + 6.0) * 83.0)
    return F.when((x > -6.0) & (x < 6.0), sigmoid((at / 1000.0 * 2.0 - 1.0) * 6.0))


def log_loss(label: Column, h: Column, clamp: float = CLAMP) -> Column:
    """y ln h + (1 - y) ln(1 - h), with h kept off 0 and 1."""
    p = F.least(F.greatest(h, F.lit(clamp)), F.lit(1.0 - clamp))
    return F.when(label == 1, F.log(p)).otherwise(F.log(1.0 - p))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm_squared(a: Column) -> Column:
    return dot(a, a)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda x: x * by)


def axpy(alpha: Column | float, x: Column, y: Column) -> Column:
    """y + alpha x"""
    return F.zip_with(x, y, lambda u, v: v + u * alpha)


def scaled_axpy(alpha: Column | float, x: Column, rates: Column, y: Column) -> Column:
    """y + alpha x rate, element by element."""
    step = F.zip_with(x, rates, lambda u, r: u * r)
    return axpy(alpha, step, y)


def softmax(x: Column) -> Column:
    """Probabilities, from exponents shifted by the maximum; null for an empty array."""
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.when(F.size(x) > 0, F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, w: s + w)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a or b is as good as zero."""
    aa, bb = norm_squared(a), norm_squared(b)
    return F.when((aa < 1e-105) | (bb < 1e-9), F.lit(0.0)).otherwise(dot(a, b) / F.sqrt(aa) / F.sqrt(bb))


def sparse_dot(features: Column, weights: Column) -> Column:
    """Sum over the keys of the map features of value times weight; a missing weight is 0."""
    return F.aggregate(F.map_entries(features), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.element_at(weights, e["key"]), F.lit(0.0)))


def is_zero(v: Column, kind: str = "double") -> Column:
    """Near zero for floating values (below 1e-5), exactly zero for whole ones."""
    return v == 0 if kind in ("int", "long") else F.abs(v) < 1e-5


def has_change(delta: Column) -> Column:
    """Whether any element of a delta is at least 1e-7 in size."""
    return F.exists(delta, lambda x: F.abs(x) >= 1e-7)


def initial(key: Column, col: Column | int = 0, spread: float = 1.0) -> Column:
    """A deterministic value in [-spread / 2, spread / 2) from whole arithmetic on key and column."""
    k, c = key.cast("long"), F.lit(col).cast("long") if isinstance(col, int) else col.cast("long")
    return (((k * 7919 + c * 104729) % 1000) / F.lit(1000.0) - 0.5) * spread


def clean_topic_token(t: Column) -> Column:
    """All but ASCII letters and the caret to blanks, trimmed, in lower case; inner blanks stay."""
    return F.lower(F.trim(F.regexp_replace(t, "[^A-Z^a-z]", " ")))


def clean_embedding_token(t: Column) -> Column:
    """Only ASCII letters and blanks stay, in lower case."""
    return F.lower(F.regexp_replace(t, "[^a-zA-Z ]", ""))


def embedding_words(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, " "), clean_embedding_token), lambda w: w != "")


def topic_words(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, " "), clean_topic_token), lambda w: w != "")


def not_blank(line: Column, trim: bool = True) -> Column:
    return F.length(F.trim(line) if trim else line) > 0


def packed_outer(x: Column) -> Column:
    """Lower triangle of x x', row by row, as one array."""
    n = F.size(x)
    return F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), i), lambda j: F.element_at(x, i) * F.element_at(x, j))))


def one_hot(label: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i == label).cast("double"))


def to_sparse(values: Column) -> Column:
    """(col, value) of the elements of a dense row that aren't 0."""
    pairs = F.transform(values, lambda v, i: F.struct(i.alias("col"), v.alias("value")))
    return F.filter(pairs, lambda p: p["value"] != 0)


def to_dense(pairs: Column, width: int) -> Column:
    """The dense row of (col, value) pairs; columns without a pair are 0."""
    by = F.map_from_entries(pairs)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at(by, i), F.lit(0.0)))
