"""Mixing sources to target weights by balanced sampling with the cube method.

Every document of a source gets the inclusion probability that brings the source to its target.  The
flight phase moves the probabilities of a few documents at a time along a vector in the null-space of
their balancing constraints (documents and tokens of the source), until one of them is 0 or 1; so the
sums that are balanced don't change.  It runs on blocks of documents in parallel, again on what each
block left undecided, and at last on one small table by source, where the landing phase decides the
rest with one constraint less at a time.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm import textkernel as tk
from tarnwick.llm.ranks import join_unique
from tarnwick.llm.session import cut

#: Documents that one flight takes, about.
BLOCK = 50_000
#: The default budget, as a share of all tokens of the sources that are drawn from.
BUDGET_SHARE = 1.0
_EPS = 1e-9


def null_vector(a: np.ndarray) -> np.ndarray:
    """A vector u != 0 with a @ u = 0, for a with fewer rows than columns."""
    if a.shape == (2, 3):
        u = np.array([a[0, 1] * a[1, 2] - a[0, 2] * a[1, 1], a[0, 2] * a[1, 0] - a[0, 0] * a[1, 2], a[0, 0] * a[1, 1] - a[0, 1] * a[1, 0]])
        if np.abs(u).max() > 1e-9 * max(1.0, np.abs(a).max()):
            return u / np.abs(u).max()
    return np.linalg.svd(a)[2][-1]


def flight(pi: np.ndarray, a: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """Moves probabilities pi, with constraints a [constraint, unit], until at most as many are undecided as there are constraints.

    a @ pi stays as it is, and so does the expectation of every probability.  Units are taken in order.
    """
    pi = pi.astype(float).copy()
    pi[pi < _EPS], pi[pi > 1 - _EPS] = 0, 1
    free = np.flatnonzero((pi > 0) & (pi < 1))
    width = a.shape[0] + 1
    own, at = list(free[:width]), width
    draws = r.random(len(free) + width)
    k = 0
    while len(own) == width:
        u = null_vector(a[:, own])
        p = pi[own]
        some = np.abs(u) > 1e-12
        up = np.min(np.where(u[some] > 0, (1 - p[some]) / u[some], -p[some] / u[some]))
        down = np.min(np.where(u[some] > 0, p[some] / u[some], (p[some] - 1) / u[some]))
        p = p + up * u if draws[k] * (up + down) < down else p - down * u
        k += 1
        p = np.where(p < _EPS, 0, np.where(p > 1 - _EPS, 1, p))
        pi[own] = p
        own = [i for i, x in zip(own, p) if 0 < x < 1]
        while len(own) < width and at < len(free):
            own.append(free[at])
            at += 1
    return pi


def flight_two(pi: np.ndarray, size: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """flight() for the constraints (1, size), in plain numbers: three units at a time, whose null vector is a cross product."""
    pi = [0.0 if x < _EPS else 1.0 if x > 1 - _EPS else float(x) for x in pi]
    size = [float(x) for x in size]
    free = [i for i, x in enumerate(pi) if 0 < x < 1]
    draws = r.random(len(free) + 3).tolist()
    own, at, k = free[:3], 3, 0
    while len(own) == 3:
        i, j, m = own
        u = [size[m] - size[j], size[i] - size[m], size[j] - size[i]]
        if not any(u):
            u = [1.0, -1.0, 0.0]
        up = down = float("inf")
        for c, x in zip(u, own):
            if c > 0:
                up, down = min(up, (1 - pi[x]) / c), min(down, pi[x] / c)
            elif c < 0:
                up, down = min(up, -pi[x] / c), min(down, (pi[x] - 1) / c)
        step = up if draws[k] * (up + down) < down else -down
        k += 1
        left = []
        for c, x in zip(u, own):
            p = pi[x] + step * c
            p = 0.0 if p < _EPS else 1.0 if p > 1 - _EPS else p
            pi[x] = p
            if 0 < p < 1:
                left.append(x)
        own = left
        while len(own) < 3 and at < len(free):
            own.append(free[at])
            at += 1
    return np.array(pi)


def landing(pi: np.ndarray, a: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """Decides what flight left, dropping the last constraint again and again."""
    for rows in range(a.shape[0] - 1, -1, -1):
        pi = flight(pi, a[:rows], r) if rows else np.where((pi > 0) & (pi < 1), r.random(len(pi)) < pi, pi).astype(float)
    return pi


def _seeded(seed: int, *key) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[seed, int.from_bytes(hashlib.blake2b(str(key).encode(), digest_size=8).digest(), "little")]))


def _flight_of(seed: int, level: int, land: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        r = _seeded(seed, level, int(pdf["id"].iloc[0]), len(pdf))
        pi = flight_two(pdf["pi"].to_numpy(), pdf["tokens"].to_numpy(), r)
        if land:
            pi = landing(pi, np.stack([np.ones(len(pdf)), pdf["tokens"].to_numpy(float)]), r)
        return pdf.assign(pi=pi)[["id", "src", "tokens", "pi"]]

    return run


def with_tokens(docs: DataFrame, text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """docs with the number of whitespace-separated tokens of every text, 0 for a null; an earlier column of the name is replaced."""

    def run(col: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0, np.int64), *(tk.token_counts(part) for _, part in tk.slices(col))]))

    return docs.withColumn(name, F.arrow_udf(run, "long")(F.col(text_col)))


def sample(docs: DataFrame, *, weights: dict[str, float] | None = None, alpha: float = 0.5, budget: float | None = None, seed: int = 17, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, n_tokens) of a balanced sample in which sources have the target weights by tokens.

    weights: shares by source, which need not sum to 1; by default in proportion to tokens ** alpha, where
    alpha = 1 keeps the mixture and 0 makes all sources alike.
    budget: tokens to draw; by default BUDGET_SHARE, all, of the tokens of the sources that have a weight.
    A source with too few tokens for its share comes whole, and the others' draws don't depend on it, so
    that less than the budget is drawn; one with weight 0, or not named, comes not at all.
    block: documents that one flight takes, at least 8.  The draw depends on it as on the seed, but not what
    is balanced: in every source the sample's documents and tokens differ from their expectation by less
    than the landing's two documents, however many blocks there are.

    Defined cases: rows that repeat an id are one unit with their tokens summed; rows with a null id are
    never drawn; a null source counts as one named ""; a null text has no tokens but may be drawn, as an
    empty one, and so may others of equal length, which are alike to the draw; a very long text is one
    unit; an empty table gives an empty sample; other columns, whatever their names, are not read.
    """
    if block < 8:
        raise ValueError("a block of less than 8 documents may leave as many undecided as it takes")
    units = with_tokens(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("src"), F.col(text_col).alias("text")).where("id is not null"))
    units = cut(units.groupBy("id").agg(F.min("src").alias("src"), F.sum("n_tokens").alias("tokens")))
    by = cut(units.groupBy(F.col("src").alias("s")).agg(F.sum("tokens").alias("total"), F.count("*").alias("n")))
    if weights is None:
        share = F.when(F.col("total") > 0, F.pow(F.col("total").cast("double"), F.lit(float(alpha)))).otherwise(0.0)
        by = by.withColumn("share", share)
    else:
        given = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items() if w > 0], "named string, share double")
        by = by.join(given, F.col("s") == F.col("named"), "left").select("s", "total", "n", F.coalesce("share", F.lit(0.0)).alias("share"))
    whole = by.agg(F.sum(F.when(F.col("total") > 0, F.col("share"))).alias("share"), F.sum(F.when(F.col("share") > 0, F.col("total"))).alias("tokens"), F.max("n").alias("most")).first()
    scale, draw = whole["share"] or 1.0, BUDGET_SHARE * (whole["tokens"] or 0) if budget is None else budget
    pi = F.when(F.col("total") > 0, F.least(F.lit(1.0), F.lit(float(draw)) * F.col("share") / F.lit(float(scale)) / F.col("total"))).otherwise(float(weights is None))
    plan = cut(by.select("s", pi.alias("pi"), F.ceil(F.col("n") / block).alias("blocks")))
    left = join_unique(units, plan, "src", "s").select("id", "src", "tokens", "pi", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
    schema, level, decided = "id long, src string, tokens long, pi double", 0, []
    most = whole["most"] or 0
    while most > block:  # each block leaves at most two documents undecided
        done = cut(left.groupBy("src", "block").applyInPandas(_flight_of(seed, level, False), schema))
        decided.append(done.where("pi = 1"))
        undecided = done.where("pi > 0 and pi < 1")
        most = undecided.groupBy("src").count().agg(F.max("count")).first()[0] or 0
        level += 1
        left = undecided.withColumn("block", F.pmod(F.xxhash64("id", F.lit(level)), F.lit(max(1, -(-most // block)))))
    done = left.groupBy("src").applyInPandas(_flight_of(seed, level, True), schema)
    decided.append(done.where("pi = 1"))
    out = decided[0]
    for d in decided[1:]:
        out = out.union(d)
    return out.select(F.col("id").alias("doc_id"), F.col("src").alias("source"), F.col("tokens").alias("n_tokens"))
