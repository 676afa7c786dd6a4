import math
import time

import numpy as np
import pytest

from tarnwick.operators import embed, recommend, regression, topics
from tarnwick.operators.params import ParamTable
from tarnwick.plans.schedule import Mode, StalenessClock, lags, snapshot_versions

ROWS = [(i, i % 2, [i % 3, 3 + i % 4], [1.0, 0.5 + i % 2]) for i in range(23)]
SCHEMA = "sample_id long, label int, keys array<long>, vals array<double>"


def golden(rounds_of, iterations, eta=0.3):
    """Plain dictionaries: each round's parts start from the same weights, and deltas are summed."""
    w, costs = {k: 0.0 for k in range(8)}, []
    for _ in range(iterations):
        cost = 0.0
        for parts in rounds_of:
            delta = dict.fromkeys(w, 0.0)
            for part in parts:
                own = dict(w)
                for _, y, keys, vals in part:
                    h = 1 / (1 + math.exp(-sum(own[k] * v for k, v in zip(keys, vals))))
                    cost -= math.log(h if y else 1 - h)
                    for k, v in zip(keys, vals):
                        own[k] -= eta * (h - y) * v
                for k in own:
                    delta[k] += own[k] - w[k]
            w = {k: w[k] + delta[k] for k in w}
        costs.append(cost / len(ROWS))
    return w, costs


def parted(n, batch=None):
    parts = [[r for r in ROWS if r[0] % n == p] for p in range(n)]
    if batch is None:
        return [parts]
    return [[p[a : a + batch] for p in parts if p[a:]] for a in range(0, max(map(len, parts)), batch)]


@pytest.mark.parametrize(("mode", "batch"), [(Mode.BSP, None), (Mode.ASGD, 3)])
def test_logistic_matches_plain_python(spark, mode, batch):
    fit = regression.fit_logistic(spark.createDataFrame(ROWS, SCHEMA), dim=7, eta=0.3, iterations=2, parts=3, mode=mode, batch_size=batch or 1)
    w, costs = golden(parted(3, batch), 2)
    assert {r["key"]: r["value"] for r in fit.table.df.collect()} == pytest.approx(w)
    assert fit.costs == pytest.approx(costs) and costs[1] < costs[0]


def test_warm_start_and_staleness(spark):
    data = spark.createDataFrame(ROWS, SCHEMA)
    once = regression.fit_logistic(data, dim=7, eta=0.3, iterations=1, parts=3, mode=Mode.BSP)
    twice = regression.fit_logistic(data, dim=7, eta=0.3, iterations=1, parts=3, mode=Mode.BSP, init=once.table)
    assert {r["key"]: r["value"] for r in twice.table.df.collect()} == pytest.approx(golden(parted(3), 2)[0])
    stale = regression.fit_logistic(data, dim=7, eta=0.3, iterations=2, parts=3, mode=Mode.SSP, max_lag=1, policy="stalest")
    assert {r["key"]: r["value"] for r in stale.table.df.collect()} == pytest.approx({k: 2 * v for k, v in golden(parted(3), 1)[0].items()})
    assert [snapshot_versions(c, 2, c, "stalest") for c in range(5)] == [0, 0, 0, 1, 2]


def test_empty_samples(spark):
    fit = regression.fit_logistic(spark.createDataFrame([], SCHEMA), dim=3, iterations=1, parts=2, mode=Mode.BSP)
    assert fit.costs == [0.0] and {r["value"] for r in fit.table.df.collect()} == {0.0}


def test_softmax_learns(spark):
    rows = [(i, i % 3, [i % 3, 3], [1.0, 1.0]) for i in range(30)]
    fit = regression.fit_softmax(spark.createDataFrame(rows, SCHEMA), dim=4, classes=3, iterations=3, parts=2, batch_size=20)
    assert fit.costs[0] > fit.costs[-1]
    one = regression.fit_softmax(spark.createDataFrame(rows[:1], SCHEMA), dim=4, classes=3, iterations=1, parts=1, mode=Mode.BSP)
    got = {r["key"]: r["values"] for r in one.table.df.collect()}
    assert got[0] == pytest.approx([0.1 * 2 / 3, -0.1 / 3, -0.1 / 3])


def test_topic_sweep_keeps_counts_and_finds_topics():
    r = np.random.default_rng(0)
    p = topics.Params(k=2, alpha=0.1, beta=0.1)
    doc = np.repeat(np.arange(30), 12)
    word = np.where(doc % 2 == 0, r.integers(0, 3, len(doc)), r.integers(3, 6, len(doc)))
    topic = r.integers(0, 2, len(doc))
    for _ in range(60):
        nkw = np.zeros((6, 2), np.int64)
        np.add.at(nkw, (word, topic), 1)
        nk = nkw.sum(0)
        topic = topics.sweep(doc, word, topic, nkw, nk, p, 6, r)
        again = np.zeros((6, 2), np.int64)
        np.add.at(again, (word, topic), 1)
        assert (again == nkw).all() and (nk == nkw.sum(0)).all()
    top = nkw.argmax(1)
    assert len({*top[:3]}) == 1 and len({*top[3:]}) == 1 and top[0] != top[3]


def test_sampler_follows_the_exact_posterior():
    """One document of three tokens: long-run frequencies against the enumerated posterior."""
    p, words = topics.Params(k=2, alpha=0.5, beta=0.5, cycles=2), 3
    doc, word = np.zeros(3, np.int64), np.array([0, 0, 1])

    def weight(z):
        ndk, nkw = np.bincount(z, minlength=2), np.zeros((3, 2))
        np.add.at(nkw, (word, z), 1)
        lg = np.vectorize(math.lgamma)
        return math.exp(lg(ndk + p.alpha).sum() + lg(nkw + p.beta).sum() - lg(nkw.sum(0) + words * p.beta).sum())

    states = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    exact = np.array([weight(np.array(s)) for s in states])
    exact /= exact.sum()
    r, z, seen = np.random.default_rng(1), np.array([0, 1, 0]), np.zeros(8)
    for _ in range(20_000):
        nkw = np.zeros((3, 2), np.int64)
        np.add.at(nkw, (word, z), 1)
        z = topics.sweep(doc, word, z, nkw, nkw.sum(0), p, words, r)
        seen[z @ [4, 2, 1]] += 1
    assert np.abs(seen / seen.sum() - exact).sum() / 2 < 0.03


def test_topic_training_in_spark(spark):
    rows = [(d, i, (d % 2) * 3 + (i * 7 + d) % 3) for d in range(20) for i in range(10)]
    tokens = topics.assign_topics(spark.createDataFrame(rows, "doc_id long, pos long, word_id int"), 2)
    model = topics.train(tokens, 6, topics.Params(k=2, alpha=0.1, beta=0.1, iterations=2, parts=3))
    assert model.tokens.count() == 200 and len(model.perplexities) == 2
    bad = topics.mismatches(model.tokens, topics.topic_counts(tokens), topics.word_topic_counts(model.tokens), topics.doc_topic_counts(model.tokens)).first()
    assert bad["word_diffs"] == 0
    counts = {r["doc_id"]: sum(r["counts"]) for r in topics.infer(model, tokens.union(spark.createDataFrame([(99, 0, 77, 0)], topics.TOKENS).select(tokens.columns)), sweeps=3).collect()}
    assert counts == dict.fromkeys(range(20), 10)


@pytest.mark.parametrize("cbow", [True, False])
def test_embedding_steps_lower_the_loss(cbow):
    r = np.random.default_rng(0)
    syn0, syn1 = r.normal(size=(5, 4)).astype(np.float32) * 0.3, r.normal(size=(3, 4)).astype(np.float32) * 0.3
    a0, a1 = np.full((5, 4), 0.1, np.float32), np.full((3, 4), 0.1, np.float32)
    context, code, nodes = np.array([0, 1, 1]), np.array([0, 1], np.float32), np.array([2, 0])

    def loss():
        f = (syn0[context].mean(0) if cbow else syn0[context]) @ syn1[nodes].T
        return np.log1p(np.exp(-(1 - 2 * code) * f)).sum()

    before = loss()
    for _ in range(20):
        (embed.cbow_step if cbow else embed.skipgram_step)(syn0, syn1, a0, a1, context, code, nodes)
    assert loss() < before


def test_embedding_training(spark):
    vocabulary = spark.createDataFrame([(0, "a", 9), (1, "b", 5), (2, "c", 2)], "id int, word string, count long")
    samples = spark.createDataFrame([(i, [0, 1, 0, 2, i % 3]) for i in range(6)], "sample_id long, keys array<long>")
    fit = embed.train(samples, vocabulary, embed.Params(size=4, window=2, iterations=1, batch_size=2, parts=2))
    start = ParamTable.create(spark, 3, 4, "float").randomise().df
    moved = fit.words.df.join(start.withColumnRenamed("values", "old"), "key").where("values <> old").count()
    assert moved == 3 and fit.nodes.df.count() == 2


def test_least_squares_descend(spark):
    rows = [(u, p, float((u * 3 + p) % 5)) for u in range(6) for p in range(5) if (u + p) % 4]
    r = spark.createDataFrame(rows, "uid long, pid long, rating double")
    users, products, errors = recommend.fit(r, rank=2, iterations=2)
    assert errors[1] <= errors[0] + 1e-9 and users.count() == 6 and products.count() == 5
    x = {k["key"]: np.array(k["values"]) for k in products.collect()}
    for u in users.collect():
        own = [(x[p], v) for a, p, v in rows if a == u["key"]]
        a = sum(np.outer(q, q) for q, _ in own) + 0.1 * np.eye(2)
        assert u["values"] == pytest.approx(np.linalg.solve(a, sum(q * v for q, v in own)))
    with pytest.raises(NotImplementedError):
        recommend.fit(r, implicit=True)


def test_clock():
    c = StalenessClock([0, 1], 2)
    assert [c.progress(*x) for x in ((0, 0), (1, 0), (0, 1), (0, 2))] == [(False, []), (False, []), (False, []), (True, [])]
    assert c.progress(1, 1) == (False, [0])
    level = StalenessClock([0, 1], 0)
    assert level.progress(0, 0) == (True, []) and level.progress(1, 0) == (False, [0])


def test_lags_by_pieces(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(3)
    at, rows = {}, []
    for seq in range(60):
        w = int(r.integers(0, 5))
        at[w] = at.get(w, -1) + 1
        rows.append((seq, w, at[w], min(at.values())))
    df = spark.createDataFrame([x[:3] for x in rows], "seq long, worker long, iter long")
    got = {r["seq"]: (r["slowest"], r["lag"]) for r in lags(df, ["seq"], F.floor(F.col("seq") / 9)).collect()}
    assert got == {s: (low, i - low) for s, _, i, low in rows}


def test_clock_of_many_workers_takes_no_look_at_all_of_them(spark):
    from pyspark.sql import functions as F

    from tarnwick.plans.schedule import replay

    workers = 20_000
    seq = spark.range(2 * workers).withColumnRenamed("id", "seq")
    df = seq.withColumn("worker", F.col("seq") % workers).withColumn("iter", F.floor(F.col("seq") / workers))
    began = time.monotonic()
    out = replay(df, 1).agg(F.sum(F.col("waits").cast("long")), F.sum(F.size("released"))).first()
    assert tuple(out) == (2 * workers - 2, 2 * workers - 2)
    assert time.monotonic() - began < 60


def test_clock_by_number_of_workers():
    known, number = StalenessClock([3, 5, 9], 1), StalenessClock(3, 1)
    for x in ((3, 0), (5, 0), (3, 2), (9, 1), (5, 1), (5, 4), (9, 2)):
        assert known.progress(*x) == number.progress(*x)


def test_lags_of_a_piece_of_many_batches(spark):
    from pyspark.sql import functions as F

    rows = [(s, s % 3, s // 3) for s in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.createDataFrame(rows, "seq long, worker int, iter int")
        got = lags(df, ["seq"], F.floor(F.col("seq") / 300)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["seq"]: r["lag"] for r in got} == {s: 0 if w == 2 or s < 3 else 1 for s, w, _ in rows}


@pytest.mark.parametrize("limit", [0, 10**6])
def test_rounds_of_one_task_and_of_many(spark, monkeypatch, limit):
    """Batches of 2 rows make the task's stream; a table above the limit is joined for each round."""
    from tarnwick.operators import training

    cuts = []
    monkeypatch.setattr(training, "ONE_TASK", limit)
    monkeypatch.setattr(training, "cut", lambda df, cut=training.cut: cuts.append(1) or cut(df))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        fit = regression.fit_logistic(spark.createDataFrame(ROWS, SCHEMA), dim=7, eta=0.3, iterations=2, parts=3, mode=Mode.ASGD, batch_size=3)
        bsp = regression.fit_logistic(spark.createDataFrame(ROWS, SCHEMA), dim=7, eta=0.3, iterations=2, parts=3, mode=Mode.BSP)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    w, costs = golden(parted(3, 3), 2)
    assert {r["key"]: r["value"] for r in fit.table.df.collect()} == pytest.approx(w) and fit.costs == pytest.approx(costs)
    assert {r["key"]: r["value"] for r in bsp.table.df.collect()} == pytest.approx(golden(parted(3), 2)[0])
    assert len(cuts) == (2 + 2 * 3 * 2 if not limit else 2 + 2 * 2) + 2 + 2 * 2


def test_blocks_solve_what_aggregates_solve(spark, monkeypatch):
    """Batches of 3 rows cut through the ratings of a key; no rating goes through metrics.rating_errors."""
    from pyspark.sql import functions as F

    from tarnwick.operators import metrics

    r = np.random.default_rng(5)
    ratings = spark.createDataFrame([(int(u), int(p), float(r.integers(1, 6))) for u in range(9) for p in r.permutation(12)[:7]], "uid long, pid long, rating double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        users, products, errors = recommend.fit(ratings, rank=3, iterations=2)
        again = {x["key"]: x["values"] for x in recommend.half_step(ratings, products, 3, 0.1, "uid", "pid").collect()}
        assert {x["key"]: x["values"] for x in users.collect()} == {k: pytest.approx(v) for k, v in again.items()}
        assert errors[-1] == pytest.approx(metrics.rmse(metrics.rating_errors(ratings, users, products), 1, 1).first()["rmse"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not hasattr(recommend, "rating_errors") and ratings.where(F.col("rating") < 0).isEmpty()
