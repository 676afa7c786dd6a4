from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwick.llm import mixing, packing, sharding
from tarnwick.llm.ranks import only_ids, ranks


def test_flights_keep_their_sums():
    r = np.random.default_rng(0)
    pi, size = r.uniform(0.1, 0.9, 200), r.integers(1, 500, 200).astype(float)
    for out in (mixing.flight_two(pi, size, r), mixing.flight(pi, np.stack([np.ones(200), size]), r)):
        assert out.sum() == pytest.approx(pi.sum()) and out @ size == pytest.approx(pi @ size)
        assert ((out > 0) & (out < 1)).sum() <= 2
    same = mixing.flight_two(np.full(9, 1 / 3), np.full(9, 7), r)
    assert same.sum() == pytest.approx(3) and ((same > 0) & (same < 1)).sum() <= 2
    landed = mixing.landing(out, np.stack([np.ones(200), size]), r)
    assert set(landed) <= {0.0, 1.0} and abs(landed.sum() - pi.sum()) < 2.5


def test_inclusion_probabilities_are_met():
    pi, size = np.array([0.2, 0.5, 0.8, 0.4, 0.6]), np.array([3, 1, 4, 1, 5.0])
    r, total = np.random.default_rng(1), np.zeros(5)
    for _ in range(4000):
        total += mixing.landing(mixing.flight_two(pi, size, r), np.stack([np.ones(5), size]), r)
    assert total / 4000 == pytest.approx(pi, abs=0.03)


@pytest.mark.parametrize("block", [50_000, 40, 8])
def test_sources_reach_their_weights(spark, block):
    rows = [(i, "w " * (5 + i * 7 % 40), f"s{i % 3 if i % 5 else 0}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.sample(df, weights={"s0": 2.0, "s1": 1.0, "s2": 1.0}, budget=8000, block=block).collect()
    tokens = Counter()
    for r in out:
        tokens[r["source"]] += r["n_tokens"]
        assert r["n_tokens"] == 5 + r["doc_id"] * 7 % 40
    assert len({r["doc_id"] for r in out}) == len(out)
    assert tokens["s0"] == pytest.approx(4000, abs=100) and tokens["s1"] == pytest.approx(2000, abs=100) and tokens["s2"] == pytest.approx(2000, abs=100)


def brute_flight(pi, size, draws):
    """The cube method step by step, as flight_two does it, with null vectors from a singular value decomposition."""
    pi, k = [float(x) for x in pi], 0
    queue = [i for i, x in enumerate(pi) if 0 < x < 1]
    own, queue = queue[:3], queue[3:]
    while len(own) == 3:
        a = np.array([[1.0] * 3, [size[i] for i in own]])
        u = np.array([1.0, -1.0, 0.0]) if len({size[i] for i in own}) == 1 else np.linalg.svd(a)[2][-1]
        u = u * np.sign(np.cross(a[0], a[1]) @ u or 1.0)
        up = min((1 - pi[i]) / c if c > 0 else -pi[i] / c for c, i in zip(u, own) if abs(c) > 1e-12)
        down = min(pi[i] / c if c > 0 else (pi[i] - 1) / c for c, i in zip(u, own) if abs(c) > 1e-12)
        step = up if draws[k] * (up + down) < down else -down
        k += 1
        for c, i in zip(u, own):
            pi[i] = min(1.0, max(0.0, round(pi[i] + step * c, 9)))
        own = [i for i in own if 0 < pi[i] < 1]
        own, queue = own + queue[: 3 - len(own)], queue[3 - len(own) :]
    return pi


def test_flight_by_brute_force():
    for seed in range(20):
        r = np.random.default_rng(seed)
        pi, size = r.uniform(0.05, 0.95, 30), r.integers(1, 9, 30)
        draws = np.random.default_rng(seed + 100).random(33).tolist()
        assert mixing.flight_two(pi, size, np.random.default_rng(seed + 100)) == pytest.approx(brute_flight(pi, size, draws), abs=1e-6)


def test_blocks_of_too_few_documents_are_refused(spark, docs):
    with pytest.raises(ValueError):
        mixing.sample(docs, block=7)


def test_mixing_edges(spark, docs):
    assert mixing.sample(docs.limit(0)).count() == 0
    out = mixing.sample(docs, weights={"src0": 1.0, "nowhere": 5.0}).collect()
    assert {r["source"] for r in out} == {"src0"} and None not in {r["doc_id"] for r in out}
    assert mixing.sample(docs, weights={}).count() == 0
    whole = mixing.sample(docs, alpha=1.0)
    assert whole.where("doc_id = 100").count() == 1
    kept = only_ids(docs, whole.select("doc_id"))
    assert kept.columns == docs.columns and kept.where("doc_id = 100").count() == 2
    assert only_ids(docs, whole.select("doc_id"), broadcast_bytes=0).count() == kept.count()


def test_a_rare_source_leaves_the_others_alone(spark):
    rows = [(i, "w " * 20, f"s{i % 3}") for i in range(600)] + [(600, "w " * 5, None)]
    out = mixing.sample(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sum(r["n_tokens"] for r in out) > 0.9 * 12_005 and 600 in {r["doc_id"] for r in out}
    even = [r for r in rows if r[2]]
    rich = even + [(1000 + i, "w " * 20, "rich") for i in range(5000)]
    tokens = Counter()
    for r in mixing.sample(spark.createDataFrame(rich, "doc_id long, text string, source string")).collect():
        tokens[r["source"]] += r["n_tokens"]
    share = 5000**0.5 / (5000**0.5 + 3 * 200**0.5)
    assert tokens["rich"] == pytest.approx(112_000 * share, abs=60) and tokens["s0"] == 4000


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), min_size=1, max_size=12))
def test_patterns_hold_every_piece(hist):
    size, demand = np.array(sorted(hist)), np.array([hist[k] for k in sorted(hist)])
    patterns, copies, bound = packing.integer_patterns(size, demand, 40)
    assert (patterns.T @ copies == demand).all() and (patterns @ size <= 40).all()
    assert copies.sum() >= bound - 1e-6 >= demand @ size / 40 - 1e-5
    assert copies.sum() <= bound + len(size) + 1


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 90), st.integers(1, 40), st.lists(st.integers(0, 300), min_size=1, max_size=30))
def test_any_capacity_and_classes(spark, capacity, classes, lengths):
    """Every piece has a class that the program can hold, whatever the capacity and the number of classes."""
    k = min(classes, capacity)
    pieces = [min(capacity, n + 1 - at) for n in lengths for at in range(0, n + 1, capacity)]
    own = Counter(-(-n * k // capacity) for n in pieces)
    size, demand = np.array(sorted(own)), np.array([own[c] for c in sorted(own)])
    patterns, copies, bound = packing.integer_patterns(size, demand, k)
    assert (patterns.T @ copies == demand).all() and (patterns @ size <= k).all() and copies.sum() >= bound - 1e-6


def test_a_capacity_that_is_no_multiple(spark):
    df = spark.createDataFrame([(k, "w " * n) for k, n in enumerate([2046, 2047, 5000, 7, 0, 1023, 1023])], "doc_id long, text string")
    out = packing.pack(df, capacity=2047, classes=256).collect()
    load = Counter()
    for r in out:
        load[r["sequence"]] += r["length"]
    assert max(load.values()) <= 2047 and sum(load.values()) == 2046 + 2047 + 5000 + 7 + 2046 + 7


def test_inverse_by_elimination():
    a = np.random.default_rng(2).normal(size=(40, 40))
    a[0, 0] = 0
    assert packing.inverted(a) @ a == pytest.approx(np.eye(40), abs=1e-9)
    with pytest.raises(np.linalg.LinAlgError):
        packing.inverted(np.zeros((2, 2)))


def test_the_bound_holds_however_the_program_ends():
    size, demand = np.array([3, 5, 7, 11, 13]), np.array([50, 41, 37, 29, 23])
    ends = [packing.column_generation(size, demand, 26, patience)[1:] for patience in (1, 1000)]
    assert all(bound <= ends[1][0].sum() + 1e-6 for _, bound in ends) and ends[1][1] == pytest.approx(ends[1][0].sum(), rel=1e-6)


def test_knapsack_by_brute_force():
    import itertools

    r = np.random.default_rng(3)
    for _ in range(20):
        size, value = r.integers(1, 9, 4), r.random(4)
        best, counts = packing.knapsack(value, size, 15)
        want = max(np.dot(c, value) for c in itertools.product(range(16), repeat=4) if np.dot(c, size) <= 15)
        assert best == pytest.approx(want) and counts @ value == pytest.approx(want) and counts @ size <= 15


def test_packing_covers_every_token(spark, docs):
    out = packing.pack(docs, capacity=64, classes=16).collect()
    want = {(r["doc_id"], r["text"]) for r in docs.where("text is not null").collect()}
    total = Counter()
    for r in out:
        total[r["doc_id"]] += r["length"]
    expected = Counter()
    for r in docs.where("text is not null").collect():
        expected[r["doc_id"]] += len(r["text"].split()) + 1
    assert total == expected and want
    by = {}
    for r in out:
        by.setdefault(r["sequence"], []).append((r["position"], r["length"]))
    for spans in by.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 64
    assert packing.pack(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.integers(1, 40), min_size=1, max_size=10), st.integers(1, 6))
def test_schedule_is_longest_first(hist, shards):
    import heapq

    sizes, counts = np.array(sorted(hist)), np.array([hist[k] for k in sorted(hist)])
    heap = [(0, k) for k in range(shards)]
    for s in sorted((s for s, n in hist.items() for _ in range(n)), reverse=True):
        x, k = heapq.heappop(heap)
        heapq.heappush(heap, (x + s, k))
    out = sharding.schedule(sizes, counts, shards)
    assert (out.sum(1) == counts).all() and sorted(sizes @ out) == sorted(x for x, _ in heap)


def test_size_classes(spark):
    sizes = [0, 1, 511, 512, 513, 1023, 1024, 1025, 10**6 + 1, 2**40 + 1, 2**62 - 3]
    for r in spark.createDataFrame([(n,) for n in sizes], "n long").select("n", sharding.size_class(F.col("n")).alias("c")).collect():
        assert r["n"] <= r["c"] <= r["n"] * (1 + 1 / 256) and (r["n"] >= 512 or r["c"] == r["n"])
        assert len(bin(r["c"])[2:].rstrip("0")) <= 9


def test_shards_are_balanced_as_by_a_heap(spark):
    import heapq

    rows = [(k, f"g{k % 300}", 1 + (k * 7919) % 5000) for k in range(900)] + [(1000, "big", 400_000), (1001, None, 9), (1002, None, -5), (1002, None, None)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, g string, n int"), F.col("g"), F.col("n"), shards=7)
    size, load, at = Counter(), Counter(), {}
    for i, g, n in rows:
        size[g or f"id:{i}"] += max(0, n or 0)
    for r in out.collect():
        assert at.setdefault(r["group_id"], r["shard"]) == r["shard"]
    assert at.keys() == size.keys()
    heap = [(0, k) for k in range(7)]
    for n in sorted(size.values(), reverse=True):
        x, k = heapq.heappop(heap)
        heapq.heappush(heap, (x + n, k))
    for g, k in at.items():
        load[k] += size[g]
    assert max(load.values()) <= max(x for x, _ in heap) * (1 + 1 / 256) + 1


def test_sharding_keeps_groups_together(spark, docs):
    out = sharding.shard(docs, F.md5("text"), F.octet_length("text"), shards=4)
    rows = out.collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["group_id"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in by.values())
    assert {r["shard"] for r in rows if r["doc_id"] in (0, 100)} == {next(r["shard"] for r in rows if r["doc_id"] == 0)}
    assert sharding.shard(docs.limit(0), F.md5("text"), F.octet_length("text")).count() == 0


def test_ranks_over_pieces(spark):
    df = spark.range(500).selectExpr("id", "id % 3 as c")
    out = ranks(df, "c", ["id"], total=3_000_000).collect()
    for c in range(3):
        assert sorted(r["rank"] for r in out if r["c"] == c) == list(range(len([r for r in out if r["c"] == c])))
