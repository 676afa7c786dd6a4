import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwick.functions import kernels as K


@given(st.lists(st.integers(1, 100), min_size=2, max_size=30))
def test_huffman_is_prefix_free_and_optimal(counts):
    import heapq

    counts = sorted(counts, reverse=True)
    out = K.huffman(counts)
    codes = ["".join(map(str, c)) for c, _ in out]
    assert sum(2.0 ** -len(c) for c in codes) == pytest.approx(1)
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        cost += s
        heapq.heappush(heap, s)
    assert sum(n * len(c) for n, c in zip(counts, codes)) == cost
    assert all(0 <= n < len(counts) - 1 for _, nodes in out for n in nodes)


def test_huffman_fixture():
    out = K.huffman([5, 3, 2, 1])
    assert [len(c) for c, _ in out] == [1, 2, 3, 3] and [n for _, n in out] == [[2], [2, 1], [2, 1, 0], [2, 1, 0]]
    assert K.huffman([4]) == [([], [])]
    with pytest.raises(ValueError):
        K.huffman([1, 2])


@settings(max_examples=20)
@given(st.lists(st.floats(0.01, 10), min_size=1, max_size=8))
def test_alias_table_has_the_weights(p):
    share, other = K.alias_table(np.array(p))
    got = np.zeros(len(p))
    for k in range(len(p)):
        got[k] += share[k]
        got[other[k]] += 1 - share[k]
    assert got / len(p) == pytest.approx(np.array(p) / sum(p))


def test_linear_algebra():
    x = np.array([1.0, 2.0, 3.0])
    full = K.unpack(K.packed_update(np.zeros(6), 2.0, x))
    assert full == pytest.approx(2 * np.outer(x, x))
    a = full + np.eye(3)
    assert a @ K.solve_spd(a, x) == pytest.approx(x)
    assert K.softmax(x) == pytest.approx([0.09003057, 0.24472847, 0.66524096])
    rows = K.unit_gaussian_rows(np.array([3, 4]), 5)
    assert np.linalg.norm(rows, axis=1) == pytest.approx([1, 1]) and (rows >= 0).all()
    assert K.unit_gaussian_rows(np.array([4]), 5)[0] == pytest.approx(rows[1])
    assert [K.cumulative_draw(np.array([1.0, 0, 3]), u) for u in (0.0, 0.2, 0.25, 0.99)] == [0, 0, 2, 2]
    assert (K.congruential(5) < 2**64).all()


def test_alias_draws_follow_the_weights_of_each_row():
    p = np.array([[1.0, 2.0, 7.0], [5.0, 0.0, 5.0]])
    tables = [K.alias_table(row) for row in p]
    table = tuple(np.stack([t[c] for t in tables]) for c in range(2))
    r = np.random.default_rng(0)
    row, slot = np.repeat([0, 1], 60_000), r.integers(0, 3, 120_000)
    out = K.alias_draw(table, (row, slot), slot, r.random(120_000))
    for k in range(2):
        assert np.bincount(out[row == k], minlength=3) / 60_000 == pytest.approx(p[k] / p[k].sum(), abs=0.01)


def test_array_columns(spark):
    from pyspark.sql import functions as F

    from tarnwick.functions import columns as C

    row = spark.createDataFrame([([1.0, 2.0], [0.5, 0.25], [10.0, 20.0], {1: 2.0, 5: 3.0}, {1: 4.0})], "x array<double>, r array<double>, y array<double>, f map<int,double>, w map<int,double>")
    got = row.select(C.scaled_axpy(F.lit(2.0), F.col("x"), F.col("r"), F.col("y")).alias("a"), C.sparse_dot(F.col("f"), F.col("w")).alias("d")).first()
    assert list(got["a"]) == [11.0, 21.0] and got["d"] == 8.0


def test_tokeniser_counts_without_a_row_for_a_token(monkeypatch):
    import pyarrow as pa

    from tarnwick.operators import tokenise

    texts = pa.array(["a^b-c Don't\n\n  \nOne  two", None, "", "1 2\n \u00e9t\u00e9 two two"])
    t = tokenise.topic(texts)
    got = [(int(r), int(n), int(p), t.words[int(c)].as_py()) for r, n, p, c in zip(t.row, t.line, t.pos, t.code)]
    assert got == [(0, 0, 0, "a^b c"), (0, 0, 1, "don t"), (0, 3, 0, "one"), (0, 3, 2, "two"), (3, 1, 1, "t"), (3, 1, 2, "two"), (3, 1, 3, "two")]
    e = tokenise.embedding(texts)
    assert [(int(r), int(n), int(p), e.words[int(c)].as_py()) for r, n, p, c in zip(e.row, e.line, e.pos, e.code)] == [(0, 0, 0, "abc"), (0, 0, 1, "dont"), (0, 3, 0, "one"), (0, 3, 1, "two"), (3, 1, 0, "t"), (3, 1, 1, "two"), (3, 1, 2, "two")]
    ids, words, n = tokenise.text_words(pa.array([7, 8, 9, 10]), t, None)
    assert sorted(zip(ids.to_pylist(), words.to_pylist(), n.tolist()))[-1] == (10, "two", 2)
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array(["xx", None, "y" * 9])], ["doc_id", "text"])
    monkeypatch.setattr(tokenise, "SLICE", 4)
    assert [s.num_rows for s in tokenise._slices(batch)] == [2, 1]
