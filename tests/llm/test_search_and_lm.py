import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwick.llm import collision_knn, ngram_lm, queries


def truth(x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return [{int(j) for j in np.argsort(row, kind="stable")[:k]} for row in d]


@pytest.mark.parametrize("more", [{}, {"index_rows": 120}, {"index_rows": 90, "query_rows": 50}])
def test_neighbours_recall(spark, more):
    r = np.random.default_rng(0)
    x = (r.normal(size=(20, 24))[r.integers(0, 20, 400)] + 0.4 * r.normal(size=(400, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = collision_knn.neighbours(df, k=10, **more).collect()
    assert len(out) == 4000
    want, hits = truth(x.astype(float), 10), 0
    for row in out:
        hits += row["neighbour_id"] in want[row["vec_id"]]
        assert row["distance"] == pytest.approx(np.linalg.norm(x[row["vec_id"]].astype(float) - x[row["neighbour_id"]]), abs=1e-6)
    assert hits / 4000 >= 0.9


def test_op7_recall_against_exact_search(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    hits = total = 0
    found = {}
    for r in queries.op7_nearest_neighbours(spark, "/root/testdata/sf0.01").collect():
        found.setdefault(r["vec_id"], set()).add(r["neighbour_id"])
    assert set(found) == {int(i) for i in ids if i % 50 == 0}
    for q, near in found.items():
        d = ((x - x[ids == q]) ** 2).sum(1)
        d[ids == q] = np.inf
        hits, total = hits + len(near & set(ids[np.argsort(d, kind="stable")[:10]].tolist())), total + 10
    assert hits / total >= 0.9


def test_neighbours_edges(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None), (None, [1.0, 2.0]), (5, [1.0]), (6, []), (7, [None, 1.0]), (8, [float("nan"), 1.0]), (9, [3e38, -3e38])]
    df = spark.createDataFrame([(*r, 1, 2.0, 3) for r in rows], "vec_id long, embedding array<float>, rank int, distance double, v int")
    out = {(r["vec_id"], r["rank"]): (r["neighbour_id"], r["distance"]) for r in collision_knn.neighbours(df.where("vec_id is null or vec_id < 9"), k=10).collect()}
    assert out == {(1, 1): (2, 0.0), (1, 2): (3, pytest.approx(2**0.5)), (2, 1): (1, 0.0), (2, 2): (3, pytest.approx(2**0.5)), (3, 1): (1, pytest.approx(2**0.5)), (3, 2): (2, pytest.approx(2**0.5))}
    assert collision_knn.neighbours(df, k=2).where("vec_id = 1").count() == 2
    one = collision_knn.neighbours(df, df.where("vec_id = 3"), 1).collect()
    assert [(r["vec_id"], r["neighbour_id"]) for r in one] == [(3, 1)]
    long = spark.createDataFrame([(1, [1.0] * 900), (2, [0.0] * 900), (3, [1.0])], "vec_id long, embedding array<float>")
    assert {(r["vec_id"], r["neighbour_id"]) for r in collision_knn.neighbours(long).collect()} == {(1, 2), (2, 1)}
    assert collision_knn.neighbours(df.limit(0)).count() == 0
    assert collision_knn.neighbours(df.where("vec_id = 1")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(ids):
    a = np.array(ids, np.int64)
    assert ngram_lm.suffix_array(a).tolist() == sorted(range(len(ids)), key=lambda k: ids[k:])
