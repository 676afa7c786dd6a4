import pytest
from pyspark.sql import functions as F

from tarnwick.operators.keys import All, Keys, Range
from tarnwick.operators.params import Model, ParamTable


def rows(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_push_fetch_and_unknown_keys(spark):
    t = ParamTable.create(spark, 5)
    t = t.push(spark.createDataFrame([(1, 2.0), (1, 0.5), (9, 1.0)], "key long, value double"))
    assert rows(t.fetch(All())) == {0: 0, 1: 2.5, 2: 0, 3: 0, 4: 0}
    assert rows(t.fetch(Keys.of([1, 9]))) == {1: 2.5}
    wanted = spark.createDataFrame([(1,), (9,)], "k long")
    assert rows(t.fetch(wanted)) == {1: 2.5}
    with pytest.raises(Exception, match="no key 9"):
        t.fetch(wanted, strict=True).collect()
    assert rows(t.zero().df) == dict.fromkeys(range(5), 0) and rows(t.init(1.5).df) == dict.fromkeys(range(5), 1.5)


def test_guarded_push_raises(spark):
    t = ParamTable.create(spark, 2, value_type="int")
    with pytest.raises(Exception, match="below zero"):
        t.push(spark.createDataFrame([(0, -1)], "key long, value int"), guarded=True).df.collect()


def test_matrix_push_and_columns(spark):
    t = ParamTable.create(spark, 3, 2)
    t = t.push(spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 0.0])], "key long, values array<double>"))
    t = t.push_cells(spark.createDataFrame([(2, 1, 5.0)], "key long, col int, value double"))
    got = {r["key"]: r["values"] for r in t.df.collect()}
    assert got == {0: [2.0, 2.0], 1: [0.0, 0.0], 2: [0.0, 5.0]}
    assert [r["values"] for r in t.fetch_columns(Range(2, 2), 1, 1).collect()] == [[5.0]]


def test_adagrad_rate_shrinks_above_one(spark):
    t = ParamTable.create(spark, 2, 1).set_alpha(0.05, 0.0001, 10.0)
    t = t.push_adagrad(spark.createDataFrame([(0, [2.0]), (1, [0.5])], "key long, values array<double>"))
    got = {r["key"]: (r["values"][0], r["deltas"][0], r["alphas"][0]) for r in t.df.collect()}
    assert got[0] == pytest.approx((2.0, 4.0, 0.0025)) and got[1] == pytest.approx((0.5, 0.25, 0.05))
    parts = ParamTable.create(spark, 2, 1).set_alpha(0.05, 0.0001, 10.0)
    for v in (1.5, 0.5):
        parts = parts.push_adagrad(spark.createDataFrame([(0, [v])], "key long, values array<double>"))
    once = ParamTable.create(spark, 2, 1).set_alpha(0.05, 0.0001, 10.0).push_adagrad(spark.createDataFrame([(0, [1.5]), (0, [0.5])], "key long, values array<double>"))
    assert sorted(map(str, parts.df.collect())) == sorted(map(str, once.df.collect()))


def test_model(spark, tmp_path):
    m = Model({"dim": "2"})
    m.register("w", ParamTable.create(spark, 3, 2, "float").set_alpha(0.1, 0.01, 1.0))
    with pytest.raises(ValueError):
        m.register("w", ParamTable.create(spark, 1))
    with pytest.raises(KeyError):
        m["v"]
    m.save(str(tmp_path / "m"))
    back = Model.load(spark, str(tmp_path / "m"))
    assert back.comments == {"dim": "2"} and back["w"].adagrad["alpha"] == 0.1 and back["w"].df.count() == 3


def test_random_is_the_same_for_any_layout(spark):
    t = ParamTable.create(spark, 50, 3).randomise()
    again = t.with_df(t.df.repartition(7)).df.orderBy("key").collect()
    assert t.df.orderBy("key").collect() == again
    assert t.df.select(F.max(F.array_max("values")) < 0.34).first()[0]
