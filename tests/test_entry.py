"""The registry, with and without the optional subpackage; sources; streams; queries against SQL."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnwick import queries as core
from tarnwick.operators import metrics, text
from tarnwick.operators.params import ParamTable
from tarnwick.sources import parsers
from tarnwick.streaming import updates

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def test_imports_without_the_optional_parts(tmp_path):
    shutil.copytree(f"{REPO}/tarnwick", tmp_path / "tarnwick", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'lr_predict' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)


def test_a_broken_optional_part_is_not_passed_over(tmp_path):
    shutil.copytree(f"{REPO}/tarnwick", tmp_path / "tarnwick", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    (tmp_path / "tarnwick/llm").mkdir()
    (tmp_path / "tarnwick/llm/__init__.py").touch()
    (tmp_path / "tarnwick/llm/queries.py").write_text("import no_such_module")
    (tmp_path / "corpus_pipeline.py").touch()
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode and "no_such_module" in done.stderr


def test_pairs_within_a_window(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["x"]), (3, []), (4, None)], "s int, words array<string>")
    got = {(r["s"], r["center"], r["context"], r["center_word"] + r["context_word"]) for r in text.context_pairs(df, 2).collect()}
    w = "abcd"
    assert got == {(1, i, j, w[i] + w[j]) for i in range(4) for j in range(4) if i != j and abs(i - j) <= 2}


def plain(v):
    return None if v is None or v != v else repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", ["fetch_keys", "key_intersect", "linear_split", "push_array", "push_matrix", "push_guarded", "push_adagrad", "delta_prune", "cells_to_dense", "table_fill", "parse_sparse", "parse_dense", "parse_ratings", "vocabulary_topic", "vocabulary_embedding", "topic_perplexity", "topic_verify", "context_pairs", "key_overlap_hull", "corpus_stats", "kept_tokens", "distinct_ids", "lr_predict", "lr_auc", "lr_gd_steps", "mlr_softmax", "mlr_validate", "synonyms_topk", "als_half_step", "als_rmse", "ssp_lag", "sigmoid_table"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    found = con.execute(core.SQL[name])
    names = [c[0] for c in found.description]
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    got = core.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(map(plain, r)) for r in got.select(*names).collect()), key=lambda t: tuple(x or "" for x in t)) == sorted(want, key=lambda t: tuple(x or "" for x in t))


def test_auc_with_a_tie(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "score double, label int")
    assert metrics.auc(df).first()["auc"] == pytest.approx(0.75)
    assert metrics.auc(df, pieces=2).first()["auc"] == pytest.approx(0.75)
    assert metrics.auc(df.limit(0)).first()["auc"] is None


def test_cleaners(spark):
    df = spark.createDataFrame([(0, "a^b-c Don't\n\n  \nOne  two")], "doc_id long, text string")
    assert [r["word"] for r in text.topic_tokens(df).orderBy("line_no", "pos").collect()] == ["a^b c", "don t", "one", "two"]
    assert [r["word"] for r in text.embedding_tokens(df).orderBy("line_no", "pos").collect()] == ["abc", "dont", "one", "two"]


def test_ids_by_pieces(spark):
    df = spark.createDataFrame([(w, c) for w, c in zip("b a d c e".split(), [3, 3, 9, 1, 3])], "word string, count long")
    assert {r["word"]: r["id"] for r in text.vocabulary_by_count(df).collect()} == {"d": 0, "a": 1, "b": 2, "e": 3, "c": 4}


def test_parsers(spark):
    lines = spark.createDataFrame([("1 3:0.5 17:2 3:4",)], "value string")
    assert parsers.sparse_rows(lines).first().asDict() == {"label": 1, "features": {3: 4.0, 17: 2.0}}
    assert parsers.sparse_rows(spark.createDataFrame([("1.9 3:1",)], "value string"), "float").first()["label"] == 1
    assert parsers.dense_rows(spark.createDataFrame([("0 0 255 7",)], "value string"), 10).first().asDict() == {"features": {2: 255.0}, "label_vec": [0.0] * 7 + [1.0] + [0.0] * 2}
    assert tuple(parsers.ratings(spark.createDataFrame([("1,10,4.5",)], "value string")).first()) == (0, 9, 4.5)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        parsers.sparse_rows(spark.createDataFrame([("x 3:1",)], "value string")).collect()


def test_image_files(spark, tmp_path):
    import struct

    (tmp_path / "x").write_bytes(struct.pack(">iiii", 2051, 2, 1, 2) + bytes([1, 2, 3, 4]))
    (tmp_path / "y").write_bytes(struct.pack(">ii", 2049, 2) + bytes([7, 8]))
    out = parsers.idx_images(spark, str(tmp_path / "x"), str(tmp_path / "y"))
    assert sorted(r["value"] for r in out.collect()) == ["1 2 7", "3 4 8"]
    with pytest.raises(ValueError):
        parsers.idx_lines(b"\0" * 16, b"\0" * 8)


def test_stream_of_deltas(spark, tmp_path):
    schema = "key long, value double"
    for k, rows in enumerate([[(0, 1.0), (1, 2.0)], [(0, 0.5)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = updates.write_snapshots(stream, ParamTable.create(spark, 3), str(tmp_path / "out"), str(tmp_path / "log"))
    q.awaitTermination(120)
    last = sorted(os.listdir(tmp_path / "out"))[-1]
    assert {r["key"]: r["value"] for r in spark.read.parquet(str(tmp_path / "out" / last)).collect()} == {0: 1.5, 1: 2.0, 2: 0.0}


def test_fetch_is_pushed_to_the_scan(spark):
    plan = core.fetch_range(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_partkey), GreaterThanOrEqual(p_partkey,100), LessThanOrEqual(p_partkey,1499)]" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_retailprice:double>" in plan
    assert core.parts(spark, SF).df.where(F.lit(True)).columns == ["key", "value"]
