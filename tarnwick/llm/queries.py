"""One query for each operator of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm import collision_knn, language_id, licence_scan, mixing, ngram_lm, packing, quality_rules, sharding, url_filter
from tarnwick.llm.jaccard_join import jaccard_join


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\f\\r]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
grams AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g
  FROM words WHERE len(w) > 0),
own AS (SELECT DISTINCT doc_id, g FROM grams),
sets AS (SELECT g, min(doc_id) AS rep, count(*) AS copies FROM own GROUP BY g),
flat AS (SELECT rep, len(g) AS n, unnest(g) AS gram FROM sets),
pairs AS (
  SELECT a.rep AS x, b.rep AS y FROM flat a JOIN flat b ON a.gram = b.gram AND a.rep <> b.rep
  GROUP BY 1, 2 HAVING count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.5 - 1e-12),
reach(node, root) AS (SELECT rep, rep FROM sets UNION SELECT y, root FROM reach JOIN pairs ON node = x),
classes AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node),
links AS (SELECT x, count(*) AS links FROM pairs GROUP BY x)
SELECT doc_id, class_id, copies, coalesce(links, 0) AS links
FROM own JOIN sets USING (g) JOIN classes ON node = rep LEFT JOIN links ON x = rep
"""


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs.select("doc_id", "text"), language_id.train(docs)).select("doc_id", "lang_id.*")


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.scan(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rules = quality_rules.learn_from(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs.select("doc_id", "text"), rules).select("doc_id", "rule", "keep")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches for every vector whose id is divisible by 50, among all vectors."""
    vectors = _table(spark, sf_dir, "embeddings")
    return collision_knn.neighbours(vectors, vectors.where("vec_id % 50 = 0"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_each(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), F.md5(F.col("text")), F.octet_length("text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_id, op2_licence_scan, op3_ngram_jaccard_join, op4_quality_rules, op5_mix_sources, op6_url_filter, op7_nearest_neighbours, op8_packing, op9_lm_scoring, op10_sharding)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard_join": OP3_SQL, "op6_url_filter": url_filter.oracle(url_filter.compile_rules())}
