import pytest
from pyspark.sql import functions as F

from tarnwick import queries as core
from tarnwick.operators import text, tokenise, topics

TEXTS = [(1, "a b a c\nb a"), (2, "c c d"), (3, "d a"), (2, "a b"), (None, "a z"), (4, None), (5, ""), (6, "e f g a b c d")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("topics"))
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_counts_of_the_pass_equal_those_of_rows(spark, folder, monkeypatch):
    """Also with an id that repeats, one that is null, and a vocabulary too large to broadcast."""
    own = core.TopicCorpus(spark, folder)
    got = [rows(own.counts(x)) for x in (None, "word_id", "doc_id")] + [rows(own.tokens().select("doc_id", "pos", "word_id", "topic")), rows(own.documents())]
    assert own.lookup is not None
    monkeypatch.setattr(tokenise, "BROADCAST_WORDS", 0)
    joined = core.TopicCorpus(spark, folder)
    assert joined.lookup is None
    t = joined.tokens()
    assert got[:4] == [rows(f(t)) for f in (topics.topic_counts, topics.word_topic_counts, topics.doc_topic_counts)] + [rows(t.select("doc_id", "pos", "word_id", "topic"))]
    tokens = lambda d: sorted((i, *x) for i, *lists in d for x in zip(*lists))
    assert tokens(got[4]) == tokens(rows(joined.documents())) and len(got[4]) == 4


def test_pairs_are_counted_once_and_told_both_ways(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    each = text.context_pairs(text.embedding_lines(docs), 2).groupBy("center_word", "context_word").agg(F.count("*").alias("n"))
    assert rows(text.pair_counts(docs, tokenise.embedding, 2)) == rows(each)


def test_chunks_and_groups_keep_all_tokens(spark, folder, monkeypatch):
    own = core.TopicCorpus(spark, folder)
    monkeypatch.setattr(topics, "CHUNK_TOKENS", 4)
    monkeypatch.setattr(topics, "GROUP_TOKENS", 1)
    p, words, docs = topics.Params(k=10, iterations=2, parts=2), own.vocabulary.count(), own.documents()
    model = topics.train_documents(docs, words, p)
    key = ["doc_id", "pos", "word_id"]
    assert rows(model.tokens.select(key)) == rows(own.tokens().where("doc_id is not null").select(key))
    again = topics.perplexity_of(topics.documents(model.tokens), topics.word_topic_counts(model.tokens), p, words).first()["perplexity"]
    assert model.perplexities[-1] == pytest.approx(again)
    out = {r["doc_id"]: sum(r["counts"]) for r in topics.infer_documents(own.counts("word_id"), docs, p, words, 3).collect()}
    assert out == {r["doc_id"]: len(r["pos"]) for r in docs.collect()}
