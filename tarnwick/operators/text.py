"""Tokens, vocabularies and encoded corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions import columns as C
from tarnwick.operators import tokenise
from tarnwick.plans.lineage import cut


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line): texts cut at line feeds."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))


_TOKENS = "doc_id {id}, line_no int, pos int, word string"
_TOKEN_NAMES = ["doc_id", "line_no", "pos", "word"]


def topic_tokens(docs: DataFrame, **cols) -> DataFrame:
    """(doc_id, line_no, pos, word) with the topic model's cleaner; blank lines and tokens are dropped."""
    return tokenise.mapped(docs, tokenise.topic, tokenise.all_tokens, _TOKENS, _TOKEN_NAMES, **cols)


def embedding_tokens(docs: DataFrame, **cols) -> DataFrame:
    """(doc_id, line_no, pos, word) with the embedding cleaner; pos counts the tokens that stay."""
    return tokenise.mapped(docs, tokenise.embedding, tokenise.all_tokens, _TOKENS, _TOKEN_NAMES, **cols)


def word_totals(docs: DataFrame, cleaner: tokenise.Cleaner, **cols) -> DataFrame:
    """(word, count) of all tokens."""
    return tokenise.mapped(docs, cleaner, tokenise.word_totals, "word string, n long", ["word", "n"], **cols).groupBy("word").agg(F.sum("n").alias("count"))


def text_words(docs: DataFrame, cleaner: tokenise.Cleaner, **cols) -> DataFrame:
    """(doc_id, word, n): how often each word comes in each text."""
    return tokenise.mapped(docs, cleaner, tokenise.text_words, "doc_id {id}, word string, n long", ["doc_id", "word", "n"], **cols)


def embedding_lines(docs: DataFrame, **cols) -> DataFrame:
    """(doc_id, line_no, words): the tokens of embedding_tokens, one array for each line."""
    return lines(docs, **cols).where(C.not_blank(F.col("line"), trim=False)).select("doc_id", "line_no", C.embedding_words(F.col("line")).alias("words"))


def word_counts(tokens: DataFrame, more_than: int = 0) -> DataFrame:
    """(word, count) of words that come more than so many times."""
    return tokens.groupBy("word").count().where(F.col("count") > more_than)


def vocabulary_by_count(counts: DataFrame, ascending: bool = False) -> DataFrame:
    """(word, count, id): ids from 0, by count and then by word."""
    return dense_ids(counts, [F.col("count") if ascending else -F.col("count"), F.substring("word", 1, 2)], "word")


def vocabulary_by_word(tokens: DataFrame) -> DataFrame:
    """(word, id): the distinct words, numbered from 0 in their order."""
    return dense_ids(tokens.select("word").distinct(), [F.substring("word", 1, 2)], "word")


def dense_ids(df: DataFrame, pieces: list[Column], last: str) -> DataFrame:
    """df with id, from 0, in ascending order of pieces and then of column last.

    Rows are ranked within the pieces that the first columns make, and shifted by the sizes of the pieces
    before; so no single task sorts all rows.  df is computed once, as it is read for both.
    """
    own = cut(df.withColumn("__b", F.struct(*(c.alias(f"p{k}") for k, c in enumerate(pieces)))))
    before = own.groupBy("__b").count().withColumn("__n", F.sum("count").over(Window.orderBy("__b")) - F.col("count")).select(F.col("__b").alias("__of"), "__n")
    ranked = own.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(last)) - 1)
    return ranked.join(before, F.col("__b") == F.col("__of")).withColumn("id", (F.col("__r") + F.col("__n")).cast("int")).drop("__b", "__of", "__n", "__r")


def encode(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """tokens with word_id; words outside the vocabulary are dropped.  Spark broadcasts the vocabulary if it is small."""
    return tokens.join(vocabulary.select("word", F.col("id").alias("word_id")), "word").drop("word")


def corpus_stats(encoded: DataFrame) -> DataFrame:
    """One row (docs, tokens)."""
    return encoded.agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("tokens"))


def context_pairs(sentences: DataFrame, window: int, words: str = "words") -> DataFrame:
    """sentences with center, context, center_word, context_word: a row for each pair of words of a sentence at most window places apart.

    A sentence is an array of words in one row, so its pairs are made in the row, without a join.
    """
    w = F.col(words)
    last = F.size(w) - 1

    def around(i: Column) -> Column:
        near = F.sequence(F.greatest(i - window, F.lit(0)), F.least(i + window, last))
        return F.transform(F.filter(near, lambda j: j != i), lambda j: F.struct(i.alias("center"), j.alias("context"), F.get(w, i).alias("center_word"), F.get(w, j).alias("context_word")))

    pairs = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), last), around)))
    return sentences.where(last >= 0).withColumn("__pair", pairs).select(*(c for c in sentences.columns if c != words), "__pair.*")


def pair_counts(docs: DataFrame, cleaner: tokenise.Cleaner, window: int, **cols) -> DataFrame:
    """(center_word, context_word, n): the rows of context_pairs, counted.  A pair and its reverse come as often, so one of them is counted and shuffled."""
    pairs = tokenise.mapped(docs, cleaner, tokenise.window_pairs(window), "a string, b string, n long", ["a", "b", "n"], **cols).groupBy("a", "b").agg(F.sum("n").alias("n"))
    same = F.col("a") == F.col("b")
    ways = F.when(same, F.array(F.struct(F.col("a").alias("center_word"), F.col("b").alias("context_word"), (F.col("n") * 2).alias("n")))).otherwise(F.array(F.struct(F.col("a").alias("center_word"), F.col("b").alias("context_word"), "n"), F.struct(F.col("b").alias("center_word"), F.col("a").alias("context_word"), "n")))
    return pairs.select(F.explode(ways).alias("__w")).select("__w.*")


def distinct_ids(encoded: DataFrame) -> DataFrame:
    """(doc_id, word_ids): the distinct words of each document, in order of their ids."""
    return encoded.groupBy("doc_id").agg(F.array_sort(F.collect_set("word_id")).alias("word_ids"))


def kept_tokens(counts: DataFrame) -> DataFrame:
    """One row (words, tokens) of a vocabulary's counts."""
    return counts.agg(F.count("*").alias("words"), F.coalesce(F.sum("count"), F.lit(0)).alias("tokens"))


def similarities(vectors: DataFrame, word_id: int) -> DataFrame:
    """(id, similarity): the cosine of every other vector (id, values) with that of word_id."""
    query = vectors.where(F.col("id") == word_id).select(F.col("values").alias("__q")).limit(1)
    return vectors.where(F.col("id") != word_id).crossJoin(F.broadcast(query)).select("id", C.cosine(F.col("__q"), F.col("values")).alias("similarity"))


def nearest_words(vectors: DataFrame, word_id: int, k: int) -> DataFrame:
    """(id, similarity) of the k vectors of greatest cosine with that of word_id, which is left out; ties go to the smaller id."""
    return similarities(vectors, word_id).orderBy(F.desc("similarity"), "id").limit(k)
