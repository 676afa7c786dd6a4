"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions import columns as C
from tarnwick.plans.lineage import cut


def linear_scores(features: DataFrame, weights: DataFrame, key: str = "key") -> DataFrame:
    """(sample_id, z): sums of weight times value over (sample_id, key, value) rows; a key without weight counts 0."""
    w = weights.select(F.col("key").alias("__k"), F.col("value").alias("__w"))
    return features.join(w, features[key] == F.col("__k"), "left").groupBy("sample_id").agg(F.sum(F.col("value") * F.coalesce("__w", F.lit(0.0))).alias("z"))


def predict(features: DataFrame, weights: DataFrame) -> DataFrame:
    """(sample_id, probability) of a logistic model."""
    return linear_scores(features, weights).select("sample_id", C.sigmoid(F.col("z")).alias("probability"))


def negative_log_likelihood(scored: DataFrame, label: str = "label", h: str = "probability") -> DataFrame:
    """One row (samples, nll) with the mean over all samples."""
    return scored.agg(F.count("*").alias("samples"), (-F.avg(C.log_loss(F.col(label), F.col(h)))).alias("nll"))


def auc(scored: DataFrame, score: str = "score", label: str = "label", pieces: int = 256) -> DataFrame:
    """One row (positives, negatives, auc): the share of pairs in the right order, ties by half.

    Scores are computed once and grouped, and cut into pieces at their quantiles; negatives below a score are those of
    the pieces before and those before it in its piece, so no task sorts all scores.
    """
    scored = cut(scored.select(score, label))
    g = scored.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))
    bounds = scored.agg(F.percentile_approx(F.col(score).cast("double"), [k / pieces for k in range(1, pieces)], 10_000)).first()[0] or []
    g = g.withColumn("__b", F.size(F.filter(F.lit(sorted(set(bounds))).cast("array<double>"), lambda b: b <= F.col("s"))))
    before = g.groupBy(F.col("__b").alias("__of")).agg(F.sum("n").alias("__all"))
    before = before.withColumn("__n", F.sum("__all").over(Window.orderBy("__of")) - F.col("__all")).drop("__all")
    below = F.coalesce(F.sum("n").over(Window.partitionBy("__b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("__n")
    part = g.join(before, F.col("__b") == F.col("__of")).withColumn("won", F.col("p") * (below + F.col("n") / 2.0))
    return part.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), (F.sum("won") / F.sum("p") / F.sum("n")).alias("auc"))


def class_logits(features: DataFrame, weights: DataFrame) -> DataFrame:
    """(sample_id, cls, z) from (sample_id, key, value) rows and weight cells (key, cls, value)."""
    w = weights.select(F.col("key").alias("__k"), "cls", F.col("value").alias("__w"))
    return features.join(w, features["key"] == F.col("__k")).groupBy("sample_id", "cls").agg(F.sum(F.col("value") * F.col("__w")).alias("z"))


def class_probabilities(logits: DataFrame) -> DataFrame:
    """logits with p, the softmax over the classes of a sample."""
    own = Window.partitionBy("sample_id")
    e = F.exp(F.col("z") - F.max("z").over(own))
    return logits.withColumn("p", e / F.sum(e).over(own))


def correct(probabilities: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (samples, correct): a sample is correct if its label's class has the greatest probability, ties included."""
    best = probabilities.withColumn("top", F.max("p").over(Window.partitionBy("sample_id")))
    hit = best.join(labels, (best["sample_id"] == labels["label_id"]) & (best["cls"] == labels["label"]))
    return hit.agg(F.count("*").alias("samples"), F.sum((F.col("p") >= F.col("top")).cast("long")).alias("correct"))


def perplexity(tokens: DataFrame, topics: int, alpha: float, beta: float, words: int) -> DataFrame:
    """One row (tokens, perplexity) of (doc_id, word_id, topic) tokens: exp of the mean of -ln sum_k theta phi.

    Products are formed only for topics that a document, or a word, has; the rest of the sum is closed form.
    """
    n_dk = tokens.groupBy("doc_id", "topic").agg(F.count("*").alias("dk"))
    n_d = tokens.groupBy("doc_id").agg(F.count("*").alias("d"))
    n_kw = tokens.groupBy("word_id", "topic").agg(F.count("*").alias("kw"))
    n_k = tokens.groupBy("topic").agg(F.count("*").alias("k"))
    spark = tokens.sparkSession
    all_k = spark.range(topics).select(F.col("id").cast("int").alias("topic")).join(F.broadcast(n_k), "topic", "left").select("topic", F.coalesce("k", F.lit(0)).alias("k"))
    base = F.col("k") + beta * words
    # sum_k (dk + alpha)(kw + beta) / base_k, split by which counts are above zero
    rest = all_k.agg(F.sum(alpha * beta / base).alias("rest"))
    by_d = n_dk.join(F.broadcast(all_k), "topic").groupBy("doc_id").agg(F.sum(F.col("dk") * beta / base).alias("of_d"))
    by_w = n_kw.join(F.broadcast(all_k), "topic").groupBy("word_id").agg(F.sum(F.col("kw") * alpha / base).alias("of_w"))
    pairs = tokens.groupBy("doc_id", "word_id").agg(F.count("*").alias("n"))
    both = pairs.join(n_dk, "doc_id").join(n_kw, ["word_id", "topic"]).join(F.broadcast(all_k), "topic").groupBy("doc_id", "word_id").agg(F.sum(F.col("dk") * F.col("kw") / base).alias("of_dw"))
    p = pairs.join(n_d, "doc_id").join(by_d, "doc_id").join(by_w, "word_id").join(both, ["doc_id", "word_id"], "left").crossJoin(F.broadcast(rest))
    inner = (F.col("rest") + F.col("of_d") + F.col("of_w") + F.coalesce("of_dw", F.lit(0.0))) / (F.col("d") + alpha * topics)
    return p.agg(F.sum("n").alias("tokens"), F.exp(-F.sum(F.col("n") * F.log(inner)) / F.sum("n")).alias("perplexity"))


def rating_errors(ratings: DataFrame, users: DataFrame, products: DataFrame) -> DataFrame:
    """ratings with predicted and error, from factor tables (key, values)."""
    u, p = users.select(F.col("key").alias("uid"), F.col("values").alias("__u")), products.select(F.col("key").alias("pid"), F.col("values").alias("__p"))
    own = ratings.join(u, "uid").join(p, "pid").withColumn("predicted", C.dot(F.col("__u"), F.col("__p"))).drop("__u", "__p")
    return own.withColumn("error", F.col("rating") - F.col("predicted"))


def rmse(errors: DataFrame, users: int, products: int) -> DataFrame:
    """One row (rmse, rmse_by_cells): over the ratings, and over all cells of the matrix."""
    return errors.agg(F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.sqrt(F.sum(F.col("error") * F.col("error")) / F.lit(float(users) * products)).alias("rmse_by_cells"))
