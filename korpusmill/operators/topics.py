"""Naive Bayes topics: priors, likelihoods and detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MODELS = ("multinomial", "bernoulli")


def topic_priors(assigned: DataFrame, max_topics: int | None = 40) -> DataFrame:
    """(topic, n, logp) of the ``max_topics`` most frequent topics (None: of all); ``assigned`` has doc_id, topic."""
    counts = assigned.where(F.col("topic").isNotNull()).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    priors = counts.crossJoin(F.broadcast(total)).select("topic", "n", F.ln(F.col("n") / F.col("total")).alias("logp"))
    return priors if max_topics is None else priors.orderBy(F.desc("n"), "topic").limit(max_topics)


def word_topic_counts(words: DataFrame, assigned: DataFrame, priors: DataFrame, model: str) -> DataFrame:
    """(word, topic, n) over surviving topics; once per document for Bernoulli."""
    if model not in MODELS:
        raise ValueError(f"model must be one of {MODELS}")
    rows = words.select("doc_id", "word")
    rows = rows.distinct() if model == "bernoulli" else rows
    tagged = rows.join(assigned.select("doc_id", "topic"), "doc_id").join(F.broadcast(priors.select("topic")), "topic", "left_semi")
    return tagged.groupBy("word", "topic").agg(F.count(F.lit(1)).alias("n"))


def _grid(counts: DataFrame, priors: DataFrame) -> DataFrame:
    """Every known word with every surviving topic (a row per word and topic)."""
    topics = priors.agg(F.collect_list("topic").alias("ts"))
    by_word = counts.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("topic", "n"))).alias("by"), F.sum("n").alias("total"))
    rows = by_word.crossJoin(F.broadcast(topics)).select("word", "total", "by", F.explode("ts").alias("topic"))
    return rows.select("word", "total", "topic", F.coalesce(F.try_element_at("by", F.col("topic")), F.lit(0)).alias("n"))


def multinomial_likelihood(counts: DataFrame, priors: DataFrame) -> DataFrame:
    """(word, topic, logp): ln((c + 1) / (sum over topics + number of topics))."""
    k = priors.agg(F.count(F.lit(1)).alias("k"))
    return _grid(counts, priors).crossJoin(F.broadcast(k)).select("word", "topic", F.ln((F.col("n") + 1) / (F.col("total") + F.col("k"))).alias("logp"))


def bernoulli_likelihood(counts: DataFrame, priors: DataFrame) -> DataFrame:
    """(word, topic, logp, logp_absent): document frequency with add-one smoothing and its complement."""
    size = priors.select("topic", F.col("n").alias("docs"))
    p = (F.col("n") + 1) / (F.col("docs") + 2)
    return _grid(counts, priors).join(F.broadcast(size), "topic").select("word", "topic", F.ln(p).alias("logp"), F.ln(1 - p).alias("logp_absent"))


def detect_topics(words: DataFrame, priors: DataFrame, likelihood: DataFrame, model: str = "multinomial", n_best: int = 3) -> DataFrame:
    """(doc_id, rank, topic, score): prior plus likelihoods of the known words, best first."""
    if model not in MODELS:
        raise ValueError(f"model must be one of {MODELS}")
    rows = words.select("doc_id", "word")
    rows = rows.distinct() if model == "bernoulli" else rows
    sums = rows.join(likelihood, "word").groupBy("doc_id", "topic").agg(F.sum("logp").alias("s"))
    every = words.select("doc_id").distinct().crossJoin(F.broadcast(priors.select("topic", F.col("logp").alias("prior"))))
    scored = every.join(sums, ["doc_id", "topic"], "left").withColumn("score", F.col("prior") + F.coalesce("s", F.lit(0.0)))
    w = W.partitionBy("doc_id").orderBy(F.desc(F.round("score", 9)), F.desc("topic"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_best).select("doc_id", "rank", "topic", "score")
