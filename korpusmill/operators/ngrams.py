"""n-gram statistics: counts, smoothed log-probabilities, look-ups, lengthening statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpusmill.functions.text import corpus_line, ngram_key, squeeze_runs, words_of_line

LAMBDA = 0.5
BOL, EOL = "bol", "eol"


def corpus_lines(documents: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, line) of the cleaned corpus; empty lines are dropped."""
    return documents.where(F.col(column).isNotNull()).select(F.col(key), corpus_line(F.col(column)).alias("line")).where("line <> ''")


def corpus_words(documents: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, pos, word) of the cleaned corpus."""
    lines = corpus_lines(documents, key, column)
    return lines.select(key, F.posexplode(F.split("line", " ")).alias("pos", "word"))


def unigram_counts(documents: DataFrame, column: str = "text") -> DataFrame:
    """(w, cnt): words between white space plus one end mark per line, by normalised key."""
    lines = documents.where(F.col(column).isNotNull())
    words = lines.select(F.explode(F.concat(words_of_line(F.col(column)), F.array(F.lit("<eol>")))).alias("w"))
    return words.groupBy(ngram_key(F.col("w")).alias("w")).agg(F.count(F.lit(1)).alias("cnt"))


def ngram_counts(documents: DataFrame, n: int = 2, column: str = "text") -> DataFrame:
    """(w1, ..., wn, cnt): windows of width n over begin mark, words and end mark."""
    keys = F.transform(words_of_line(F.col(column)), ngram_key)
    framed = documents.where(F.col(column).isNotNull()).select(F.concat(F.array(F.lit(BOL)), keys, F.array(F.lit(EOL))).alias("ws")).where(F.size("ws") >= n)
    grams = framed.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - (n - 1)), lambda i: F.slice("ws", i, n))).alias("g"))
    names = [f"w{i + 1}" for i in range(n)]
    return grams.select(*[F.col("g")[i].alias(name) for i, name in enumerate(names)]).groupBy(*names).agg(F.count(F.lit(1)).alias("cnt"))


def max_width(counts: DataFrame) -> DataFrame:
    """One row: distinct unigrams, or the most distinct successors of a context."""
    names = [c for c in counts.columns if c != "cnt"]
    if len(names) == 1:
        return counts.agg(F.count(F.lit(1)).alias("width"))
    return counts.groupBy(*names[:-1]).agg(F.count(F.lit(1)).alias("k")).agg(F.max("k").alias("width"))


def unigram_logprob(counts: DataFrame, lam: float = LAMBDA) -> DataFrame:
    """(w, cnt, logp): ln((c + lambda) / (N + lambda (V + 1))); the totals are one row."""
    totals = counts.agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("v"))
    return counts.crossJoin(F.broadcast(totals)).select("w", "cnt", F.ln((F.col("cnt") + lam) / (F.col("n") + lam * (F.col("v") + 1))).alias("logp"))


def bigram_logprob(counts: DataFrame, lam: float = LAMBDA) -> DataFrame:
    """(w1, w2, cnt, logp, ctx_default): per-context totals with the widest context's smoothing."""
    width = max_width(counts)
    total = F.sum("cnt").over(W.partitionBy("w1")) + lam * (F.col("width") + 1)
    return counts.crossJoin(F.broadcast(width)).withColumn("total", total).select("w1", "w2", "cnt", F.ln((F.col("cnt") + lam) / F.col("total")).alias("logp"), F.ln(F.lit(lam) / F.col("total")).alias("ctx_default"))


def unseen_default(counts: DataFrame, lam: float = LAMBDA) -> DataFrame:
    """One row: log-probability of a bigram whose context is unknown."""
    contexts = counts.groupBy("w1").agg(F.sum("cnt").alias("c"))
    return contexts.crossJoin(F.broadcast(max_width(counts))).agg(F.ln(F.lit(lam) / F.sum(F.col("c") + lam * (F.col("width") + 1))).alias("global_default"))


def lookup_bigrams(pairs: DataFrame, counts: DataFrame, lam: float = LAMBDA) -> DataFrame:
    """``pairs`` (w1, w2, ...) with logp: known bigram, else its context's default, else the global one."""
    probs = bigram_logprob(counts, lam)
    contexts = probs.groupBy("w1").agg(F.first("ctx_default").alias("ctx_default"))
    known = probs.select("w1", "w2", "logp")
    joined = pairs.join(known, ["w1", "w2"], "left").join(contexts, "w1", "left").crossJoin(F.broadcast(unseen_default(counts, lam)))
    return joined.withColumn("logp", F.coalesce("logp", "ctx_default", "global_default")).drop("ctx_default", "global_default")


def lengthened_stat(words: DataFrame, order: list[str], word: str = "word", share: float = 0.1) -> DataFrame:
    """(key, word, cnt, prob) of keys with several spellings.

    A word counts if its key has at least two characters and the word is lengthened or
    its key was met before (``order`` gives the sequence): the first lengthened position
    of a key decides, which is one aggregate over the lengthened words instead of a running scan.
    """
    keyed = words.select(*order, F.lower(F.col(word)).alias("word")).withColumn("key", squeeze_runs(F.col("word"))).where(F.length("key") > 1)
    place = F.struct(*order)
    first = keyed.where(F.col("key") != F.col("word")).groupBy("key").agg(F.min(place).alias("first"))
    counted = keyed.join(first, "key").where(place >= F.col("first")).groupBy("key", "word").agg(F.count(F.lit(1)).alias("cnt"))
    by_key = W.partitionBy("key")
    probs = counted.withColumn("prob", F.col("cnt") / F.sum("cnt").over(by_key)).withColumn("n_forms", F.count(F.lit(1)).over(by_key)).withColumn("top", F.max("prob").over(by_key))
    return probs.where((F.col("n_forms") >= 2) & (F.col("prob") > F.col("top") * share)).select("key", "word", "cnt", "prob")
