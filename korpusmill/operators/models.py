"""Classifiers: token tagger baseline, message classifier, pluggable sequence taggers, vector maps."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import CountVectorizer, HashingTF, IndexToString, StringIndexer
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tagger takes the feature lists of a sentence and yields a tag for each token.
SequenceTagger = Callable[[list[list[str]]], list[str]]


def fit_token_tagger(features: DataFrame, tags: DataFrame, dimensions: int = 1 << 16, c2: float = 1e-4) -> PipelineModel:
    """Logistic regression on hashed token features; ``features``: (.., features), ``tags``: (.., tag)."""
    rows = features.join(tags, ["doc_id", "sent_id", "idx"])
    index = StringIndexer(inputCol="tag", outputCol="label", handleInvalid="keep", stringOrderType="alphabetAsc").fit(rows)
    stages = [index, HashingTF(inputCol="features", outputCol="x", numFeatures=dimensions), LogisticRegression(featuresCol="x", labelCol="label", regParam=c2, maxIter=20), IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels + ["O"])]
    return Pipeline(stages=stages).fit(rows)


def fit_message_classifier(messages: DataFrame, label: str = "polarity", max_words: int = 20_000) -> PipelineModel:
    """Linear support vectors, one against the rest, on word counts of ``words``."""
    index = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc").fit(messages)
    stages = [index, CountVectorizer(inputCol="words", outputCol="x", vocabSize=max_words, minDF=2.0), OneVsRest(classifier=LinearSVC(maxIter=15, regParam=0.01), featuresCol="x", labelCol="y"), IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)]
    return Pipeline(stages=stages).fit(messages)


def tag_sequences(features: DataFrame, make: Callable[[], SequenceTagger]) -> DataFrame:
    """(doc_id, sent_id, idx, tag) by any sequence model; ``make`` builds it once per task.

    The plug-in point for taggers, parsers, role labellers and recurrent networks.
    """
    rows = features.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("idx", "features"))).alias("ts"))

    def run(batches):
        tagger = make()
        for batch in batches:
            out = []
            for doc, sent, ts in zip(batch["doc_id"], batch["sent_id"], batch["ts"]):
                tags = tagger([list(t["features"]) for t in ts])
                if len(tags) != len(ts):
                    raise ValueError("a tagger must yield one tag per token")
                out += [(doc, sent, t["idx"], tag) for t, tag in zip(ts, tags)]
            yield pd.DataFrame(out, columns=["doc_id", "sent_id", "idx", "tag"])

    return rows.mapInPandas(run, "doc_id string, sent_id int, idx int, tag string")


class Perceptron:
    """Greedy structured perceptron with the previous tag as a feature: a small sequence model without outer tools."""

    def __init__(self, weights: dict[tuple[str, str], float], tags: list[str]):
        self.weights, self.tags = weights, tags

    def __call__(self, sentence: list[list[str]]) -> list[str]:
        out, previous = [], "^"
        for features in sentence:
            feats = [*features, "prev=" + previous]
            previous = max(self.tags, key=lambda t: (sum(self.weights.get((f, t), 0.0) for f in feats), t))
            out.append(previous)
        return out

    @classmethod
    def fit(cls, sentences: list[tuple[list[list[str]], list[str]]], epochs: int = 5) -> Perceptron:
        """Averaged weights from a sample of sentences that the caller has bounded."""
        tags = sorted({t for _, ts in sentences for t in ts})
        weights: dict[tuple[str, str], float] = {}
        sums: dict[tuple[str, str], float] = {}
        step, model = 1, cls(weights, tags)
        for _ in range(epochs):
            for feats, gold in sentences:
                found, before = model(feats), "^"
                for f, g, p in zip(feats, gold, found):
                    if g != p:
                        for name in (*f, "prev=" + before):
                            for tag, delta in ((g, 1.0), (p, -1.0)):
                                weights[name, tag] = weights.get((name, tag), 0.0) + delta
                                sums[name, tag] = sums.get((name, tag), 0.0) + delta * step
                    before = p
                step += 1
        return cls({k: w - sums[k] / step for k, w in weights.items()}, tags)


def map_vectors(pairs: DataFrame, dimensions: int) -> list[LinearRegression]:
    """Least-squares map of ``x`` vectors to each coordinate of ``y`` (array column): one model per coordinate."""
    return [LinearRegression(featuresCol="x", labelCol="t", solver="normal", regParam=1e-9).fit(pairs.withColumn("t", F.col("y")[k].cast("double"))) for k in range(dimensions)]
