"""Classifiers learn what their features say."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from korpusmill.operators import models


def tokens(spark, n=60):
    rows = [(f"d{i}", 0, j, [f"w={'ab'[(i + j) % 2]}", "b"], "XY"[(i + j) % 2]) for i in range(n) for j in range(1, 5)]
    return spark.createDataFrame(rows, "doc_id string, sent_id int, idx int, features array<string>, tag string")


def test_token_tagger(spark):
    rows = tokens(spark)
    model = models.fit_token_tagger(rows.select("doc_id", "sent_id", "idx", "features"), rows.select("doc_id", "sent_id", "idx", "tag"), 1 << 10)
    assert model.transform(rows).where("predicted <> tag").count() == 0


def test_message_classifier(spark):
    rows = spark.createDataFrame([([w, "x"], p) for w, p in (("gut", "pos"), ("schlecht", "neg"), ("hm", "neut")) for _ in range(20)], "words array<string>, polarity string")
    assert models.fit_message_classifier(rows).transform(rows).where("predicted <> polarity").count() == 0


def test_sequence_plugin(spark):
    rows = tokens(spark, 10)
    sample = [([list(r["features"])], [r["tag"]]) for r in rows.collect()]
    model = models.Perceptron.fit(sample)
    got = models.tag_sequences(rows.select("doc_id", "sent_id", "idx", "features"), lambda: model)
    assert got.join(rows.select("doc_id", "sent_id", "idx", F.col("tag").alias("gold")), ["doc_id", "sent_id", "idx"]).where("tag <> gold").count() == 0


def test_vector_map(spark):
    rows = spark.createDataFrame([([float(i), float(i % 3)], [2.0 * i, 1.0 * (i % 3) - i]) for i in range(20)], "a array<double>, y array<double>").withColumn("x", array_to_vector("a"))
    first, second = models.map_vectors(rows, 2)
    assert abs(first.coefficients[0] - 2) < 1e-3 and abs(second.coefficients[0] + 1) < 1e-3
