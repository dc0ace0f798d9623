"""Streams over the test tables give what the batch gives."""

from pyspark.sql import functions as F

from korpusmill.operators import timeseries
from korpusmill.session import table
from korpusmill.streaming import pipelines


def copy(df, path, parts=3):
    df.repartition(parts).write.mode("overwrite").parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_clean_stream(spark, data, tmp_path):
    docs = copy(table(spark, data, "messages").select("id", "text"), tmp_path / "m")
    stream = pipelines.clean_messages(pipelines.read_stream(spark, str(tmp_path / "m"), docs))
    got = pipelines.run_once(stream, spark, "cleaned")
    batch = pipelines.clean_messages(docs)
    assert got.exceptAll(batch).isEmpty() and batch.exceptAll(got).isEmpty()


def test_windows(spark, data, tmp_path):
    events = copy(table(spark, data, "events").select("ts", "event_type").withColumn("ts", F.col("ts").cast("timestamp")), tmp_path / "e", 1)
    stream = pipelines.class_windows(pipelines.read_stream(spark, str(tmp_path / "e"), events), "ts", "event_type", late="365 days")
    got = pipelines.run_once(stream, spark, "windows", "complete")
    batch = timeseries.time_buckets(events, 2, "ts", "event_type", with_year=True)
    assert got.agg(F.sum("n")).first()[0] == batch.agg(F.sum("n")).first()[0] and got.count() == batch.count()


def test_dedupe_stream(spark, data, tmp_path):
    messages = copy(table(spark, data, "messages").select("id", "loaded_at"), tmp_path / "d", 1)
    got = pipelines.run_once(pipelines.dedupe_stream(pipelines.read_stream(spark, str(tmp_path / "d"), messages), late="3650 days"), spark, "deduped")
    assert got.count() == messages.select("id").distinct().count()


def test_reply_counts(spark, data, tmp_path):
    messages = copy(table(spark, data, "messages").select("id", "in_reply_to_status_id"), tmp_path / "r", 2)
    got = pipelines.run_once(pipelines.reply_counts(pipelines.read_stream(spark, str(tmp_path / "r"), messages)), spark, "replies", "update")
    final = {r["parent"]: r["n"] for r in got.groupBy("parent").agg(F.max("n_replies").alias("n")).collect()}
    want = {r["parent"]: r["n"] for r in messages.where("in_reply_to_status_id is not null").groupBy(F.col("in_reply_to_status_id").cast("string").alias("parent")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert final == want
