"""Structured Streaming: message normalisation, windows over event time, reply counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from korpusmill.functions import text as fn


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    """A stream of parquet files with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def clean_messages(messages: DataFrame, column: str = "text") -> DataFrame:
    """Stateless normalisation of a message stream: characters, links, mail, users, dots, white space."""
    c = F.col(column)
    for f in (fn.plain_characters, fn.replace_links, fn.replace_mail, fn.replace_users, fn.cap_dots, fn.strip_hash_marks, fn.squeeze_space):
        c = f(c)
    return messages.withColumn(column, c)


def class_windows(events: DataFrame, time: str, klass: str, hours: int = 2, late: str = "1 day") -> DataFrame:
    """(start, class, n): tumbling windows of n hours; rows later than the watermark are left out."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, f"{hours} hours"), F.col(klass).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("start"), "class", "n")


def dedupe_stream(messages: DataFrame, key: str = "id", time: str = "loaded_at", late: str = "7 days") -> DataFrame:
    """Re-deliveries within the watermark left out."""
    return messages.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def _count_replies(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen = state.get[0] if state.exists else 0
    fresh = sum(len(r) for r in rows)
    state.update((seen + fresh,))
    yield pd.DataFrame({"parent": [key[0]], "n_replies": [seen + fresh]})


def reply_counts(messages: DataFrame) -> DataFrame:
    """(parent, n_replies): running number of replies to each message, kept as state."""
    replies = messages.where("in_reply_to_status_id is not null").select(F.col("in_reply_to_status_id").cast("string").alias("parent"), "id")
    return replies.groupBy("parent").applyInPandasWithState(_count_replies, "parent string, n_replies long", "n long", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a memory table (tests and small reports)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
