"""Time buckets of classified messages and the frequent words of each class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def time_buckets(rows: DataFrame, hours: int = 2, time: str = "ts", klass: str = "class", with_year: bool = False) -> DataFrame:
    """Counts per class and tumbling bucket of n hours keyed by month, day and hour range."""
    keys = [F.month(time).alias("month"), F.dayofmonth(time).alias("day"), F.expr(f"hour({time}) div {int(hours)}").cast("int").alias("hrange")]
    if with_year:
        keys.insert(0, F.year(time).alias("year"))
    return rows.where(F.col(time).isNotNull()).groupBy(*keys, F.col(klass).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def pivot_buckets(buckets: DataFrame, classes: list[str]) -> DataFrame:
    """One row per bucket with a column per class and the total."""
    keys = [c for c in buckets.columns if c not in ("class", "n")]
    return buckets.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("class") == c, F.col("n"))), F.lit(0)).alias(c) for c in classes], F.sum("n").alias("total"))


def merge_equal_spans(buckets: DataFrame) -> DataFrame:
    """Rows of equal month, day and range summed."""
    return buckets.groupBy("month", "day", "hrange").agg(F.sum("n").alias("n"))


def top_words(rows: DataFrame, n: int = 70, klass: str = "class", word: str = "word") -> DataFrame:
    """(class, rank, word, n): the n most frequent words of each class."""
    counts = rows.groupBy(F.col(klass).alias("class"), F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("class").orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("class", "rank", "word", "n")
