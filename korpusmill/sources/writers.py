"""Writers of text formats; every sink is a distributed write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESC = "\x1b"


def escaped_blocks(messages: DataFrame) -> DataFrame:
    """(id, value): metadata lines, text and the blank line after it as one value per message."""
    meta = F.concat(F.lit(f"{ESC}\tid\t"), F.coalesce("id", F.lit("unknown")), F.lit(f"\n{ESC}\tpolarity\t"), F.coalesce("polarity", F.lit("unknown")))
    return messages.select("id", F.concat(meta, F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("value"))


def tab_lines(rows: DataFrame, columns: list[str], empty: str = "_") -> DataFrame:
    """(value): tab-separated lines; nulls as the empty mark, tabs and line ends in values as blanks."""
    cell = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]+", " "), F.lit(empty))
    return rows.select(F.concat_ws("\t", *map(cell, columns)).alias("value"))


def write_text(values: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Text files; ``order`` sorts globally by range so that the files in turn are sorted."""
    rows = values.repartitionByRange(*order).sortWithinPartitions(*order) if order else values
    rows.select("value").write.mode("overwrite").text(path)


def write_words_xml(words: DataFrame, path: str) -> None:
    """Stand-off word files: ``word`` elements with their id."""
    rows = words.select(F.concat(F.lit("word_"), F.col("word_id").cast("string")).alias("_id"), F.coalesce("form", F.lit("")).alias("_VALUE"))
    rows.write.format("xml").option("rootTag", "words").option("rowTag", "word").mode("overwrite").save(path)


def write_atoms(atoms: DataFrame, path: str) -> None:
    write_text(atoms.select(F.col("atom").alias("value")), path)


def write_table(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Statistics tables as parquet, optionally partitioned."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
