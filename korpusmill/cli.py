"""Command line: run a query over a folder of tables, or clean a file of messages.

    python -m korpusmill.cli query p3_found --data DIR --out DIR
    python -m korpusmill.cli clean messages.json --format json --out DIR
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusmill.operators.noise import clean_noise
from korpusmill.session import ship_package
from korpusmill.sources import readers, writers


@dataclass(frozen=True)
class Options:
    """What the commands share."""

    out: str
    form: str = "parquet"
    lang: str | None = None


def read_messages(spark: SparkSession, path: str, kind: str, lang: str | None = None) -> DataFrame:
    """(id, text) of a file of messages in one of the formats json, xml, tsv and txt."""
    if kind not in ("json", "xml", "tsv", "txt"):
        raise ValueError(f"unknown format {kind}")
    if kind == "json":
        return readers.read_tweets_json(spark, path, lang).select("id", "text")
    if kind == "xml":
        return readers.read_tweets_xml(spark, path).select("id", "text")
    lines = readers.read_lines(spark, path)
    if kind == "tsv":
        return readers.parse_message_lines(lines)[0].select("id", "text")
    return lines.where("line <> ''").select(F.concat_ws(":", "file", "line_no").alias("id"), F.col("line").alias("text"))


def save(rows: DataFrame, options: Options) -> None:
    if options.form == "text":
        writers.write_text(writers.tab_lines(rows, rows.columns), options.out)
    else:
        writers.write_table(rows, options.out)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="korpusmill", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    query = commands.add_parser("query", help="run a query and save its rows")
    query.add_argument("name")
    query.add_argument("--data", required=True)
    clean = commands.add_parser("clean", help="clean the messages of a file")
    clean.add_argument("file")
    clean.add_argument("--format", choices=("json", "xml", "tsv", "txt"), default="txt")
    clean.add_argument("--lang")
    for command in (query, clean):
        command.add_argument("--out", required=True)
        command.add_argument("--as", dest="form", choices=("parquet", "text"), default="parquet")
    given = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("korpusmill").getOrCreate()
    ship_package(spark)
    options = Options(given.out, given.form)
    if given.command == "query":
        from korpusmill.plans.registry import QUERIES

        save(QUERIES[given.name](spark, given.data), options)
    else:
        messages = read_messages(spark, given.file, given.format, given.lang)
        save(messages.select("id", clean_noise(F.col("text")).getField("text").alias("text")), options)


if __name__ == "__main__":
    main()
