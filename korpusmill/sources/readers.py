"""Readers: text lines, JSON, XML, quoted tables, CoNLL, stand-off annotation, lexica, rules, vectors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korpusmill.functions.text import is_xml_tag, squeeze_space
from korpusmill.operators.lexicon import read_lexicon
from korpusmill.operators.packed import span_numbers
from korpusmill.operators.scans import ranked

TWEET = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("id_str", T.StringType()), ("created_at", T.StringType()), ("text", T.StringType()), ("lang", T.StringType()), ("in_reply_to_status_id", T.LongType()))])
#: Values that mean a missing one in the text formats (fixed values).
EMPTY_VALUES = ("_", "empty", "?", "unknown")


def null_if_empty(c):
    return F.when(c.isin(*EMPTY_VALUES), None).otherwise(c)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line_no, line): lines of text files without white space at their end.

    Large files are read in blocks by many tasks; a line's number is its rank by block and
    place in the block within its file.
    """
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    numbered = ranked(rows, ["file"], ["_block", "_at"], "_i", "_n")
    return numbered.select("file", (F.col("_i") + 1).cast("int").alias("line_no"), F.regexp_replace("value", r"\s+$", "").alias("line"))


def mark_skipped(lines: DataFrame, skip_line: str | None = None, skip_xml: bool = False) -> DataFrame:
    """``skipped``: lines that are passed on unprocessed."""
    cond = F.lit(False) if skip_line is None else F.col("line") == skip_line
    return lines.withColumn("skipped", cond | is_xml_tag(F.col("line")) if skip_xml else cond)


def read_tweets_json(spark: SparkSession, path: str, lang: str | None = "de") -> DataFrame:
    """(id, created_at, text) of JSON lines that have all three, in ``lang``; white space squeezed."""
    rows = spark.read.schema(TWEET).json(path).select(F.coalesce("id_str", F.col("id").cast("string")).alias("id"), "created_at", "text", "lang", "in_reply_to_status_id")
    rows = rows.where(F.col("id").isNotNull() & F.col("created_at").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(F.col("lang") == lang) if lang else rows
    return rows.select("id", "created_at", squeeze_space(F.col("text")).alias("text"), "in_reply_to_status_id")


def read_tweets_xml(spark: SparkSession, path: str, row_tag: str = "tweet") -> DataFrame:
    """(id, time, text) of every element; missing id and time are ``unknown``."""
    schema = T.StructType([T.StructField("_id", T.StringType()), T.StructField("_time", T.StringType()), T.StructField("_VALUE", T.StringType())])
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return rows.select(F.coalesce("_id", F.lit("unknown")).alias("id"), F.coalesce("_time", F.lit("unknown")).alias("time"), squeeze_space(F.col("_VALUE")).alias("text"))


def read_quoted_table(spark: SparkSession, path: str, columns: list[str], sep: str = "\t", header: bool = True) -> DataFrame:
    """Quoted records that may span lines; a record with too many fields fails the read."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, sep=sep, quote='"', escape='"', multiLine=True, mode="FAILFAST", header=header)


def parse_message_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, polarity, text), bad lines): three tab-separated fields, other numbers go apart."""
    parts = F.split("line", "\t")
    good = lines.where(F.size(parts) == 3).select(null_if_empty(parts[0]).alias("id"), null_if_empty(parts[1]).alias("polarity"), parts[2].alias("text"))
    return good, lines.where(F.size(parts) != 3)


def read_markables_xml(spark: SparkSession, path: str) -> DataFrame:
    """(file, markable_id, level, span, words, attrs) of markable elements in any level file."""
    names = ("id", "span", "mmax_level", "polarity", "intensity", "sarcasm", "preferred", "degree", "sentiment_ref", "emo_expression_ref", "anaphref")
    schema = T.StructType([T.StructField("_" + n, T.StringType()) for n in names])
    rows = spark.read.format("xml").option("rowTag", "markable").schema(schema).load(path).withColumn("file", F.input_file_name())
    attrs = F.map_filter(F.create_map(*[x for n in names[3:] for x in (F.lit(n), F.col("_" + n))]), lambda k, v: v.isNotNull())
    return rows.select("file", F.col("_id").alias("markable_id"), F.col("_mmax_level").alias("level"), F.col("_span").alias("span"), span_numbers(F.col("_span")).alias("words"), attrs.alias("attrs"))


def read_words_xml(spark: SparkSession, path: str) -> DataFrame:
    """(file, word_id, form) of stand-off word files."""
    schema = T.StructType([T.StructField("_id", T.StringType()), T.StructField("_VALUE", T.StringType())])
    rows = spark.read.format("xml").option("rowTag", "word").schema(schema).load(path)
    return rows.select(F.input_file_name().alias("file"), F.regexp_extract("_id", r"^word_(\d+)$", 1).try_cast("int").alias("word_id"), F.col("_VALUE").alias("form"))


def read_lexicon_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return read_lexicon(read_lines(spark, paths))


def read_rule_lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a rule file on the driver; rule files are small by nature."""
    lines = read_lines(spark, path).orderBy("line_no").limit(100_001).collect()
    if len(lines) > 100_000:
        raise ValueError("a rule file has more than 100,000 lines")
    return [r["line"] for r in lines]


def read_vectors(spark: SparkSession, path: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """(word, vector) of ``word v1 v2 ...`` lines, only words of the vocabulary, plus ``%UNK%`` as the mean."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("word"), F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: x.try_cast("float")).alias("vector"))
    kept = rows.join(vocabulary.select(F.col(vocabulary.columns[0]).alias("word")).distinct(), "word", "left_semi") if vocabulary is not None else rows
    mean = kept.select(F.posexplode("vector").alias("p", "x")).groupBy("p").agg(F.avg("x").alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"].cast("float")).alias("vector"))
    return kept.unionByName(mean.select(F.lit("%UNK%").alias("word"), "vector"))


#: Categories of connective lexica and their types (fixed values); others are adverbs.
CONNECTIVE_TYPES = {"konj": "conj", "coordconj": "conj", "subj": "subj", "postp": "subj", "praep": "prep"}


def read_connective_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(orth, type, ante, post, insert, rel) of an XML lexicon with ``entry`` elements."""
    part = T.StructType([T.StructField("part", T.ArrayType(T.StringType()))])
    order = T.StructType([T.StructField(n, T.StringType()) for n in ("ante", "post", "insert")])
    syn = T.StructType([T.StructField("_type", T.StringType()), T.StructField("order", order), T.StructField("rel", T.ArrayType(T.StringType()))])
    rows = spark.read.format("xml").option("rowTag", "entry").schema(T.StructType([T.StructField("orth", T.ArrayType(part)), T.StructField("syn", T.ArrayType(syn))])).load(path)
    types = F.create_map(*[x for k, v in CONNECTIVE_TYPES.items() for x in (F.lit(k), F.lit(v))])
    flag = lambda c: F.coalesce(c.isin("1", "true", "yes"), F.lit(False))
    one = rows.select(F.explode("orth.part").alias("orth"), F.explode(F.array(F.get("syn", F.lit(0)))).alias("s"))
    return one.select(F.transform("orth", lambda x: F.trim(x)).alias("orth"), F.coalesce(F.try_element_at(types, F.lower("s._type")), F.when(F.col("s._type").isin("conj", "subj", "prep", "adv"), F.col("s._type")), F.lit("adv")).alias("type"), flag(F.col("s.order.ante")).alias("ante"), flag(F.col("s.order.post")).alias("post"), flag(F.col("s.order.insert")).alias("insert"), F.coalesce("s.rel", F.array().cast("array<string>")).alias("rel"))


def number_words(lines: DataFrame) -> DataFrame:
    """(file, word_id, form): lines that are no tags, numbered per file."""
    rows = lines.where(~is_xml_tag(F.col("line")) & (F.col("line") != ""))
    return ranked(rows, ["file"], ["line_no"], "_i", "_n").select("file", (F.col("_i") + 1).cast("int").alias("word_id"), F.col("line").alias("form"))


def parts_of_corpus(messages: DataFrame, per_part: int = 99, group: str = "category", sub: str = "subcorpus", key: str = "id") -> DataFrame:
    """``part``: every subcorpus in parts of ``per_part`` messages, each proportional to its groups."""
    sizes = messages.groupBy(F.col(sub).alias("_s")).agg(F.ceil(F.count(F.lit(1)) / per_part).alias("_parts"))
    placed = ranked(messages, [sub, group], [key], "_i", "_n").join(sizes, F.col(sub).eqNullSafe(F.col("_s")))
    return placed.withColumn("part", (F.floor(F.col("_i") * F.col("_parts") / F.col("_n")) + 1).cast("int")).drop("_i", "_n", "_s", "_parts")


def drop_subcorpus(messages: DataFrame, name: str, sub: str = "subcorpus") -> DataFrame:
    return messages.where(~F.col(sub).eqNullSafe(F.lit(name)))


def regroup(messages: DataFrame, kinds: Iterable[str], by: str = "msg_type", sub: str = "subcorpus") -> DataFrame:
    """(subcorpus, msg_type, ids): the messages of each subcorpus by their type."""
    return messages.where(F.col(by).isin(*kinds)).groupBy(sub, by).agg(F.array_sort(F.collect_list("id")).alias("ids"))
