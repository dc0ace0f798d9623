"""Stand-off annotation: markables on words, joins, integrity, restoring replacements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpusmill.operators.packed import span_numbers
from korpusmill.operators.scans import prefix_sums

LEVELS = ("sentiment", "target", "source", "emo-expression", "intensifier", "diminisher", "negation")


def current_words(words: DataFrame) -> DataFrame:
    """One row per (file_name, word_id) without deleted ones, the first loaded."""
    return words.where("deleted_at is null").groupBy("file_name", "word_id").agg(F.min_by("form", F.struct("loaded_at", "form")).alias("form"))


def current_markables(markables: DataFrame) -> DataFrame:
    """Live markables, re-delivered rows once (smallest key)."""
    w = W.partitionBy("file_name", "annotator", "anno_level", "markable_id").orderBy("mk_key")
    ranked = markables.where("deleted_at is null").withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return ranked.select("file_name", "annotator", "anno_level", "markable_id", "mk_key", "span", "sentiment_ref", "emo_expression_ref", "attrs")


def reference_id(c):
    """Markable id of a reference, null for null, empty and ``empty``."""
    plain = F.regexp_replace(c, r"\s+", "")
    return F.when(plain.isin("", "empty"), None).otherwise(F.element_at(F.split(plain, ":"), -1))


def markable_words(markables: DataFrame) -> DataFrame:
    """(file_name, annotator, level, own_id, word_id, is_first): a row per word of each markable.

    The id of a markable with a reference is the referenced one. All words carry the
    mark, only the first of a span carries the attributes.
    """
    own = F.coalesce(reference_id(F.col("sentiment_ref")), reference_id(F.col("emo_expression_ref")), F.col("markable_id"))
    rows = markables.select("file_name", "annotator", F.col("anno_level").alias("level"), own.alias("own_id"), "markable_id", "attrs", F.posexplode(span_numbers(F.col("span"))).alias("p", "word_id"))
    return rows.select("file_name", "annotator", "level", "own_id", "markable_id", "word_id", (F.col("p") == 0).alias("is_first"), F.when(F.col("p") == 0, F.col("attrs")).alias("attrs"))


def message_of_word(words: DataFrame) -> DataFrame:
    """(file_name, word_id, form, msg_no): messages end with the word EOL."""
    ends = F.coalesce((F.col("form") == "EOL").cast("int"), F.lit(0))
    return prefix_sums(words, ["file_name"], ["word_id"], {"msg_no": ends}, inclusive=False).where("form <> 'EOL'")


def level_flags(marks: DataFrame) -> DataFrame:
    """(file_name, annotator, word_id, is_target, is_source, is_sentiment, is_emo)."""
    flag = lambda level: F.bool_or(F.col("level") == level)
    return marks.groupBy("file_name", "annotator", "word_id").agg(flag("target").alias("is_target"), flag("source").alias("is_source"), flag("sentiment").alias("is_sentiment"), flag("emo-expression").alias("is_emo"))


def emo_inside(flags: DataFrame) -> DataFrame:
    """``has_emo``: whether the sentiment span a word lies in holds an emotional expression.

    A span is a run of consecutive sentiment words of an annotator; every word of it gets
    the flag, also those before the expression.
    """
    w = W.partitionBy("file_name", "annotator").orderBy("word_id")
    sent = flags.where("is_sentiment").withColumn("_new", F.when(F.col("word_id") - F.lag("word_id").over(w) == 1, 0).otherwise(1))
    runs = prefix_sums(sent, ["file_name", "annotator"], ["word_id"], {"span_no": F.col("_new")})
    has = runs.groupBy("file_name", "annotator", "span_no").agg(F.bool_or("is_emo").alias("has_emo"))
    return runs.join(has, ["file_name", "annotator", "span_no"]).select("file_name", "annotator", "word_id", "span_no", "has_emo")


def annotation_atoms(marks: DataFrame, prefix: str = "W") -> DataFrame:
    """(file_name, annotator, atom): isLevel(word) and hasLevelAttribute(word, VALUE) ground atoms, each once."""
    name = lambda c: F.regexp_replace(F.initcap(F.regexp_replace(c, r"[^A-Za-z]+", " ")), " ", "")
    word = F.concat(F.lit(f'"{prefix}_'), F.col("word_id").cast("string"), F.lit('"'))
    level = name(F.col("level"))
    is_ = F.array(F.concat(F.lit("is"), level, F.lit("("), word, F.lit(")")))
    has = F.transform(F.map_entries(F.coalesce("attrs", F.create_map().cast("map<string,string>"))), lambda e: F.concat(F.lit("has"), level, name(e["key"]), F.lit("("), word, F.lit(", "), F.upper(e["value"]), F.lit(")")))
    return marks.select("file_name", "annotator", F.explode(F.concat(is_, has)).alias("atom")).distinct()


def dangling_levels(marks: DataFrame) -> DataFrame:
    """Marks against the guideline: sources and targets in a file without any sentiment of the annotator."""
    has = marks.where("level = 'sentiment'").select("file_name", "annotator").distinct()
    return marks.where(F.col("level").isin("source", "target")).join(has, ["file_name", "annotator"], "left_anti")


def annotator_pairs(markables: DataFrame, level: str) -> DataFrame:
    """(file_name, word_id, a1, a2): words of a level by the two lowest annotators of each file, full join."""
    marks = markable_words(markables).where(F.col("level") == level)
    ranks = marks.select("file_name", "annotator").distinct().withColumn("k", F.row_number().over(W.partitionBy("file_name").orderBy("annotator"))).where("k <= 2")
    words = marks.join(ranks, ["file_name", "annotator"]).select("file_name", "word_id", "k").distinct()
    return words.groupBy("file_name", "word_id").agg(F.max((F.col("k") == 1).cast("int")).alias("a1"), F.max((F.col("k") == 2).cast("int")).alias("a2"))


def pairs_of_annotators(marks: DataFrame) -> DataFrame:
    """(file_name, annotator1, annotator2): every two annotators of a file, the lower one first."""
    who = marks.select("file_name", "annotator").distinct()
    first, second = who.withColumnRenamed("annotator", "annotator1"), who.withColumnRenamed("annotator", "annotator2")
    return first.join(second, "file_name").where("annotator1 < annotator2")


def marks_of_pairs(marks: DataFrame) -> DataFrame:
    """``marks`` once for each pair their annotator is in, with annotator1, annotator2 and k (1 or 2: which one it is)."""
    pairs = pairs_of_annotators(marks)
    sides = pairs.select("*", F.explode(F.array(F.struct(F.lit(1).alias("k"), F.col("annotator1").alias("annotator")), F.struct(F.lit(2).alias("k"), F.col("annotator2").alias("annotator")))).alias("s"))
    return marks.join(sides.select("file_name", "annotator1", "annotator2", "s.k", "s.annotator"), ["file_name", "annotator"])


def every_annotator_pair(markables: DataFrame, level: str) -> DataFrame:
    """(file_name, annotator1, annotator2, word_id, a1, a2): words of a level by every two annotators of each file, full join."""
    marks = marks_of_pairs(markable_words(markables).where(F.col("level") == level))
    flag = lambda k: F.max((F.col("k") == k).cast("int"))
    return marks.groupBy("file_name", "annotator1", "annotator2", "word_id").agg(flag(1).alias("a1"), flag(2).alias("a2"))


def split_by_difference(markables: DataFrame, attribute: str = "diff_type") -> tuple[DataFrame, DataFrame]:
    """(kept, differing): markables without and with a difference of kind missing or redundant."""
    kind = F.try_element_at("attrs", F.lit(attribute))
    differs = F.coalesce(kind.isin("missing", "redundant"), F.lit(False))
    return markables.where(~differs), markables.where(differs)


def restore_replacements(tokens: DataFrame, log: DataFrame, restore: list[str], key: str = "doc_id") -> DataFrame:
    """Tokens with the original text put back wherever a replacement lies inside them.

    ``tokens``: key, pos, token, start, len; ``log``: key, offset, length, orig, replacement.
    The offsets of a message bound the join: it goes per message.
    """
    wanted = log.where(F.col("replacement").isin(restore)).select(key, "offset", "length", "orig")
    inside = (F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("start") + F.col("len"))
    hits = tokens.join(wanted, key).where(inside).groupBy(key, "pos").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "orig")), asc=False).alias("h"))
    joined = tokens.join(hits, [key, "pos"], "left")

    def put(token, entry):
        at = entry["offset"] - F.col("start")
        return F.concat(F.substring(token, F.lit(1), at), entry["orig"], F.substring(token, at + entry["length"] + 1, F.length(token)))

    new = F.aggregate("h", F.col("token"), put)  # the last one first, so offsets before it hold
    return joined.select(key, "pos", F.when(F.col("h").isNotNull(), new).otherwise(F.col("token")).alias("token"), "start", "len")


def join_by_position(tokens: DataFrame, annotation: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """The k-th annotation of a group joined to its k-th token; unequal numbers raise."""
    w = W.partitionBy(*by).orderBy(order)
    left = tokens.withColumn("_k", F.row_number().over(w))
    right = annotation.withColumn("_k", F.row_number().over(w)).select(*by, "_k", value)
    joined = left.join(right.withColumn("_there", F.lit(True)), [*by, "_k"], "full")
    fits = F.col("_there").isNotNull() & F.col(order).isNotNull()
    return joined.withColumn("_ok", F.when(~fits, F.raise_error(F.lit("annotation and tokens differ in number"))).otherwise(F.lit(True))).where("_ok").drop("_k", "_there", "_ok")
