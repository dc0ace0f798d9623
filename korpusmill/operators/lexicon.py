"""Polarity lexica: scan, conversion, look-up, sentence polarity with negation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANY = "..."
#: Tags that a coarse tag of a lexicon source stands for; any other tag stands for itself (fixed values).
FINE_TAGS = {
    "VV": ["VVINF", "VVFIN", "VVPP", "VVIMP", "VVIZU"],
    "VM": ["VMFIN", "VMINF", "VMPP"],
    "AD": ["ADJA", "ADJD", "ADV"],
    "AP": ["APPR", "APPRART", "APPO", "APZR"],
    "PI": ["PIS", "PIAT", "PIDAT"],
    "PT": ["PTKZU", "PTKNEG", "PTKVZ", "PTKANT", "PTKA"],
}
#: Macros of lexicon files and the tags they write out (fixed values).
MACROS = {"t_ADJX": ["ADJA", "ADJD"], "t_VVINF": ["VVINF", "VVIZU", "VVFIN"], "t_ANY": [ANY]}
#: Lemmas that carry no information (fixed values).
NOT_INFORMATIVE = (
    "sollen", "haben", "sein", "werden", "müssen", "wollen", "können", "mögen", "eine", "die",
    "mit", "ohne", "so", "dann", "hier", "also", "auch", "lt", "gt", "immer", "mehr",
)
#: Negating words (fixed values).
NEGATORS = ("keine", "nicht", "wenig", "kaum", "schwerlich")
NOUN_TAGS = ("NN", "NE", "XY")
VERB_TAGS = ("VVFIN", "VVIMP", "VVINF", "VVIZU", "VVPP", "VAFIN", "VAIMP", "VAINF", "VAPP", "VMFIN", "VMINF", "VMPP")
ADJ_TAGS = ("ADJA", "ADJD")
ADV_TAGS = ("ADV",)
#: Tags of words at which the scope of a negator ends (fixed values).
CANCELLED_BY = {
    "keine": NOUN_TAGS + VERB_TAGS,
    "nicht": VERB_TAGS + ADJ_TAGS + ADV_TAGS,
    "wenig": NOUN_TAGS + VERB_TAGS + ADJ_TAGS + ADV_TAGS,
    "kaum": NOUN_TAGS + VERB_TAGS + ADJ_TAGS + ADV_TAGS,
    "schwerlich": NOUN_TAGS + VERB_TAGS + ADJ_TAGS + ADV_TAGS,
}

LEXICON = T.StructType([T.StructField("class", T.StringType()), T.StructField("word", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("seq", T.LongType())])


def read_lexicon(lines: DataFrame) -> DataFrame:
    """Lexicon rows of a frame (file, line_no, line): class headers, comments, macros, lower-case words.

    The class header of a file holds for the lines after it; before it the class is the name of the file
    without path and ending. A macro may stand for the entry, ``t_X(word, score)``, or for its tag.
    """
    header = F.nullif(F.regexp_extract("line", r"^##!\s*CLASS:\s*(\S+)", 1), F.lit(""))
    w = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    classed = lines.withColumn("class", F.coalesce(F.last(header, ignorenulls=True).over(w), F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1)))
    body = F.trim(F.regexp_replace("line", r"(^|\s+)#.*$", ""))
    rows = classed.withColumn("body", body).where("body <> ''")
    macro = r"^(t_[A-Z]+)\(\s*([^,]+?)\s*,\s*([-+.\d]+)\s*\)"
    tags = F.create_map(*[x for name, fine in MACROS.items() for x in (F.lit(name), F.array(*map(F.lit, fine)))])
    name = F.regexp_extract("body", macro, 1)
    parts = F.split("body", r"\t")
    entry = F.when(name != "", F.transform(F.coalesce(F.try_element_at(tags, name), F.array(F.lit(ANY))), lambda t: F.struct(F.regexp_extract("body", macro, 2).alias("word"), t.alias("tag"), F.regexp_extract("body", macro, 3).alias("score"))))
    given = F.trim(F.get(parts, F.lit(1)))
    entry = entry.when(F.size(parts) >= 3, F.transform(F.coalesce(F.try_element_at(tags, given), F.array(given)), lambda t: F.struct(parts[0].alias("word"), t.alias("tag"), F.get(parts, F.lit(2)).alias("score"))))
    done = rows.select("class", F.col("line_no").cast("bigint").alias("seq"), F.explode(entry).alias("e"))
    return done.select("class", F.lower(F.trim("e.word")).alias("word"), F.trim("e.tag").alias("tag"), F.col("e.score").try_cast("double").alias("score"), "seq").where(F.col("score").isNotNull())


def convert_lexicon(source: DataFrame) -> DataFrame:
    """Six-field source (word, lemma, tag, polarity, scores, note, seq) to (word, tag, score).

    A coarse tag becomes its fine tags, another one stays; the score is the first part of a/b/c, ``-`` meaning
    0.3333; the first entry of a word and tag wins.
    """
    fine = F.create_map(*[x for name, tags in FINE_TAGS.items() for x in (F.lit(name), F.array(*map(F.lit, tags)))])
    part = F.element_at(F.split("scores", "/"), 1)
    rows = source.select(F.lower("lemma").alias("word"), F.explode(F.coalesce(F.try_element_at(fine, F.col("tag")), F.array("tag"))).alias("tag"), F.when(part == "-", F.lit(0.3333)).otherwise(part.try_cast("double")).alias("score"), "seq")
    return rows.groupBy("word", "tag").agg(F.min_by("score", "seq").alias("score"))


def lexicon_from(spark: SparkSession, entries: list[tuple[str, str, str, float]]) -> DataFrame:
    """A small lexicon given in code: (class, word, tag, score), later entries overwrite earlier ones."""
    return spark.createDataFrame([(c, w, t, float(s), i) for i, (c, w, t, s) in enumerate(entries)], LEXICON)


def last_wins(lexicon: DataFrame) -> DataFrame:
    """One entry per word and tag, the last one."""
    return lexicon.groupBy("word", "tag").agg(F.max_by("score", "seq").alias("score"), F.max_by("class", "seq").alias("class"))


def lookup(tokens: DataFrame, lexicon: DataFrame, lemma: str = "lemma", tag: str = "pos") -> DataFrame:
    """Tokens with ``score`` and ``class``: the entry of lemma and tag, else the one for any tag.

    The joins are left to the planner: it broadcasts the lexicon if its size allows.
    """
    best = last_wins(lexicon)
    exact = best.where(F.col("tag") != ANY).select(F.col("word").alias("_w"), F.col("tag").alias("_t"), F.col("score").alias("_s1"), F.col("class").alias("_c1"))
    wild = best.where(F.col("tag") == ANY).select(F.col("word").alias("_v"), F.col("score").alias("_s2"), F.col("class").alias("_c2"))
    low = F.lower(F.col(lemma))
    joined = tokens.join(exact, (low == F.col("_w")) & (F.col(tag) == F.col("_t")), "left").join(wild, low == F.col("_v"), "left")
    return joined.withColumn("score", F.coalesce("_s1", "_s2")).withColumn("class", F.coalesce("_c1", "_c2")).drop("_w", "_t", "_s1", "_c1", "_v", "_s2", "_c2")


def is_informative(lemma, tag):
    """Verbs, nouns and adjectives of more than three letters that are no function words."""
    low = F.lower(lemma)
    return (tag.rlike("^[VN]") | tag.startswith("ADJ")) & (F.length(low) > 3) & ~low.isin(*NOT_INFORMATIVE) & ~low.rlike(r"\p{Punct}")


def polarity_class(score):
    return F.when(score > 0, "pos").when(score < 0, "neg").otherwise("neut")


def sentence_polarity(tokens: DataFrame, lexicon: DataFrame, by: list[str]) -> DataFrame:
    """(by, score, polarity, n_informative): sum of weights per sentence."""
    scored = lookup(tokens, lexicon)
    info = (F.col("score").isNull() & is_informative(F.col("lemma"), F.col("pos"))).cast("int")
    return scored.groupBy(*by).agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("score"), F.sum(info).alias("n_informative")).withColumn("polarity", polarity_class(F.col("score")))


def sentence_polarity_negated(tokens: DataFrame, lexicon: DataFrame, by: list[str], order: str = "idx", literal: bool = False) -> DataFrame:
    """Sentence polarity with negation as a fold over the ordered tokens of a sentence.

    A negator is pushed on a stack and flips the weights of polar words until a word with
    a cancelling tag comes. With ``literal`` the negators left at the end flip the first
    stored weights again, as the literal rule does; by default they have no further effect.
    """
    scored = lookup(tokens, lexicon)
    cancels = F.create_map(*[x for n, tags in CANCELLED_BY.items() for x in (F.lit(n), F.array(*map(F.lit, tags)))])
    item = F.struct(F.col(order).alias("i"), F.lower("lemma").alias("lemma"), F.coalesce("pos", F.lit("")).alias("tag"), F.col("score").alias("s"))
    grouped = scored.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("ts"))
    zero = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<double>").alias("weights"))

    def step(acc, t):
        stack, weights = acc["stack"], acc["weights"]
        top = F.try_element_at(stack, F.lit(-1))
        polar = t["s"].isNotNull()
        negator = ~polar & t["lemma"].isin(*NEGATORS)
        ends = ~polar & ~negator & top.isNotNull() & F.array_contains(F.coalesce(F.try_element_at(cancels, top), F.array().cast("array<string>")), t["tag"])
        return F.struct(
            F.when(negator, F.concat(stack, F.array(t["lemma"]))).when(ends, F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(stack).alias("stack"),
            F.when(polar, F.concat(weights, F.array(F.when(top.isNotNull(), -t["s"]).otherwise(t["s"])))).otherwise(weights).alias("weights"),
        )

    folded = F.aggregate("ts", zero, step)
    rows = grouped.select(*by, folded.alias("f"))
    left = F.size("f.stack")
    total = F.aggregate("f.weights", F.lit(0.0), lambda a, x: a + x)
    if literal:
        flipped = F.aggregate(F.slice("f.weights", F.lit(1), F.greatest(left, F.lit(1))), F.lit(0.0), lambda a, x: a + x)
        total = F.when(left > 0, total - 2 * flipped).otherwise(total)
    return rows.select(*by, total.alias("score"), left.alias("open_negators")).withColumn("polarity", polarity_class(F.col("score")))
