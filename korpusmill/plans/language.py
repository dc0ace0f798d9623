"""Queries: noise cleaning, sentences, grammar, connectives, alignment (fixture-tested, no SQL where none fits)."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpusmill.functions import text as fn
from korpusmill.operators import conll, discourse, grammar, ngrams, noise, segments
from korpusmill.operators.tokens import pattern_tokens
from korpusmill.plans.base import Registry
from korpusmill.session import table

R = Registry()


def _docs(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", "text", "lang")


def _tokens(spark, d):
    return conll.current_tokens(table(spark, d, "conll_words"))


@R.add()
def noise_clean(spark, d):
    rows = _docs(spark, d).select("doc_id", noise.clean_noise(F.col("text")).alias("c"))
    return rows.select("doc_id", F.col("c.text").alias("text"), F.size("c.log").alias("n_replaced"))


@R.add()
def replacement_log(spark, d):
    rows = _docs(spark, d).select("doc_id", noise.clean_noise(F.col("text")).alias("c"))
    return rows.select("doc_id", F.explode("c.log").alias("e")).select("doc_id", "e.offset", "e.length", "e.num", "e.orig", "e.replacement")


@R.add()
def noise_restore(spark, d):
    """User names put back into the tokens of the cleaned messages."""
    return noise.restored_tokens(_docs(spark, d), ["%User"])


@R.add()
def slang_normalize(spark, d):
    return _docs(spark, d).where("lang = 'de'").select("doc_id", noise.normalize_slang(F.col("text")).alias("text"))


@R.add()
def umlaut_restore(spark, d):
    rows = _docs(spark, d).where("lang = 'de'")
    candidate = F.when(F.col("text").rlike("(?i)[aou]e"), F.col("text"))  # the others stay in the JVM
    return rows.select("doc_id", F.coalesce(noise.UmlautRestorer().column(candidate).getField("text"), F.col("text")).alias("text"))


@R.add()
def corpus_preprocess(spark, d):
    """The whole preprocessing of German messages: plain characters, noise, slang, umlauts, then the corpus line."""
    rows = _docs(spark, d).where("lang = 'de'").select("doc_id", noise.clean_noise(fn.plain_characters(F.col("text"))).getField("text").alias("text"))
    slang = rows.select("doc_id", noise.normalize_slang(F.col("text")).alias("text"))
    candidate = F.when(F.col("text").rlike("(?i)[aou]e"), F.col("text"))
    restored = slang.select("doc_id", F.coalesce(noise.UmlautRestorer().column(candidate).getField("text"), F.col("text")).alias("text"))
    return ngrams.corpus_lines(restored)


@R.add()
def umlaut_restore_simple(spark, d):
    return _docs(spark, d).where("lang = 'de'").select("doc_id", fn.restore_umlauts_simple(F.col("text")).alias("text"))


@R.add()
def misspelling_restore(spark, d):
    docs = _docs(spark, d).where("lang = 'de'").select("doc_id", "text")
    words = ngrams.corpus_words(docs).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("word")
    return noise.restore_misspellings(docs, "text", words, unigrams=ngrams.unigram_counts(docs), bigrams=ngrams.ngram_counts(docs, 2))


@R.add()
def elongation_candidates(spark, d):
    words = _docs(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return noise.shortening_rows(words)


@R.add()
def squeeze_elongated(spark, d):
    tokens = _tokens(spark, d)
    docs = _docs(spark, d).where("lang = 'de'")
    words = ngrams.corpus_words(docs)
    dictionary = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("word")
    spread = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("pos", "word"))
    return noise.squeeze_elongated(tokens, dictionary, ngrams.ngram_counts(docs, 2), ngrams.unigram_counts(docs), ngrams.lengthened_stat(spread, ["doc_id", "pos"]))


@R.add(
    r"""with dict as (select distinct tag as word from tagset), w as (select distinct lower(pos) as word from conll_words where pos is not null)
 select w.word, coalesce(a.word is not null or b.word is not null, false) as known from w left join dict a on a.word = w.word left join dict b on b.word = upper(w.word[1:1]) || w.word[2:]"""
)
def dictionary_lookup(spark, d):
    entries = table(spark, d, "tagset").select(F.col("tag").alias("word"))
    words = table(spark, d, "conll_words").where("pos is not null").select(F.lower("pos").alias("word")).distinct()
    return noise.in_dictionary(words, entries)


@R.add(
    r"""with w as (select distinct lower(tag) as word from tagset), p as (select a.word, b.word as suggestion, levenshtein(a.word, b.word) as distance from w a, w b where abs(length(a.word) - length(b.word)) <= 1 and levenshtein(a.word, b.word) <= 1)
 select word, row_number() over (partition by word order by distance, suggestion)::int as rank, suggestion, distance::int as distance from p qualify rank <= 3"""
)
def dictionary_suggestions(spark, d):
    entries = table(spark, d, "tagset").select("tag")
    return noise.suggestions(entries, entries, "tag")


def _forms(spark, d):
    """Every form of the token files with its frequency."""
    return _tokens(spark, d).where("form is not null").groupBy(F.col("form").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@R.add(
    r"""with tok as (select * from conll_words qualify row_number() over (partition by doc_id, sent_id, idx order by tok_id) = 1), w as (select form as word, count(*) as n from tok where form is not null group by 1), dict as (select word from w where n >= 3)
 select w.word, coalesce(a.word is not null or b.word is not null, false) as known from w left join dict a on a.word = w.word left join dict b on b.word = upper(w.word[1:1]) || lower(w.word[2:])"""
)
def dictionary_lookup_all(spark, d):
    """Every word of the token files looked up among the frequent ones."""
    words = _forms(spark, d)
    return noise.in_dictionary(words.select("word"), words.where("n >= 3").select("word"))


@R.add()
def dictionary_suggestions_all(spark, d):
    """Frequent words near each word of the token files."""
    words = _forms(spark, d)
    return noise.suggestions(words, words.where("n >= 3").select("word"))


@R.add()
def sentence_split(spark, d):
    rows = _docs(spark, d).select("doc_id", F.posexplode(segments.sentences(F.col("text"))).alias("sent_id", "s"))
    return rows.select("doc_id", "sent_id", "s.sentence", "s.start")


@R.add()
def pattern_tokens_query(spark, d):
    return pattern_tokens(_docs(spark, d), "doc_id")


@R.add()
def token_alignment(spark, d):
    """Tokens of each message aligned to the words of its text between blanks."""
    tokens = _tokens(spark, d).select("doc_id", (F.col("sent_id") * 10_000 + F.col("idx")).alias("idx"), "form")
    texts = table(spark, d, "messages").where("text is not null").groupBy(F.col("id").alias("doc_id")).agg(F.min("text").alias("text"))
    words = texts.select("doc_id", F.posexplode(F.split("text", " ")).alias("word_id", "form"))
    return segments.merge_by_alignment(tokens, words)


@R.add(
    r"""with tok as (select * from conll_words qualify row_number() over (partition by doc_id, sent_id, idx order by tok_id) = 1), f as (select tok_id, regexp_extract_all(coalesce(feat, ''), '[a-z]+') as v from tok),
 b as (select tok_id, list_sum(list_transform(['nom', 'gen', 'dat', 'acc'], lambda x, i: (list_contains(v, x))::int * (1 << (i - 1)))) as c, list_sum(list_transform(['sg', 'pl'], lambda x, i: (list_contains(v, x))::int * (1 << (i - 1)))) as n,
 list_sum(list_transform(['masc', 'fem', 'neut'], lambda x, i: (list_contains(v, x))::int * (1 << (i - 1)))) as g from f) select tok_id, ((case when c = 0 then 15 else c end) + (case when n = 0 then 3 else n end) * 16 + (case when g = 0 then 7 else g end) * 64)::int as bits from b"""
)
def feature_bits(spark, d):
    return _tokens(spark, d).select("tok_id", grammar.feature_bits_column(F.col("feat")).alias("bits"))


@R.add()
def chunks(spark, d):
    return discourse.chunks(_tokens(spark, d))


@R.add()
def discourse_units(spark, d):
    return discourse.discourse_units(_tokens(spark, d))


@R.add()
def segment_offsets(spark, d):
    tokens = _tokens(spark, d)
    return discourse.segment_offsets(discourse.discourse_units(tokens), tokens)


@R.add()
def rst_nodes(spark, d):
    tokens = _tokens(spark, d)
    texts = tokens.where("form is not null").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_id", "idx", "form"))), lambda x: x["form"]), " ").alias("text"))
    return discourse.rst_nodes(discourse.segment_offsets(discourse.discourse_units(tokens), tokens), texts)


@R.add()
def units_xml(spark, d):
    return discourse.units_xml(discourse.discourse_units(_tokens(spark, d)))


def _connectives(spark, d):
    lexicon = spark.createDataFrame(discourse.CONNECTIVES, discourse.CONNECTIVE_DDL)
    return discourse.find_connectives(_tokens(spark, d), lexicon)


SINGLE = ", ".join(f"('{c[0][0]}', '{c[1]}')" for c in discourse.CONNECTIVES if len(c[0]) == 1 and " " not in c[0][0])


@R.add(f"with tok as (select * from conll_words qualify row_number() over (partition by doc_id, sent_id, idx order by tok_id) = 1), c(w, type) as (values {SINGLE}) select type, count(*) as n from tok join c on lower(form) = w where w not in ('aber') group by 1")
def connective_counts(spark, d):
    found = _connectives(spark, d).where((F.size("orth") == 1) & ~F.col("orth")[0].isin("aber", "ohne dass"))
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@R.add()
def connective_counts_all(spark, d):
    """Connectives by type, those of several parts or words too."""
    return _connectives(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@R.add()
def connective_arguments(spark, d):
    lexicon = spark.createDataFrame(discourse.CONNECTIVES, discourse.CONNECTIVE_DDL)
    scopes = discourse.connective_arguments(table(spark, d, "conll_words"), lexicon)
    return scopes.withColumn("orth", F.array_join("orth", " ")).withColumn("rel", F.array_join("rel", ","))
