"""Queries of the training-data operators tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusmill.llm import bpe, canon, consensus, langid, leakage, mojibake, shared_spans
from korpusmill.session import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restore_tokens(table(spark, sf_dir, "conll_words"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.mislabelled_sentences(table(spark, sf_dir, "messages"), table(spark, sf_dir, "conll_words"))


def p1_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, words = table(spark, sf_dir, "messages"), table(spark, sf_dir, "conll_words")
    return langid.stretches(words, langid.train(messages, words)).withColumn("confidence", F.round("confidence", 4))


def p1_message_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.message_languages(spark, table(spark, sf_dir, "messages"), table(spark, sf_dir, "conll_words"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.canonical_tokens(table(spark, sf_dir, "conll_words"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus_passages(table(spark, sf_dir, "markables")).select("file_name", "first_word", "last_word", "polarity")


def p7_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = consensus.Consensus(consensus.passage_votes(table(spark, sf_dir, "markables")))
    return fitted.annotators.select("annotator", "competence", F.explode("guess").alias("label", "guess")).withColumn("guess", F.round("guess", 6))


def p7_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.agreement_alpha(consensus.passage_votes(table(spark, sf_dir, "markables")))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    decoded = bpe.decode_corpus(bpe.encode_corpus(documents)).withColumnRenamed("text", "decoded")
    same = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")
    return documents.select("doc_id", "text").join(decoded, "doc_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(same.cast("int")).alias("n_same"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leak_containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_characters(table(spark, sf_dir, "documents"))


def p10_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.span_clusters(table(spark, sf_dir, "documents"))


_ALL = (
    p1_found, p1_stretches, p1_message_languages, p4_found, p6_found, p7_found, p7_reliability, p7_agreement, p8_ids, p8_roundtrip,
    p9_found, p9_containment, p10_found, p10_clusters,
)
QUERIES = {f.__name__: f for f in _ALL}
#: Words of problem 9 and their runs of 13 as text.
_WORDS = r"regexp_extract_all(lower(nfc_normalize(regexp_replace(text, '[\p{Cf}\x{34F}\x{FE00}-\x{FE0F}]', '', 'g'))), '[\p{L}\p{N}]+')"
_GRAMS = f"""d as (select doc_id, {_WORDS} as ws from documents where text is not null), i as (select item_id, {_WORDS} as ws from eval_items where text is not null),
dg as (select distinct doc_id, array_to_string(ws[k:k + 12], ' ') as g from (select *, unnest(range(1, len(ws) - 11)) as k from d where len(ws) >= 13)),
ig as (select distinct item_id, array_to_string(ws[k:k + 12], ' ') as g from (select *, unnest(range(1, len(ws) - 11)) as k from i where len(ws) >= 13))"""
#: Distinct votes of problem 7, spans as sorted word lists.
_VOTES = r"""w as (select file_name, annotator, markable_id, attrs['polarity'] as label, list_sort(list_distinct(list_filter(flatten(list_transform(regexp_extract_all(regexp_replace(span, '\s*\.{2,}\s*', '..', 'g'), '[^"|;,/\t ]+'),
 lambda p: case when p like '%..%' then range(cast(regexp_extract(p, '^(?:word_)?(\d+)', 1) as int), cast(regexp_extract(p, '(\d+)$', 1) as int) + 1) else [try_cast(regexp_extract(p, '^word_(\d+)$', 1) as bigint)] end)), lambda x: x is not null))) as words
 from markables where anno_level = 'sentiment' and span is not null and span not in ('', '_', 'empty')),
per as (select file_name, words, annotator, label, count(*) as n from (select distinct * from w where annotator is not null and label is not null and len(words) > 0) group by all),
v as (select file_name, words, annotator, arg_min(label, (-n, label)) as label from per group by 1, 2, 3)"""

ORACLES: dict[str, str] = {
    "p9_found": f"with {_GRAMS} select distinct doc_id, item_id from dg join ig using (g)",
    "p9_containment": f"with {_GRAMS}, n as (select item_id, count(*) as n_windows from ig group by 1) select doc_id, item_id, count(*) as n_shared, any_value(n_windows) as n_windows, round(count(*) / any_value(n_windows), 6) as containment from dg join ig using (g) join n using (item_id) group by 1, 2",
    "p10_found": """with w as (select doc_id, pos, text[pos:pos + 119] as s from (select doc_id, text, unnest(range(1, length(text) - 118)) as pos from documents where length(text) >= 120)),
 sh as (select s from w group by 1 having min(doc_id) < max(doc_id)), c as (select doc_id, pos, lag(pos) over (partition by doc_id order by pos) as before from w semi join sh using (s))
 select doc_id, sum(least(120, pos - coalesce(before, pos - 120)))::bigint as shared_chars from c group by 1""",
    "p7_agreement": f"""with {_VOTES}, m as (select file_name, words, count(*) as m from v group by 1, 2 having count(*) >= 2), c as (select file_name, words, label, count(*) as c from v semi join m using (file_name, words) group by 1, 2, 3),
 i as (select file_name, words, sum(c) as m, sum(c * c) as sq from c group by 1, 2), p as (select sum(m) as n, count(*) as n_items, sum((m * m - sq) / (m - 1)) as differ from i), e as (select sum(k * k) as sq from (select label, sum(c) as k from c group by 1))
 select n_items, n::bigint as n_votes, round(1 - (n - 1) * differ / (n * n - sq), 6) as alpha from p, e""",
    "p8_roundtrip": "select count(*) as n_docs, count(*) as n_same from documents",
    "p10_clusters": """with recursive w as (select doc_id, text[pos:pos + 119] as s from (select doc_id, text, unnest(range(1, length(text) - 118)) as pos from documents where length(text) >= 120)),
 e as (select distinct w.doc_id as a, h.head as b from w join (select s, min(doc_id) as head from w group by 1 having min(doc_id) < max(doc_id)) h using (s)), both_ways as (select a, b from e union select b, a from e),
 reach(node, other) as (select a, a from both_ways union select r.node, b.b from reach r join both_ways b on b.a = r.other)
 select node as doc_id, min(other) as cluster from reach group by 1""",
}
