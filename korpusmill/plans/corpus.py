"""Queries: text functions, n-gram statistics, topics on ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpusmill.functions import text as fn
from korpusmill.operators import ngrams, topics
from korpusmill.plans.base import Registry
from korpusmill.session import table

R = Registry()


def _german(spark, d):
    return table(spark, d, "documents").where("lang = 'de'")


CLEAN = r"""lines as (select doc_id, lower(trim(regexp_replace(text, '[[:punct:] \t\n\r\f]+', ' ', 'g'), ' ')) as line from documents where lang = 'de' and text is not null),
clean as (select * from lines where line <> '')"""
RAW = r"""raw as (select doc_id, list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda w: w <> '') as ws from documents where lang = 'de' and text is not null)"""
KEY = r"lower(trim(regexp_replace({}, '[[:punct:] \t\n\r\f]+', ' ', 'g'), ' '))"


@R.add("select doc_id, lang, n_chars from documents where lang = 'de'")
def lang_filter(spark, d):
    return _german(spark, d).select("doc_id", "lang", "n_chars")


@R.add(r"select doc_id, trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'), ' ') as text from documents where text is not null")
def whitespace_squeeze(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", fn.squeeze_space(F.col("text")).alias("text"))


@R.add(f"with {CLEAN} select * from clean")
def corpus_clean(spark, d):
    return ngrams.corpus_lines(_german(spark, d))


@R.add(f"with {CLEAN} select doc_id, unnest(range(len(string_split(line, ' '))))::int as pos, unnest(string_split(line, ' ')) as word from clean")
def tokenize_explode(spark, d):
    return ngrams.corpus_words(_german(spark, d))


@R.add(
    r"""with lines as (select doc_id, string_split(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'), ' '), ' ') as ts from documents where text is not null),
 t as (select doc_id, unnest(range(1, len(ts) + 1)) as i, unnest(ts) as token from lines)
 select doc_id, i::int - 1 as pos, token, (coalesce(sum(length(token) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0))::bigint as start, length(token)::int as len from t"""
)
def token_offsets(spark, d):
    from korpusmill.operators.tokens import token_table

    docs = table(spark, d, "documents").where("text is not null").select("doc_id", fn.squeeze_space(F.col("text")).alias("text"))
    return token_table(docs, "doc_id").select("doc_id", "pos", "token", "start", "len")


@R.add(f"with {RAW}, w as (select unnest(list_append(ws, '<eol>')) as w from raw) select {KEY.format('w')} as w, count(*) as cnt from w group by 1")
def unigram_counts(spark, d):
    return ngrams.unigram_counts(_german(spark, d))


@R.add(
    f"""with {RAW}, u as (select unnest(list_append(ws, '<eol>')) as w from raw), c as (select {KEY.format('w')} as w, count(*) as cnt from u group by 1),
 t as (select sum(cnt) as n, count(*) as v from c) select w, cnt, round(ln((cnt + 0.5) / (n + 0.5 * (v + 1))), 6) as logp from c, t"""
)
def unigram_logprob(spark, d):
    return ngrams.unigram_logprob(ngrams.unigram_counts(_german(spark, d))).select("w", "cnt", F.round("logp", 6).alias("logp"))


@R.add(
    f"""with {CLEAN}, u as (select unnest(string_split(line, ' ')) as w from clean), c as (select w, count(*) as cnt from u group by 1),
 t as (select sum(cnt) as n, count(*) as v from c) select w, cnt, round(ln((cnt + 0.5) / (n + 0.5 * (v + 1))), 6) as logp from c, t order by cnt desc, w limit 100"""
)
def unigram_logprob_top(spark, d):
    counts = ngrams.corpus_words(_german(spark, d)).groupBy(F.col("word").alias("w")).agg(F.count(F.lit(1)).alias("cnt"))
    return ngrams.unigram_logprob(counts).select("w", "cnt", F.round("logp", 6).alias("logp")).orderBy(F.desc("cnt"), "w").limit(100)


FRAMED = f"{RAW}, framed as (select list_concat(['bol'], list_transform(ws, lambda w: {KEY.format('w')}), ['eol']) as ws from raw)"
BIGRAMS = f"{FRAMED}, p as (select ws, unnest(range(1, len(ws))) as i from framed), b as (select ws[i] as w1, ws[i + 1] as w2, count(*) as cnt from p group by 1, 2)"


@R.add(f"with {BIGRAMS} select * from b")
def bigram_counts(spark, d):
    return ngrams.ngram_counts(_german(spark, d), 2)


@R.add(f"with {FRAMED}, p as (select ws, unnest(range(1, len(ws) - 1)) as i from framed) select ws[i] as w1, ws[i + 1] as w2, ws[i + 2] as w3, count(*) as cnt from p group by 1, 2, 3")
def trigram_counts(spark, d):
    return ngrams.ngram_counts(_german(spark, d), 3)


@R.add(f"with {BIGRAMS} select max(k) as width from (select w1, count(*) as k from b group by 1)")
def ngram_width(spark, d):
    return ngrams.max_width(ngrams.ngram_counts(_german(spark, d), 2))


@R.add(
    f"""with {BIGRAMS}, wd as (select max(k) as width from (select w1, count(*) as k from b group by 1)), x as (select w1, w2, cnt, sum(cnt) over (partition by w1) + 0.5 * (width + 1) as total from b, wd)
 select w1, w2, cnt, round(ln((cnt + 0.5) / total), 6) as logp, round(ln(0.5 / total), 6) as ctx_default from x"""
)
def bigram_logprob(spark, d):
    return ngrams.bigram_logprob(ngrams.ngram_counts(_german(spark, d), 2)).select("w1", "w2", "cnt", F.round("logp", 6).alias("logp"), F.round("ctx_default", 6).alias("ctx_default"))


@R.add(
    f"""with {BIGRAMS}, wd as (select max(k) as width from (select w1, count(*) as k from b group by 1)), ctx as (select w1, sum(cnt) + 0.5 * (any_value(width) + 1) as total from b, wd group by 1),
 g as (select ln(0.5 / sum(total)) as gd from ctx), q as (select distinct w1, 'die' as w2 from b union all values ('no such word', 'die'))
 select q.w1, q.w2, round(case when b.cnt is not null then ln((b.cnt + 0.5) / ctx.total) when ctx.total is not null then ln(0.5 / ctx.total) else gd end, 6) as logp
 from q left join b on b.w1 = q.w1 and b.w2 = q.w2 left join ctx on ctx.w1 = q.w1, g"""
)
def bigram_lookup(spark, d):
    counts = ngrams.ngram_counts(_german(spark, d), 2)
    pairs = counts.select("w1", F.lit("die").alias("w2")).distinct().unionByName(spark.createDataFrame([("no such word", "die")], "w1 string, w2 string"))
    return ngrams.lookup_bigrams(pairs, counts).select("w1", "w2", F.round("logp", 6).alias("logp"))


SQUEEZE = "list_aggregate(list_filter(list_transform(range(1, length({w}) + 1), lambda i: case when i > 1 and lower({w}[i:i]) = lower({w}[i - 1:i - 1]) and regexp_full_match({w}[i:i], '\\p{{L}}') then '' else {w}[i:i] end), lambda x: x <> ''), 'string_agg', '')"
LETTERS = "select distinct unnest(regexp_extract_all(text, '[\\p{L}]+')) as word from documents where text is not null"


@R.add(f"with w as ({LETTERS}) select word, coalesce({SQUEEZE.format(w='word')}, '') as squeezed from w")
def squeeze_runs(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", fn.squeeze_runs(F.col("word")).alias("squeezed"))


@R.add(
    f"""with w as ({LETTERS}) select word from w where len(list_filter(range(3, length(word) + 1), lambda i: lower(word[i:i]) = lower(word[i - 1:i - 1]) and lower(word[i - 1:i - 1]) = lower(word[i - 2:i - 2]))) > 0
 and not regexp_full_match(word, '[VILXCD]+')"""
)
def elongated_words(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word")).distinct()
    return words.where(fn.is_elongated(F.col("word")))


@R.add(
    f"""with l as (select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}]+') as ws from documents where lang = 'de' and text is not null), t as (select doc_id, unnest(range(1, len(ws) + 1)) as pos, unnest(ws) as word from l),
 dw as (select distinct word from t), sq as (select word, {SQUEEZE.format(w='word')} as key from dw), k as (select t.*, key, min(case when key <> t.word then (doc_id, pos) end) over (partition by key) as first from t join sq using (word) where length(key) > 1),
 c as (select key, word, count(*) as cnt from k where (doc_id, pos) >= first group by 1, 2), p as (select *, cnt / sum(cnt) over (partition by key) as prob, count(*) over (partition by key) as n from c)
 select key, word, cnt, round(prob, 6) as prob from (select *, max(prob) over (partition by key) as top from p) where n >= 2 and prob > top * 0.1"""
)
def lengthened_stat(spark, d):
    rows = _german(spark, d).where("text is not null").select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("pos", "word"))
    return ngrams.lengthened_stat(rows, ["doc_id", "pos"]).select("key", "word", "cnt", F.round("prob", 6).alias("prob"))


@R.add(r"select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '#([\p{L}0-9_]+)', 1))), '; ') as topics from documents where text is not null and text like '%#%'")
def hashtag_or_topic_set(spark, d):
    return table(spark, d, "documents").where("text like '%#%'").select("doc_id", fn.hashtag_set(F.col("text")).alias("topics"))


@R.add(r"select doc_id, regexp_replace(text, '[A-Za-z0-9][A-Za-z0-9_.+-]*@[A-Za-z0-9_]+(?:[.][A-Za-z0-9_]+)+', '%Mail', 'g') as text from documents where text is not null")
def mail_replace(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", fn.replace_mail(F.col("text")).alias("text"))


@R.add(r"select doc_id, regexp_replace(text, '(^|[ \t\n\r])@+[A-Za-z0-9_]+', '\1%User', 'g') as text from documents where text is not null")
def user_replace(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", fn.replace_users(F.col("text")).alias("text"))


@R.add(r"select doc_id, regexp_replace(text, '(?:https?://?|www[.])[^ \t\n\r,;]*[^ \t\n\r,.:;!?]', '%Link', 'g') as text from documents where text is not null")
def link_replace(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", fn.replace_links(F.col("text")).alias("text"))


@R.add(r"select doc_id, regexp_replace(regexp_replace(text, '\.{4,}', '...', 'g'), '!([!?]+)', '!', 'g') as text from documents where text is not null")
def dots_cap(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", fn.cap_dots(F.col("text")).alias("text"))


@R.add(r"select doc_id, regexp_replace(text, '(^|[ \t\n\r])[#_]+([^#_ \t\n\r])', '\1\2', 'g') as text from documents where text is not null")
def hash_strip(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", fn.strip_hash_marks(F.col("text")).alias("text"))


@R.add(
    """select doc_id, replace(replace(replace(translate(text, '“”„«»‘’‚–—', '"' || '"' || '"' || '"' || '"' || chr(39) || chr(39) || chr(39) || '--'), '…', '...'), '€', 'Euro'), 'ß', 'ss') as text
 from documents where text is not null"""
)
def character_normalize(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", fn.plain_characters(F.col("text")).alias("text"))


@R.add(r"with w as (select doc_id, list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda w: w <> '') as ws from documents where text is not null) select doc_id, len(ws)::int as n_words, len(list_distinct(ws))::int as n_types from w")
def word_counts(spark, d):
    ws = fn.words_of_line(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(ws).alias("n_words"), F.size(F.array_distinct(ws)).alias("n_types"))


@R.add(r"""select doc_id, replace(replace(replace(text, '&quot;', '"'), '&nbsp;', ' '), '&amp;', ' and ') as text from documents where text is not null""")
def entities(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", fn.unescape_entities(F.col("text")).alias("text"))


@R.add(
    r"""with s as (select doc_id, list_filter(string_split_regex(regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> '') as ss from documents where text is not null)
 select doc_id, len(ss)::int as n_sentences from s"""
)
def sentence_split_simple(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(fn.sentences_simple(F.col("text"))).alias("n_sentences"))


# --- topics: the source of a document is its topic ---------------------------------------

TOPIC = f"""{CLEAN}, asg as (select doc_id, source as topic from documents where lang = 'de' and text is not null and source is not null), wd as (select doc_id, unnest(string_split(line, ' ')) as word from clean),
 pr as (select topic, n, ln(n / sum(n) over ()) as logp from (select topic, count(*) as n from asg group by 1) order by n desc, topic limit 8)"""


def _topics(spark, d):
    docs = _german(spark, d).where("text is not null")
    return docs, docs.select("doc_id", F.col("source").alias("topic")).where("topic is not null"), ngrams.corpus_words(docs).select("doc_id", "word")


@R.add(f"with {TOPIC}, allp as (select topic, n, ln(n / sum(n) over ()) as logp from (select topic, count(*) as n from asg group by 1)) select topic, n, round(logp, 6) as logp from allp order by n desc, topic limit 8")
def topic_priors(spark, d, max_topics=8):
    _, assigned, _ = _topics(spark, d)
    return topics.topic_priors(assigned, max_topics).select("topic", "n", F.round("logp", 6).alias("logp"))


TOPIC = TOPIC.replace(
    " pr as (select topic, n, ln(n / sum(n) over ()) as logp from (select topic, count(*) as n from asg group by 1) order by n desc, topic limit 8)",
    " allp as (select topic, n, ln(n / sum(n) over ()) as logp from (select topic, count(*) as n from asg group by 1)), pr as (select * from allp order by n desc, topic limit 8)",
)
MULTI = f"{TOPIC}, tc as (select word, topic, count(*) as n from wd join asg using (doc_id) semi join pr using (topic) group by 1, 2), tot as (select word, sum(n) as total from tc group by 1), lik as (select tot.word, pr.topic, ln((coalesce(tc.n, 0) + 1) / (total + (select count(*) from pr))) as logp from tot cross join pr left join tc on tc.word = tot.word and tc.topic = pr.topic)"


@R.add(f"with {MULTI} select word, topic, round(logp, 6) as logp from lik")
def topic_likelihood_multinomial(spark, d, max_topics=8):
    _, assigned, words = _topics(spark, d)
    priors = topics.topic_priors(assigned, max_topics)
    return topics.multinomial_likelihood(topics.word_topic_counts(words, assigned, priors, "multinomial"), priors).select("word", "topic", F.round("logp", 6).alias("logp"))


BERN = f"{TOPIC}, tc as (select word, topic, count(*) as n from (select distinct doc_id, word from wd) join asg using (doc_id) semi join pr using (topic) group by 1, 2), tot as (select distinct word from tc), lik as (select tot.word, pr.topic, (coalesce(tc.n, 0) + 1) / (pr.n + 2) as p from tot cross join pr left join tc on tc.word = tot.word and tc.topic = pr.topic)"


@R.add(f"with {BERN} select word, topic, round(ln(p), 6) as logp, round(ln(1 - p), 6) as logp_absent from lik")
def topic_likelihood_bernoulli(spark, d, max_topics=8):
    _, assigned, words = _topics(spark, d)
    priors = topics.topic_priors(assigned, max_topics)
    done = topics.bernoulli_likelihood(topics.word_topic_counts(words, assigned, priors, "bernoulli"), priors)
    return done.select("word", "topic", F.round("logp", 6).alias("logp"), F.round("logp_absent", 6).alias("logp_absent"))


@R.add(
    f"""with {MULTI}, ev as (select distinct doc_id from wd), s as (select doc_id, topic, sum(lik.logp) as s from wd join lik using (word) group by 1, 2),
 sc as (select ev.doc_id, pr.topic, pr.logp + coalesce(s, 0) as score from ev cross join pr left join s on s.doc_id = ev.doc_id and s.topic = pr.topic),
 rk as (select *, row_number() over (partition by doc_id order by round(score, 9) desc, topic desc) as rank from sc) select doc_id, rank::int as rank, topic, round(score, 5) as score from rk where rank <= 3"""
)
def topic_detect_top3(spark, d, max_topics=8):
    _, assigned, words = _topics(spark, d)
    priors = topics.topic_priors(assigned, max_topics)
    likelihood = topics.multinomial_likelihood(topics.word_topic_counts(words, assigned, priors, "multinomial"), priors)
    return topics.detect_topics(words, priors, likelihood).select("doc_id", "rank", "topic", F.round("score", 5).alias("score"))


@R.add(
    f"""with {BERN}, l2 as (select word, topic, ln(p) as logp from lik), dwd as (select distinct doc_id, word from wd), ev as (select distinct doc_id from wd), s as (select doc_id, topic, sum(l2.logp) as s from dwd join l2 using (word) group by 1, 2),
 sc as (select ev.doc_id, pr.topic, pr.logp + coalesce(s, 0) as score from ev cross join pr left join s on s.doc_id = ev.doc_id and s.topic = pr.topic),
 rk as (select *, row_number() over (partition by doc_id order by round(score, 9) desc, topic desc) as rank from sc) select doc_id, rank::int as rank, topic, round(score, 5) as score from rk where rank <= 3"""
)
def topic_detect_bernoulli(spark, d, max_topics=8):
    _, assigned, words = _topics(spark, d)
    priors = topics.topic_priors(assigned, max_topics)
    likelihood = topics.bernoulli_likelihood(topics.word_topic_counts(words, assigned, priors, "bernoulli"), priors)
    return topics.detect_topics(words, priors, likelihood, "bernoulli").select("doc_id", "rank", "topic", F.round("score", 5).alias("score"))


@R.add(f"with {MULTI} select pr.topic, w.word from pr cross join (select distinct word from tc) w anti join tc on tc.topic = pr.topic and tc.word = w.word")
def topic_missing_words(spark, d, max_topics=8):
    _, assigned, words = _topics(spark, d)
    priors = topics.topic_priors(assigned, max_topics)
    counts = topics.word_topic_counts(words, assigned, priors, "multinomial")
    every = counts.select("word").distinct().crossJoin(F.broadcast(priors.select("topic")))  # a row per topic
    return every.join(counts, ["topic", "word"], "left_anti").select("topic", "word")


def _over_all_topics(query):
    """Registers the query over every topic, with its SQL without the limit of eight."""

    def run(spark, d):
        return query(spark, d, None)

    run.__name__ = f"{query.__name__}_all"
    R.add(R.oracles[query.__name__].replace(" order by n desc, topic limit 8", ""))(run)


for _query in (topic_priors, topic_likelihood_multinomial, topic_likelihood_bernoulli, topic_detect_top3, topic_detect_bernoulli, topic_missing_words):
    _over_all_topics(_query)


SOURCES = r"with f as (select source, unnest(list_filter(string_split_regex(regexp_replace(lower(text), ':[0-9.]+', '', 'g'), '[ \t\n\r\f]+'), lambda w: w <> '')) as feature from documents where text is not null and source in ('feed_01', 'feed_02')), a as (select distinct feature from f where source = 'feed_01'), b as (select distinct feature from f where source = 'feed_02')"


@R.add(f"{SOURCES} select (select count(*) from a) as n_first, (select count(*) from b) as n_second, (select count(*) from a semi join b using (feature)) as n_both, (select count(*) from (select * from a union select * from b)) as n_union")
def feature_set_compare(spark, d):
    from korpusmill.operators.evaluation import compare_feature_sets

    rows = table(spark, d, "documents").where("text is not null")
    feats = lambda s: rows.where(F.col("source") == s).select(F.explode(fn.words_of_line(F.regexp_replace(F.lower("text"), ":[0-9.]+", ""))).alias("feature"))
    return compare_feature_sets(feats("feed_01"), feats("feed_02"))
