"""Queries: token tables, features, lexica, tagging evaluation on ``conll_words`` and ``conll_lines``."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpusmill.functions import text as fn
from korpusmill.operators import conll, evaluation, features, lexicon
from korpusmill.operators import timeseries as ts
from korpusmill.plans.base import Registry
from korpusmill.session import table

R = Registry()
TOK = "tok as (select * from conll_words qualify row_number() over (partition by doc_id, sent_id, idx order by tok_id) = 1)"


def _tokens(spark, d):
    return conll.current_tokens(table(spark, d, "conll_words"))


@R.add(f"with {TOK} select doc_id, sent_id, idx, tok_id, form from tok")
def dedupe_tokens(spark, d):
    return _tokens(spark, d).select("doc_id", "sent_id", "idx", "tok_id", "form")


@R.add(f"with {TOK} select doc_id, count(distinct sent_id) as n_sentences, count(*) as n_tokens from tok group by 1")
def document_sizes(spark, d):
    return _tokens(spark, d).groupBy("doc_id").agg(F.count_distinct("sent_id").alias("n_sentences"), F.count(F.lit(1)).alias("n_tokens"))


@R.add("select tok_id, doc_id, sent_id, idx, form, pos from conll_words where doc_id = (select min(doc_id) from conll_words)")
def select_by_id(spark, d):
    words = table(spark, d, "conll_words")
    return words.join(F.broadcast(words.agg(F.min("doc_id").alias("doc_id"))), "doc_id").select("tok_id", "doc_id", "sent_id", "idx", "form", "pos")  # one row


CLASS = r"""case when regexp_full_match(form, '\p{L}+') then case when regexp_full_match(form, '[\p{Lu}\p{Lt}][^\p{Lu}\p{Lt}]*') then 'Title' when regexp_full_match(form, '[^\p{Ll}]*\p{Lu}[^\p{Ll}]*') then 'Upper'
 when regexp_full_match(form, '[^\p{Lu}]*\p{Ll}[^\p{Lu}]*') then 'Lower' else 'MixedAlpha' end when regexp_full_match(form, '\p{Nd}+') then 'Digit' when regexp_full_match(form, '[\p{L}\p{Nd}]+') then 'Alnum' when regexp_full_match(form, '[[:punct:]]+') then 'Punct' else 'Mixed' end"""


@R.add(f"select {CLASS} as char_class, count(*) as n from conll_words where form is not null group by 1")
def char_class_counts(spark, d):
    return table(spark, d, "conll_words").where("form is not null").groupBy(fn.char_class(F.col("form")).alias("char_class")).agg(F.count(F.lit(1)).alias("n"))


@R.add(f"with {TOK} select tok_id, lower(form)[:3] as init, right(lower(form), 3) as trail from tok where form is not null")
def affix_features(spark, d):
    return _tokens(spark, d).where("form is not null").select("tok_id", fn.prefix(F.col("form")).alias("init"), fn.suffix(F.col("form")).alias("trail"))


@R.add(f"with {TOK} select tok_id, lag(pos) over w as pos_m1, lead(pos) over w as pos_p1, lag(form) over w as form_m1, lead(form) over w as form_p1 from tok window w as (partition by doc_id, sent_id order by idx)")
def offset_features(spark, d):
    return features.at_offsets(_tokens(spark, d), ["pos", "form"]).select("tok_id", "pos_m1", "pos_p1", "form_m1", "form_p1")


@R.add(f"with {TOK} select tok_id, case when idx = min(idx) over w then '__BOS__' when idx = max(idx) over w then '__EOS__' end as mark from tok window w as (partition by doc_id, sent_id)")
def sentence_marks(spark, d):
    return features.sentence_marks(_tokens(spark, d)).select("tok_id", "mark")


@R.add(f"with {TOK} select pos, lead(pos) over (partition by doc_id, sent_id order by idx) as next_pos, tok_id from tok")
def pairwise_tags(spark, d):
    return features.at_offsets(_tokens(spark, d), ["pos"], (1,)).select("pos", F.col("pos_p1").alias("next_pos"), "tok_id")


@R.add(
    f"""with {TOK}, g as (select t.tok_id, p.lemma as parent_lemma, g.pos as grandparent_pos from tok t left join tok p on p.doc_id = t.doc_id and p.sent_id = t.sent_id and p.idx = t.phead
 left join tok g on g.doc_id = t.doc_id and g.sent_id = t.sent_id and g.idx = p.phead) select * from g"""
)
def tree_relatives(spark, d):
    return conll.with_relatives(_tokens(spark, d)).select("tok_id", F.col("parent.lemma").alias("parent_lemma"), F.col("grandparent.pos").alias("grandparent_pos"))


@R.add(f"with {TOK} select doc_id, sent_id, phead as idx, count(*) as n_children, string_agg(coalesce(pdeprel, ''), ' ' order by idx) as rels from tok where phead > 0 group by 1, 2, 3")
def tree_children(spark, d):
    kids = conll.children(_tokens(spark, d))
    return kids.select("doc_id", "sent_id", "idx", F.size("kids").cast("bigint").alias("n_children"), F.array_join(F.transform("kids", lambda k: F.coalesce(k["pdeprel"], F.lit(""))), " ").alias("rels"))


BAG = r"""bag as (select tok_id, ppos, form, list_transform(list_filter(string_split(coalesce(pfeat, '_'), '|'), lambda p: trim(p, ' ') not in ('', '_')), lambda p: trim(p, ' ')) as ps from tok)"""


@R.add(
    f"""with {TOK}, {BAG}, x as (select tok_id, unnest(range(1, len(ps) + 1)) as i, unnest(ps) as p from bag), kv as (select tok_id, i, case when instr(p, '=') > 0 then split_part(p, '=', 1)
 when lower(p) in ('nom', 'gen', 'dat', 'acc') then 'case' when lower(p) in ('fem', 'masc', 'neut') then 'gender' when lower(p) in ('sg', 'pl') then 'num' when lower(p) in ('1', '2', '3') then 'pers'
 when lower(p) in ('ind', 'imp', 'subj') then 'mood' when lower(p) in ('pres', 'past') then 'tense' else lower(p) end as name,
 case when instr(p, '=') > 0 then p[instr(p, '=') + 1:] when lower(p) in ('nom', 'gen', 'dat', 'acc', 'fem', 'masc', 'neut', 'sg', 'pl', '1', '2', '3', 'ind', 'imp', 'subj', 'pres', 'past') then lower(p) else 'True' end as value from x)
 select tok_id, name, arg_max(value, i) as value from kv group by 1, 2"""
)
def feature_bag(spark, d):
    return _tokens(spark, d).select("tok_id", F.explode(conll.feature_map(F.col("pfeat"))).alias("name", "value"))


@R.add(
    f"""with {TOK}, {BAG} select tok_id, case when list_contains(ps, 'nom') then 'nom' when list_contains(ps, 'gen') then 'gen' when list_contains(ps, 'dat') then 'dat' when list_contains(ps, 'acc') then 'acc' end as "case",
 case when list_contains(ps, 'pres') then 'pres' when list_contains(ps, 'past') then 'past' when ppos = 'VVPP' then 'perf' end as tense, case when list_contains(ps, 'masc') then 'masc' when list_contains(ps, 'fem') then 'fem' when list_contains(ps, 'neut') then 'neut' end as gender
 from bag where not list_contains(list_transform(ps, lambda p: instr(p, '=') > 0), true)"""
)
def grammatical_features(spark, d):
    rows = _tokens(spark, d).where(~F.coalesce(F.col("pfeat").contains("="), F.lit(False)))
    return features.grammatical(rows).select("tok_id", "case", "tense", "gender")


@R.add(
    f"""with {TOK}, r as (select *, replace(regexp_replace(coalesce(pdeprel, '_'), '[ \\t\\n\\r\\f]+', '_', 'g'), ':', '__COLON__') as rel from tok)
 select tok_id, lag(rel) over w || '|' || rel as before, rel || '|' || lead(rel) over w as after,
 case when phead = lag(idx) over w then 'parent' when lag(phead) over w = idx then 'child' end as prev_is from r window w as (partition by doc_id, sent_id order by idx)"""
)
def template_features(spark, d):
    feats = features.template_features(_tokens(spark, d), keep=("tok_id",))
    value = lambda name: F.get(F.filter("features", lambda f: f.startswith(name + "=")), F.lit(0)).substr(F.lit(len(name) + 2), F.lit(10000))
    prev = F.when(F.array_contains("features", "prevWordIsMyParent=True"), "parent").when(F.array_contains("features", "prevWordIsMyChild=True"), "child")
    return feats.select("tok_id", value("deprel[-1]|deprel[0]").alias("before"), value("deprel[0]|deprel[1]").alias("after"), prev.alias("prev_is"))


@R.add(
    f"""with {TOK} select tok_id, 'Tag("W_' || sent_id || '_' || idx || '", ' || case pos when '$.' then 'TPUNCT' when '$,' then 'TCOMMA' when '$(' then 'TBRACE' else coalesce(pos, '_') end || ')' as atom from tok
 union all select tok_id, 'Connector("W_' || sent_id || '_' || idx || '", "W_' || sent_id || '_' || phead || '", ' || case when pdeprel = '--' then 'CPUNCT' else coalesce(pdeprel, '_') end || ')' from tok where phead is not null"""
)
def logic_atoms(spark, d):
    atoms = features.logic_atoms(_tokens(spark, d), keep=("tok_id",)).where(F.col("atom").rlike(r"^(?:Tag|Connector)\("))
    return atoms.select("tok_id", "atom")


@R.add()
def logic_atoms_all(spark, d):
    """Tags, edges and features; a token without head makes no edge."""
    return features.logic_atoms(_tokens(spark, d), keep=("tok_id",)).where("atom is not null").select("tok_id", "atom")


@R.add(
    f"""with {TOK}, n as (select doc_id, sent_id, idx, '  n' || idx || ' [label="' || replace(replace(coalesce(form, ''), '\\', '\\\\'), '"', '\\"') || '"];' || case when phead > 0 then chr(10) || '  n' || phead || ' -> n' || idx || ' [label="' || coalesce(pdeprel, '') || '"];' else '' end as s from tok)
 select doc_id, sent_id, 'digraph {{' || chr(10) || string_agg(s, chr(10) order by idx) || chr(10) || '}}' as dot from n group by 1, 2"""
)
def tree_dot(spark, d):
    return conll.tree_dot(_tokens(spark, d))


@R.add(r"with f as (select file_name, line_no, string_split(line_text, chr(9)) as p from conll_lines where starts_with(line_text, chr(27))) select file_name, line_no, p[2] as kind, array_to_string(p[3:], chr(9)) as value from f")
def metadata_lines(spark, d):
    return conll.metadata_rows(table(spark, d, "conll_lines"))


@R.add(
    r"""with m as (select *, starts_with(line_text, chr(27) || chr(9) || 'id' || chr(9))::int as is_id, (starts_with(line_text, chr(27)) or regexp_replace(line_text, '[\r ]+$', '') = '')::int as is_break from conll_lines where line_text is not null),
 n as (select *, sum(is_id) over w as msg_no, sum(is_break) over w as block from m window w as (partition by file_name order by line_no, line_id))
 select line_id, file_name, line_no, msg_no::bigint as msg_no, (dense_rank() over (partition by file_name, msg_no order by block) - 1)::int as sent_no from n where is_break = 0"""
)
def sentence_numbers(spark, d):
    return conll.sentence_numbers(table(spark, d, "conll_lines"))


# --- evaluation of automatic tags (ppos, pdeprel) against the given ones ------------------

EV = f"""{TOK}, ev as (select doc_id, sent_id, idx, case when pos like 'N%' then 'NOM' when pos like 'V%' then 'VERB' else 'O' end as gold, case when ppos like 'N%' then 'NOM' when ppos like 'V%' then 'VERB' else 'O' end as pred from tok where pos is not null and ppos is not null and pos not like '$%'),
 l as (select *, case when lag(gold) over w is not distinct from gold then 0 else 1 end as cg, case when lag(pred) over w is not distinct from pred then 0 else 1 end as cp from ev window w as (partition by doc_id, sent_id order by idx)),
 i as (select *, sum(cg) over w as ig, sum(cp) over w as ip from l window w as (partition by doc_id, sent_id order by idx)),
 g as (select doc_id, sent_id, ig, gold as tag, count(*) as n, sum((gold = pred)::int) as m, max(idx) as last from i group by 1, 2, 3, 4), p as (select doc_id, sent_id, ip, pred as tag, count(*) as n, sum((gold = pred)::int) as m, max(idx) as last from i group by 1, 2, 3, 4)"""
PRF = "select coalesce(a.tag, b.tag) as tag, coalesce(ng, 0) as n_gold, coalesce(np, 0) as n_pred, round(coalesce(100 * sp / np, 0), 6) as prec, round(coalesce(100 * sg / ng, 0), 6) as recall, round(case when coalesce(sp / np, 0) + coalesce(sg / ng, 0) > 0 then 2 * (100 * sp / np) * (100 * sg / ng) / ((100 * sp / np) + (100 * sg / ng)) else 0 end, 6) as f1 from a full join b using (tag)"


def _tagged(spark, d):
    group = lambda c: F.when(F.col(c).startswith("N"), "NOM").when(F.col(c).startswith("V"), "VERB").otherwise("O")
    rows = _tokens(spark, d).where("pos is not null and ppos is not null")
    return rows.select("doc_id", "sent_id", "idx", group("pos").alias("gold"), group("ppos").alias("pred"), F.col("pos").startswith("$").alias("punct"))


def _span_query(mode):
    def run(spark, d):
        return evaluation.span_scores(_tagged(spark, d), ["doc_id", "sent_id"], ["idx"], mode, "punct")

    run.__name__ = f"span_eval_{mode}"
    return run


for _mode, _score in (("binary", "(m > 0)::int"), ("proportional", "m / n")):
    R.add(f"with {EV}, a as (select tag, count(*) as ng, sum({_score})::double as sg from g group by 1), b as (select tag, count(*) as np, sum({_score})::double as sp from p group by 1) {PRF}")(_span_query(_mode))
R.add(
    f"with {EV}, h as (select g.tag, count(*) as h from g join p using (doc_id, sent_id, tag, n, last) group by 1), a as (select tag, count(*) as ng, coalesce(any_value(h), 0)::double as sg from g left join h using (tag) group by 1), b as (select tag, count(*) as np, coalesce(any_value(h), 0)::double as sp from p left join h using (tag) group by 1) {PRF}"
)(_span_query("exact"))


@R.add(f"with {EV}, a as (select tag, count(*) as ng, sum(m / n)::double as sg from g group by 1), b as (select tag, count(*) as np, sum(m / n)::double as sp from p group by 1), r as ({PRF}) select round(avg(f1) / 100, 6) as macro_f1 from r")
def macro_f1(spark, d):
    return evaluation.macro_f1(_tagged(spark, d).where("not punct"), ["doc_id", "sent_id"], ["idx"])


@R.add(f"with {EV} select doc_id, sent_id, ig::bigint as span_no, tag, n from g")
def tag_islands(spark, d):
    rows = evaluation.islands(_tagged(spark, d).where("not punct"), ["doc_id", "sent_id"], ["idx"], "gold", "span_no")
    return rows.groupBy("doc_id", "sent_id", "span_no", F.col("gold").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


CONF = f"""{TOK}, a as (select distinct doc_id, sent_id, idx, pos as tag from tok where pos is not null), b as (select distinct doc_id, sent_id, idx, ppos as tag from tok where ppos is not null),
 t as (select tag, sum((a.ok and b.ok)::int) as tp, sum((a.ok is null)::int) as fp, sum((b.ok is null)::int) as fn from (select *, true as ok from a) a full join (select *, true as ok from b) b using (doc_id, sent_id, idx, tag) group by 1)"""


def _confusion(spark, d):
    tokens = _tokens(spark, d)
    key = ["doc_id", "sent_id", "idx"]
    gold = tokens.where("pos is not null").select(*key, F.col("pos").alias("tag"))
    return evaluation.confusion_counts(gold, tokens.where("ppos is not null").select(*key, F.col("ppos").alias("tag")), key, "tag")


@R.add(f"with {CONF} select tag, coalesce(tp, 0)::bigint as tp, fp::bigint as fp, fn::bigint as fn from t")
def tp_fp_fn(spark, d):
    return _confusion(spark, d)


@R.add(
    f"""with {CONF}, s as (select tag, coalesce(tp, 0) as tp, fp, fn from t), q as (select *, tp / (case when tp + fp = 0 then 1e6 else tp + fp end) as p, tp / (case when tp + fn = 0 then 1e6 else tp + fn end) as r from s)
 select tag, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, round(p, 6) as prec, round(r, 6) as recall, round(2 * p * r / (case when p + r = 0 then 1e6 else p + r end), 6) as f1 from q"""
)
def prf_summary(spark, d):
    return evaluation.prf_summary(_confusion(spark, d), "tag")


@R.add(
    f"""with {TOK}, c as (select pos as tag1, ppos as tag2, count(*) as n from tok where pos <> ppos and not (pos in ('PAV', 'PROAV') and ppos in ('PAV', 'PROAV')) group by 1, 2 order by n desc, tag1, tag2 limit 10)
 select row_number() over (order by n desc, tag1, tag2)::int as rank, * from c"""
)
def tagger_confusion(spark, d):
    return evaluation.tag_confusion(_tokens(spark, d), "pos", "ppos", [("PAV", "PROAV")])


@R.add(f"with {TOK}, w as (select distinct doc_id from tok where pos is distinct from ppos) select doc_id, sent_id, idx, pos, ppos from tok semi join w using (doc_id)")
def error_messages(spark, d):
    return evaluation.error_messages(_tokens(spark, d), "doc_id", "pos", "ppos").select("doc_id", "sent_id", "idx", "pos", "ppos")


# --- polarity -----------------------------------------------------------------------------

#: A small polarity lexicon of our own for the words of the test corpus.
LEXICON = [
    ("positive", "schön", "...", 0.5), ("positive", "lobt", "VVFIN", 0.6), ("positive", "rühmt", "VVFIN", 0.7), ("positive", "genießt", "VVFIN", 0.8), ("positive", "begrüßt", "VVFIN", 0.4),
    ("positive", "fröhlich", "...", 0.7), ("positive", "stolz", "...", 0.5), ("negative", "verhöhnt", "VVFIN", -0.8), ("negative", "zerstört", "VVFIN", -0.9), ("negative", "fürchtet", "VVFIN", -0.5),
    ("negative", "vergisst", "...", -0.3), ("negative", "mürrisch", "...", -0.6), ("negative", "verliert", "...", -0.4), ("negative", "unterschätzt", "VVFIN", -0.4), ("positive", "stolz", "...", 0.45),
]
VALUES = "lex(class, word, tag, score, seq) as (values " + ", ".join(f"('{c}', '{w}', '{t}', {s}, {i})" for i, (c, w, t, s) in enumerate(LEXICON)) + ")"
BEST = f"{VALUES}, best as (select word, tag, arg_max(score, seq)::double as score, arg_max(class, seq) as class from lex group by 1, 2)"
SCORED = f"{TOK}, {BEST}, sc as (select tok.*, coalesce(e.score, a.score) as score, coalesce(e.class, a.class) as class from tok left join best e on e.word = lower(tok.lemma) and e.tag = tok.pos and e.tag <> '...' left join best a on a.word = lower(tok.lemma) and a.tag = '...')"


def _lexicon(spark):
    return lexicon.lexicon_from(spark, LEXICON)


@R.add(f"with {SCORED} select tok_id, class, score from sc where score is not null")
def lexicon_lookup(spark, d):
    return lexicon.lookup(_tokens(spark, d), _lexicon(spark)).where("score is not null").select("tok_id", "class", "score")


INFO = "(regexp_matches(pos, '^[VN]') or pos like 'ADJ%') and length(lower(lemma)) > 3 and lower(lemma) not in (" + ", ".join(f"'{w}'" for w in lexicon.NOT_INFORMATIVE) + ") and not regexp_matches(lower(lemma), '[[:punct:]]')"


@R.add(
    f"""with {SCORED} select doc_id, sent_id, round(coalesce(sum(score), 0), 6) as score, sum((score is null and {INFO})::int)::bigint as n_informative, case when round(coalesce(sum(score), 0), 6) > 0 then 'pos' when round(coalesce(sum(score), 0), 6) < 0 then 'neg' else 'neut' end as polarity from sc group by 1, 2"""
)
def lexicon_sentence_polarity(spark, d):
    rows = lexicon.sentence_polarity(_tokens(spark, d), _lexicon(spark), ["doc_id", "sent_id"]).withColumn("score", F.round("score", 6))
    return rows.withColumn("polarity", lexicon.polarity_class(F.col("score")))


@R.add(
    f"""with {SCORED}, s as (select doc_id, sent_id, round(coalesce(sum(score), 0), 6) as score from sc group by 1, 2) select case when score > 0 then 'pos' when score < 0 then 'neg' else 'neut' end as polarity, count(*) as n from s group by 1"""
)
def polarity_totals(spark, d):
    rows = lexicon.sentence_polarity(_tokens(spark, d), _lexicon(spark), ["doc_id", "sent_id"])
    return rows.groupBy(lexicon.polarity_class(F.round("score", 6)).alias("polarity")).agg(F.count(F.lit(1)).alias("n"))


@R.add()
def polarity_negated(spark, d):
    return lexicon.sentence_polarity_negated(_tokens(spark, d), _lexicon(spark), ["doc_id", "sent_id"])


@R.add(f"with {TOK}, c as (select pos as class, lower(lemma) as word, count(*) as n from tok where pos in ('NN', 'ADV', 'VVFIN') and lemma is not null and {INFO.replace('and length', 'and length')} group by 1, 2), r as (select *, row_number() over (partition by class order by n desc, word) as rank from c) select class, rank::int as rank, word, n from r where rank <= 70")
def top_words_per_class(spark, d):
    rows = _tokens(spark, d).where(F.col("pos").isin("NN", "ADV", "VVFIN") & F.col("lemma").isNotNull() & lexicon.is_informative(F.col("lemma"), F.col("pos")))
    return ts.top_words(rows.select(F.col("pos").alias("class"), F.lower("lemma").alias("word")))


@R.add(f"with {TOK} select tok_id, lower(lemma) as lemma from tok where regexp_matches(pos, '^(AD|[NV])') and lemma is not null")
def topic_lemmas(spark, d):
    return _tokens(spark, d).where(F.col("pos").rlike("^(AD|[NV])") & F.col("lemma").isNotNull()).select("tok_id", F.lower("lemma").alias("lemma"))


@R.add(f"with {TOK} select tok_id, case when regexp_full_match(form, '[0-9.]*[0-9][0-9.]*') then '1' else lower(form) end as norm from tok where form is not null")
def normalized_words(spark, d):
    return _tokens(spark, d).where("form is not null").select("tok_id", fn.normalize_word(F.col("form")).alias("norm"))


@R.add(f"with {TOK} select tok_id, replace(regexp_replace(form, '[ \\t\\n\\r\\f]+', '_', 'g'), ':', '__COLON__') as escaped from tok where form is not null")
def escaped_forms(spark, d):
    return _tokens(spark, d).where("form is not null").select("tok_id", fn.escape_feature(F.col("form")).alias("escaped"))


@R.add(f"with {TOK} select t.tok_id, t.pos from tok t left join tagset g on g.tag_kind = 'pos' and g.tag = t.pos where g.tag is null and t.pos is not null and t.pos <> '_'")
def unknown_tags(spark, d):
    valid = table(spark, d, "tagset").where("tag_kind = 'pos'").select(F.col("tag").alias("pos"))
    return _tokens(spark, d).where("pos is not null and pos <> '_'").join(valid, "pos", "left_anti").select("tok_id", "pos")


@R.add()
def crf_lines(spark, d):
    tokens = _tokens(spark, d)
    tags = tokens.select("doc_id", "sent_id", "idx", F.coalesce(F.nullif("sentiment", F.lit("_")), F.lit("O")).alias("tag"))
    return features.crf_lines(features.template_features(tokens), tags)


@R.add(
    f"""with recursive {TOK}, ok as (select * from tok where phead is not null), d as (select t.doc_id, t.sent_id, t.idx, 0 as depth from ok t left join ok h on h.doc_id = t.doc_id and h.sent_id = t.sent_id and h.idx = t.phead where h.idx is null
 union all select t.doc_id, t.sent_id, t.idx, d.depth + 1 from ok t join d on t.doc_id = d.doc_id and t.sent_id = d.sent_id and t.phead = d.idx) select ok.doc_id, ok.sent_id, ok.idx, d.depth::int as depth from ok left join d using (doc_id, sent_id, idx)"""
)
def tree_depths(spark, d):
    return conll.tree_depths(_tokens(spark, d).where("phead is not null"))


@R.add(f"with {SCORED}, s as (select doc_id, sent_id, round(coalesce(sum(score), 0), 6) as score from sc group by 1, 2), p as (select *, case when score > 0 then 'pos' when score < 0 then 'neg' else 'neut' end as line from s) select doc_id, sent_id, line from p where regexp_matches(line, 'pos|neg')")
def sentiment_lines(spark, d):
    rows = lexicon.sentence_polarity(_tokens(spark, d), _lexicon(spark), ["doc_id", "sent_id"])
    return rows.select("doc_id", "sent_id", lexicon.polarity_class(F.round("score", 6)).alias("line")).where(F.col("line").rlike("pos|neg"))


@R.add(f"""with {TOK} select tok_id, 'Tag("W_' || sent_id || '_' || idx || '", ' || case pos when '$.' then 'TPUNCT' when '$,' then 'TCOMMA' when '$(' then 'TBRACE' else coalesce(pos, '_') end || ').' as atom from tok""")
def evidence_atoms(spark, d):
    evidence, _ = features.split_evidence(features.logic_atoms(_tokens(spark, d), keep=("tok_id",)), ["Connector"])
    return evidence.where(F.col("atom").startswith("Tag(")).select("tok_id", "atom")


@R.add()
def evidence_atoms_all(spark, d):
    """All evidence atoms, those of features too."""
    evidence, _ = features.split_evidence(features.logic_atoms(_tokens(spark, d)), ["Connector"])
    return evidence


@R.add()
def grammatical_features_all(spark, d):
    """Case, tense and gender of every token, those with named features too."""
    return features.grammatical(_tokens(spark, d)).select("tok_id", "case", "tense", "gender")


@R.add(f"with {TOK} select doc_id, sent_id, idx, form, coalesce(lemma, '_') as lemma, coalesce(pos, '_') as pos, '_' as feat, -1 as head from tok")
def tagged_to_conll(spark, d):
    from korpusmill.operators.tokens import tagged_to_conll as convert

    return convert(_tokens(spark, d).withColumn("tag", F.col("pos"))).select("doc_id", "sent_id", "idx", "form", "lemma", "pos", "feat", "head")


@R.add("select file_name, line_id, split_part(line_text, chr(9), 1) as idx, split_part(line_text, chr(9), 2) as form from conll_lines where len(string_split(line_text, chr(9))) = 14 and line_text not like '%\"%' and not starts_with(line_text, chr(27)) and regexp_full_match(split_part(line_text, chr(9), 1), '[1-9][0-9]*')")
def scan_token_lines(spark, d):
    rows = table(spark, d, "conll_lines")
    parts = F.split("line_text", "\t")
    plain = rows.where((F.size(parts) == 14) & ~F.col("line_text").contains('"') & ~F.col("line_text").startswith(conll.ESC) & parts[0].rlike("^[1-9][0-9]*$"))
    return plain.select("file_name", "line_id", parts[0].alias("idx"), parts[1].alias("form"))
