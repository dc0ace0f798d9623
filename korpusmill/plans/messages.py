"""Queries: messages, threads, selections, annotations, events."""

from __future__ import annotations

from pyspark.sql import functions as F

from korpusmill.functions import text as fn
from korpusmill.operators import annotations, evaluation, sampling, threads
from korpusmill.operators import timeseries as ts
from korpusmill.operators.packed import span_numbers
from korpusmill.plans.base import Registry
from korpusmill.session import table

R = Registry()


def _messages(spark, d):
    return table(spark, d, "messages")


TREE = """ed as (select id, max(cast(in_reply_to_status_id as varchar)) as parent from messages where id is not null group by 1),
 alle as (select * from ed union all select distinct parent, null from ed where parent is not null and parent not in (select id from ed)),"""
CLOSURE = f"recursive {TREE} cl as (select id, parent, id as root, 0 as depth from alle where parent is null union all select a.id, a.parent, cl.root, cl.depth + 1 from alle a join cl on a.parent = cl.id)"


@R.add(f"with {CLOSURE} select a.id, a.parent, root, depth::int as depth from alle a left join cl using (id)")
def thread_closure(spark, d):
    return threads.thread_roots(_messages(spark, d))


@R.add(f"with {CLOSURE} select root, sum((depth > 0)::int)::bigint as n_replies, max(depth)::int as max_depth from cl group by 1")
def thread_totals(spark, d):
    return threads.thread_totals(threads.thread_roots(_messages(spark, d)))


@R.add(f"with {CLOSURE} select root, sum((depth > 0)::int)::bigint as n_replies, max(depth)::int as max_depth from cl group by 1 order by n_replies desc, root limit 10")
def thread_top_n(spark, d):
    return threads.top_threads(threads.thread_totals(threads.thread_roots(_messages(spark, d))))


@R.add(f"with {CLOSURE}, s as (select root, count(*) as n from alle left join cl using (id) group by 1) select sum((n = 1)::int)::bigint as n_singles, sum(n)::bigint as n_messages, round(100 * sum((n = 1)::int) / sum(n), 6) as pct_singles from s")
def singles_vs_replies(spark, d):
    return threads.singles_ratio(threads.thread_roots(_messages(spark, d)))


@R.add(
    f"""with {CLOSURE}, tx as (select id, min(text) as text from messages group by 1), pt as (select id, parent, root, depth, id as path from cl where depth = 0),
 full_path as (select * from (with recursive p as (select id, id as path, 0 as depth, id as root from alle where parent is null union all select a.id, p.path || '/' || a.id, p.depth + 1, p.root from alle a join p on a.parent = p.id) select * from p))
 select root, path, repeat(chr(9), depth) || f.id || chr(9) || coalesce(text, 'unknown') as line from full_path f left join tx using (id)"""
)
def thread_printout(spark, d):
    closure = threads.thread_roots(_messages(spark, d))
    return threads.print_thread_rows(closure, _messages(spark, d))


@R.add(
    f"""with {CLOSURE}, tx as (select id, max(text) as text from messages group by 1), s as (select root, count(*) as n, sum((text is null)::int) as u from cl left join tx using (id) group by 1)
 select root, n from s where n between 2 and 10 and u = 0 order by md5(root || '0'), root limit 20"""
)
def thread_sample(spark, d):
    return threads.sample_threads(threads.thread_roots(_messages(spark, d)), _messages(spark, d), 20)


@R.add("select id, max(cast(in_reply_to_status_id as varchar)) as parent from messages where id is not null group by 1")
def reply_edges(spark, d):
    return threads.reply_edges(_messages(spark, d))


FIRST = "first as (select * from messages qualify row_number() over (partition by id order by loaded_at, text nulls first, lang nulls first) = 1)"


@R.add("with ids as (select distinct id from messages), old as (select distinct id from messages where polarity = 'neg') select id from ids anti join old using (id)")
def dedupe_antijoin(spark, d):
    messages = _messages(spark, d)
    once = sampling.dedupe_first(messages.select("id", "loaded_at"), "id", ["loaded_at"])
    return sampling.skip_ids(once, messages.where("polarity = 'neg'").select("id").distinct(), "id").select("id")


@R.add("select distinct id from messages where id is not null")
def message_ids(spark, d):
    return _messages(spark, d).where("id is not null").select("id").distinct()


@R.add(r"select id, strftime(try_strptime(created_at[5:], '%b %d %H:%M:%S %z %Y'), '%Y-%m-%d %H:%M:%S') as created from messages where created_at is not null")
def message_times(spark, d):
    return _messages(spark, d).where("created_at is not null").select("id", F.date_format(fn.message_time(F.col("created_at")), "yyyy-MM-dd HH:mm:ss").alias("created"))


@R.add(r"select strftime(min(t), '%Y-%m-%d %H:%M:%S') as first_time, strftime(max(t), '%Y-%m-%d %H:%M:%S') as last_time from (select try_strptime(created_at[5:], '%b %d %H:%M:%S %z %Y') as t from messages)")
def corpus_time_bounds(spark, d):
    b = sampling.time_bounds(_messages(spark, d).select(fn.message_time(F.col("created_at")).alias("t")), "t")
    return b.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in b.columns])


BUCKET = r"b as (select month(t)::int as month, day(t)::int as day, (hour(t) // 2)::int as hrange, coalesce(polarity, 'none') as class from (select try_strptime(created_at[5:], '%b %d %H:%M:%S %z %Y') as t, polarity from messages) where t is not null)"


def _buckets(spark, d):
    rows = _messages(spark, d).select(fn.message_time(F.col("created_at")).alias("t"), F.coalesce("polarity", F.lit("none")).alias("class"))
    return ts.time_buckets(rows, 2, "t")


@R.add(f"with {BUCKET} select month, day, hrange, class, count(*) as n from b group by all")
def polarity_time_buckets(spark, d):
    return _buckets(spark, d)


@R.add(f"with {BUCKET} select month, day, hrange, sum((class = 'pos')::int)::bigint as pos, sum((class = 'neg')::int)::bigint as neg, sum((class = 'neut')::int)::bigint as neut, count(*) as total from b group by 1, 2, 3")
def polarity_pivot(spark, d):
    return ts.pivot_buckets(_buckets(spark, d), ["pos", "neg", "neut"])


@R.add(f"with {BUCKET} select month, day, hrange, count(*) as n from b group by 1, 2, 3")
def merge_spans(spark, d):
    return ts.merge_equal_spans(_buckets(spark, d))


RANK = "r as (select *, row_number() over (order by id, loaded_at, coalesce(text, '')) - 1 as i, count(*) over () as n from messages where id is not null)"
ORDER = ["id", "loaded_at", "_t"]


def _ranked_input(spark, d):
    return _messages(spark, d).where("id is not null").withColumn("_t", F.coalesce("text", F.lit("")))


@R.add(f"with {RANK} select id, case when i < n * 70 // 100 then 'train' when i < n * 80 // 100 then 'dev' else 'test' end as split, count(*) as k from r group by 1, 2")
def split_70_10_20(spark, d):
    return sampling.split_70_10_20(_ranked_input(spark, d), ORDER).groupBy("id", "split").agg(F.count(F.lit(1)).alias("k"))


@R.add(f"with {RANK} select id, count(*) as k from r where i >= n * 25 // 100 and i < n * 40 // 100 group by 1")
def percentage_range(spark, d):
    return sampling.percentage_range(_ranked_input(spark, d), ORDER, 25, 40).groupBy("id").agg(F.count(F.lit(1)).alias("k"))


@R.add("with m as (select distinct id from messages where id is not null) select id from m order by md5(id || '7'), id limit 50")
def deterministic_sample(spark, d):
    return sampling.hash_sample(_messages(spark, d).where("id is not null").select("id").distinct(), "id", 50, "7")


@R.add(
    """with m as (select id, coalesce(min(polarity), 'none') as g from messages where id is not null group by 1), z as (select g, count(*) as n from m group by 1),
 r as (select *, row_number() over (partition by g order by md5(id), id) as k from m) select g, count(*) as n_sampled from r join z using (g) where k <= least(n, 30) group by 1"""
)
def stratified_sample(spark, d):
    rows = _messages(spark, d).where("id is not null").groupBy("id").agg(F.coalesce(F.min("polarity"), F.lit("none")).alias("g"))
    return sampling.stratified_sample(rows, "g", "id", 120).groupBy("g").agg(F.count(F.lit(1)).alias("n_sampled"))


@R.add("with m as (select id, coalesce(min(polarity), 'none') as g from messages where id is not null group by 1), z as (select g, count(*) as n from m group by 1) select g, (select max(n) from z) as n from z")
def balance_classes(spark, d):
    rows = _messages(spark, d).where("id is not null").groupBy("id").agg(F.coalesce(F.min("polarity"), F.lit("none")).alias("g"))
    return sampling.balance_classes(rows, "g", "id").groupBy("g").agg(F.count(F.lit(1)).alias("n"))


WORDS = ", ".join(f"'{w}'" for w in sampling.FUNCTION_WORDS)


@R.add(
    rf"""with m as (select id, text, list_filter(string_split_regex(lower(text), '[-\]\s:;,.?!(){{}}\[]+'), lambda w: regexp_full_match(w, '[\p{{L}}0-9_][\p{{L}}0-9_'']+[\p{{L}}0-9_.$]') and not regexp_matches(w, '^([@#]|www|http)')) as ws from (select distinct id, text from messages where text is not null))
 select id, count(*) as k from m where len(ws) > 4 and len(list_intersect(ws, [{WORDS}])) > 0 group by 1"""
)
def good_messages(spark, d):
    rows = _messages(spark, d).where("text is not null").select("id", "text").distinct()
    return rows.where(sampling.is_good_message(F.col("text"))).groupBy("id").agg(F.count(F.lit(1)).alias("k"))


# --- annotations --------------------------------------------------------------------------

SPAN = r"""list_filter(flatten(list_transform(regexp_extract_all(regexp_replace(span, '\s*\.{2,}\s*', '..', 'g'), '[^"|;,/\t ]+'), lambda p: case when p like '%..%' then range(cast(regexp_extract(p, '^(?:word_)?(\d+)', 1) as int), cast(regexp_extract(p, '(\d+)$', 1) as int) + 1)
 else [try_cast(regexp_extract(p, '^word_(\d+)$', 1) as bigint)] end)), lambda x: x is not null)"""
CURRENT = "cur as (select * from markables where deleted_at is null qualify row_number() over (partition by file_name, annotator, anno_level, markable_id order by mk_key) = 1)"
REF = "case when regexp_replace({c}, '\\s+', '', 'g') in ('', 'empty') then null else list_extract(string_split(regexp_replace({c}, '\\s+', '', 'g'), ':'), -1) end"
MARKS = f"""{CURRENT}, sp as (select file_name, annotator, anno_level as level, markable_id, coalesce({REF.format(c='sentiment_ref')}, {REF.format(c='emo_expression_ref')}, markable_id) as own_id, {SPAN} as ws from cur where span is not null and span not in ('', '_', 'empty')),
 marks as (select file_name, annotator, level, own_id, markable_id, unnest(ws)::int as word_id, unnest(range(len(ws))) = 0 as is_first from sp)"""


def _marks(spark, d):
    return annotations.markable_words(annotations.current_markables(table(spark, d, "markables")))


@R.add(f"with {MARKS} select * from marks")
def markable_words(spark, d):
    return _marks(spark, d).drop("attrs")


@R.add(f"with {MARKS} select file_name, annotator, word_id, bool_or(level = 'target') as is_target, bool_or(level = 'source') as is_source, bool_or(level = 'sentiment') as is_sentiment, bool_or(level = 'emo-expression') as is_emo from marks group by 1, 2, 3")
def level_flags(spark, d):
    return annotations.level_flags(_marks(spark, d))


@R.add(f"with {MARKS} select file_name, annotator, word_id, case when bool_or(level = 'target') then 'TARGET' when bool_or(level = 'source') then 'SOURCE' when bool_or(level = 'sentiment') then 'SENTIMENT' else 'O' end as tag from marks group by 1, 2, 3")
def target_tags(spark, d):
    from korpusmill.operators.features import target_tag

    return target_tag(annotations.level_flags(_marks(spark, d))).select("file_name", "annotator", "word_id", "tag")


@R.add(
    f"""with {MARKS}, fl as (select file_name, annotator, word_id, bool_or(level = 'emo-expression') as emo from marks group by 1, 2, 3 having bool_or(level = 'sentiment')),
 n as (select *, case when word_id - lag(word_id) over w = 1 then 0 else 1 end as new from fl window w as (partition by file_name, annotator order by word_id)), r as (select *, sum(new) over (partition by file_name, annotator order by word_id) as span_no from n)
 select file_name, annotator, word_id, span_no::bigint as span_no, bool_or(emo) over (partition by file_name, annotator, span_no) as has_emo from r"""
)
def emo_inside(spark, d):
    return annotations.emo_inside(annotations.level_flags(_marks(spark, d)))


@R.add(f"""with {MARKS} select distinct file_name, annotator, 'is' || case level when 'emo-expression' then 'EmoExpression' else upper(level[1:1]) || level[2:] end || '("W_' || word_id || '")' as atom from marks""")
def annotation_atoms(spark, d):
    return annotations.annotation_atoms(_marks(spark, d)).where(F.col("atom").startswith("is"))


@R.add()
def annotation_atoms_all(spark, d):
    """Marks and attributes; a null attribute makes no atom."""
    return annotations.annotation_atoms(_marks(spark, d)).where("atom is not null")


WORDSQL = "wd as (select file_name, word_id, arg_min(form, (loaded_at, form)) as form from mmax_words where deleted_at is null group by 1, 2), ms as (select *, coalesce(sum((form = 'EOL')::int) over (partition by file_name order by word_id rows between unbounded preceding and 1 preceding), 0)::bigint as msg_no from wd)"


def _words(spark, d):
    return annotations.message_of_word(annotations.current_words(table(spark, d, "mmax_words")))


@R.add(f"with {WORDSQL} select file_name, word_id, msg_no from ms where form <> 'EOL'")
def message_of_word(spark, d):
    return _words(spark, d).select("file_name", "word_id", "msg_no")


@R.add(f"with {WORDSQL}, {MARKS} select m.file_name, m.annotator, ms.msg_no, count(distinct m.markable_id) as n_marks from marks m join ms on ms.file_name = m.file_name and ms.word_id = m.word_id where form <> 'EOL' group by 1, 2, 3")
def marks_per_message(spark, d):
    joined = _marks(spark, d).join(_words(spark, d), ["file_name", "word_id"])
    return joined.groupBy("file_name", "annotator", "msg_no").agg(F.count_distinct("markable_id").alias("n_marks"))


@R.add(f"with {MARKS}, has as (select distinct file_name, annotator from marks where level = 'sentiment') select distinct file_name, annotator, level, markable_id from marks anti join has using (file_name, annotator) where level in ('source', 'target')")
def dangling_levels(spark, d):
    return annotations.dangling_levels(_marks(spark, d)).select("file_name", "annotator", "level", "markable_id").distinct()


TWO = f"{MARKS}, an as (select file_name, annotator, row_number() over (partition by file_name order by annotator) as k from (select distinct file_name, annotator from marks)), two as (select m.file_name as file, m.level, k as annotator, m.markable_id as span_id, m.word_id as word from marks m join an using (file_name, annotator) where k <= 2), nw as (select file_name as file, count(distinct word_id) as n from mmax_words group by 1)"
KAPPA = """select file, level, n::bigint as n, marked1::bigint as marked1, overlap1::bigint as overlap1, marked2::bigint as marked2, overlap2::bigint as overlap2, round(case when n = 0 or (marked1 / n) * (marked2 / n) + (1 - marked1 / n) * (1 - marked2 / n) = 1 then 0
 else ((n - marked1 + overlap1 - marked2 + overlap2) / n - ((marked1 / n) * (marked2 / n) + (1 - marked1 / n) * (1 - marked2 / n))) / (1 - ((marked1 / n) * (marked2 / n) + (1 - marked1 / n) * (1 - marked2 / n))) end, 6) as kappa from r"""


def _two(spark, d):
    marks = _marks(spark, d)
    from pyspark.sql import Window as W

    ranks = marks.select("file_name", "annotator").distinct().withColumn("k", F.row_number().over(W.partitionBy("file_name").orderBy("annotator"))).where("k <= 2")
    two = marks.join(ranks, ["file_name", "annotator"]).select(F.col("file_name").alias("file"), "level", F.col("k").alias("annotator"), F.col("markable_id").alias("span_id"), F.col("word_id").alias("word"))
    totals = table(spark, d, "mmax_words").groupBy(F.col("file_name").alias("file")).agg(F.count_distinct("word_id").alias("n"))
    return two, totals


def _agreement(scheme):
    def run(spark, d):
        return evaluation.annotator_agreement(*_two(spark, d), scheme)

    run.__name__ = f"agreement_{scheme}"
    return run


PW = "pw as (select file, level, word, max((annotator = 1)::int) as m1, max((annotator = 2)::int) as m2 from two group by 1, 2, 3)"
GOOD = "wd as (select distinct file, level, annotator, word from two), ht as (select distinct t.file, t.level, t.annotator, t.word from two t semi join good g on g.file = t.file and g.level = t.level and g.annotator = t.annotator and g.span_id = t.span_id), c as (select wd.file, wd.level, sum((annotator = 1)::int) as marked1, sum((annotator = 2)::int) as marked2, sum((annotator = 1 and ht.word is not null)::int) as overlap1, sum((annotator = 2 and ht.word is not null)::int) as overlap2 from wd left join ht using (file, level, annotator, word) group by 1, 2)"
ROLL = "r as (select file, level, sum(n) as n, sum(marked1) as marked1, sum(overlap1) as overlap1, sum(marked2) as marked2, sum(overlap2) as overlap2 from c join nw using (file) group by grouping sets ((file, level), (level)))"
R.add(f"with {TWO}, {PW}, c as (select file, level, sum(m1) as marked1, sum(m2) as marked2, sum(m1 * m2) as overlap1, sum(m1 * m2) as overlap2 from pw group by 1, 2), {ROLL} {KAPPA}")(_agreement("proportional"))
R.add(f"with {TWO}, {PW}, good as (select t.file, t.level, t.annotator, t.span_id from two t join pw using (file, level, word) group by 1, 2, 3, 4 having max(m1 * m2) = 1), {GOOD}, {ROLL} {KAPPA}")(_agreement("binary"))
R.add(
    f"with {TWO}, sps as (select file, level, annotator, span_id, list_sort(list_distinct(list(word))) as ws from two group by 1, 2, 3, 4), sh as (select file, level, ws from sps group by 1, 2, 3 having count(distinct annotator) = 2), good as (select sps.* from sps semi join sh using (file, level, ws)), {GOOD}, {ROLL} {KAPPA}"
)(_agreement("exact"))


@R.add(
    f"""with {TWO}, {WORDSQL}, am as (select distinct t.file, t.annotator, ms.msg_no from two t join ms on ms.file_name = t.file and ms.word_id = t.word where t.level = 'sentiment' and ms.form <> 'EOL'),
 mg as (select distinct file_name as file, msg_no from ms where form <> 'EOL'), x as (select mg.file, mg.msg_no, max((annotator = 1)::int) as m1, max((annotator = 2)::int) as m2 from mg left join am using (file, msg_no) group by 1, 2),
 c as (select count(*) as n, sum(coalesce(m1, 0)) as a, sum(coalesce(m2, 0)) as b, sum(coalesce(m1 * m2, 0)) as ab from x), k as (select *, (a / n) * (b / n) + (1 - a / n) * (1 - b / n) as ch, (n - a + ab - b + ab) / n as ag from c)
 select n, a::bigint as a, b::bigint as b, ab::bigint as n_both, round((ag - ch) / (1 - ch), 6) as kappa, round(ab / b, 6) as prec, round(ab / a, 6) as recall, round(2 * (ab / b) * (ab / a) / ((ab / b) + (ab / a)), 6) as f1 from k"""
)
def message_agreement(spark, d):
    two, _ = _two(spark, d)
    words = _words(spark, d).withColumnsRenamed({"file_name": "file", "word_id": "word"})
    flagged = two.where("level = 'sentiment'").join(words, ["file", "word"]).groupBy("file", "msg_no").agg(F.max((F.col("annotator") == 1).cast("int")).alias("m1"), F.max((F.col("annotator") == 2).cast("int")).alias("m2"))
    every = words.select("file", "msg_no").distinct().join(flagged, ["file", "msg_no"], "left").fillna(0, ["m1", "m2"])
    return evaluation.message_agreement(every)


@R.add(f"with {MARKS}, an as (select file_name, annotator, row_number() over (partition by file_name order by annotator) as k from (select distinct file_name, annotator from marks where level = 'target')), t as (select file_name, word_id, max((k = 1)::int) as a1, max((k = 2)::int) as a2 from marks join an using (file_name, annotator) where level = 'target' and k <= 2 group by 1, 2) select * from t")
def annotator_pairs(spark, d):
    return annotations.annotator_pairs(annotations.current_markables(table(spark, d, "markables")), "target")


# --- every two annotators of a file: the queries above with (file, annotator1, annotator2) in the place of the file

PAIR = "{'file': pr.file_name, 'annotator1': annotator1, 'annotator2': annotator2}"
PAIRS = f"""{MARKS}, an as (select distinct file_name, annotator from marks), pr as (select a.file_name, a.annotator as annotator1, b.annotator as annotator2 from an a join an b on a.file_name = b.file_name and a.annotator < b.annotator),
 two as (select {PAIR} as file, m.level, case when m.annotator = annotator1 then 1 else 2 end as annotator, m.markable_id as span_id, m.word_id as word from marks m join pr on pr.file_name = m.file_name and m.annotator in (annotator1, annotator2)),
 nw as (select {PAIR} as file, n from pr join (select file_name, count(distinct word_id) as n from mmax_words group by 1) using (file_name))"""
OF_PAIR = "file.file as file, file.annotator1 as annotator1, file.annotator2 as annotator2"


def _pair():
    return F.struct(F.col("file_name").alias("file"), "annotator1", "annotator2").alias("file")


def _every_pair(spark, d):
    marks = _marks(spark, d)
    two = annotations.marks_of_pairs(marks).select(_pair(), "level", F.col("k").alias("annotator"), F.col("markable_id").alias("span_id"), F.col("word_id").alias("word"))
    n_words = table(spark, d, "mmax_words").groupBy("file_name").agg(F.count_distinct("word_id").alias("n"))
    pairs = annotations.pairs_of_annotators(marks)
    return two, pairs.join(n_words, "file_name").select(_pair(), "n"), pairs


def _agreement_all(scheme):
    def run(spark, d):
        two, totals, _ = _every_pair(spark, d)
        return evaluation.annotator_agreement(two, totals, scheme).select("file.*", "level", "n", "marked1", "overlap1", "marked2", "overlap2", "kappa")

    run.__name__ = f"agreement_{scheme}_all"
    return run


for _scheme in ("proportional", "binary", "exact"):
    R.add(R.oracles[f"agreement_{_scheme}"].replace(TWO, PAIRS).replace(KAPPA, KAPPA.replace("select file,", f"select {OF_PAIR},")))(_agreement_all(_scheme))


@R.add(
    f"""with {PAIRS}, {WORDSQL}, am as (select distinct t.file, t.annotator, ms.msg_no from two t join ms on ms.file_name = t.file.file and ms.word_id = t.word where t.level = 'sentiment' and ms.form <> 'EOL'),
 mg as (select distinct {PAIR} as file, msg_no from ms join pr using (file_name) where form <> 'EOL'), x as (select mg.file, mg.msg_no, max(coalesce((annotator = 1)::int, 0)) as m1, max(coalesce((annotator = 2)::int, 0)) as m2 from mg left join am using (file, msg_no) group by 1, 2),
 c as (select file, count(*) as n, sum(m1) as a, sum(m2) as b, sum(m1 * m2) as ab from x group by grouping sets ((file), ())), k as (select *, (a / n) * (b / n) + (1 - a / n) * (1 - b / n) as ch, (n - a + ab - b + ab) / n as ag, coalesce(ab / nullif(b, 0), 0) as p, coalesce(ab / nullif(a, 0), 0) as r from c)
 select {OF_PAIR}, n, a::bigint as a, b::bigint as b, ab::bigint as n_both, round(case when ch = 1 then 0 else (ag - ch) / (1 - ch) end, 6) as kappa, round(p, 6) as prec, round(r, 6) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1 from k"""
)
def message_agreement_all(spark, d):
    two, _, pairs = _every_pair(spark, d)
    words = _words(spark, d)
    by_pair = words.join(pairs, "file_name").select(_pair(), "msg_no").distinct()
    marked = two.where("level = 'sentiment'").withColumn("file_name", F.col("file.file")).join(words.withColumnRenamed("word_id", "word"), ["file_name", "word"])
    flag = lambda k: F.max((F.col("annotator") == k).cast("int"))
    flagged = marked.groupBy("file", "msg_no").agg(flag(1).alias("m1"), flag(2).alias("m2"))
    every = by_pair.join(flagged, ["file", "msg_no"], "left").fillna(0, ["m1", "m2"])
    return evaluation.message_agreement(every, "file").select("file.*", "n", "a", "b", "n_both", "kappa", "prec", "recall", "f1")


@R.add(
    f"with {MARKS}, t as (select distinct file_name, annotator, word_id from marks where level = 'target'), an as (select distinct file_name, annotator from t), pr as (select a.file_name, a.annotator as annotator1, b.annotator as annotator2 from an a join an b on a.file_name = b.file_name and a.annotator < b.annotator) select t.file_name, annotator1, annotator2, word_id, max((annotator = annotator1)::int) as a1, max((annotator = annotator2)::int) as a2 from t join pr on pr.file_name = t.file_name and annotator in (annotator1, annotator2) group by 1, 2, 3, 4"
)
def annotator_pairs_all(spark, d):
    return annotations.every_annotator_pair(annotations.current_markables(table(spark, d, "markables")), "target")


@R.add("select mk_key, coalesce(attrs['intensity'], 'none') as kind from markables where coalesce(attrs['intensity'] not in ('weak', 'strong'), true)")
def split_markables(spark, d):
    from pyspark.sql.functions import coalesce, lit, try_element_at, when

    rows = table(spark, d, "markables")
    marked = rows.withColumn("kind", coalesce(try_element_at("attrs", lit("intensity")), lit("none")))
    marked = marked.withColumn("attrs", F.create_map(lit("diff_type"), when(F.col("kind") == "weak", "missing").when(F.col("kind") == "strong", "redundant").otherwise("none")))
    return annotations.split_by_difference(marked)[0].select("mk_key", "kind")


@R.add(f"select mk_key, list_aggregate(list_transform({SPAN}, lambda x: cast(x as varchar)), 'string_agg', ',') as words from markables where span is not null and span not in ('', '_', 'empty')")
def span_expansion(spark, d):
    rows = table(spark, d, "markables").withColumn("w", span_numbers(F.col("span"))).where("w is not null")
    return rows.select("mk_key", F.array_join(F.transform("w", lambda x: x.cast("string")), ",").alias("words"))


# --- events: time series and JSON ------------------------------------------------------------


@R.add("select month(ts)::int as month, day(ts)::int as day, (hour(ts) // 2)::int as hrange, event_type as class, count(*) as n from events group by all")
def event_buckets(spark, d):
    return ts.time_buckets(table(spark, d, "events"), 2, "ts", "event_type")


@R.add("select year(ts)::int as year, month(ts)::int as month, day(ts)::int as day, (hour(ts) // 6)::int as hrange, event_type as class, count(*) as n from events group by all")
def event_buckets_by_year(spark, d):
    return ts.time_buckets(table(spark, d, "events"), 6, "ts", "event_type", with_year=True)


@R.add("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@R.add("select event_type as class, row_number() over (partition by event_type order by n desc, word)::int as rank, word, n from (select event_type, cast(user_id as varchar) as word, count(*) as n from events group by 1, 2) qualify row_number() over (partition by event_type order by n desc, word) <= 5")
def top_users_per_class(spark, d):
    return ts.top_words(table(spark, d, "events").select(F.col("event_type").alias("class"), F.col("user_id").cast("string").alias("word")), 5)


@R.add("select vec_id, round(sum(x * x), 4) as sq from (select vec_id, unnest(embedding)::double as x from embeddings) group by 1")
def vector_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("sq"))
