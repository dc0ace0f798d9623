"""Queries of the general training-data operators (problems 2, 3 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from korpusmill.operators import packed, records, references
from korpusmill.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.bad_lines(records.parse_lines(table(spark, sf_dir, "conll_lines"), table(spark, sf_dir, "tagset")))


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.good_records(records.parse_lines(table(spark, sf_dir, "conll_lines"), table(spark, sf_dir, "tagset")))


def p2_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.recovered_records(records.parse_lines(table(spark, sf_dir, "conll_lines"), table(spark, sf_dir, "tagset")))


def p2_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = records.parse_lines(table(spark, sf_dir, "conll_lines"), table(spark, sf_dir, "tagset"))
    return parsed.where("reason is not null").select("line_id", "file_name", "line_no", "reason", "field_no", "char_pos", "resumed_at")


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.packed_fields(table(spark, sf_dir, "conll_words"), table(spark, sf_dir, "markables"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.split_packed(_fields(spark, sf_dir))


def p3_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.separator_scores(_fields(spark, sf_dir))


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_cascade(table(spark, sf_dir, "markables"), table(spark, sf_dir, "mmax_words"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir).where("generation = 0").select("mk_key", "ref_field", "orphan_kind")


def p5_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir).select("mk_key", "ref_field", "orphan_kind", "generation")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_report(_cascade(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p2_found, p2_records, p2_recovered, p2_errors, p3_found, p3_separators, p5_found, p5_cascade, p5_report)}
#: Token lines with their fields and the first reason against them.
_LINES = r"""l as (select line_id, regexp_replace(line_text, '[\r ]+$', '') as t from conll_lines where line_text is not null),
s as (select line_id, t, regexp_full_match(t, '(?:(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)\t)*(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)', 's') as ok from l where t <> '' and not starts_with(t, chr(27))),
f as (select line_id, ok, case when ok then list_transform(regexp_extract_all(chr(9) || t, '\t(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)', 0, 's'),
   lambda x: case when x[2:2] = '"' then replace(x[3:-2], '""', '"') else x[2:] end) end as f from s),
v as (select line_id, f, case when not ok then 'quoting' when len(f) <> 14 then 'columns'
  when not regexp_full_match(f[1], '0*[1-9][0-9]*') or trim(f[2], chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') = ''
    or not (f[9] = '-1' or regexp_full_match(f[9], '[0-9]+')) or not (f[10] = '-1' or regexp_full_match(f[10], '[0-9]+'))
    or not (f[5] = '_' or list_contains(pt, f[5])) or not (f[6] = '_' or list_contains(pt, f[6]))
    or not (f[11] = '_' or list_contains(dt, f[11])) or not (f[12] = '_' or list_contains(dt, f[12])) then 'value' end as reason
  from f, (select list(tag) filter (tag_kind = 'pos') as pt, list(tag) filter (tag_kind = 'deprel') as dt from tagset))"""
#: Direct orphans, and the references that lead to their records generation by generation.
_ORPHANS = r"""items as (
  select mk_key, unnest(regexp_extract_all(regexp_replace(span, '\s*\.{2,}\s*', '..', 'g'), '[^"|;,/\t ]+')) as p from markables where deleted_at is null and span is not null and span not in ('', '_', 'empty')
), nums as (
  select distinct mk_key, unnest(case when p like '%..%' then range(cast(regexp_extract(p, '^(?:word_)?(\d+)', 1) as int), cast(regexp_extract(p, '(\d+)$', 1) as int) + 1)
    else [try_cast(regexp_extract(p, '^word_(\d+)$', 1) as bigint)] end) as word_id from items
), words as (select file_name, word_id, min(loaded_at) as first_loaded, bool_and(deleted_at is not null) as gone from mmax_words group by 1, 2),
sp as (select n.mk_key, 'span' as ref_field, case when w.word_id is null then 'missing' when gone then 'deleted' when first_loaded > m.loaded_at then 'late' end as orphan_kind
  from nums n join markables m using (mk_key) left join words w on w.file_name = m.file_name and w.word_id = n.word_id where n.word_id is not null),
refs as (
  select mk_key, file_name, annotator, loaded_at, 'sentiment_ref' as ref_field, regexp_replace(sentiment_ref, '\s', '', 'g') as r, ['sentiment'] as dflt from markables where deleted_at is null
  union all select mk_key, file_name, annotator, loaded_at, 'emo_expression_ref', regexp_replace(emo_expression_ref, '\s', '', 'g'), ['emo-expression', 'intensifier'] from markables where deleted_at is null
), parsed as (select mk_key, file_name, annotator, loaded_at, ref_field, case when instr(r, ':') > 0 then [split_part(r, ':', 1)] else dflt end as levels,
   case when instr(r, ':') > 0 then r[instr(r, ':') + 1:] else r end as id from refs where r is not null and r not in ('', 'empty')),
t as (select p.mk_key, p.ref_field, p.loaded_at, min(m.loaded_at) as first_loaded, bool_and(m.deleted_at is not null) as gone, count(m.mk_key) as n
  from parsed p left join markables m on m.file_name = p.file_name and m.annotator = p.annotator and m.markable_id = p.id and list_contains(p.levels, m.anno_level) group by 1, 2, 3),
k as (select mk_key, ref_field, case when n = 0 then 'missing' when gone then 'deleted' when first_loaded > loaded_at then 'late' end as orphan_kind from t),
direct as (select * from k where orphan_kind is not null union all select distinct * from sp where orphan_kind is not null)"""
_INHERITED = """e as (select distinct p.mk_key, p.ref_field, m.mk_key as target from parsed p join markables m on m.file_name = p.file_name and m.annotator = p.annotator and m.markable_id = p.id and list_contains(p.levels, m.anno_level)),
same as (select a.mk_key as one, b.mk_key as other from markables a join markables b using (file_name, annotator, anno_level, markable_id)),
reach(mk_key, generation) as (select mk_key, 0 from direct union select e.mk_key, r.generation + 1 from reach r join same s on s.one = r.mk_key join e on e.target = s.other where r.generation < 50),
first as (select mk_key, min(generation) as generation from reach group by 1),
inherited as (select distinct e.mk_key, e.ref_field, f.generation from first f join e using (mk_key) join same s on s.other = e.target join first g on g.mk_key = s.one and g.generation = f.generation - 1 where f.generation > 0)"""
ORACLES: dict[str, str] = {
    "p2_found": f"with {_LINES} select line_id, reason from v where reason is not null",
    "p2_records": f"""with {_LINES} select v.line_id, c.file_name, c.line_no, {', '.join(f"cast(f[{i + 1}] as bigint) as {name}" if name in records.INTEGERS else f"f[{i + 1}] as {name}" for i, name in enumerate(records.COLUMNS))},
 cast(null as map(varchar, varchar)) as too_large from v join conll_lines c using (line_id) where reason is null""",
    "p3_found": r"""with f as (
  select 'conll_words' as src_table, tok_id as row_key, feat as v, false as is_span from conll_words
  union all select 'markables', mk_key, regexp_replace(span, '\s*\.{2,}\s*', '..', 'g'), true from markables
), held as (select * from f where v is not null and trim(v, ' ') not in ('', '_', 'empty')),
raw as (
  select src_table, row_key, is_span, regexp_extract_all(v, '"(?:[^"]|"")*"|[^"|;,/\t ][^|;,/\t ]*') as r from held
), bare as (
  select src_table, row_key, is_span, list_transform(r, lambda x: case when x like '"%"' and length(x) >= 2 then trim(replace(x[2:-2], '""', '"'), ' ') else trim(x, ' ') end) as b from raw
), pieces as (
  select src_table, row_key, case when is_span then flatten(list_transform(b, lambda p: case
      when regexp_full_match(p, '(?:word_)?\d+\.\.(?:word_)?\d+') then list_transform(
        case when cast(regexp_extract(p, '^(?:word_)?(\d+)', 1) as int) <= cast(regexp_extract(p, '(\d+)$', 1) as int)
          then range(cast(regexp_extract(p, '^(?:word_)?(\d+)', 1) as int), cast(regexp_extract(p, '(\d+)$', 1) as int) + 1)
          else list_reverse(range(cast(regexp_extract(p, '(\d+)$', 1) as int), cast(regexp_extract(p, '^(?:word_)?(\d+)', 1) as int) + 1)) end, lambda n: 'word_' || n)
      when regexp_full_match(p, 'word_\d+') then ['word_' || cast(cast(p[6:] as int) as varchar)] else [p] end)) else b end as items from bare
), kept as (select src_table, row_key, list_filter(items, lambda x: x <> '') as items from pieces)
select src_table, row_key, cast(i as int) as item_pos, items[i] as item_value from (select *, unnest(range(1, len(items) + 1)) as i from kept)""",
    "p5_found": f"with {_ORPHANS} select mk_key, ref_field, orphan_kind from direct",
    "p5_cascade": f"with recursive {_ORPHANS}, {_INHERITED} select mk_key, ref_field, orphan_kind, 0 as generation from direct union all select mk_key, ref_field, 'inherited', generation from inherited",
    "p5_report": f"""with recursive {_ORPHANS}, {_INHERITED}, o as (select mk_key, ref_field, orphan_kind, 0 as generation from direct union all select mk_key, ref_field, 'inherited', generation from inherited)
 select m.anno_level, o.ref_field, strftime(m.loaded_at, '%Y-%m') as load_month, o.orphan_kind, count(*) as n_references, count(distinct o.mk_key) as n_records, sum(case when generation > 0 then 1 else 0 end)::bigint as n_inherited
 from o join markables m using (mk_key) group by 1, 2, 3, 4""",
}
