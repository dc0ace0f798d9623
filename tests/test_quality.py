"""Records, packed fields and references on small fixtures."""

from datetime import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from korpusmill.operators import packed, records, references

GRAMMAR = records.Grammar(frozenset({"NN", "ART"}), frozenset({"SB", "--"}))
GOOD = ["1", "Haus", "Haus", "Haus", "NN", "NN", "_", "_", "-1", "2", "SB", "--", "_", "_"]


def line(**changes):
    row = list(GOOD)
    for k, v in changes.items():
        row[records.COLUMNS.index(k)] = v
    return "\t".join(row)


@pytest.mark.parametrize(
    "text, reason",
    [
        (line(), None), (line() + " \r", None), (line(form='"a\tb"'), None), (line(form='"a""b"'), None), (line(form='5"'), None), (line(form='"a" '), "quoting"), (line(form='"a"x'), "quoting"),
        (line(form='"a'), "quoting"), (line() + "\t", "columns"), ("1\tHaus", "columns"), (line(idx="0"), "value"), (line(idx="+1"), "value"), (line(idx="1.0"), "value"), (line(form=" "), "value"),
        (line(form='""'), "value"), (line(head="-2"), "value"), (line(phead="x"), "value"), (line(pos="nn"), "value"), (line(pos="_"), None), (line(pdeprel="XX"), "value"), (line(form='"a', pos="bad"), "quoting"),
        (line(idx="٣"), "value"), (line(pred='"arg'), "quoting"),
    ],
)
def test_line_reasons(text, reason):
    assert GRAMMAR.line(text)["reason"] == reason


@pytest.mark.parametrize("text", ["", "  ", "\r", "\x1b\tid\t5", " \r "])
def test_no_records(text):
    assert GRAMMAR.line(text) is None


def test_recovers_at_next_record_start():
    verdict = GRAMMAR.line(line(form='"broken') + "\t" + line(idx="2"))
    assert verdict["reason"] == "quoting" and verdict["fields"][0] == "2"
    assert verdict["resumed_at"] > verdict["char_pos"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab"\t x', max_size=6), min_size=1, max_size=6))
def test_quoting_round_trip(fields):
    text = "\t".join('"' + f.replace('"', '""') + '"' for f in fields)
    assert GRAMMAR.record(text) == fields


def test_parse_lines_frame(spark):
    rows = [(1, "f", 1, line()), (2, "f", 2, None), (3, None, None, line(idx="x")), (4, "f", 4, line()), (5, "f", 5, "9" * 30 + line()[1:])]
    lines = spark.createDataFrame(rows, "line_id bigint, file_name string, line_no int, line_text string").withColumn("reason", F.lit("clash"))
    tags = spark.createDataFrame([("pos", "NN"), ("deprel", "SB"), ("deprel", "--"), ("pos", None)], "tag_kind string, tag string")
    parsed = records.parse_lines(lines, tags)
    assert {r["line_id"]: r["reason"] for r in records.bad_lines(parsed).collect()} == {3: "value"}
    assert {r["line_id"] for r in records.good_records(parsed).collect()} == {1, 4, 5}
    assert records.parse_lines(lines.limit(0), tags).count() == 0


def test_large_integers_and_recovered_records(spark):
    rows = [(1, "f", 1, line(idx="3000000000", head="0007")), (2, "f", 2, line(idx="9" * 5000)), (3, "f", 3, line(form='"broken') + "\t" + line(idx="2")), (4, "f", 4, line(form='"lost'))]
    lines = spark.createDataFrame(rows, "line_id bigint, file_name string, line_no int, line_text string")
    tags = spark.createDataFrame([("pos", "NN"), ("deprel", "SB"), ("deprel", "--")], "tag_kind string, tag string")
    parsed = records.parse_lines(lines, tags)
    good = {r["line_id"]: r for r in records.good_records(parsed).collect()}
    assert set(good) == {1, 2} and good[1]["idx"] == 3_000_000_000 and good[1]["head"] == 7 and good[1]["too_large"] is None
    assert good[2]["idx"] is None and good[2]["too_large"] == {"idx": "9" * 5000}
    found = records.recovered_records(parsed).collect()
    assert [(r["line_id"], r["idx"], r["form"]) for r in found] == [(3, 2, "Haus")]


def split(spark, values, table="conll_words", source="s"):
    fields = spark.createDataFrame([(table, source, i, v) for i, v in enumerate(values)], "src_table string, source string, row_key bigint, value string")
    out = {}
    for r in packed.split_packed(fields).orderBy("row_key", "item_pos").collect():
        out.setdefault(r["row_key"], []).append(r["item_value"])
    return [out.get(i, []) for i in range(len(values))]


def test_packed_values(spark):
    got = split(
        spark,
        ["nom|sg|masc", " acc ; pl", '"note=a, b"|dat', "_", None, "", "empty", 'x="', "case=nom/num=sg", "|a||b|", '"gloss=""gut""; so",c', "a b\tc", '"a" "b"', "single", "  "],
    )
    assert got[0] == ["nom", "sg", "masc"] and got[1] == ["acc", "pl"] and got[2] == ["note=a, b", "dat"]
    assert got[3] == got[4] == got[5] == got[6] == got[14] == []
    assert got[8] == ["case=nom", "num=sg"] and got[9] == ["a", "b"] and got[10] == ['gloss="gut"; so', "c"]
    assert got[11] == ["a", "b", "c"] and got[12] == ["a", "b"] and got[13] == ["single"]


def test_packed_spans(spark):
    got = split(spark, ["word_3..word_5", "word_1 .. word_2", "word_7...8", '"word_1";"word_2..3"', "word_4,", "empty", "word_2|word_9"], "markables")
    w = lambda *n: [f"word_{i}" for i in n]
    assert got == [w(3, 4, 5), w(1, 2), w(7, 8), w(1, 2, 3), w(4), [], w(2, 9)]


def test_separators_are_scored_per_source(spark):
    rows = [("t", "a", i, "x|y|z") for i in range(9)] + [("t", "b", i, "x;y") for i in range(9)]
    seps = packed.inferred_separators(spark.createDataFrame(rows, "src_table string, source string, row_key bigint, value string"))
    assert {r["source"]: r["seps"] for r in seps.collect()} == {"a": "|", "b": ";"}


def test_separators_that_belong_to_values_are_rejected(spark):
    decimals = ["3,5|2,75", "10,0", "4,1|3,3|2,0", "7,5|1,25", "8,5"] * 20
    speeds = ["10 km/h|20 km/h", "5 km/h", "7 km/h;9 km/h", "8 km/h|3 km/h|2 km/h"] * 20
    lists = ["x,y", "x", "y,z,x", "z", "x,z"] * 20
    rows = [("t", s, 1000 * at + i, v) for at, (s, values) in enumerate([("a", decimals), ("b", speeds), ("c", lists)]) for i, v in enumerate(values)]
    fields = spark.createDataFrame(rows, "src_table string, source string, row_key bigint, value string")
    judged = {(r["source"], r["sep"]): r["accepted"] for r in packed.separator_scores(fields).collect()}
    assert judged == {("a", ","): False, ("a", "|"): True, ("b", " "): False, ("b", "/"): False, ("b", "|"): True, ("b", ";"): True, ("c", ","): True}
    got = {}
    for r in packed.split_packed(fields).orderBy("row_key", "item_pos").collect():
        got.setdefault(r["row_key"], []).append(r["item_value"])
    assert got[0] == ["3,5", "2,75"] and got[1] == ["10,0"] and got[1000] == ["10 km/h", "20 km/h"] and got[1002] == ["7 km/h", "9 km/h"] and got[2002] == ["y", "z", "x"]


def test_padding_before_quotes(spark):
    got = split(spark, ['a, "x/y; z", b', 'c | "p, q"', '"r"  ,  "s;t"', "a", "b,c", "d|e", "f,g|h"] * 5)
    assert got[:3] == [["a", "x/y; z", "b"], ["c", "p, q"], ["r", "s;t"]]


def test_rare_candidates_follow_the_table(spark):
    rows = [("t", "big", i, v) for i, v in enumerate(["x;y", "x", "y;z"] * 50)] + [("t", "small", 0, "x;z")] + [("u", "one", 0, "a|b")]
    seps = packed.inferred_separators(spark.createDataFrame(rows, "src_table string, source string, row_key bigint, value string"))
    assert {r["source"]: r["seps"] for r in seps.collect()}["small"] == ";"


def test_spans_use_the_separators_of_their_file(spark):
    rows = [(i, "f", s) for i, s in enumerate(["word_1;word_2", "word_3", "word_4..word_6;word_8", None, "empty"] * 9)]
    marks = spark.createDataFrame(rows, "mk_key bigint, file_name string, span string")
    got = {r["mk_key"]: r["numbers"] for r in packed.span_fields(marks, "mk_key").collect()}
    assert got[0] == [1, 2] and got[1] == [3] and got[2] == [4, 5, 6, 8] and 3 not in got


T1, T2, T3 = dt(2014, 1, 1), dt(2014, 2, 1), dt(2014, 3, 1)
MK = "mk_key bigint, file_name string, annotator int, anno_level string, markable_id string, span string, sentiment_ref string, emo_expression_ref string, loaded_at timestamp, deleted_at timestamp"


def orphans(spark, rows, words=()):
    marks = spark.createDataFrame(rows, MK).withColumn("orphan_kind", F.lit("clash"))
    ws = spark.createDataFrame(list(words), "file_name string, word_id int, form string, loaded_at timestamp, deleted_at timestamp")
    return sorted((r["mk_key"], r["ref_field"], r["orphan_kind"], r["generation"]) for r in references.orphan_cascade(marks, ws).collect())


def test_orphan_kinds_and_cascade(spark):
    rows = [
        (1, "f", 1, "sentiment", "m1", None, None, None, T1, None),
        (2, "f", 1, "emo-expression", "m2", None, " sentiment: m1", None, T1, None),
        (3, "f", 1, "emo-expression", "m3", None, "m9", None, T1, None),
        (4, "f", 1, "intensifier", "m4", None, None, "m3", T1, None),
        (5, "f", 1, "intensifier", "m5", None, None, "intensifier:m4", T1, None),
        (6, "f", 1, "sentiment", "m6", None, None, None, T1, T2),
        (7, "f", 1, "target", "m7", None, "m6", None, T1, None),
        (8, "f", 1, "sentiment", "m8", None, None, None, T3, None),
        (9, "f", 1, "source", "m10", None, "m8", "empty", T1, None),
        (10, "f", 2, "source", "m11", None, "m1", "", T1, None),
        (11, "f", 1, "source", "m12", None, "m6", None, T1, T2),
        (12, "f", 1, "diminisher", "m13", None, None, "m2", T1, None),
    ]
    assert orphans(spark, rows) == [
        (3, "sentiment_ref", "missing", 0), (4, "emo_expression_ref", "inherited", 1), (5, "emo_expression_ref", "inherited", 2), (7, "sentiment_ref", "deleted", 0),
        (9, "sentiment_ref", "late", 0), (10, "sentiment_ref", "missing", 0),
    ]


def test_span_orphans(spark):
    words = [("f", 1, "a", T1, None), ("f", 2, "b", T1, T2), ("f", 3, "c", T3, None), ("f", 3, "c", T1, None), ("f", 5, "e", T3, None)]
    rows = [(1, "f", 1, "target", "m1", "word_1..word_4", None, None, T1, None), (2, "f", 1, "target", "m2", "word_5", None, None, T1, None), (3, "f", 1, "target", "m3", "word_1", None, None, T1, None)]
    assert orphans(spark, rows, words) == [(1, "span", "deleted", 0), (1, "span", "missing", 0), (2, "span", "late", 0)]


def test_reference_cycle_ends(spark):
    rows = [(1, "f", 1, "emo-expression", "a", None, "zz", "emo-expression:b", T1, None), (2, "f", 1, "emo-expression", "b", None, None, "emo-expression:a", T1, None)]
    got = orphans(spark, rows)
    assert (1, "sentiment_ref", "missing", 0) in got and (2, "emo_expression_ref", "inherited", 1) in got


def test_no_references(spark):
    assert orphans(spark, []) == []
