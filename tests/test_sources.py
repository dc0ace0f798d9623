"""Readers and writers on files."""

import json

import pytest
from pyspark.sql import functions as F

from korpusmill.operators import features
from korpusmill.sources import readers, writers


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"eins  \r\n<tag x=\"1\">\n\nzwei\n")
    rows = readers.mark_skipped(readers.read_lines(spark, str(tmp_path / "a.txt")), "zwei", skip_xml=True).orderBy("line_no").collect()
    assert [(r["line_no"], r["line"], r["skipped"]) for r in rows] == [(1, "eins", False), (2, '<tag x="1">', True), (3, "", False), (4, "zwei", True)]


def test_lines_of_a_large_file(spark, tmp_path):
    (tmp_path / "big.txt").write_text("\n".join(f"line {i}" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        rows = readers.read_lines(spark, str(tmp_path / "big.txt"))
        assert rows.where("line <> concat('line ', line_no - 1)").count() == 0 and rows.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_json(spark, tmp_path):
    rows = [{"id": 1, "created_at": "t", "text": " a  b\n", "lang": "de"}, {"id": 2, "text": "x", "lang": "de"}, {"id_str": "3", "created_at": "t", "text": "y", "lang": "en"}]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, rows)))
    assert [(r["id"], r["text"]) for r in readers.read_tweets_json(spark, str(tmp_path / "m.json")).collect()] == [("1", "a b")]
    assert readers.read_tweets_json(spark, str(tmp_path / "m.json"), None).count() == 2


def test_xml(spark, tmp_path):
    (tmp_path / "m.xml").write_text('<corpus><tweet id="7" time="t1"> Hallo  Welt </tweet><tweet>x</tweet></corpus>')
    got = {(r["id"], r["time"], r["text"]) for r in readers.read_tweets_xml(spark, str(tmp_path / "m.xml")).collect()}
    assert got == {("7", "t1", "Hallo Welt"), ("unknown", "unknown", "x")}


def test_quoted_table(spark, tmp_path):
    (tmp_path / "m.csv").write_text('id\ttext\n1\t"a\nb"\n2\t"c ""d"""\n')
    got = {r["id"]: r["text"] for r in readers.read_quoted_table(spark, str(tmp_path / "m.csv"), ["id", "text"]).collect()}
    assert got == {"1": "a\nb", "2": 'c "d"'}
    (tmp_path / "bad.csv").write_text("id\ttext\n1\ta\tb\n")
    with pytest.raises(Exception):
        readers.read_quoted_table(spark, str(tmp_path / "bad.csv"), ["id", "text"]).collect()


def test_message_lines(spark):
    lines = spark.createDataFrame([("1\tpos\ttext",), ("unknown\t_\tx",), ("a\tb",)], "line string")
    good, bad = readers.parse_message_lines(lines)
    assert [tuple(r) for r in good.collect()] == [("1", "pos", "text"), (None, None, "x")] and bad.count() == 1


def test_stand_off_files(spark, tmp_path):
    words = spark.createDataFrame([(1, "Das"), (2, "EOL")], "word_id int, form string")
    writers.write_words_xml(words, str(tmp_path / "words"))
    assert sorted((r["word_id"], r["form"]) for r in readers.read_words_xml(spark, str(tmp_path / "words")).collect()) == [(1, "Das"), (2, "EOL")]
    (tmp_path / "mk.xml").write_text('<markables><markable id="m1" span="word_2..word_4,word_6" mmax_level="sentiment" polarity="positive"/></markables>')
    row = readers.read_markables_xml(spark, str(tmp_path / "mk.xml")).first()
    assert (row["markable_id"], row["level"], row["words"], row["attrs"]) == ("m1", "sentiment", [2, 3, 4, 6], {"polarity": "positive"})


def test_lexicon_and_rules(spark, tmp_path):
    (tmp_path / "p.smdict").write_text("##! CLASS: positive\nGut\t...\t1\n")
    assert [tuple(r)[:4] for r in readers.read_lexicon_files(spark, str(tmp_path / "p.smdict")).collect()] == [("positive", "gut", "...", 1.0)]
    assert readers.read_rule_lines(spark, str(tmp_path / "p.smdict")) == ["##! CLASS: positive", "Gut\t...\t1"]


def test_vectors(spark, tmp_path):
    (tmp_path / "v.txt").write_text("haus 1 2\nbaum 3 4\nrest 9 9\n")
    got = {r["word"]: r["vector"] for r in readers.read_vectors(spark, str(tmp_path / "v.txt"), spark.createDataFrame([("haus",), ("baum",)], "w string")).collect()}
    assert got == {"haus": [1.0, 2.0], "baum": [3.0, 4.0], "%UNK%": [2.0, 3.0]}


def test_connective_lexicon(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<lex><entry><orth><part>zwar</part><part>aber</part></orth><syn type="coordconj"><order><ante>0</ante><post>1</post><insert>0</insert></order><rel>concession</rel></syn></entry></lex>')
    row = readers.read_connective_lexicon(spark, str(tmp_path / "c.xml")).first()
    assert (row["orth"], row["type"], row["post"], row["ante"], row["rel"]) == (["zwar", "aber"], "conj", True, False, ["concession"])


def test_corpus_parts(spark):
    rows = spark.createDataFrame([(i, "s", "ab"[i % 2]) for i in range(200)], "id int, subcorpus string, category string")
    sizes = {(r["part"], r["category"]): r["count"] for r in readers.parts_of_corpus(rows).groupBy("part", "category").count().collect()}
    assert len({p for p, _ in sizes}) == 3 and all(33 <= n <= 34 for n in sizes.values())
    assert readers.drop_subcorpus(rows, "s").count() == 0


def test_numbered_words(spark):
    lines = spark.createDataFrame([("f", 1, "<t>"), ("f", 2, "a"), ("f", 3, ""), ("f", 4, "b")], "file string, line_no int, line string")
    assert [(r["word_id"], r["form"]) for r in readers.number_words(lines).orderBy("word_id").collect()] == [(1, "a"), (2, "b")]


def test_text_sinks(spark, tmp_path):
    messages = spark.createDataFrame([("1", "pos", "Hallo"), ("2", None, None)], "id string, polarity string, text string")
    values = [r["value"] for r in writers.escaped_blocks(messages).orderBy("id").collect()]
    assert values[0] == "\x1b\tid\t1\n\x1b\tpolarity\tpos\nHallo\n"
    writers.write_text(writers.tab_lines(messages, ["id", "polarity", "text"]), str(tmp_path / "out"), ["value"])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).orderBy("value").collect()] == ["1\tpos\tHallo", "2\t_\t_"]
    writers.write_table(messages, str(tmp_path / "table"), ["id"])
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_arff(spark):
    assert features.arff_header("r", [("a", "string")]).splitlines()[0] == "@relation r"
    row = spark.createDataFrame([("it's", None)], "a string, b string").select(features.arff_row(F.col("a"), F.col("b")).alias("x")).first()
    assert row["x"] == "'it\\'s',?"


def test_command_line(spark, data, tmp_path):
    from korpusmill import cli

    (tmp_path / "m.tsv").write_text("1\tpos\tGruß @max!!!!\nbad line\n")
    cli.main(["clean", str(tmp_path / "m.tsv"), "--format", "tsv", "--out", str(tmp_path / "clean"), "--as", "text"], spark)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "clean")).collect()] == ["1\tGruß %User!"]
    cli.main(["query", "word_counts", "--data", data, "--out", str(tmp_path / "q")], spark)
    assert spark.read.parquet(str(tmp_path / "q")).count() > 0
    with pytest.raises(ValueError):
        cli.read_messages(spark, "x", "pdf")
