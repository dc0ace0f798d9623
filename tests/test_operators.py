"""Rule engines, normalisers, grammar and further operators on hand-written examples."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from korpusmill.functions import text as fn
from korpusmill.operators import annotations, cleaning, conll, discourse, evaluation, grammar, lexicon, ngrams, noise, patterns, sampling, segments, threads, topics


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("RT @Bob675: Der Ausschuss tagt heute - mit #Kuchen... http://t.co/KZLYi7aj", "Der Ausschuss tagt heute - mit Kuchen..."),
        ("Wär doch mal was Neues :-)", "Wär doch mal was Neues %PosSmiley"),
        ("ich hoffe das passt, Gruß @hanna", "ich hoffe das passt, Gruß %User"),
        ("Mail an max@example.org bitte", "Mail an %Mail bitte"),
        ("mehr unter www.beispiel.de/x heute.....", "mehr unter %Link heute..."),
        ("alles gut!!!! xD", "alles gut! %PosSmiley"),
        ("ein _wort_ hier", "ein wort hier"),
        ("", ""),
    ],
)
def test_noise_rules(raw, clean):
    assert cleaning.NoiseCleaner().clean(raw) == clean


def test_replacement_log_places():
    log = patterns.ReplacementLog()
    text = cleaning.NoiseCleaner().clean("sagt @anna dazu :-)", log)
    for entry in log.entries:
        assert text[entry["offset"] : entry["offset"] + entry["length"]] == entry["replacement"]
    assert [e["num"] for e in log.entries] == list(range(0, 2 * len(log.entries), 2))


def test_rules_refuse_code_and_check_groups():
    with pytest.raises(ValueError):
        patterns.PatternRules.parse(['(a) --> __import__("os");;'])
    with pytest.raises(ValueError):
        patterns.PatternRules.parse(['(a)(b) --> "x";;'])


def test_rule_conflicts_prefer_earlier_then_longer():
    rules = patterns.PatternRules.parse(['(bc) --> "X";;', '(abc) --> "Y";;', '(ab) --> "Z";;'])
    assert rules.sub("abc") == "Y"
    assert patterns.PatternRules.parse(['a(b)c --> "1";;', '(a)bc --> "2";;']).sub("abc") == "21c"


def test_dictionary_groups():
    rules = patterns.PatternRules.parse(['x(?d\\w+) --> "D";;'], frozenset({"haus"}))
    assert rules.sub("xhaus xbaum") == "xD xbaum"


def test_maps():
    rules = patterns.MapRules.parse(["##! RE_OPTIONS: IGNORECASE | WORDS", "nich -> nicht", '"gehts" -> "geht es" # comment'])
    assert rules.replace("Nich so, gehts NICH nichts") == "Nicht so, geht es NICHT nichts"
    assert patterns.MapRules({"a": "b", "ab": "c"}).replace("aba") == "cb"
    with pytest.raises(ValueError):
        patterns.MapRules({"a": "x", "b": "x"}).reverse()
    assert patterns.MapRules({"ä": "ae"}).reverse().replace("baer") == "bär"


def test_map_column(spark):
    assert column(spark, ["äa", None], patterns.MapRules({"ä": "a"}).column) == ["aa", None]
    assert column(spark, ["nix da", None], patterns.MapRules({"nix": "nichts"}, whole_words=True).column) == ["nichts da", None]


def test_log_shift(spark):
    df = spark.range(1).select(F.array(F.struct(F.lit(5).alias("offset"), F.lit(1).alias("length"), F.lit(0).alias("num"), F.lit("a").alias("orig"), F.lit("b").alias("replacement"))).alias("log"))
    assert df.select(patterns.shift_log(F.col("log"), F.lit(2), F.lit(3)).alias("l")).first()["l"][0]["offset"] == 8


def test_span_selection():
    spans = [(0, 5), (3, 8), (7, 9), (0, 2)]
    assert patterns.leftmost_longest(spans) == [(0, 5), (7, 9)]
    assert patterns.leftmost_longest([(0, 5), (3, 8), (7, 9)], literal=True) == [(0, 5)]
    assert patterns.not_starting_inside([(1, 2), (5, 6)], [(0, 1), (6, 7)]) == [(5, 6)]


def test_umlauts():
    restorer = noise.UmlautRestorer()
    assert restorer.restore("gruendlich aktuell Aerger quer neue") == "gründlich aktuell Ärger quer neue"
    log = patterns.ReplacementLog()
    log.append(10, "x", "y")
    assert restorer.restore("fuer alle da", log) == "für alle da" and log.entries[0]["offset"] == 9


def test_elongations(spark):
    assert noise.shortenings("liiieb") == ["lieb", "liieb", "liiieb"]
    assert noise.shortenings("liiieb", literal=True) == ["lieb", "liieb"]
    assert column(spark, ["heeeeyy", "XIII", "Saal", None], fn.squeeze_runs) == ["hey", "XI", "Sal", None]
    assert column(spark, ["heeey", "XIII", "Saal", "@aaa"], fn.is_elongated) == [True, False, False, False]


def test_misspellings():
    known = {"habe", "gehen", "das", "gibt", "geht", "komm"}
    restorer = noise.MisspellingRestorer(noise.Checks(known.__contains__))
    assert restorer.correct("ich hab das, gehn wir raus? gibts ne Suppe") == "ich habe das, gehen wir heraus? gibt es eine Suppe"
    assert restorer.correct("") == ""


def test_sentences(spark):
    text = "Das ist gut. Wirklich? Ja! Am 3. mai kommen ca. 5 Leute... Ende"
    got = segments.split_sentences(text)
    assert [s for s, _ in got] == ["Das ist gut.", "Wirklich?", "Ja!", "Am 3. mai kommen ca. 5 Leute...", "Ende"]
    assert all(text[i : i + len(s)] == s for s, i in got)
    assert column(spark, ["a. B!", "", None], segments.sentences)[1:] == [[], None]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_linear_alignment_is_as_good(a, b):
    def score(found):
        pairs = [(i, j) for i, js in enumerate(found) for j in js]
        return sum(segments.plain_score(a[i], b[j]) for i, j in pairs) - 2 * (len(a) + len(b) - 2 * len(pairs))

    assert score(segments.align(a, b)) == score(segments.align_linear(a, b, cells=1))


def test_alignment_frame(spark):
    tokens = spark.createDataFrame([("d", 1, "#Haus"), ("d", 2, "ist"), ("d", 3, "neu")], "doc_id string, idx int, form string")
    words = spark.createDataFrame([("d", 7, "haus"), ("d", 9, "neu")], "doc_id string, word_id int, form string")
    got = {r["idx"]: list(r["word_ids"]) for r in segments.merge_by_alignment(tokens, words).collect()}
    assert got == {1: [7], 2: [], 3: [9]}


def toks(s):
    pairs = [x.rsplit("/", 1) for x in s.split()]
    return [dict(form=f, pos=p, lemma=f.lower(), idx=i + 1, head=0, feats=()) for i, (f, p) in enumerate(pairs)]


def test_units():
    units = discourse.UnitSegmenter().segment(toks("Die/ART Frau/NN ,/$, die/PRELS lacht/VVFIN ,/$, lobt/VVFIN wegen/APPR der/ART Hitze/NN den/ART Koch/NN ./$."))
    assert [(u.kind, u.parent) for u in units] == [("MainCl", None), ("RelCl", 0), ("DiPP", 0)]
    units = discourse.UnitSegmenter().segment(toks("Bevor/KOUS der/ART Laden/NN schließt/VVFIN ,/$, kauft/VVFIN er/PPER Brot/NN ./$."))
    assert [u.kind for u in units] == ["SubCl", "MainCl"]
    units = discourse.UnitSegmenter().segment(toks("Er/PPER weiß/VVFIN ,/$, dass/KOUS sie/PPER kommt/VVFIN ./$."))
    assert len(units) == 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["NN", "ART", "VVFIN", "KOUS", "$,", "$.", "APPR", "PRELS", "KON", "ADV", "VVINF", "PTKZU"]), max_size=14))
def test_units_keep_every_token(tags):
    tokens = [dict(form="w", pos=t, lemma="w", idx=i, head=0, feats=()) for i, t in enumerate(tags)]
    found = sorted(t["idx"] for u in discourse.UnitSegmenter().segment(tokens) for t in u.tokens)
    assert found == list(range(len(tags)))


def test_chunk_agreement():
    assert grammar.unifies(grammar.feature_bits({"nom", "sg"}), grammar.feature_bits({"nom"}))
    assert not grammar.unifies(grammar.feature_bits({"nom"}), grammar.feature_bits({"dat"}))
    det = dict(form="der", pos="ART", feats=("nom", "sg", "masc"))
    noun = dict(form="Hund", pos="NN", feats=("nom", "sg", "masc"))
    assert [n.label for n in grammar.CHUNKS.parse([det, noun])] == ["NC"]
    cascade = grammar.Cascade()
    with pytest.raises(ValueError):
        cascade.add(-1, "X", "<A>")


def test_verb_patterns():
    trie = discourse.VerbTrie(["an|nehmen", "aus|gehen[davon/PROAV]"])
    assert trie.match("annehmen", []) and not trie.match("ausgehen", []) and trie.match("ausgehen", [dict(lemma="davon", pos="PROAV")])


CON = [(["weil"], "subj", True, True, True, ["cause"]), (["entweder", "oder"], "conj", False, True, False, ["disjunction"]), (["ohne dass"], "subj", False, True, False, ["manner"]), (["aber"], "conj", False, True, True, ["contrast"])]


def test_connectives(spark):
    lex = spark.createDataFrame(CON, discourse.CONNECTIVE_DDL)
    words = "entweder er kommt oder sie geht ohne dass er fragt weil es regnet".split()
    tokens = spark.createDataFrame([("d", 0, i + 1, w) for i, w in enumerate(words)] + [("d", 1, 1, "Aber"), ("d", 1, 2, "nein")], "doc_id string, sent_id int, idx int, form string")
    found = discourse.argument_type(discourse.find_connectives(tokens, lex), tokens)
    got = {(r["sent_id"], r["first_idx"], r["last_idx"], " ".join(r["orth"]), r["arg_type"]) for r in found.collect()}
    assert got == {(0, 1, 4, "entweder oder", "inter_sent"), (0, 7, 8, "ohne dass", "intra_sent"), (0, 11, 11, "weil", "intra_sent"), (1, 1, 1, "aber", "inter_sent")}


def test_longest_prefix(spark):
    phrases = spark.createDataFrame([("an",), ("an Hand",), ("trotz",)], "p string")
    texts = spark.createDataFrame([("an Hand von",), ("an der Ecke",), ("ander",)], "text string")
    got = {r["text"]: r["phrase"] for r in discourse.longest_prefix(phrases, texts).collect()}
    assert got == {"an Hand von": "an Hand", "an der Ecke": "an"}


def test_case_functions(spark):
    df = spark.createDataFrame([("abc", "Xy"), ("abc", "XYZ"), ("abc", "xyz"), ("a b", "XY")], "a string, b string")
    assert [r[0] for r in df.select(fn.upcase_capitalize(F.col("a"), F.col("b"))).collect()] == ["Abc", "ABC", "abc", "A b"]
    assert [patterns.upcase_capitalize("abc", x) for x in ("Xy", "XYZ", "xyz")] == ["Abc", "ABC", "abc"]
    assert [r[0] for r in df.select(fn.adjust_case(F.col("a"), F.col("b"))).collect()] == ["Abc", "ABC", "abc", "A B"]


def test_xml_lines(spark):
    lines = ['<tag a="1" b="x y">', "text", "<a/><b/>", "<a> text"]
    assert column(spark, lines, fn.is_xml_tag) == [True, False, True, False]
    assert column(spark, lines[:1], fn.xml_tag_name) == ["tag"]
    assert column(spark, lines[:1], fn.xml_attributes) == [{"a": "1", "b": "x y"}]


def test_tokens_by_pattern(spark):
    got = column(spark, ["Siehe http://a.de/x, @max :-) z.B. 3,5 Mio. geht's?!"], fn.tokens_of)[0]
    assert got == ["Siehe", "http://a.de/x", ",", "@max", ":-)", "z.B.", "3,5", "Mio", ".", "geht's", "?!"]


def test_message_time(spark):
    got = column(spark, ["Sat Sep 06 21:28:14 +0000 2014", "unknown", None], fn.message_time)
    assert str(got[0]) == "2014-09-06 21:28:14" and got[1:] == [None, None]


def test_lexicon_reading(spark):
    lines = ["##! CLASS: positive", "Gut\t...\t0.5  # note", "t_ADJX(schön, 0.7)", "##! CLASS: negative", "schlecht\tADJD\t-0.5", "gut\t...\t0.9", "bad line"]
    rows = lexicon.read_lexicon(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string"))
    got = {(r["class"], r["word"], r["tag"], r["score"]) for r in rows.collect()}
    assert got == {("positive", "gut", "...", 0.5), ("positive", "schön", "ADJA", 0.7), ("positive", "schön", "ADJD", 0.7), ("negative", "schlecht", "ADJD", -0.5), ("negative", "gut", "...", 0.9)}
    best = {(r["word"], r["tag"]): r["score"] for r in lexicon.last_wins(rows).collect()}
    assert best["gut", "..."] == 0.9


def test_lexicon_conversion(spark):
    entries = [("x", "Haus", "NN", "POS", "0.2/-/-", "", 1), ("x", "haus", "NN", "POS", "0.9/-/-", "", 2), ("x", "nett", "AD", "POS", "-/-/-", "", 3), ("x", "lachen", "VV", "POS", "0.5/-/-", "", 4), ("x", "kein", "PI", "NEG", "0.1/-/-", "", 5)]
    rows = spark.createDataFrame(entries, "form string, lemma string, tag string, polarity string, scores string, note string, seq int")
    got = {(r["word"], r["tag"]): r["score"] for r in lexicon.convert_lexicon(rows).collect()}
    want = {("haus", "NN"): 0.2} | {("nett", t): 0.3333 for t in ("ADJA", "ADJD", "ADV")} | {("lachen", t): 0.5 for t in ("VVINF", "VVFIN", "VVPP", "VVIMP", "VVIZU")} | {("kein", t): 0.1 for t in ("PIS", "PIAT", "PIDAT")}
    assert got == want


def test_lexicon_macros_and_class_of_the_file(spark):
    lines = ["Gut\tt_ANY\t0.5", "schön\tt_ADJX\t0.7", "##! CLASS: other", "t_VVINF(lachen, 1)"]
    rows = lexicon.read_lexicon(spark.createDataFrame([("/a/b/positive.smdict", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string"))
    got = {(r["class"], r["word"], r["tag"]) for r in rows.collect()}
    assert got == {("positive", "gut", "..."), ("positive", "schön", "ADJA"), ("positive", "schön", "ADJD")} | {("other", "lachen", t) for t in ("VVINF", "VVIZU", "VVFIN")}


def test_connectives_of_many_parts_and_words():
    matcher = discourse.ConnectiveMatcher([(["weder", "noch", "und auch"], "conj", []), (["noch"], "adv", []), (["aus dem einfachen grund dass"], "subj", []), (["aus"], "adv", [])])
    find = lambda text: [(a, b, matcher.entries[n][0][0]) for a, b, n in matcher.match(text.split())]
    assert find("weder er noch sie") == [(2, 2, "noch")]
    assert find("weder er noch sie und auch wir") == [(0, 5, "weder")]
    assert find("aus dem einfachen grund dass er lacht") == [(0, 4, "aus dem einfachen grund dass")]
    assert find("") == []


def test_connective_arguments_in_one_pass(spark):
    words = [("d", 0, 1, "Es", "PPER"), ("d", 0, 2, "regnet", "VVFIN"), ("d", 1, 1, "Aber", "KON"), ("d", 1, 2, "er", "PPER"), ("d", 1, 3, "lacht", "VVFIN"), ("d", 1, 4, ",", "$,"), ("d", 1, 5, "weil", "KOUS"), ("d", 1, 6, "er", "PPER"), ("d", 1, 7, "singt", "VVFIN"), ("e", 3, 1, None, None)]
    tokens = spark.createDataFrame([(d, s, i, w, w, p, 0, None) for d, s, i, w, p in words], "doc_id string, sent_id int, idx int, form string, lemma string, pos string, phead int, feat string")
    got = {r["first_idx"]: (r["arg_type"], r["int_arg"], r["ext_arg"]) for r in discourse.connective_arguments(tokens, spark.createDataFrame(discourse.CONNECTIVES, discourse.CONNECTIVE_DDL)).collect()}
    assert got[1][0] == "inter_sent" and got[1][2] == "Es regnet"
    assert got[5][0] == "intra_sent" and "weil" in got[5][1]


def test_negation(spark):
    lex = lexicon.lexicon_from(spark, [("positive", "gut", "...", 1.0)])
    rows = [("d", 0, 1, "nicht", "PTKNEG"), ("d", 0, 2, "gut", "ADJD"), ("d", 1, 1, "nicht", "PTKNEG"), ("d", 1, 2, "laufen", "VVINF"), ("d", 1, 3, "gut", "ADJD")]
    tokens = spark.createDataFrame(rows, "doc_id string, sent_id int, idx int, lemma string, pos string")
    got = {r["sent_id"]: (r["score"], r["polarity"]) for r in lexicon.sentence_polarity_negated(tokens, lex, ["doc_id", "sent_id"]).collect()}
    assert got == {0: (-1.0, "neg"), 1: (1.0, "pos")}
    literal = {r["sent_id"]: r["score"] for r in lexicon.sentence_polarity_negated(tokens, lex, ["doc_id", "sent_id"], literal=True).collect()}
    assert literal[0] == 1.0


def test_thread_cycle_and_chain(spark):
    rows = [("1", None), ("2", 1), ("3", 2), ("4", 3), ("8", 9), ("9", 8), ("5", 77), ("2", 1)]
    messages = spark.createDataFrame(rows, "id string, in_reply_to_status_id bigint")
    got = {r["id"]: (r["root"], r["depth"]) for r in threads.thread_roots(messages).collect()}
    assert got == {"1": ("1", 0), "2": ("1", 1), "3": ("1", 2), "4": ("1", 3), "8": (None, None), "9": (None, None), "5": ("77", 1), "77": ("77", 0)}


def test_deep_thread(spark):
    messages = spark.createDataFrame([(str(i), i - 1 if i else None) for i in range(300)], "id string, in_reply_to_status_id bigint")
    assert threads.thread_roots(messages).agg(F.max("depth")).first()[0] == 299


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcde"), st.integers(0, 20), min_size=1), st.integers(0, 60))
def test_quotas(sizes, total):
    got = sampling.quotas(sizes, total)
    assert sum(got.values()) == min(total, sum(sizes.values())) and all(0 <= got[g] <= sizes[g] for g in sizes)
    unfilled = [got[g] for g in sizes if got[g] < sizes[g]]
    assert not unfilled or max(got.values()) <= max(unfilled) + 1 or max(unfilled) - min(unfilled) <= 1


def test_topic_model_name_is_checked(spark):
    with pytest.raises(ValueError):
        topics.detect_topics(None, None, None, model="m")


def test_feature_map(spark):
    got = column(spark, ["nom|num=pl|num=sg|x", "_", None, ""], conll.feature_map)
    assert got == [{"case": "nom", "num": "sg", "x": "True"}, {}, None, {}]


def test_restore_replacements(spark):
    tokens = spark.createDataFrame([(1, 0, "hallo", 0, 5), (1, 1, "(%User),", 6, 8)], "doc_id int, pos int, token string, start int, len int")
    log = spark.createDataFrame([(1, 7, 5, "@max", "%User"), (1, 0, 2, "x", "%Mail")], "doc_id int, offset int, length int, orig string, replacement string")
    got = {r["pos"]: r["token"] for r in annotations.restore_replacements(tokens, log, ["%User"]).collect()}
    assert got == {0: "hallo", 1: "(@max),"}


def test_join_by_position(spark):
    tokens = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b")], "doc_id string, idx int, form string")
    notes = spark.createDataFrame([("d", 5, "X"), ("d", 9, "Y")], "doc_id string, idx int, tag string")
    got = [(r["form"], r["tag"]) for r in annotations.join_by_position(tokens, notes, ["doc_id"], "idx", "tag").orderBy("idx").collect()]
    assert got == [("a", "X"), ("b", "Y")]
    with pytest.raises(Exception, match="differ in number"):
        annotations.join_by_position(tokens, notes.limit(1), ["doc_id"], "idx", "tag").collect()


def test_span_scores_small(spark):
    rows = [("s", 1, "A", "A"), ("s", 2, "A", "O"), ("s", 3, "O", "O"), ("s", 4, "BB", "B"), ("s", 5, "B", "B")]
    tags = spark.createDataFrame(rows, "d string, i int, gold string, pred string")
    got = {r["tag"]: (r["prec"], r["recall"]) for r in evaluation.span_scores(tags, ["d"], ["i"], "proportional").collect()}
    assert got["A"] == (100.0, 50.0)
    exact = {r["tag"]: (r["prec"], r["recall"]) for r in evaluation.span_scores(tags, ["d"], ["i"], "exact").collect()}
    assert exact["A"] == (0.0, 0.0) and exact["B"] == (100.0, 100.0)
    with pytest.raises(ValueError):
        evaluation.span_scores(tags, ["d"], ["i"], "x")


def test_ngram_probabilities_sum(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (4, "")], "doc_id int, text string")
    counts = ngrams.unigram_counts(docs)
    assert {r["w"]: r["cnt"] for r in counts.collect()} == {"a": 2, "b": 2, "c": 1, "eol": 3}
    assert ngrams.unigram_logprob(counts).agg(F.sum(F.exp("logp"))).first()[0] < 1


def test_balance_and_split(spark):
    rows = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(10)], "id int, k string")
    assert {r["k"]: r["count"] for r in sampling.balance_classes(rows, "k", "id").groupBy("k").count().collect()} == {"a": 7, "b": 7}
    assert {r["split"]: r["count"] for r in sampling.split_70_10_20(rows, ["id"]).groupBy("split").count().collect()} == {"train": 7, "dev": 1, "test": 2}


def test_prefix_sums_of_a_hot_group(spark):
    from korpusmill.operators.scans import prefix_sums, ranked

    rows = [("hot", i, i % 3) for i in range(500)] + [("b", 5, 1), (None, 7, 2), ("c", 1, 0)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(7)
    got = {(r["g"], r["i"]): (r["s"], r["s_total"]) for r in prefix_sums(df, ["g"], ["i"], {"s": F.col("v")}, totals=True).collect()}
    want, run = {}, {}
    for g, i, v in rows:
        run[g] = run.get(g, 0) + v
        want[g, i] = run[g]
    assert got == {k: (v, run[k[0]]) for k, v in want.items()}
    assert sorted(r["rank0"] for r in ranked(df, [], ["i", "g"]).collect()) == list(range(len(rows)))


def test_holdout_and_halves(spark):
    rows = spark.range(2000)
    assert 120 < sampling.holdout(rows, "id").where("part = 'dev'").count() < 280
    first, second = sampling.half_resample(rows, "id", 0), sampling.half_resample(rows, "id", 1)
    assert 850 < first.count() < 1150 and not first.exceptAll(second).isEmpty()


def test_unit_layers_round_trip(spark):
    rows = [("d", 0, 0, "MainCl", None, 1, 3), ("d", 0, 1, "RelCl", 0, 4, 6), ("d", 1, 0, "MainCl", None, 1, 2)]
    units = spark.createDataFrame(rows, "doc_id string, sent_id int, unit_no int, kind string, parent int, first_idx int, last_idx int")
    marks, feats = discourse.unit_layers(units)
    assert marks.where("layer = 'SDS'").count() == 2
    assert sorted(map(tuple, discourse.units_of_layers(marks, feats).collect())) == sorted(rows)


def test_source_texts_are_unique(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, text string")
    assert discourse.source_texts(texts).count() == 2
    with pytest.raises(Exception, match="duplicate id"):
        discourse.source_texts(texts.union(texts)).collect()


def test_tree_depths_with_a_loop(spark):
    rows = [("d", 0, 1, 2), ("d", 0, 2, 0), ("d", 0, 3, 4), ("d", 0, 4, 3), ("d", 0, 5, 3), ("d", 0, 6, 1)]
    got = {r["idx"]: r["depth"] for r in conll.tree_depths(spark.createDataFrame(rows, "doc_id string, sent_id int, idx int, phead int")).collect()}
    assert got == {1: 1, 2: 0, 3: None, 4: None, 5: None, 6: 2}
