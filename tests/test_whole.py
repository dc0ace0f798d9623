"""Queries that must cover their whole input, on small fixtures."""

import re

import pytest

from korpusmill.operators import annotations, ngrams, noise
from korpusmill.plans import registry


@pytest.fixture
def tables(spark, tmp_path):
    def write(**frames):
        for name, (rows, ddl) in frames.items():
            spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_every_topic_is_detected(spark, tables):
    rows = [(f"d{k}_{i}", f"feed_{k:02}", "de", f"wort{chr(97 + k)} wort{chr(97 + k)} alle") for k in range(12) for i in range(2)]
    d = tables(documents=(rows, "doc_id string, source string, lang string, text string"))
    names = {f"feed_{k:02}" for k in range(12)}
    run = lambda name: registry.QUERIES[name](spark, d).collect()
    assert {r["topic"] for r in run("topic_priors_all")} == names
    for name in ("topic_detect_top3_all", "topic_detect_bernoulli_all"):
        best = {r["doc_id"]: r["topic"] for r in run(name) if r["rank"] == 1}
        assert best == {doc: source for doc, source, _, _ in rows}
    for name in ("topic_likelihood_multinomial_all", "topic_likelihood_bernoulli_all", "topic_missing_words_all"):
        assert {r["topic"] for r in run(name)} == names


def test_ngrams_refuse_a_misspelling(spark):
    """"hab" is out of the dictionary and "habe" in it, but only the n-grams of one line speak for the change."""
    lines = spark.createDataFrame([("a", "ich hab das"), ("b", "sie hab nie"), ("c", None)], "doc_id string, text string")
    known = spark.createDataFrame([("habe",), ("ich",), ("das",)], "word string")
    corpus = spark.createDataFrame([(f"x{i}", "ich habe das") for i in range(9)] + [(f"y{i}", "sie hab nie") for i in range(9)], "doc_id string, text string")
    uni, bi = ngrams.unigram_counts(corpus), ngrams.ngram_counts(corpus, 2)
    got = {r["doc_id"]: r["text"] for r in noise.restore_misspellings(lines, "text", known, unigrams=uni, bigrams=bi).collect()}
    assert got == {"a": "ich habe das", "b": "sie hab nie", "c": None}


def test_misspelling_query_uses_ngrams(spark, tables):
    texts = ["sie gibts nie"] + ["wer gibt dir"] * 2
    d = tables(documents=([(f"d{i}", t, "de") for i, t in enumerate(texts)], "doc_id string, text string, lang string"))
    got = {r["doc_id"]: r["text"] for r in registry.QUERIES["misspelling_restore"](spark, d).collect()}
    assert got["d0"] == "sie gibts nie"


def test_asked_ngrams_cover_what_is_asked():
    known = {"gibt", "geht", "habe", "komm", "kommst", "das", "es"}
    texts = ["gibts hab das", "hab gehts kommste", "gibts gibts hab hab", "", "ne hab raus kommste"]
    for wanted in (0.0, 1.0):
        for text in texts:
            asked = set(noise.MisspellingRestorer(noise.Checks(known.__contains__)).asked(text))
            missed = []
            score = lambda x: (missed.append(x) if x not in asked else None, wanted * (len(x) % 7))[1]
            noise.MisspellingRestorer(noise.Checks(known.__contains__, score, lambda a, b: score(f"{a} {b}"))).correct(text)
            assert not missed


def test_every_pair_of_annotators_is_compared(spark, tables):
    marks = [(f"k{a}", "f", a, "sentiment", f"m{a}", span) for a, span in ((1, "word_1"), (2, "word_2"), (3, "word_1"))]
    marks += [(f"t{a}", "f", a, "target", f"t{a}", "word_1") for a in (1, 2, 3)]
    ddl = "mk_key string, file_name string, annotator int, anno_level string, markable_id string, span string"
    frame = [(*m, None, None, None, None) for m in marks]
    d = tables(
        markables=(frame, f"{ddl}, sentiment_ref string, emo_expression_ref string, attrs map<string,string>, deleted_at timestamp"),
        mmax_words=([("f", i, w, None, None) for i, w in ((1, "gut"), (2, "schlecht"), (3, "EOL"), (4, "so"))], "file_name string, word_id int, form string, loaded_at timestamp, deleted_at timestamp"),
    )
    for scheme in ("binary", "proportional", "exact"):
        rows = [r for r in registry.QUERIES[f"agreement_{scheme}_all"](spark, d).collect() if r["level"] == "sentiment"]
        assert {(r["annotator1"], r["annotator2"]): r["overlap1"] for r in rows} == {(1, 2): 0, (1, 3): 1, (2, 3): 0, (None, None): 1}
    rows = registry.QUERIES["message_agreement_all"](spark, d).collect()
    assert sorted((r["annotator1"] or 0, r["annotator2"] or 0, r["n"], r["n_both"]) for r in rows) == [(0, 0, 6, 3), (1, 2, 2, 1), (1, 3, 2, 1), (2, 3, 2, 1)]
    rows = registry.QUERIES["annotator_pairs_all"](spark, d).collect()
    assert sorted((r["annotator1"], r["annotator2"], r["word_id"], r["a1"], r["a2"]) for r in rows) == [(1, 2, 1, 1, 1), (1, 3, 1, 1, 1), (2, 3, 1, 1, 1)]


TOKEN = "tok_id string, doc_id string, sent_id int, idx int, form string, pos string, phead int, pdeprel string, pfeat string"


def tokens_of(*sentences):
    words = [(k, i, w) for k, s in enumerate(sentences) for i, w in enumerate(s.split(), 1)]
    return [(f"{k}_{i}", "d", k, i, w, "NN", 0 if i == 1 else 1, "SB", None) for k, i, w in words], TOKEN


def near(a, b):
    """Whether one insertion, deletion or substitution at most leads from a to b, by trying them all."""
    edits = {a} | {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i + k :] for i in range(len(a) + 1) for c in set(b) for k in (0, 1)}
    return b in edits


def test_dictionary_runs_over_the_words_of_the_texts(spark, tables):
    rows = tokens_of("haus maus Haus laus hau Baum", "haus maus Baum haus maus Baum", "xyz haut maus baum aus")
    d = tables(conll_words=rows)
    forms = [r[4] for r in rows[0]]
    frequent = {w for w in forms if forms.count(w) >= 3}
    known = {r["word"]: r["known"] for r in registry.QUERIES["dictionary_lookup_all"](spark, d).collect()}
    assert known == {w: w in frequent or w.capitalize() in frequent for w in forms}
    got = {}
    for r in registry.QUERIES["dictionary_suggestions_all"](spark, d).collect():
        got.setdefault(r["word"], []).append((r["rank"], r["suggestion"], r["distance"]))
    want = {}
    for w in {f.lower() for f in forms}:
        best = sorted((int(w != f.lower()), f.lower()) for f in frequent if near(w, f.lower()))[:3]
        if best:
            want[w] = [(k, f, n) for k, (n, f) in enumerate(best, 1)]
    assert {w: sorted(x) for w, x in got.items()} == want


def test_every_connective_counts_once(spark, tables):
    d = tables(conll_words=tokens_of("aber sie kommt weil er lacht", "zwar singt er aber leise", "entweder er kommt oder nicht", "sie geht ohne dass er lacht", "zwar und zwar klein aber fein"))
    got = {r["type"]: r["n"] for r in registry.QUERIES["connective_counts_all"](spark, d).collect()}
    assert got == {"conj": 5, "subj": 2}  # aber, zwar..aber, entweder..oder, und, zwar..aber; weil, ohne dass


def test_atoms_of_attributes_and_features(spark, tables):
    mark = ("k1", "f", 1, "sentiment", "m1", "word_1..word_2", None, None, {"polarity": "positive"}, None)
    rows, ddl = tokens_of("Haus steht")
    rows = [(*rows[0][:8], "nom|sg|masc"), (*rows[1][:6], None, *rows[1][7:])]
    d = tables(
        markables=([mark], "mk_key string, file_name string, annotator int, anno_level string, markable_id string, span string, sentiment_ref string, emo_expression_ref string, attrs map<string,string>, deleted_at timestamp"),
        conll_words=([(*r[:8], "case=nom|num=sg" if r[8] else None) for r in rows], ddl),
    )
    atoms = {r["atom"] for r in registry.QUERIES["annotation_atoms_all"](spark, d).collect()}
    assert atoms == {'isSentiment("W_1")', 'isSentiment("W_2")', 'hasSentimentPolarity("W_1", POSITIVE)'}
    got = [r["atom"] for r in registry.QUERIES["logic_atoms_all"](spark, d).collect()]
    assert None not in got and sorted(a.split("(")[0] for a in got) == ["Connector", "Tag", "Tag", "isCase", "isNum"]


def test_short_pieces_go_through_the_transducer(monkeypatch):
    from korpusmill.llm import bpe

    transducer = bpe.Transducer({bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257})
    used = []
    step = bpe.PieceStream._step
    monkeypatch.setattr(bpe.PieceStream, "_step", lambda self, byte: (used.append(byte), step(self, byte))[1])
    assert transducer.piece("abcab") == transducer.merge(b"abcab") == [257, 256]
    assert len(used) == 5


def test_preprocessing_is_chained(spark, tables):
    texts = ["RT @anna: Gruesse aus Koeln!!! http://x.de", "nix da… #Kuchen", "", None, "alles gut"]
    d = tables(documents=([(f"d{i}", t, "de") for i, t in enumerate(texts)], "doc_id string, text string, lang string"))
    got = {r["doc_id"]: r["line"] for r in registry.QUERIES["corpus_preprocess"](spark, d).collect()}
    assert got == {"d0": "grüsse aus köln", "d1": "nichts da kuchen", "d4": "alles gut"}
    whole = {r["doc_id"]: r["text"] for r in registry.QUERIES["umlaut_restore"](spark, d).collect()}
    assert set(whole) == {"d0", "d1", "d2", "d4"} and "Köln" in whole["d0"] and whole["d4"] == "alles gut"


def test_every_user_of_a_message_is_restored(spark, tables, monkeypatch):
    """A token may hold several placeholders; messages are cut into blocks; nothing is joined or sent to the driver."""
    texts = [
        (1, "mit @anna und\n@bob!\n@cleo, da"), (2, "gut :) sagt (@max)"), (3, ""), (4, None), (5, "ohne alles"), (6, "  "),
        (7, "x" * 70_000 + "\n@anna " + "wort @max " * 20_000 + "ende"), (8, "üb 😂 @änn_1 😂 @max"), (8, "wort @bob x"),
    ]
    d = tables(documents=([(i, t, "de") for i, t in texts], "doc_id long, text string, lang string"))
    want = []
    for i, t in texts:
        if t is not None:
            clean = noise.NoiseCleaner().clean(t).split(" ")
            # the names as they stand in the text, in order
            names = iter(re.findall(r"@\w+", t))
            at = 0
            for pos, token in enumerate(clean):
                parts = token.split("%User")
                want.append((i, pos, parts[0] + "".join(next(names) + p for p in parts[1:]), at, len(token)))
                at += len(token) + 1
    df = registry.QUERIES["noise_restore"](spark, d)
    assert sorted(map(tuple, df.collect())) == sorted(want)
    monkeypatch.setattr(noise, "BLOCK", 10)
    assert sorted(map(tuple, registry.QUERIES["noise_restore"](spark, d).collect())) == sorted(want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_every_replacement_of_a_token_is_restored(spark):
    tokens = spark.createDataFrame([(1, 0, "a\n%User\n%User!", 0, 14), (1, 1, "b", 15, 1)], "doc_id int, pos int, token string, start int, len int")
    log = spark.createDataFrame([(1, 2, 5, "@bob", "%User"), (1, 8, 5, "@cleopatra", "%User")], "doc_id int, offset int, length int, orig string, replacement string")
    got = {r["pos"]: r["token"] for r in annotations.restore_replacements(tokens, log, ["%User"]).collect()}
    assert got == {0: "a\n@bob\n@cleopatra!", 1: "b"}
