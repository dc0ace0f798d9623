"""Decoding errors, canonical spelling, languages, tokenizer."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from korpusmill.llm import bpe, canon, langid, mojibake

SAMPLE = "für groß Käserei Übung déjà façon niño così più Ångstrøm „so“ – … 😀 👨‍🌾 дождь ποτάμι m² ½ 25°".split()


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251"])
@pytest.mark.parametrize("word", SAMPLE)
def test_every_pair_is_undone(word, page):
    garbled = mojibake._decode(word.encode("utf-8"), page)
    if garbled is None or garbled == word:
        return
    assert mojibake.restore_multibyte(garbled) == word


@pytest.mark.parametrize("word", SAMPLE)
def test_double_garbling(word):
    once = mojibake._decode(word.encode("utf-8"), "cp1252")
    twice = mojibake._decode(once.encode("utf-8"), "cp1252")
    assert mojibake.restore_multibyte(twice) == word


@pytest.mark.parametrize("word", [*SAMPLE, "NÃO", "MAÇÃ", "√2", "±3", "CHÂTELAIN", "Łąka", "Øvrevoll", "Þing", "H₂O", "Оѕt", "Вonne", "a" * 50_000, ""])
def test_correct_text_stays(word):
    assert mojibake.restore_multibyte(word) == word


def test_mixed_text_keeps_its_correct_part():
    assert mojibake.restore_multibyte("schön und grÃ¼n") == "schön und grün"


@pytest.mark.parametrize("raw, good", [("привет fÃ¼r", "привет für"), ("m²a fÃ¼r", "m²a für"), ("привет/fÃ¼r", "привет/für"), ("ДÐ´", "Дд"), ("grÃ¼n\nund schÃ¶n", "grün\nund schön")])
def test_words_are_judged_one_by_one(raw, good):
    assert mojibake.restore_multibyte(raw) == good


@pytest.mark.parametrize("times", range(1, 8))
def test_garbling_of_any_depth(times):
    text = "ä"
    for _ in range(times):
        text = mojibake._decode(text.encode("utf-8"), "cp1252")
    assert mojibake.restore_multibyte(text) == "ä"


@pytest.mark.parametrize("page", mojibake.LATIN1_AS)
def test_every_one_byte_pair_is_proposed(page):
    for word in ("Möhren", "für", "señor", "São"):
        garbled = mojibake._decode(word.encode("latin-1"), page)
        if garbled and garbled != word:
            assert word in [new for _, new in mojibake.proposals(garbled)]


def test_one_byte_pairs_replace_matched_spans_only():
    assert mojibake.replace_spans("M÷hren ist 5", "cp437") == "Möhren ist 5"


def words_frame(spark, forms):
    return spark.createDataFrame([(i, f, f) for i, f in enumerate(forms)], "tok_id bigint, form string, lemma string").withColumn("n", F.lit("clash")).withColumn("kind", F.lit(1))


def test_restore_tokens(spark):
    forms = ["Möhren"] * 3 + ["M÷hren", "Mˆhren", "f�r", None, "", "prÃ¼ft", "÷", "prÃ¼ft", "abc", "Ã°Å¸â€˜ï¿½"] + ["théâtre"] * 2 + ["thÈ‚tre"]
    got = {r["tok_id"]: r["restored"] for r in mojibake.restore_tokens(words_frame(spark, forms)).collect()}
    assert got == {3: "Möhren", 4: "Möhren", 5: "", 8: "prüft", 10: "prüft", 12: "", 15: "théâtre"}
    assert mojibake.restore_tokens(words_frame(spark, forms).limit(0)).count() == 0


@pytest.mark.parametrize(
    "raw, plain",
    [
        ("ｗｏｒｔ１", "wort1"), ("März", "März"), ("die​", "die"), (" die ", "die"), ("a b", "a b"), ("Нaus", "Haus"), ("Bолжанка", "Волжанка"), ("Ρause", "Pause"),
        ("👨‍🌾", "👨‍🌾"), ("👨‍🌾‍", "👨‍🌾"), ("m²", "m²"), ("H₂O", "H₂O"), ("½", "½"), ("Волжанка", "Волжанка"), ("ποτάμι", "ποτάμι"), ("laaaang", "laaaang"), ("⚠️", "⚠️"),
        ("a️", "a"), ("！", "！"), ("е́tе", "éte"), ("​", ""), ("👨‍👩‍👧‍👦", "👨‍👩‍👧‍👦"),
    ],
)
def test_canon_rules(raw, plain):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE batch AS SELECT ? AS value", [raw])
    assert con.execute(f"SELECT canon FROM ({canon.canon_sql()})").fetchone()[0] == plain


@pytest.mark.parametrize("raw, good", [("Wort\n", "Wort"), ("Wort\u0085", "Wort"), ("\u2028Wort", "Wort"), ("a\U000f0001b\u200b", "a\U000f0001b"), ("\U000f0000\U000f0002ｘ", "\U000f0000\U000f0002x"), ("\U000f0000\U000f0005\u200b", "\U000f0000\U000f0005")])
def test_line_ends_and_private_characters(spark, raw, good):
    rows = {(r["field_name"], r["canon"]) for r in canon.canonical_spelling(words_frame(spark, [raw])).collect()}
    assert rows == {("form", good), ("lemma", good)}


def test_canonical_tokens(spark):
    forms = ["die​", "die", None, "", "prÃ¼ft", "ｄｉｅ", "ｄｉｅ", "​" * 20_000 + "x"]
    rows = {(r["tok_id"], r["field_name"]): r["canon"] for r in canon.canonical_tokens(words_frame(spark, forms)).collect()}
    assert rows == {(i, f): v for i, v in ((0, "die"), (5, "die"), (6, "die"), (7, "x")) for f in ("form", "lemma")}
    assert canon.canonical_tokens(words_frame(spark, forms).limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aäе́​ ｂß1Ωо👨‍", max_size=8))
def test_canon_is_idempotent(text):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE batch AS SELECT ? AS value", [text])
    once = con.execute(f"SELECT canon FROM ({canon.canon_sql()})").fetchone()[0]
    con.execute("CREATE OR REPLACE TABLE batch AS SELECT ? AS value", [once])
    assert con.execute(f"SELECT canon FROM ({canon.canon_sql()})").fetchone()[0] == once


# --- languages ---------------------------------------------------------------------------

DE = "der die das und nicht mit dem hund läuft heute über straße wieder nach hause weil regen kommt".split()
EN = "the dog runs home again because rain is coming over street with our old neighbour today".split()


def message_frames(spark, n=120, seed=3):
    rng = random.Random(seed)
    messages, words, tok = [], [], 0
    for i in range(n):
        lang = "de" if i % 2 else "en"
        label = None if i % 11 == 0 else "en" if i % 13 == 0 else lang
        forms = [rng.choice(DE if lang == "de" else EN) for _ in range(9)]
        if i % 7 == 0:
            forms += [rng.choice(EN if lang == "de" else DE) for _ in range(6)]
        forms.insert(3, f"@xanopilu{i}")
        forms.insert(5, rng.choice(["Xanopilu", "Velomira"]))
        messages.append((str(i), label))
        for j, f in enumerate(forms):
            for _ in range(1 + (i % 10 == 0)):  # delivered again
                words.append((tok, str(i), 0, j + 1, f))
                tok += 1
    return spark.createDataFrame(messages, "id string, lang string"), spark.createDataFrame(words, "tok_id bigint, doc_id string, sent_id int, idx int, form string")


def test_languages_of_stretches(spark):
    messages, words = message_frames(spark)
    model = langid.train(messages, words)
    spans = langid.stretches(words, model).toPandas()
    right = 0
    for i in range(120):
        mine = spans[spans["doc_id"] == str(i)].sort_values("first_idx")
        want = ["de" if i % 2 else "en"] + (["en" if i % 2 else "de"] if i % 7 == 0 else [])
        right += list(mine["lang"]) == want
    assert right >= 112
    assert spans["confidence"].between(0, 1).all()
    found = {(r["doc_id"], r["lang"]) for r in langid.mislabelled_sentences(messages, words).collect()}
    assert ("0", "en") in found and ("11", "de") in found and ("1", "de") not in found


def test_languages_come_from_the_labels(spark):
    messages, words = message_frames(spark)
    assert set(langid.train(messages, words).langs) == {"de", "en"}
    named = {"de": "sv", "en": "pl"}
    other = messages.replace(named, subset="lang")  # no list of languages knows these texts
    wrong = other.withColumn("lang", F.when(F.col("id").cast("int") % 17 == 0, "da").otherwise(F.col("lang")))
    assert set(langid.train(wrong, words).langs) == {"sv", "pl"}
    spans = langid.stretches(words, langid.train(wrong, words)).toPandas()
    assert set(spans["lang"]) == {"sv", "pl"}


def test_messages_without_words(spark):
    messages, words = message_frames(spark, 30)
    more = messages.union(spark.createDataFrame([("empty", "de"), (None, "de")], messages.schema))
    got = {r["doc_id"]: (r["lang"], r["confidence"]) for r in langid.message_languages(spark, more, words).collect()}
    assert got["empty"] == ("und", 0.0) and got["1"][0] == "de" and None not in got


def test_language_of_dirty_words():
    assert langid.spelling(langid.plain("ｓｔｒａßｅ")) == langid.spelling("STRASSE") and langid.spelling("gruendlich") == langid.spelling("gründlich")
    assert not langid.is_word("@abc") and not langid.is_word("#abc") and not langid.is_word("42") and not langid.is_word("😀") and langid.is_word("l'été")


def test_language_edge_cases(spark):
    messages, words = message_frames(spark, 30)
    model = langid.train(messages, words)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "a", 0, 1, ""), (3, "a", 0, 2, None), (4, "b", 0, 1, "42")], words.schema)
    assert langid.stretches(odd, model).count() == 0
    assert langid.mislabelled_sentences(messages.limit(0), words.limit(0)).count() == 0
    long = spark.createDataFrame([(i, "x", 0, i + 1, DE[i % len(DE)]) for i in range(20_000)], words.schema)
    spans = langid.stretches(long, model).collect()
    assert sum(s["n_words"] for s in spans) == 20_000


def test_named_language(spark):
    rows = spark.createDataFrame([(x,) for x in ("de_CH", "EN", "", None, "und", "unknown", "?", "_", "fr-BE")], "lang string")
    assert [r[0] for r in rows.select(langid.named_language(F.col("lang"))).collect()] == ["de", "en", None, None, None, None, None, None, "fr"]


# --- tokenizer ------------------------------------------------------------------------------

needs_ranks = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_RANKS), reason="no public tokenizer here")


@pytest.fixture(scope="module")
def transducer():
    with open(bpe.DEFAULT_RANKS, "rb") as file:
        return bpe.Transducer(bpe.parse_ranks(file.read()))


@pytest.fixture(scope="module")
def library(transducer):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=transducer.ranks, special_tokens={})


def test_transducer_on_a_small_merge_list():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258, b"abab": 259, b"aa": 260, b"aaaa": 261}
    t = bpe.Transducer(ranks)
    rng = random.Random(1)
    for _ in range(300):
        raw = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60))).encode()
        stream = bpe.PieceStream(t)
        assert [*stream.feed(raw), *stream.end()] == t.merge(raw)


def test_memory_stays_bounded():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abab": 257}
    stream = bpe.PieceStream(bpe.Transducer(ranks))
    for _ in range(200):
        stream.feed(b"ab" * 50)
        assert len(stream.window) <= 10 * stream.t.lookahead + 8


@needs_ranks
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é'lvres  \n\t12!?-ÃÄ😀", max_size=60))
def test_same_as_library(transducer, library, text):
    assert bpe.encode_text(transducer, text) == library.encode_ordinary(text)


@needs_ranks
def test_stream_in_chunks(transducer, library, monkeypatch):
    monkeypatch.setattr(bpe.TextStream, "OPEN_FROM", 8)
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a" * rng.randint(1, 30), " " * rng.randint(1, 20), "\n" * 3, "'ll", "12345", "é" * 9, "!?-" * 4, "x", "'"]) for _ in range(rng.randint(1, 10)))
        stream, out, at = bpe.TextStream(transducer), [], 0
        while at < len(text):
            n = rng.randint(1, 12)
            out += stream.feed(text[at : at + n])
            at += n
        assert out + stream.end() == library.encode_ordinary(text)


@needs_ranks
def test_every_id_comes_from_the_transducer(library, monkeypatch):
    with open(bpe.DEFAULT_RANKS, "rb") as file:
        fresh = bpe.Transducer(bpe.parse_ranks(file.read()))
    calls, steps = [], [0]
    plain, step, fits = bpe.Transducer.merge, bpe.PieceStream._step, bpe.Transducer.fits
    inside = [False]

    def asked(self, left, right):
        inside[0] = True
        try:
            return fits(self, left, right)
        finally:
            inside[0] = False

    monkeypatch.setattr(bpe.Transducer, "merge", lambda self, raw: (calls.append(raw) if not inside[0] else None, plain(self, raw))[1])
    monkeypatch.setattr(bpe.Transducer, "fits", asked)
    monkeypatch.setattr(bpe.PieceStream, "_step", lambda self, byte: (steps.__setitem__(0, steps[0] + 1), step(self, byte))[1])
    text = "Die Fährgesellschaft prüft's heute wieder, 12345 mal!? " + "x" * 3000
    assert bpe.encode_text(fresh, text) == library.encode_ordinary(text)
    assert not calls and steps[0] >= len("".join(dict.fromkeys(text.split())).encode())


@needs_ranks
def test_long_texts_in_constant_memory(transducer, library):
    import tracemalloc

    part = "Der Bäcker  zählt 123 Möhren.\n\n" + "a" * 5000 + " " * 3000 + "!?" * 2000 + "é" * 4000
    stream, n = bpe.TextStream(transducer), 0
    for chunk in (part[:700], part[700:]):
        n += len(stream.feed(chunk))
    tracemalloc.start()
    for _ in range(9):
        for at in range(0, len(part), 4096):
            n += len(stream.feed(part[at : at + 4096]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n += len(stream.end())
    assert n == len(library.encode_ordinary(part * 10)) and peak < 4_000_000


@needs_ranks
def test_chunks_of_the_frame_encoder(transducer, library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 7)
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice(["ab", " ", "  ", "\n", "'s", "12", "é", "!?", "🙂", "word "]) for _ in range(rng.randint(0, 40)))
        assert bpe.encode_text(transducer, text) == library.encode_ordinary(text)


@needs_ranks
def test_encode_frame(spark, library):
    texts = [None, "", "<|endoftext|>", "Hallo Welt", "a" * 30_000, "Hallo Welt", " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(1))
    encoded = bpe.encode_corpus(docs)
    got = {r["doc_id"]: list(r["ids"]) for r in encoded.collect()}
    assert got == {i: library.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    back = {r["doc_id"]: r["text"] for r in bpe.decode_corpus(encoded).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode_corpus(docs.limit(0)).count() == 0
