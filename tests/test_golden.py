"""Golden cases of the cleaner, the sentence splitter, the umlaut, misspelling and elongation rules and the chunker."""

import pytest

from korpusmill.operators import cleaning, grammar, noise, segments

NOISE = [
    ("@anna @bob Hallo zusammen", "Hallo zusammen"), ("Na dann los! @anna @bob", "Na dann los!"), ("mit @anna und @bob", "mit %User und %User"), ("@solo", "%User"), ("...was?", "was?"),
    ("!? Na so was", "Na so was"), ("RT @anna: Guten Morgen", "Guten Morgen"), ("Ja genau RT @anna: Guten Morgen", "Ja genau Guten Morgen"), ("MT @anna @bob Guten Morgen", "Guten Morgen"), ("RT steht allein", "RT steht allein"),
    ("#Kuchen ist #lecker", "Kuchen ist lecker"), ("##doppelt", "doppelt"), ("snake_case bleibt", "snake_case bleibt"), ("_betont_", "betont"), ("C # D", "C # D"),
    ("Post an a.b+c@example.org.", "Post an %Mail."), ("(siehe www.beispiel.de)", "(siehe %Link)"), ("mehr - http://x.de/abc", "mehr"), ("erst http://x.de dann mehr", "erst %Link dann mehr"), ("http://a.de http://b.de", "%Link %Link"),
    ("auf beispiel.de/x?y=1 steht es", "auf %Link steht es"), ("d.h. z.B. so", "d.h. z.B. so"), ("am 3.4. um 5.30", "am 3.4. um 5.30"), ("gut :) schön", "gut %PosSmiley schön"), ("schade :-(", "schade %NegSmiley"),
    ("naja ;-)", "naja %IronicSmiley"), ("hm :P", "hm %IronicSmiley"), ("wow :O", "wow %Smiley"), ("o_O", "%Smiley"), ("^^ ja", "%PosSmiley ja"),
    (":'( weg", "%NegSmiley weg"), ("<3 dich", "%PosSmiley dich"), ("&lt;3", "%PosSmiley"), ("um 8) oder", "um 8) oder"), ("Uhrzeit 8:30", "Uhrzeit 8:30"),
    ("toll 😂", "toll %PosSmiley"), ("oje 😭😭", "oje %NegSmiley%NegSmiley"), ("soso 😏", "soso %IronicSmiley"), ("Baum 🌳", "Baum 🌳"), ("los!!!", "los!"),
    ("was?!?", "was?!"), ("so!?!", "so!"), ("hm......", "hm..."), ("hm...", "hm..."), ("• eins", " eins"), ("\"@anna\" sagt", "\"%User\" sagt"), ("   ", "   "), ("", ""),
]


@pytest.mark.parametrize("raw, clean", NOISE)
def test_noise(raw, clean):
    assert cleaning.NoiseCleaner().clean(raw) == clean


def test_suspects_cover_every_edit(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(raw,) for raw, _ in NOISE], "t string")
    got = [(r["t"], r["c"]["text"]) for r in rows.select("t", noise.clean_noise(F.col("t")).alias("c")).collect()]
    assert got == NOISE


def test_long_message_is_scanned_once():
    text = "@a " * 20_000 + "x" + "." * 50_000
    assert cleaning.NoiseCleaner().clean(text) == "x..."


SENTENCES = [
    ("Eins. Zwei.", 2), ("Eins! Zwei? Drei", 3), ("Das kostet 3.50 Euro.", 1), ("Am 3. mai war es.", 1), ("Am 3. Mai war es.", 2), ("Es kam ca. 5 mal vor.", 1),
    ("Dr. Maier kommt.", 1), ("Nr. 5 lebt.", 1), ("Frau M. Schulz geht.", 1), ("z.B. so etwas.", 1), ("Gut usw. und fertig.", 1), ("Ende... Neu", 2),
    ("Was?! Ja", 2), ("Sagt er: \"Komm.\" Dann geht er.", 2), ("Er ging (endlich.) Danach kam sie.", 2), ("alles gut. weiter klein", 1), ("Toll! %PosSmiley Danke", 2), ("Toll. %PosSmiley Danke", 2),
    ("Wetter gut - Ich gehe raus", 2), ("Hin - und zurück", 1), ("RT @anna: Morgen", 2), ("", 0), ("   ", 0), ("...", 1),
    ("Bitte lesen: www.x.de", 1), ("Prof. Huber und Co. kommen", 1), ("Das war's. %Link", 2), ("Eins.Zwei", 2), ("v. Chr. lebten sie", 1), ("Ja.\nNein.", 2), ("bzw. anders", 1), ("Er kam um 5. Danach nichts.", 2), ("u.a. Hunde", 1),
]


@pytest.mark.parametrize("text, n", SENTENCES)
def test_sentences(text, n):
    got = segments.split_sentences(text)
    assert len(got) == n, got
    assert all(text[i : i + len(s)] == s for s, i in got)
    assert "".join(s for s, _ in got).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")


UMLAUTS = [
    ("fuer", "für"), ("Aerger", "Ärger"), ("OEL", "ÖL"), ("schoen", "schön"), ("quer", "quer"), ("bauen", "bauen"), ("neue", "neue"), ("treue", "treue"), ("aktuell", "aktuell"), ("gruendlich", "gründlich"),
    ("@ueber", "@ueber"), ("@aerger", "@aerger"), ("ueibel", "ueibel"), ("Michael", "Michael"), ("Poesie", "Poesie"), ("MUELLER", "MÜLLER"), ("Uebung", "Übung"), ("uEben", "üben"), ("eue", "eue"), ("aae", "aae"),
    ("Koenig Moewe", "König Möwe"), ("", ""), ("e", "e"), ("ae", "ä"), ("oe ue", "ö ü"), ("zuerst", "zuerst"), ("soeben", "soeben"), ("Bequem", "Bequem"), ("hoeren", "hören"), ("Maedchen", "Mädchen"),
]


@pytest.mark.parametrize("raw, good", UMLAUTS)
def test_umlauts(raw, good):
    assert noise.UmlautRestorer().restore(raw) == good


KNOWN = {"habe", "gehen", "das", "gibt", "geht", "komm", "kommst", "ist", "hat", "was", "laufen", "muss", "sehe", "machen", "glaube"}
MISSPELT = [
    ("hab", "habe"), ("gehn", "gehen"), ("gibts", "gibt es"), ("sehe's", "sehe's"), ("kommste", "kommst du"), ("isses", "ist es"), ("isser", "ist er"), ("wat", "was"), ("raus", "heraus"), ("rausgehen", "herausgehen"),
    ("Raus", "Heraus"), ("RAUS", "HERAUS"), ("rauf", "herauf"), ("raufen", "raufen"), ("rum", "herum"), ("rummel", "rummel"), ("ne", "eine"), ("'nen", "einen"), ("nem", "einem"), ("irgendne", "irgendeine"),
    ("Ne", "Eine"), ("nett", "nett"), ("das", "das"), ("xyz", "xyz"), ("", ""), ("hab, gehn!", "habe, gehen!"), ("laufn", "laufen"), ("rüber", "herüber"), ("runterlaufen", "herunterlaufen"), ("machn", "machen"), ("seh", "sehe"), ("glaubs", "glaube es"),
]


@pytest.mark.parametrize("raw, good", MISSPELT)
def test_misspellings(raw, good):
    assert noise.MisspellingRestorer(noise.Checks(KNOWN.__contains__)).correct(raw) == good


def test_misspellings_by_joins_are_the_same(spark):
    lines = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(MISSPELT)] + [(99, None)], "i int, text string")
    known = spark.createDataFrame([(w,) for w in KNOWN], "word string")
    held = {r["i"]: r["text"] for r in noise.restore_misspellings(lines, "text", known).collect()}
    joined = {r["i"]: r["text"] for r in noise.restore_misspellings(lines, "text", known, max_words=3).collect()}
    assert held == joined and held[0] == "habe" and held[99] is None


SQUEEZED = ["liiieb", "süüüß", "jaaa", "Hallooo", "coooool", "neeeein", "soooo", "guuut", "Mannnn", "toll", "Saal", "XIII", "1000", "@aaa", "aaabbb", "hmmm"]


@pytest.mark.parametrize("word", SQUEEZED)
def test_shortenings_squeeze_back(word):
    found = noise.shortenings(word.lower())
    assert found == sorted(set(found)) and all(noise.squeeze(c) == noise.squeeze(word.lower()) for c in found)
    assert noise.shortenings(word.lower(), literal=True) == found[:-1]


def test_known_shortenings_need_no_enumeration(spark):
    spam = "".join(c * 9 for c in "abcdefghijklmnopqrstuvwxyz")
    words = spark.createDataFrame([("liiieb",), (spam,), ("coooool",), (None,), ("tolll",)], "word string")
    dictionary = spark.createDataFrame([("lieb",), ("liieb",), ("cool",), ("abcdefghijklmnopqrstuvwxyz",), ("tol",), ("toll",), (None,), ("tollll",)], "word string")
    got = {(r["word"], r["candidate"]) for r in noise.known_shortenings(words, dictionary).collect()}
    assert got == {("liiieb", "lieb"), ("liiieb", "liieb"), ("coooool", "cool"), (spam, "abcdefghijklmnopqrstuvwxyz"), ("tolll", "tol"), ("tolll", "toll")}


def toks(text):
    return [dict(zip(("form", "pos", "feats"), (*x.split("/")[:2], tuple(x.split("/")[2].split(",")) if x.count("/") > 1 else ())), lemma=x.split("/")[0]) for x in text.split()]


CHUNKS = [
    ("der/ART Hund/NN", "NC"), ("er/PPER schläft/VVFIN", "NC VVFIN"), ("im/APPRART Haus/NN", "PC"), ("sehr/ADV gut/ADJD", "AC"), ("der/ART sehr/ADV alte/ADJA Hund/NN", "NC"), ("Anfang/NN Mai/NN", "NC"), ("Haus/NN Maus/NN", "NC NC"),
    ("der/ART am/APPRART Abend/NN müde/ADJA Hund/NN", "NC"), ("bis/APPR zu/APPR drei/CARD", "PC"), ("mit/APPR Hund/NN und/KON Katze/NN", "PC"), ("um/APPR des/ART Friedens/NN willen/APZR", "PC"), ("das/ART/nom,sg Haus/NN/nom,sg des/ART/gen,sg Nachbarn/NN/gen,sg", "NC"),
    ("der/ART/nom Hund/NN/nom der/ART/nom Mann/NN/nom", "NC NC"), ("die/ART/nom,pl Hund/NN/nom,sg", "ART NC"), ("nicht/PTKNEG gut/ADJD", "AC"), ("nicht/PTKNEG", "PTKNEG"), ("Herr/NN Max/NE Huber/NE", "NC"), ("ohne/APPR", "APPR"), ("kleine/ADJA ,/$, rote/ADJA Hüte/NN", "NC"), ("dort/ADV", "AC"),
    ("mit/APPR ihm/PPER", "PC"), ("seit/APPR gestern/ADV", "PC"), ("und/KON", "KON"), ("alle/PIAT die/ART Leute/NN", "NC"), ("drei/CARD Leute/NN", "NC"), ("damit/PROAV", "AC"), ("schnell/ADJD", "AC"), ("dem/ART", "ART"), ("auf/APPR dem/ART Dach/NN sitzt/VVFIN er/PPER", "PC VVFIN NC"), ("Wien/NE", "NC"),
]


@pytest.mark.parametrize("text, labels", CHUNKS)
def test_chunks(text, labels):
    assert " ".join(grammar.label_of(n) for n in grammar.CHUNKS.parse(toks(text))) == labels
