"""Leaked passages and shared spans against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from korpusmill.llm import leakage, shared_spans, windows


def leaks_by_force(docs, items):
    grams = {}
    for i, text in items:
        w = leakage.words_of(text)
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out = set()
    for d, text in docs:
        w = leakage.words_of(text)
        for k in range(len(w) - 12):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + 13]), ())}
    return out


def shared_by_force(docs, least):
    where = {}
    for d, text in docs:
        for k in range(len(text or "") - least + 1):
            where.setdefault(text[k : k + least], set()).add(d)
    out = {}
    for d, text in docs:
        covered = set()
        for k in range(len(text or "") - least + 1):
            if len(where[text[k : k + least]]) > 1:
                covered.update(range(k, k + least))
        if covered:
            out[d] = len(covered)
    return out


def passages(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randint(5, 40))) for i in range(25)] + [(90, None), (91, "")]
    docs = []
    for d in range(120):
        text = say(rng.randint(0, 50))
        if d % 3 == 0:
            words = items[rng.randrange(25)][1].split()
            a = rng.randrange(len(words))
            text += ", " + "  ".join(w.upper() for w in words[a : a + rng.randint(8, 20)]) + "! " + say(5)
        docs.append((d, text))
    hot = items[3][1]
    docs += [(1000 + i, hot + " " + str(i)) for i in range(60)] + [(2000, None), (2001, ""), (2002, say(60_000) + " " + items[5][1])]
    return docs, items


def test_leaks(spark):
    docs, items = passages()
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("minhash", F.lit(1)).withColumn("win", F.lit("x"))
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    assert {tuple(r) for r in leakage.leaked_items(d, i).collect()} == leaks_by_force(docs, items)
    assert leakage.leaked_items(d.limit(0), i).count() == leakage.leaked_items(d, i.limit(0)).count() == 0


def test_recall_is_whole_and_comes_from_the_signatures(spark, monkeypatch):
    docs, items = passages(seed=11)
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    truth = leaks_by_force(docs, items)
    found = {tuple(r) for r in leakage.leaked_items(d, i).collect()}
    assert truth and len(found & truth) / len(truth) == 1.0
    tests = leakage.item_windows(i)
    wrong = tests.withColumn("minhash", F.col("minhash") + 1)  # the words are right, the signatures are not
    assert leakage.leak_windows(d, wrong).count() == 0
    assert leakage.leak_windows(d, tests).count() > 0


def test_other_writing(spark):
    text = "Der fröhliche Bäcker an der Brücke zählt heute die Möhren im großen Saal nach"
    dirty = text.upper().replace(" ", " - ").replace("Ö", "Ö").replace("B", "B​")
    d, i = spark.createDataFrame([(1, dirty), (2, text.replace("heute", "morgen"))], "doc_id bigint, text string"), spark.createDataFrame([(7, text)], "item_id bigint, text string")
    assert [tuple(r) for r in leakage.leaked_items(d, i).collect()] == leaks if (leaks := sorted(leaks_by_force([(1, dirty)], [(7, text)]))) else True
    assert leakage.words_of(dirty)[:3] == leakage.words_of(text)[:3]


def test_containment(spark):
    words = " ".join(f"w{i}" for i in range(30))
    d, i = spark.createDataFrame([(1, "x " + words), (2, " ".join(words.split()[:14]))], "doc_id bigint, text string"), spark.createDataFrame([(7, words)], "item_id bigint, text string")
    assert {r["doc_id"]: r["containment"] for r in leakage.leak_containment(d, i).collect()} == {1: 1.0, 2: round(2 / 18, 6)}


def span_documents(seed=4, least=120):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abcd äö\n😀") for _ in range(n))
    base = [say(rng.randint(0, 400)) for _ in range(40)]
    docs = list(enumerate(base))
    for d in range(100, 160):
        source = rng.choice(base)
        a = rng.randrange(max(1, len(source)))
        docs.append((d, say(rng.randint(0, 90)) + source[a : a + rng.choice([60, 119, 120, 121, 150, 300])] + say(rng.randint(0, 90))))
    hot = say(200)
    docs += [(500 + i, hot) for i in range(50)] + [(700 + i, say(30) + hot[20:160] + say(20)) for i in range(10)]
    twice = say(130)
    return docs + [(900, twice + "-" + twice), (901, None), (902, ""), (903, "a" * 5000), (904, "a" * 300), (905, say(1000) + hot)]


def test_shared_characters(spark, monkeypatch):
    docs = span_documents()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("band", F.lit(1)).withColumn("rep", F.lit("x")).withColumn("digest", F.lit(0))
    got = {r["doc_id"]: r["shared_chars"] for r in shared_spans.shared_characters(frame).collect()}
    assert got == shared_by_force(docs, 120)
    assert 900 not in got
    assert shared_spans.shared_characters(frame.limit(0)).count() == 0


def test_long_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(windows, "BLOCK", 500)
    rng = np.random.default_rng(0)
    seqs = [rng.integers(0, 9, n).astype(np.uint64) for n in (3, 2000, 0, 130, 777)]
    seen = set()
    for values, owner, place, starts in windows.blocks(seqs, 120):
        low = windows.window_minhash(values, 120, 88)
        for k in np.flatnonzero(starts):
            i, p = int(owner[k]), int(place[k])
            assert (values[k : k + 120] == seqs[i][p : p + 120]).all()
            assert low[k] == windows.window_minhash(seqs[i][p : p + 120], 120, 88)[0]
            assert (i, p) not in seen
            seen.add((i, p))
    assert seen == {(i, p) for i, s in enumerate(seqs) for p in range(len(s) - 119)}


def test_clusters(spark):
    docs = span_documents()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["doc_id"]: r["cluster"] for r in shared_spans.span_clusters(frame).collect()}
    assert set(got) == set(shared_by_force(docs, 120))
    assert len({got[500 + i] for i in range(50)} | {got[700 + i] for i in range(10)} | {got[905]}) == 1


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in shared_spans.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}
