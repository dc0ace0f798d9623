"""The annotator mixture on simulated annotators of known habits."""

import random
from datetime import datetime as dt

from pyspark.sql import functions as F

from korpusmill.llm import consensus

LABELS = ["comparison", "negative", "positive"]
MK = "mk_key bigint, file_name string, annotator int, anno_level string, markable_id string, span string, attrs map<string,string>, loaded_at timestamp, deleted_at timestamp"


def simulated(seed=1, items=400):
    rng = random.Random(seed)
    skill = {1: 0.95, 2: 0.9, 3: 0.8, 4: 0.7, 5: 0.0, 6: 0.0}
    guess = {5: [0, 0, 1], 6: [0, 0.5, 0.5]}
    truth, rows = {}, []
    for i in range(items):
        truth[i] = rng.choices(LABELS, [1, 3, 4])[0]
        for a in rng.sample(sorted(skill), rng.randint(3, 6)):
            label = truth[i] if rng.random() < skill[a] else rng.choices(LABELS, guess.get(a, [1, 1, 1]))[0]
            span = rng.choice([f"word_{3 * i}..word_{3 * i + 2}", f"word_{3 * i},word_{3 * i + 1},word_{3 * i + 2}", f'"word_{3 * i}..{3 * i + 2}"'])
            rows.append((len(rows), "f", a, "sentiment", f"m{i}", span, {"polarity": label}, dt(2014, 1, 1), None))
            if rng.random() < 0.1:
                rows.append((len(rows), *rows[-1][1:7], dt(2014, 2, 1), None))
    return truth, rows


def majority(truth, rows):
    votes = {}
    for r in {(r[2], r[4], r[6]["polarity"]) for r in rows}:
        votes.setdefault(int(r[1][1:]), []).append(r[2])
    return sum(max(sorted(set(v)), key=v.count) == truth[i] for i, v in votes.items()) / len(votes)


def test_consensus_beats_the_majority(spark):
    truth, rows = simulated()
    marks = spark.createDataFrame(rows, MK).withColumn("label", F.lit("clash")).withColumn("words", F.lit(1))
    got = consensus.consensus_passages(marks).collect()
    assert len(got) == len(truth) and all(r["last_word"] - r["first_word"] == 2 for r in got)
    share = sum(r["polarity"] == truth[r["first_word"] // 3] for r in got) / len(got)
    assert share > 0.9 and share > majority(truth, rows)
    fitted = consensus.Consensus(consensus.passage_votes(marks))
    skill = {r["annotator"]: r["competence"] for r in fitted.annotators.collect()}
    assert skill[1] > skill[4] > max(skill[5], skill[6]) and max(skill[5], skill[6]) < 0.3
    guesses = {r["annotator"]: r["guess"] for r in fitted.annotators.collect()}
    assert guesses[5]["positive"] > 0.9 and guesses[6]["comparison"] < 0.1


def by_numpy(rows, rounds):
    """The same mixture, vote by vote."""
    import numpy as np

    votes = {}
    for r in {(r[2], r[4], r[6]["polarity"]) for r in rows}:
        votes.setdefault(r[1], {})[r[0]] = LABELS.index(r[2])
    people, n = sorted({a for v in votes.values() for a in v}), len(LABELS)
    theta, guess, prior = {a: 0.6 for a in people}, {a: np.full(n, 1 / n) for a in people}, np.full(n, 1 / n)
    for _ in range(rounds):
        truth, spam, drawn, mass = dict.fromkeys(people, 0.0), dict.fromkeys(people, 0.0), {a: np.zeros(n) for a in people}, np.zeros(n)
        posts = {}
        for i, v in votes.items():
            p = prior.copy()
            for a, l in v.items():
                p *= (1 - theta[a]) * guess[a][l] + theta[a] * (np.arange(n) == l)
            posts[i] = p = p / p.sum()
            mass += p
            for a, l in v.items():
                t = p[l] * theta[a] / (theta[a] + (1 - theta[a]) * guess[a][l])
                truth[a] += t
                spam[a] += 1 - t
                drawn[a][l] += 1 - t
        theta = {a: (truth[a] + 1) / (truth[a] + spam[a] + 2) for a in people}
        guess = {a: (drawn[a] + 0.5) / (spam[a] + 0.5 * n) for a in people}
        prior = (mass + 1) / (mass.sum() + n)
    return theta, {i: LABELS[int(p.argmax())] for i, p in posts.items()}


def test_same_as_vote_by_vote(spark):
    _, rows = simulated(seed=5, items=150)
    fitted = consensus.Consensus(consensus.passage_votes(spark.createDataFrame(rows, MK)))
    theta, labels = by_numpy(rows, 3000)
    got = {r["annotator"]: r["competence"] for r in fitted.annotators.collect()}
    assert got.keys() == theta.keys() and all(abs(got[a] - theta[a]) < 1e-3 for a in theta)
    mine = {f"m{r['item']['words'][0] // 3}": r["label"] for r in fitted.items.collect()}
    assert sum(mine[i] != labels[i] for i in labels) <= 1  # a tie may fall otherwise


def test_a_fit_that_does_not_settle_raises(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(consensus, "MAX_ROUNDS", 1)
    votes = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "y"), ("b", 2, "x"), ("c", 1, "x")], "item string, annotator int, label string")
    with pytest.raises(ValueError):
        consensus.Consensus(votes)


def test_edge_cases(spark):
    rows = [
        (1, "f", None, "sentiment", "m1", "word_1", {"polarity": "positive"}, None, None), (2, "f", 1, "sentiment", "m1", None, {"polarity": "positive"}, None, None),
        (3, "f", 1, "sentiment", "m1", "empty", {"polarity": "positive"}, None, None), (4, "f", 1, "sentiment", "m1", "word_1", None, None, None), (5, "f", 1, "target", "m1", "word_1", {"polarity": "positive"}, None, None),
        (6, "f", 1, "sentiment", "m2", "word_1", {"polarity": "positive"}, None, dt(2014, 1, 1)), (7, "f", 2, "sentiment", "m3", "word_1", {"polarity": "positive"}, None, None), (8, "f", 3, "sentiment", "m4", "word_1", {"polarity": "negative"}, None, None),
        (9, "f", 1, "sentiment", "m5", "word_1..word_2", {"polarity": "negative"}, None, None),
    ]
    got = [tuple(r)[:4] for r in consensus.consensus_passages(spark.createDataFrame(rows, MK)).collect()]
    assert got == [("f", 1, 1, "positive")]
    assert consensus.consensus_passages(spark.createDataFrame([], MK)).count() == 0
    assert consensus.Consensus(consensus.passage_votes(spark.createDataFrame([], MK))).annotators.count() == 0


def test_alpha(spark):
    schema = "item string, annotator int, label string"
    same = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "y"), ("b", 2, "y"), ("c", 1, "x")], schema)
    assert consensus.agreement_alpha(same).first()["alpha"] == 1.0
    mixed = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "y"), ("b", 2, "x")], schema)
    assert consensus.agreement_alpha(mixed).first()["alpha"] < 0
