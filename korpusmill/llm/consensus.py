"""Problem 7: consensus label, agreement and annotator reliability.

Competence-and-spamming mixture: annotator j copies the true label with probability
theta_j (competence) and otherwise draws from a personal guess distribution xi_j.
Expectation-maximisation yields the posterior of every item's label, theta and xi.

Items with the same votes are counted together once. A distinct vote pattern is one row with
its votes as an array; the parameters are a numbered table of closed vocabularies (annotators
and labels, sizes checked) that goes into the expressions as an array, so a round is one
pass over the patterns with one small aggregate and no join. Every third round starts from a
point extrapolated from the two before it (squared extrapolation), which saves most rounds.
They end when a round moves no parameter by more than ``TOLERANCE``; a fit that does not settle raises.

Defined results: rows without annotator, label or words cast no vote; re-delivered rows
are one vote; if an annotator gave an item several labels the most frequent one counts,
then the alphabetically first; ties between labels go to the alphabetically first.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusmill.operators.packed import span_fields
from korpusmill.session import checkpoint

#: Pseudo-counts of the maximisation step.
SMOOTH_GUESS, SMOOTH_TRUTH = 0.5, 1.0
#: Labels and annotators are closed vocabularies; more than this are refused.
MAX_LABELS, MAX_ANNOTATORS = 100, 20_000
#: Largest change of a parameter at which the fit has settled, and the rounds after which it counts as failed.
TOLERANCE, MAX_ROUNDS = 1e-4, 600
#: Patterns in a partition of a round.
PATTERNS_EACH = 20_000


def passage_votes(markables: DataFrame, level: str = "sentiment", attribute: str = "polarity") -> DataFrame:
    """(item, annotator, label) of passages; item is the file and the exact set of words."""
    marks = markables.where((F.col("anno_level") == level) & F.col("annotator").isNotNull())
    label = F.col("attrs").getItem(attribute)
    fields = span_fields(marks.withColumn("_label", label).where(F.col("_label").isNotNull()), "file_name", "annotator", "markable_id", "_label")
    rows = fields.select("file_name", F.array_sort(F.array_distinct("numbers")).alias("words"), "annotator", "markable_id", F.col("_label").alias("label"))
    valid = rows.where(F.size("words") > 0)
    # re-delivered rows and equal labels of an item combine before they move; after that an item has a row per annotator and label
    once = valid.select(F.struct("file_name", "words").alias("item"), "annotator", "markable_id", "label").distinct()
    per = once.groupBy("item", "annotator", "label").agg(F.count(F.lit(1)).alias("n")).repartition("item")
    return per.groupBy("item", "annotator").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))


def vote_patterns(votes: DataFrame) -> DataFrame:
    """(item, votes): the sorted votes of every item; an item has at most one vote per annotator."""
    return votes.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("annotator", "label"))).alias("votes"))


def _vocabulary(patterns: DataFrame, name: str, most: int) -> list:
    """Sorted values of a field of the votes; refuses what is no closed vocabulary."""
    found = sorted(r["v"] for r in patterns.select(F.explode(f"votes.{name}").alias("v")).distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"more than {most} values of {name}")
    return found


def _array(values: np.ndarray) -> str:
    """A numeric array as SQL text; it becomes one literal, so the compiled code is the same in every round."""
    return "array(" + ", ".join(f"{x!r}D" for x in np.asarray(values, dtype=float).ravel().tolist()) + ")"


class _Parameters:
    """Competence (A), guesses (A, L) and prior (L) of a mixture over A annotators and L labels."""

    def __init__(self, theta: np.ndarray, guess: np.ndarray, prior: np.ndarray):
        self.theta, self.guess, self.prior = theta, guess, prior

    def moved(self, other: _Parameters) -> float:
        return max(float(np.abs(a - b).max()) for a, b in ((self.theta, other.theta), (self.guess, other.guess), (self.prior, other.prior)))

    def posterior(self, cells: str = "cells") -> Column:
        """Array of the posterior of each label for votes coded as annotator * L + label.

        Written as text, one call instead of hundreds; ``transform(array(x), v -> ...)[0]`` names a value that is used more than once.
        """
        n = len(self.prior)
        given = (1 - self.theta[:, None]) * self.guess
        base, gain, prior = _array(np.log(given)), _array(np.log(self.theta[:, None] + given) - np.log(given)), _array(np.log(self.prior))
        every = f"aggregate({cells}, 0D, (a, c) -> a + get({base}, c))"
        label = f"aggregate(filter({cells}, c -> c % {n} = t), every, (a, c) -> a + get({gain}, c)) + get({prior}, t)"
        scores = f"get(transform(array({every}), every -> transform(sequence(0, {n - 1}), t -> {label})), 0)"
        powers = f"get(transform(array({scores}), s -> transform(s, x -> exp(x - array_max(s)))), 0)"
        return F.expr(f"get(transform(array({powers}), p -> transform(p, x -> x / aggregate(p, 0D, (a, y) -> a + y))), 0)")

    def flat(self) -> np.ndarray:
        return np.concatenate([self.theta, self.guess.ravel(), self.prior])

    def like(self, flat: np.ndarray) -> _Parameters:
        """Parameters from their flat form, brought back to probabilities."""
        a, n = self.guess.shape
        flat = np.clip(flat, 1e-9, None)
        guess, prior = flat[a : a + a * n].reshape(a, n), flat[a + a * n :]
        return _Parameters(np.minimum(flat[:a], 1 - 1e-9), guess / guess.sum(axis=1, keepdims=True), prior / prior.sum())


def _extrapolated(x0: _Parameters, x1: _Parameters, x2: _Parameters) -> _Parameters:
    """Squared extrapolation from three successive points of the iteration."""
    r = x1.flat() - x0.flat()
    v = x2.flat() - x1.flat() - r
    size = float(np.sqrt((v * v).sum()))
    step = min(-1.0, -float(np.sqrt((r * r).sum())) / size) if size > 0 else -1.0
    return x0.like(x0.flat() - 2 * step * r + step * step * v)


def _maximised(patterns: DataFrame, now: _Parameters) -> _Parameters:
    """Parameters of the next round: one aggregate of one row per vote cell over the patterns.

    ``patterns`` has n (items), k (votes) and cells. A pattern's posterior counts towards the
    prior in equal parts through its votes, so the sums per cell hold the prior as well.
    """
    n = len(now.prior)
    honest = now.theta[:, None] / (now.theta[:, None] + (1 - now.theta[:, None]) * now.guess)
    scored = patterns.select("n", "k", "cells", now.posterior().alias("p"))
    mass = ", ".join(f"sum(n / k * get(p, {t}))" for t in range(n))
    sums = scored.selectExpr("n", "k", "p", "explode(cells) AS cell").groupBy("cell").agg(F.expr(f"array(sum(n), sum(n * get(p, cell % {n})), {mass}) AS sums"))
    votes, own, mass = np.zeros(now.guess.size), np.zeros(now.guess.size), np.zeros(n)
    for row in sums.collect():  # at most annotators x labels rows
        votes[row["cell"]], own[row["cell"]] = row["sums"][:2]
        mass += row["sums"][2:]
    truth = own.reshape(now.guess.shape) * honest
    spam = votes.reshape(now.guess.shape) - truth
    theta = (truth.sum(axis=1) + SMOOTH_TRUTH) / (truth.sum(axis=1) + spam.sum(axis=1) + 2 * SMOOTH_TRUTH)
    guess = (spam + SMOOTH_GUESS) / (spam.sum(axis=1, keepdims=True) + SMOOTH_GUESS * n)
    return _Parameters(theta, guess, (mass + 1.0) / (mass.sum() + n))


class Consensus:
    """A fitted mixture: ``items`` with consensus, ``annotators`` with reliability."""

    def __init__(self, votes: DataFrame):
        self.patterns = checkpoint(vote_patterns(votes))
        self.labels = _vocabulary(self.patterns, "label", MAX_LABELS)
        self.rounds = 0
        if not self.labels:
            self.items = self.patterns.select("item", F.lit(0).alias("n_annotators"), F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("agreement")).limit(0)
            self.annotators = votes.select("annotator", F.lit(0.0).alias("competence"), F.lit(None).cast("map<string,double>").alias("guess")).limit(0)
            return
        people, n = _vocabulary(self.patterns, "annotator", MAX_ANNOTATORS), len(self.labels)
        number = lambda values: F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i))])
        of_person, of_label = number(people), number(self.labels)
        cells = F.transform("votes", lambda v: of_person[v["annotator"]] * n + of_label[v["label"]])
        coded = self.patterns.select("item", "votes", cells.alias("cells"))
        grouped = checkpoint(coded.groupBy("cells").agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("k", F.size("cells").cast("double")))
        grouped = grouped.coalesce(max(1, math.ceil(grouped.count() / PATTERNS_EACH))).persist()
        path = [_Parameters(np.full(len(people), 0.6), np.full((len(people), n), 1.0 / n), np.full(n, 1.0 / n))]
        while True:
            path.append(_maximised(grouped, path[-1]))
            self.rounds += 1
            if (moved := path[-1].moved(path[-2])) <= TOLERANCE:
                break
            if self.rounds >= MAX_ROUNDS:
                raise ValueError(f"parameters still move by {moved} after {MAX_ROUNDS} rounds")
            if len(path) == 3:
                path = [_maximised(grouped, _extrapolated(*path))]
                self.rounds += 1
        now = path[-1]
        grouped.unpersist()
        judged = coded.select("item", "votes", now.posterior().alias("p"))
        best = F.array_max(F.transform("p", lambda p, i: F.struct(p.alias("p"), (-i).alias("o"))))  # ties go to the first label
        total = F.size("votes")
        given = lambda t: F.size(F.filter("votes", lambda v: v["label"] == t))
        same = F.aggregate(F.array(*map(given, self.labels)), F.lit(0), lambda a, x: a + x * (x - 1))
        self.items = judged.withColumn("b", best).select(
            "item", total.alias("n_annotators"), F.get(F.array(*map(F.lit, self.labels)), -F.col("b.o")).alias("label"), F.round("b.p", 6).alias("confidence"),
            F.round(F.when(total > 1, same / (total * (total - 1))), 6).alias("agreement"),
        )
        kind = votes.schema["annotator"].dataType.simpleString()
        rows = [(a, round(float(now.theta[i]), 6), {t: float(g) for t, g in zip(self.labels, now.guess[i])}) for i, a in enumerate(people)]
        self.annotators = votes.sparkSession.createDataFrame(rows, f"annotator {kind}, competence double, guess map<string,double>")


def consensus_passages(markables: DataFrame, least_annotators: int = 3) -> DataFrame:
    """Consensus of each passage that enough annotators marked."""
    items = Consensus(passage_votes(markables)).items.where(F.col("n_annotators") >= least_annotators)
    return items.select(
        F.col("item.file_name").alias("file_name"), F.array_min("item.words").alias("first_word"), F.array_max("item.words").alias("last_word"), F.col("label").alias("polarity"), "n_annotators", "confidence", "agreement"
    )


def agreement_alpha(votes: DataFrame) -> DataFrame:
    """Krippendorff's alpha (nominal) over all items with at least two votes: one row."""
    per = votes.groupBy("item", "label").agg(F.count(F.lit(1)).alias("c"))
    items = per.groupBy("item").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("sq")).where("m >= 2")
    pairs = items.agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("n_items"), F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("differ"))
    paired = votes.join(votes.groupBy("item").agg(F.count(F.lit(1)).alias("m")).where("m >= 2").select("item"), "item", "left_semi")
    expected = paired.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("sq"))
    joined = pairs.crossJoin(F.broadcast(expected))  # one row each
    ratio = (F.col("n") - 1) * F.col("differ") / F.nullif(F.col("n") * F.col("n") - F.col("sq"), F.lit(0.0))
    return joined.select("n_items", F.col("n").alias("n_votes"), F.round(1 - ratio, 6).alias("alpha"))
