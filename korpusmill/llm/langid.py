"""Problem 1: language of messages and of their mixed-language stretches.

A linear-chain conditional random field labels every word of a sentence. Features of a
word are its whole spelling, prefixes, suffixes, character n-grams, its shape and the
language its corpus lexicon entry prefers; transitions are learned. Words are labelled
by the forward-backward posterior, whose mean over a stretch is its confidence.

The languages are those of the message labels that the texts bear out: a label is a language if
enough of its sentences are explained best by the words of its other sentences, which labels
given by mistake are not. Besides them there is the state ``x`` for invented names.

Training needs no hand labels. The noisy message labels of a bounded sample
(``max_messages``) give word counts per language, handles and hashtags give the
spelling of invented names (label ``x``), a decoding with a switching penalty turns both
into word labels, and the field is fitted twice on labels that it revises in between.

Defined results: null, empty or non-word tokens, handles, hashtags and numbers get no
label and interrupt nothing; a message without words has the language ``und`` with confidence 0; re-delivered tokens of a position count once; an empty
table gives no rows; sentences of any length are labelled whole.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusmill.llm.canon import look_alike_tables
from korpusmill.llm.mojibake import restore_multibyte

#: Share of a label's sentences that its own words must explain best for it to be a language.
LEAST_BORNE_OUT = 0.3
#: A label set is a closed vocabulary; more languages than this are refused.
MAX_LANGUAGES = 200
BUCKETS = 1 << 15
#: Message labels that name no language.
NO_LABEL = ("", "und", "unknown", "?", "_")

_LATIN = {ord(a): b for a, b in zip(*look_alike_tables()["L"])}
_SPELL = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"})
_LETTER = re.compile(r"[^\W\d_]")
_LATIN_LETTER = re.compile(r"[A-Za-zÀ-ɏ]")
_RUN = re.compile(r"(.)\1+")
_NAME_TAIL = re.compile(r"(?:\d+|tag|fest|live)+$")


def plain(form: str) -> str:
    """A word without dirt: wrong decodings undone, ordinary characters, original case."""
    if form.isascii():
        return form
    text = unicodedata.normalize("NFKC", restore_multibyte(form))
    text = "".join(c for c in text if unicodedata.category(c) != "Cf").strip()
    if _LATIN_LETTER.search(text):
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_LATIN))
    return text


def spelling(text: str) -> str:
    """Key on which spelling habits have no influence: lower case, no accents, no elongation."""
    low = text.lower().translate(_SPELL)
    if not low.isascii():
        low = "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c))
    return _RUN.sub(r"\1", low)


def is_word(text: str) -> bool:
    """Whether a token can have a language at all."""
    return bool(text) and text[0] not in "@#" and _LATIN_LETTER.search(text) is not None and not any(c.isdigit() for c in text)


def name_body(form: str) -> str:
    """The invented name inside a handle or hashtag."""
    return _NAME_TAIL.sub("", spelling(plain(form)).lstrip("@#"))


def features(word: str, key: str, hint: str) -> list[int]:
    """Hashed feature ids of a word type."""
    s = f"^{key}$"
    out = ["w" + key, "L" + hint, "b", "C" + ("u" if word.isupper() else "t" if word[:1].isupper() else "l") + ("'" if "'" in word or "’" in word else "")]
    out += [f"p{s[:n]}" for n in (2, 3, 4, 5)] + [f"s{s[-n:]}" for n in (2, 3, 4, 5)]
    out += [s[i : i + n] for n in (2, 3, 4) for i in range(len(s) - n + 1)]
    return [zlib.crc32(x.encode()) % BUCKETS for x in out]


@dataclass
class LanguageField:
    """Parameters of the fitted field; a few hundred kB whatever the corpus size."""

    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    hints: dict[str, str]
    langs: tuple[str, ...] = ()
    cache: dict[str, np.ndarray | None] = field(default_factory=dict)

    def __getstate__(self):
        return {"weights": self.weights, "transitions": self.transitions, "start": self.start, "hints": self.hints, "langs": self.langs, "cache": {}}

    def emission(self, form: str) -> np.ndarray | None:
        """Scores of the states for a token; None for what has no language."""
        if form in self.cache:
            return self.cache[form]
        word = plain(form)
        if not is_word(word):
            scores = None
        else:
            key = spelling(word)
            scores = self.weights[features(word, key, self.hints.get(key, "?"))].sum(axis=0)
        if len(self.cache) > 200_000:
            self.cache.clear()
        self.cache[form] = scores
        return scores


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Posteriors of a padded batch (S, T, K), and expected transition counts if ``pairs``."""
    size, steps, k = emissions.shape
    scores = np.exp(emissions - emissions.max(axis=2, keepdims=True)).astype(np.float64)
    trans, first = np.exp(transitions), np.exp(start)
    inside = np.arange(steps)[None, :] < lengths[:, None]
    alpha = np.empty((steps, size, k))
    a = scores[:, 0] * first
    alpha[0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        a = (alpha[t - 1] @ trans) * scores[:, t]
        a /= a.sum(axis=1, keepdims=True)
        alpha[t] = np.where(inside[:, t, None], a, alpha[t - 1])
    posterior = np.empty((steps, size, k))
    beta = np.ones((size, k))
    expected = np.zeros((k, k))
    posterior[steps - 1] = alpha[steps - 1]
    for t in range(steps - 1, 0, -1):
        right = scores[:, t] * beta
        if pairs:
            joint_norm = np.einsum("si,ij,sj->s", alpha[t - 1], trans, right)
            live = inside[:, t] / np.maximum(joint_norm, 1e-300)
            expected += trans * ((alpha[t - 1] * live[:, None]).T @ right)
        b = right @ trans.T
        b /= np.maximum(b.sum(axis=1, keepdims=True), 1e-300)
        beta = np.where(inside[:, t, None], b, beta)
        p = alpha[t - 1] * beta
        posterior[t - 1] = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
    return posterior.transpose(1, 0, 2), expected


def _padded(sentences: list[list[int]], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in sentences])
    ids = np.zeros((len(sentences), max(lengths)), dtype=np.int64)
    for i, s in enumerate(sentences):
        ids[i, : len(s)] = s
    return table[ids], lengths, ids


def _viterbi(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    size, steps, k = emissions.shape
    back = np.zeros((steps, size, k), dtype=np.int8)
    score = emissions[:, 0].copy()
    best = np.zeros((size, steps), dtype=np.int64)
    history = [score]
    for t in range(1, steps):
        through = score[:, :, None] + transitions[None]
        back[t] = through.argmax(axis=1)
        new = through.max(axis=1) + emissions[:, t]
        score = np.where((t < lengths)[:, None], new, score)
        history.append(score)
    last = score.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        best[:, t] = last
        if t:
            move = back[t][np.arange(size), last]
            last = np.where(t < lengths, move, last)
    return best


def _name_scorer(names: list[str], words: list[str]):
    """Log-odds per word type that it is an invented name, from character trigrams."""
    counts = [Counter(), Counter()]
    for which, items in enumerate((names, words)):
        for x in items:
            s = f"^^{x}$"
            counts[which].update(s[i : i + 3] for i in range(len(s) - 2))
    totals = [sum(c.values()) + 20_000 for c in counts]

    def score(x: str) -> float:
        s = f"^^{x}$"
        return sum(np.log((counts[0][s[i : i + 3]] + 0.5) / totals[0]) - np.log((counts[1][s[i : i + 3]] + 0.5) / totals[1]) for i in range(len(s) - 2))

    return score


def languages_of(counts: np.ndarray, names: list[str], of_label: list[int], rows: list[np.ndarray]) -> list[int]:
    """Numbers of the labels that are languages.

    ``counts`` has the occurrences of each word key under each label, ``rows`` the keys of each
    sentence and ``of_label`` its label number or -1. A sentence is taken out of its label's counts when it is judged.
    """
    totals, share = counts.sum(axis=0), counts.sum(axis=1) / max(1.0, counts.sum())
    won, seen = np.zeros(len(names)), np.zeros(len(names))
    for label, keys in zip(of_label, rows):
        if label < 0:
            continue
        held, own = np.unique(keys, return_counts=True)
        c, n = counts[held].copy(), totals.copy()
        c[:, label] -= own
        n[label] -= len(keys)
        rates = (c + 2.0 * share[held, None] + 1e-9) / (n + 2.0)
        seen[label] += 1
        won[label] += int((np.log(rates) * own[:, None]).sum(axis=0).argmax()) == label
    return [i for i in np.argsort(-seen, kind="stable") if seen[i] and won[i] >= LEAST_BORNE_OUT * seen[i]]


def fit(sentences: list[tuple[str, list[str]]], rounds: int = 2, steps: int = 30, seed: int = 7) -> LanguageField:
    """Fit the field on (message label, forms of a sentence); labels may be missing or wrong."""
    types: dict[str, int] = {}
    words, keys, spans, labels = [], [], [], []
    name_bodies: set[str] = set()
    lower_seen: set[str] = set()
    for label, forms in sentences:
        row = []
        for form in forms:
            word = plain(form)
            if form[:1] in ("@", "#"):
                name_bodies.add(name_body(form))
            elif is_word(word):
                if word not in types:
                    types[word] = len(words)
                    words.append(word)
                    keys.append(spelling(word))
                if word[0].islower():
                    lower_seen.add(keys[types[word]])
                row.append(types[word])
        if row:
            spans.append(row)
            labels.append(label)
    n_types = len(words)
    if not n_types:
        return LanguageField(np.zeros((BUCKETS, 1), np.float32), np.zeros((1, 1)), np.zeros(1), {})
    key_id = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    of_key = np.array([key_id[k] for k in keys])
    names = sorted({x for x in labels if x})
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    of_label = [names.index(x) if x else -1 for x in labels]
    counts = np.zeros((len(key_id), len(names)))
    for label, row in zip(of_label, spans):
        if label >= 0:
            np.add.at(counts, (of_key[row], label), 1)
    chosen = languages_of(counts, names, of_label, [of_key[row] for row in spans])
    langs = tuple(names[i] for i in chosen)
    if not langs:
        return LanguageField(np.zeros((BUCKETS, 1), np.float32), np.zeros((1, 1)), np.zeros(1), {})
    k_states = len(langs) + 1
    counts = counts[:, chosen]
    totals = counts.sum(axis=0) + 1.0
    share = counts.sum(axis=1, keepdims=True) / max(1.0, counts.sum())
    rates = (counts + 2.0 * share + 1e-9) / (totals[None] + 2.0)
    log_rate = np.log(rates) - np.log(rates).mean(axis=1, keepdims=True)
    log_rate *= np.minimum(1.0, counts.sum(axis=1, keepdims=True) / 4.0)
    name = _name_scorer(sorted(name_bodies - {""}), sorted(lower_seen))
    is_name = np.array([k not in lower_seen and (w[:1].isupper() or k not in lower_seen) and name(k) > 0 for w, k in zip(words, keys)])
    base = np.zeros((n_types, k_states), dtype=np.float64)
    base[:, : len(langs)] = log_rate[of_key]
    base[:, k_states - 1] = np.where(is_name, 30.0, -30.0)
    order = log_rate.argsort(axis=1)
    second = np.take_along_axis(log_rate, order[:, -2:-1], 1)[:, 0] if len(langs) > 1 else -1.5
    clear = np.take_along_axis(log_rate, order[:, -1:], 1)[:, 0] - second > 1.5
    hints = {k: langs[order[i, -1]] for k, i in key_id.items() if clear[i]}

    # a name does not end a stretch: decode the words without names, then put the names back
    spans.sort(key=len)
    bare = [[t for t in row if not is_name[t]] for row in spans]
    gold: list[np.ndarray] = []
    hard = np.full((k_states, k_states), -6.0)
    np.fill_diagonal(hard, 0.0)
    for at in range(0, len(spans), 512):
        rows = [(i, r) for i, r in enumerate(bare[at : at + 512]) if r]
        decoded = {}
        if rows:
            emis, lengths, _ = _padded([r for _, r in rows], base)
            for (i, r), tags in zip(rows, _viterbi(emis, lengths, hard)):
                decoded[i] = list(tags[: len(r)])
        for i, row in enumerate(spans[at : at + 512]):
            tags = iter(decoded.get(i, []))
            gold.append(np.array([k_states - 1 if is_name[t] else next(tags) for t in row]))

    feats = [features(w, k, hints.get(k, "?")) for w, k in zip(words, keys)]
    flat = np.concatenate([np.array(f) for f in feats])
    sizes = np.array([len(f) for f in feats])
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(n_types), sizes)
    rng = np.random.default_rng(seed)
    weights = np.zeros((BUCKETS, k_states))
    transitions, start = np.zeros((k_states, k_states)), np.zeros(k_states)
    square_w, square_t, square_s = np.full_like(weights, 1e-2), np.full((k_states, k_states), 1.0), np.full(k_states, 1.0)
    blocks = [np.arange(a, min(a + 256, len(spans))) for a in range(0, len(spans), 256)]
    for turn in range(rounds):
        todo = [b for _ in range(max(1, steps // max(1, len(blocks)))) for b in rng.permutation(len(blocks))] if len(blocks) < steps else list(rng.permutation(len(blocks)))
        for b in todo:
            rows = [spans[i] for i in blocks[b]]
            used = np.unique(np.concatenate([np.array(r) for r in rows]))
            local = np.full(n_types, -1)
            local[used] = np.arange(len(used))
            picks = np.isin(owner, used)
            w_flat, w_owner = flat[picks], local[owner[picks]]
            table = np.stack([np.bincount(w_owner, weights[w_flat, k], len(used)) for k in range(k_states)], axis=1)
            emis, lengths, ids = _padded([[local[t] for t in r] for r in rows], table)
            post, expected = forward_backward(emis, lengths, transitions, start, pairs=True)
            mask = np.arange(emis.shape[1])[None] < lengths[:, None]
            tags = np.zeros(mask.shape, dtype=np.int64)
            for i, j in enumerate(blocks[b]):
                tags[i, : lengths[i]] = gold[j]
            diff = -post
            np.put_along_axis(diff, tags[..., None], np.take_along_axis(diff, tags[..., None], 2) + 1, 2)
            diff *= mask[..., None]
            per_type = np.stack([np.bincount(ids.ravel(), diff[..., k].ravel(), len(used)) for k in range(k_states)], axis=1)
            ids_u, inverse = np.unique(w_flat, return_inverse=True)
            grad = np.stack([np.bincount(inverse, per_type[w_owner, k], len(ids_u)) for k in range(k_states)], axis=1) - 0.01 * weights[ids_u]
            observed = np.zeros((k_states, k_states))
            both = mask[:, 1:]
            np.add.at(observed, (tags[:, :-1][both], tags[:, 1:][both]), 1)
            square_w[ids_u] += grad**2
            weights[ids_u] += 0.2 * grad / np.sqrt(square_w[ids_u])
            g = observed - expected - 0.01 * transitions
            square_t += g**2
            transitions += 0.3 * g / np.sqrt(square_t)
            g = np.bincount(tags[:, 0], minlength=k_states) - post[:, 0].sum(axis=0)
            square_s += g**2
            start += 0.3 * g / np.sqrt(square_s)
        if turn + 1 < rounds:
            table = np.stack([np.bincount(owner, weights[flat, k], n_types) for k in range(k_states)], axis=1)
            for at in range(0, len(spans), 512):
                emis, lengths, _ = _padded(spans[at : at + 512], table)
                post, _ = forward_backward(emis, lengths, transitions, start)
                for i, row in enumerate(spans[at : at + 512]):
                    gold[at + i] = post[i, : len(row)].argmax(axis=1)
    return LanguageField(weights.astype(np.float32), transitions, start, hints, langs)


def sentences_of(words: DataFrame) -> DataFrame:
    """(doc_id, sent_id, forms): tokens in order, a re-delivered position counts once.

    One shuffle on (doc_id, sent_id): both groupings keep that partitioning.
    """
    kept = words.where(F.col("form").isNotNull()).select("doc_id", "sent_id", "idx", "tok_id", "form").repartition("doc_id", "sent_id")
    once = kept.groupBy("doc_id", "sent_id", "idx").agg(F.min_by("form", "tok_id").alias("form"))
    ordered = F.array_sort(F.collect_list(F.struct("idx", "form")))
    return once.groupBy("doc_id", "sent_id").agg(F.transform(ordered, lambda x: x["form"]).alias("forms"), F.transform(ordered, lambda x: x["idx"]).alias("idxs"))


def named_language(col):
    """Two-letter code that a message label names, or null."""
    low = F.lower(F.trim(col))
    return F.when(low.isin(*NO_LABEL) | low.isNull(), None).otherwise(F.substring(low, 1, 2))


def train(messages: DataFrame, words: DataFrame, max_messages: int = 4000) -> LanguageField:
    """Fit on the sentences of at most ``max_messages`` messages, chosen by hash of the id."""
    ids = messages.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(named_language(F.col("lang"))).alias("label"))
    sample = ids.orderBy(F.xxhash64("id"), "id").limit(max_messages)
    chosen = words.join(F.broadcast(sample), words["doc_id"] == sample["id"], "left_semi")
    rows = sentences_of(chosen).join(F.broadcast(sample), F.col("doc_id") == sample["id"]).select("doc_id", "sent_id", "label", "forms").orderBy("doc_id", "sent_id").toPandas()
    return fit([(label or "", list(forms)) for label, forms in zip(rows["label"], rows["forms"])])


def _label_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageField = shared.value
        n_states = len(model.langs) + 1
        for batch in batches:
            docs, sents = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            forms, idxs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            rows = []
            for i, tokens in enumerate(forms):
                kept = [(j, e) for j, e in enumerate(map(model.emission, tokens)) if e is not None]
                if kept:
                    rows.append((i, [j for j, _ in kept], [e for _, e in kept]))
            rows.sort(key=lambda r: len(r[1]))
            out = defaultdict(list)
            at = 0
            while at < len(rows):
                # blocks of similar length with at most about 40,000 padded positions
                n = max(1, min(2000, 40_000 // len(rows[at][1])))
                block = rows[at : at + n]
                while len(block) > 1 and len(block) * len(block[-1][1]) > 80_000:
                    block = block[: len(block) // 2]
                at += len(block)
                lengths = np.array([len(r[1]) for r in block])
                emis = np.zeros((len(block), lengths.max(), n_states))
                for i, r in enumerate(block):
                    emis[i, : lengths[i]] = r[2]
                post, _ = forward_backward(emis, lengths, model.transitions, model.start)
                tags, sure = post.argmax(axis=2), post.max(axis=2)
                for i, (row, places, _) in enumerate(block):
                    run_tag, begin, end, n, conf = -1, 0, 0, 0, 0.0
                    for j in [*range(lengths[i]), -1]:
                        tag = -1 if j < 0 else tags[i, j]
                        if tag == n_states - 1:
                            continue
                        if tag != run_tag:
                            if n:
                                out["doc_id"].append(docs[row])
                                out["sent_id"].append(sents[row])
                                out["first_idx"].append(idxs[row][begin])
                                out["last_idx"].append(idxs[row][end])
                                out["lang"].append(model.langs[run_tag])
                                out["n_words"].append(n)
                                out["confidence"].append(conf / n)
                            run_tag, begin, n, conf = tag, places[j], 0, 0.0
                        if j >= 0:
                            end, n, conf = places[j], n + 1, conf + float(sure[i, j])
            yield pa.RecordBatch.from_pydict({k: out[k] for k in SPAN_SCHEMA.names}, schema=SPAN_SCHEMA)

    return run


SPAN_SCHEMA = pa.schema([("doc_id", pa.string()), ("sent_id", pa.int32()), ("first_idx", pa.int32()), ("last_idx", pa.int32()), ("lang", pa.string()), ("n_words", pa.int32()), ("confidence", pa.float64())])


def stretches(words: DataFrame, model: LanguageField) -> DataFrame:
    """One row per stretch of words of one language, with its confidence."""
    shared = words.sparkSession.sparkContext.broadcast(model)
    return sentences_of(words).mapInArrow(_label_batches(shared), "doc_id string, sent_id int, first_idx int, last_idx int, lang string, n_words int, confidence double")


def message_languages(spark: SparkSession, messages: DataFrame, words: DataFrame, max_messages: int = 4000) -> DataFrame:
    """(doc_id, lang, share, confidence): the language of most words of each message."""
    spans = stretches(words, train(messages, words, max_messages))
    per = spans.groupBy("doc_id", "lang").agg(F.sum("n_words").alias("n"), F.sum(F.col("confidence") * F.col("n_words")).alias("c"))
    best = per.groupBy("doc_id").agg(F.max_by(F.struct("lang", "n", "c"), F.struct("n", "lang")).alias("b"), F.sum("n").alias("total"))
    ids = messages.where(F.col("id").isNotNull()).select(F.col("id").alias("doc_id")).union(words.where(F.col("doc_id").isNotNull()).select("doc_id")).distinct()
    rated = ids.join(best, "doc_id", "left")
    return rated.select(
        "doc_id", F.coalesce("b.lang", F.lit("und")).alias("lang"), F.coalesce(F.round(F.col("b.n") / F.col("total"), 6), F.lit(0.0)).alias("share"), F.coalesce(F.round(F.col("b.c") / F.col("b.n"), 4), F.lit(0.0)).alias("confidence")
    )


def mislabelled_sentences(messages: DataFrame, words: DataFrame, least_words: int = 5, max_messages: int = 4000) -> DataFrame:
    """(doc_id, sent_id, lang) of each stretch whose language the message's label does not name."""
    spans = stretches(words, train(messages, words, max_messages)).where(F.col("n_words") >= least_words)
    labels = messages.groupBy(F.col("id").alias("doc_id")).agg(F.collect_set(named_language(F.col("lang"))).alias("labels"))
    found = spans.select("doc_id", "sent_id", "lang").distinct()
    return found.join(labels, "doc_id").where(~F.array_contains("labels", F.col("lang"))).select("doc_id", "sent_id", "lang")
