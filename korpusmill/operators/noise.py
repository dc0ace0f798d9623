"""Noise cleaning, umlauts, slang, misspellings and elongations of messages."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korpusmill.operators.cleaning import SUSPECT, NoiseCleaner
from korpusmill.operators.patterns import LOG, RESULT, MapRules, MultiPattern, PatternRules, ReplacementLog, adjust_case, leftmost_longest

#: Small map of colloquial forms (our own examples; callers bring their own).
SLANG = {"nich": "nicht", "net": "nicht", "nix": "nichts", "is": "ist", "isses": "ist es", "hab": "habe", "haste": "hast du", "gehts": "geht es", "gibts": "gibt es", "wirds": "wird es", "mal": "einmal", "drauf": "darauf", "ma": "einmal", "vllt": "vielleicht", "evtl": "eventuell"}

#: Characters of messages whose tokens are handled at once.
BLOCK = 2_000_000

#: Vowels that an e behind them may turn into an umlaut, the letters that forbid it in front and behind (fixed values).
UMLAUT_OF = {"a": "ä", "o": "ö", "u": "ü"}
NOT_BEHIND = {"a": "ae@", "o": "ae@", "u": "aeqä@"}
NOT_BEFORE = {"a": "", "o": "", "u": "i"}
#: Words in which the sequences are legal (our own short list; callers bring their own).
UMLAUT_EXCEPTIONS = ["aktuell", "duell", "statue", "neue", "treue", "blaue", "genaue", "poet", "poesie", "koexist", "zuerst", "soeben", "israel", "michael", "raphael", "aero", "samuel", "manuel", "individuell", "sexuell", "virtuell", "eventuell", "manuell", "ritual", "kongruen", "fluen", "quer", "bequem", "zuend", "zuerk", "zuein", "joel", "noel", "oboe", "aloe", "maestro", "dues", "influen", "konsequen"]


def clean_noise(text: Column, rules: PatternRules | None = None) -> Column:
    """Struct (text, log) of the cleaned message: by the scanner, or by the rules of a rule file.

    Messages without anything suspicious never leave the JVM.
    """
    if rules is not None:
        return rules.column(text)

    @F.pandas_udf(RESULT)
    def run(s: pd.Series) -> pd.DataFrame:
        cleaner, texts, logs = NoiseCleaner(), [], []
        for t in s:
            log = ReplacementLog()
            texts.append(None if t is None else cleaner.clean(t, log))
            logs.append(log.entries)
        return pd.DataFrame({"text": texts, "log": logs})

    suspect = F.when(text.rlike(SUSPECT), text)
    return F.when(suspect.isNotNull(), run(suspect)).otherwise(F.struct(text.alias("text"), F.array().cast(LOG).alias("log")))


def restored_tokens(docs: DataFrame, restore: list[str], key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, pos, token, start, len): plain tokens of the cleaned messages, the original text put back for the placeholders in ``restore``.

    Tokens and replacements come from the same message, so it is cleaned once and nothing has to meet
    in a join. ``start`` and ``len`` are places in the cleaned text. A token may hold several placeholders.
    """
    wanted = frozenset(restore)

    def tokens_of(texts: list[str], suspect: list[bool], cleaner: NoiseCleaner) -> tuple[np.ndarray, list]:
        """Number of tokens of each message, and the columns pos, token, start, len."""
        texts, logs = list(texts), []
        for i, t in enumerate(texts):
            if suspect[i]:
                log = ReplacementLog()
                texts[i] = cleaner.clean(t, log)
                logs += [(i, e["offset"], e["length"], e["orig"]) for e in reversed(log.entries) if e["replacement"] in wanted]
        lists = pc.split_pattern(pa.array(texts, pa.string()), pattern=" ")
        tokens, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
        first = np.cumsum(sizes) - sizes
        length = pc.utf8_length(tokens).to_numpy().astype(np.int64)
        start = np.cumsum(length + 1) - length - 1
        start -= np.repeat(start[first], sizes)
        put: dict[int, str] = {}
        for i, offset, size, orig in logs:  # from the end of a message on, so offsets before it hold
            own = slice(first[i], first[i] + sizes[i])
            k = int(first[i] + np.searchsorted(start[own], offset, "right") - 1)
            at = int(offset - start[k])
            if at < length[k]:
                token = put[k] if k in put else tokens[k].as_py()
                put[k] = token[:at] + orig + token[at + size :]
        if put:
            where = np.zeros(len(tokens), dtype=bool)
            where[list(put)] = True
            tokens = pc.replace_with_mask(tokens, pa.array(where), pa.array([put[k] for k in sorted(put)], pa.string()))
        pos = np.arange(len(tokens)) - np.repeat(first, sizes)
        return sizes, [pa.array(pos, pa.int32()), tokens, pa.array(start, pa.int64()), pa.array(length, pa.int32())]

    def run(batches):
        cleaner = NoiseCleaner()
        for batch in batches:
            keys, texts, suspect = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            ends = np.cumsum([len(t) for t in texts])
            low = 0
            while low < len(texts):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + BLOCK, "right")))
                sizes, columns = tokens_of(texts[low:high], suspect[low:high], cleaner)
                own = keys.slice(low, high - low).take(pa.array(np.repeat(np.arange(high - low), sizes)))
                yield pa.RecordBatch.from_arrays([own, *columns], names=[key, "pos", "token", "start", "len"])
                low = high

    text = F.col(column)
    rows = docs.where(text.isNotNull()).select(key, text.alias("text"), text.rlike(SUSPECT).alias("suspect"))
    return rows.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, pos int, token string, start bigint, len int")


def normalize_slang(text: Column, rules: MapRules | None = None) -> Column:
    return (rules or MapRules(SLANG, ignore_case=True, whole_words=True)).column(text)


class UmlautRestorer:
    """ae, oe and ue to umlauts outside of exceptions.

    Log entries behind a change are shifted by their place in the text as it is now
    (``literal`` keeps the coordinates of the unchanged text instead).
    """

    def __init__(self, exceptions: list[str] | None = None, literal: bool = False):
        self.exceptions = MultiPattern([([re.escape(w) for w in sorted(exceptions if exceptions is not None else UMLAUT_EXCEPTIONS, key=len, reverse=True)], 0)])
        self.literal = literal

    @staticmethod
    def places(text: str) -> list[int]:
        """Starts of a vowel and an e that may stand for an umlaut, none inside another."""
        low, out, at = text.lower(), [], 0
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        while (at := low.find("e", at + 1)) > 0:
            vowel = low[at - 1]
            if vowel not in UMLAUT_OF or out and out[-1] > at - 3:
                continue
            if (at < 2 or low[at - 2] not in NOT_BEHIND[vowel]) and (at + 1 >= len(low) or low[at + 1] not in NOT_BEFORE[vowel]):
                out.append(at - 1)
        return out

    def restore(self, text: str, log: ReplacementLog | None = None) -> str:
        held = leftmost_longest(self.exceptions.spans(text.lower())) if len(text.lower()) == len(text) else []
        out, at, shift = [], 0, 0
        for start in self.places(text):
            if any(a < start + 2 and start < b for a, b in held):
                continue
            vowel = text[start]
            out += [text[at:start], UMLAUT_OF[vowel.lower()].upper() if vowel.isupper() else UMLAUT_OF[vowel]]
            if log is not None:
                log.update(start if self.literal else start + shift, -1)
            shift -= 1
            at = start + 2
        return "".join([*out, text[at:]])

    def column(self, text: Column, log: Column | None = None) -> Column:
        """Struct (text, log); rows without a candidate are left to the native side by the caller's guard."""
        me = self

        @F.pandas_udf(RESULT)
        def run(s: pd.Series, logs: pd.Series) -> pd.DataFrame:
            texts, out = [], []
            for t, entries in zip(s, logs):
                memory = ReplacementLog([dict(e if isinstance(e, dict) else e.asDict()) for e in entries] if entries is not None else [])
                texts.append(None if t is None else me.restore(t, memory))
                out.append(memory.entries)
            return pd.DataFrame({"text": texts, "log": out})

        return run(text, log if log is not None else F.array().cast("array<struct<offset:int,length:int,num:int,orig:string,replacement:string>>"))


# --- elongations -----------------------------------------------------------------------------------

RUN3 = re.compile(r"([^\W\d_])\1{3,}", re.I)
RUN = re.compile(r"([^\W\d_])\1+", re.I)
THREE = re.compile(r"([^\W\d_])\1\1", re.I)
LEGAL = re.compile(r'^(?:"?@.+|[VILXCD]+|[$\d.,]+)\.?$')


def squeeze(word: str) -> str:
    return RUN.sub(r"\1", word)


def is_elongated(word: str) -> bool:
    return bool(THREE.search(word)) and not LEGAL.match(word)


def _shortened(word: str):
    """Every spelling with each run shortened to each length up to three, one after the other."""
    parts, at = [], 0
    for match in RUN.finditer(word):
        run = match.group()[:3]
        parts += [[word[at : match.start()]], [run[:n] for n in range(1, len(run) + 1)]]
        at = match.end()
    parts.append([word[at:]])
    return map("".join, itertools.product(*parts))


def shortenings(word: str, literal: bool = False) -> list[str]:
    """The sorted spellings; ``literal`` leaves out the last one, as the known constant does."""
    found = sorted(set(_shortened(word)))
    return found[:-1] if literal else found


def shortening_rows(words: DataFrame, column: str = "word") -> DataFrame:
    """(word, candidate) of the distinct elongated words; a word with very many spellings is written out in pieces."""
    from korpusmill.functions.text import is_elongated as native

    def run(batches):
        for batch in batches:
            pairs = ((w, c) for w in batch["word"] for c in _shortened(w.lower()))
            while part := list(itertools.islice(pairs, 20_000)):
                yield pd.DataFrame(part, columns=["word", "candidate"])

    rows = words.select(F.col(column).alias("word")).where(F.col("word").isNotNull() & native(F.col("word"))).distinct()
    return rows.mapInPandas(run, "word string, candidate string")


def known_shortenings(words: DataFrame, dictionary: DataFrame, column: str = "word") -> DataFrame:
    """(word, candidate): the shortenings that are in the dictionary.

    Words meet on their squeezed spelling and the lengths of their runs are compared, so a word of many
    runs costs as much as its partners in the dictionary, not as its shortenings.
    """
    from korpusmill.functions.text import is_elongated as native
    from korpusmill.functions.text import squeeze_runs

    lengths = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"([\p{L}])\1*|[^\p{L}]"), F.lit(0)), F.length)
    key = lambda c: squeeze_runs(F.lower(c))
    left = words.select(F.col(column).alias("word")).where(F.col("word").isNotNull() & native(F.col("word"))).distinct().withColumn("key", key("word"))
    right = dictionary.select(F.lower(dictionary.columns[0]).alias("candidate")).where("candidate is not null").distinct().withColumn("key", key("candidate"))
    pairs = left.join(right, "key").withColumn("a", lengths(F.lower("word"))).withColumn("b", lengths(F.col("candidate")))
    fits = F.forall(F.zip_with("a", "b", lambda x, y: (x >= y) & (y <= 3)), lambda ok: ok)
    return pairs.where((F.size("a") == F.size("b")) & fits).select("word", "candidate")


def squeeze_elongated(tokens: DataFrame, dictionary: DataFrame, bigrams: DataFrame, unigrams: DataFrame, lengthened: DataFrame) -> DataFrame:
    """(doc_id, sent_id, idx, form, squeezed): elongated tokens in their best spelling.

    Dictionary candidates are ranked by bigram + unigram + bigram log-probability with the
    neighbours; without one the corpus statistics of the key decide; else the word stays.
    """
    from pyspark.sql import Window as W

    from korpusmill.functions.text import adjust_case as case
    from korpusmill.functions.text import is_elongated as native
    from korpusmill.functions.text import squeeze_runs
    from korpusmill.operators.ngrams import BOL, EOL, bigram_logprob, lookup_bigrams, unigram_logprob

    w = W.partitionBy("doc_id", "sent_id").orderBy("idx")
    near = tokens.withColumn("left", F.coalesce(F.lower(F.lag("form").over(w)), F.lit(BOL))).withColumn("right", F.coalesce(F.lower(F.lead("form").over(w)), F.lit(EOL)))
    long = near.where(F.col("form").isNotNull() & native(F.col("form"))).select("doc_id", "sent_id", "idx", "form", "left", "right")
    cands = known_shortenings(long, dictionary, "form").withColumnRenamed("word", "form")
    rows = long.join(cands, "form")
    uni = unigram_logprob(unigrams).select(F.col("w").alias("candidate"), F.col("logp").alias("u"))
    floor = unigrams.agg(F.ln(F.lit(0.5) / (F.sum("cnt") + 0.5 * (F.count(F.lit(1)) + 1))).alias("u0"))
    pairs = rows.select(F.col("left").alias("w1"), F.col("candidate").alias("w2")).union(rows.select(F.col("candidate").alias("w1"), F.col("right").alias("w2"))).distinct()
    scored = lookup_bigrams(pairs, bigrams).select("w1", "w2", "logp")
    full = (
        rows.join(scored.select(F.col("w1").alias("left"), F.col("w2").alias("candidate"), F.col("logp").alias("b1")), ["left", "candidate"])
        .join(scored.select(F.col("w1").alias("candidate"), F.col("w2").alias("right"), F.col("logp").alias("b2")), ["candidate", "right"])
        .join(uni, "candidate", "left")
        .crossJoin(F.broadcast(floor))
    )  # the floor is one row
    best = full.groupBy("doc_id", "sent_id", "idx").agg(F.max_by("candidate", F.struct(F.col("b1") + F.coalesce("u", "u0") + F.col("b2"), "candidate")).alias("by_dictionary"))
    stats = lengthened.groupBy(F.col("key").alias("key")).agg(F.max_by("word", F.struct("prob", "word")).alias("by_corpus"))
    joined = long.join(best, ["doc_id", "sent_id", "idx"], "left").withColumn("key", F.lower(squeeze_runs(F.col("form")))).join(stats, "key", "left")
    new = F.coalesce("by_dictionary", "by_corpus")
    return joined.select("doc_id", "sent_id", "idx", "form", F.when(new.isNotNull(), case(new, F.col("form"))).otherwise(F.col("form")).alias("squeezed"))


# --- misspellings -----------------------------------------------------------------------------------

@dataclass
class Checks:
    """What the rules may ask: the dictionary and n-gram log-probabilities (without them the dictionary decides alone)."""

    known: Callable[[str], bool]
    uni: Callable[[str], float] | None = None
    bi: Callable[[str, str], float] | None = None

    def better(self, left: str, old: str, new: str, right: str, after: str | None = None, or_equal: bool = False) -> bool:
        if self.uni is None or self.bi is None:
            return True
        p_old = self.bi(left, old) + self.uni(old) + self.bi(old, right)
        p_new = self.bi(left, new) + self.uni(new) + self.bi(new, after or right)
        return p_new >= p_old if or_equal else p_new > p_old


@dataclass(frozen=True)
class Repair:
    """A word that ends in ``written`` is taken for one that ends in ``meant``, with ``split`` as a word of its own.

    The word must be unknown and the repaired one known. ``score`` asks whether the n-grams
    prefer it too: ``>`` or ``>=``. ``bare`` are letters the stem may not end in, ``only`` what it must end in, ``least`` its least length.
    """

    name: str
    written: str
    meant: str
    split: str = ""
    score: str = ""
    bare: str = ""
    only: tuple[str, ...] = ()
    least: int = 1

    def apply(self, word: str, checks: Checks, left: str, right: str) -> str | None:
        stem = word[: len(word) - len(self.written)]
        if len(stem) < self.least or not word.isalpha() or word[len(stem) :].lower() != self.written:
            return None
        if stem[-1].lower() in self.bare or self.only and not stem.lower().endswith(self.only):
            return None
        repaired = stem + self.meant
        if checks.known(word) or not checks.known(repaired):
            return None
        if self.score and not checks.better(left, word, repaired, right, self.split or None, or_equal=self.score == ">="):
            return None
        return f"{repaired} {self.split}" if self.split else repaired


#: Endings and what is meant by them, in the order in which they are tried (fixed values).
REPAIRS = (
    Repair("xsses", "ses", "t", "es", only=("s",), least=2),
    Repair("xsser", "ser", "t", "er", only=("s",), least=2),
    Repair("xste", "e", "", "du", score=">", only=("st",), least=3),
    Repair("xs", "s", "", "es", score=">", bare="e"),
    Repair("xes", "s", "e", "es", bare="e"),
    Repair("xn", "n", "en", bare="e", least=2),
    Repair("xt", "t", "s", only=tuple("aeiou"), least=2),
    Repair("xe", "", "e", score=">=", bare="e"),
)
#: Short forms whose first syllable is missing: beginnings and what they are short for (fixed values).
CLIPPED = {"rauf": "herauf", "raus": "heraus", "rum": "herum", "rüber": "herüber", "runter": "herunter"}
ARTICLE_ENDS = ("", "m", "n", "r", "s")


def unclipped(word: str) -> str | None:
    """A clipped direction or article with its first syllable; None for other words."""
    low = word.lower()
    stem = next((c for c in CLIPPED if low.startswith(c)), None)
    if stem and (low == stem or stem != "rauf") and not low.startswith("rummel"):
        return adjust_case(CLIPPED[stem] + word[len(stem) :], word)
    head = "irgend" if low.startswith("irgend") else ""
    rest = low[len(head) :].lstrip("'")
    if rest[:2] == "ne" and rest[2:] in ARTICLE_ENDS:
        short = word[len(word) - len(rest) :]
        return word[: len(head)] + adjust_case("ei" + short, short)
    return None


def repaired(word: str, checks: Checks, left: str, right: str) -> str | None:
    """The first repair of a word that holds, or None."""
    whole = unclipped(word)
    if whole is not None:
        return whole
    plain = word[:-2] + word[-1:] if word[-2:-1] == "'" and word[-1:] in "sS" else word  # geht's
    if plain != word:
        return REPAIRS[4].apply(plain, checks, left, right)
    for repair in REPAIRS:
        new = repair.apply(word, checks, left, right)
        if new is not None:
            return new
    return None


class _Asked(Checks):
    """Refuses every n-gram check and keeps the n-grams it would need ("w" or "w1 w2")."""

    def __init__(self, known: Callable[[str], bool]):
        super().__init__(known)
        self.ngrams: set[str] = set()

    def better(self, left: str, old: str, new: str, right: str, after: str | None = None, or_equal: bool = False) -> bool:
        self.ngrams |= {old, new, f"{left} {old}", f"{old} {right}", f"{left} {new}", f"{new} {after or right}"}
        return False


class MisspellingRestorer:
    """Ordered rules over the words of a line; the first rule whose check holds rewrites a word.

    The left neighbour is the one of the corrected line, the right one that of the line as it was.
    """

    def __init__(self, checks: Checks):
        self.checks = checks
        self.words = re.compile(r"[^\s.,?!-]+")

    def correct(self, line: str, log: ReplacementLog | None = None) -> str:
        out, at, size = [], 0, 0
        spans = [m for m in self.words.finditer(line)]
        last = "bol"
        for i, match in enumerate(spans):
            left, last = last, match.group()
            right = spans[i + 1].group() if i + 1 < len(spans) else "eol"
            new = repaired(match.group(), self.checks, left, right)
            if new is not None and new != match.group():
                out += [line[at : match.start()], new]
                size += match.start() - at + len(new)
                if log is not None:
                    log.update(size, len(new) - len(match.group()))
                at, last = match.end(), self.words.findall(new)[-1]
        return "".join([*out, line[at:]])

    def asked(self, line: str) -> list[str]:
        """N-grams ("w" or "w1 w2") that ``correct`` may ask for, whatever the n-gram checks of earlier words say."""
        asked, either = _Asked(self.checks.known), Checks(self.checks.known)
        spans, lefts = [m.group() for m in self.words.finditer(line)], {"bol"}
        for word, right in zip(spans, [*spans[1:], "eol"]):
            outcomes = [unclipped(word), *(r.apply(word, either, "", right) for r in REPAIRS), repaired(word, either, "", right)]
            for left in lefts:
                repaired(word, asked, left, right)
            lasts = {word} | {self.words.findall(new)[-1] for new in outcomes if new}
            lefts = lasts
        return sorted(asked.ngrams)


def _ngram_scores(asked: DataFrame, unigrams: DataFrame, bigrams: DataFrame) -> DataFrame:
    """(_h, scores): log-probabilities of the n-grams asked for (_h, ngram) as a map."""
    from korpusmill.functions.text import ngram_key
    from korpusmill.operators.ngrams import LAMBDA, lookup_bigrams, unigram_logprob

    parts = F.split("ngram", " ")
    keyed = asked.withColumn("w1", ngram_key(F.get(parts, F.lit(0)))).withColumn("w2", ngram_key(F.get(parts, F.lit(1))))
    pairs = keyed.where("w2 is not null")
    two = pairs.join(lookup_bigrams(pairs.select("w1", "w2").distinct(), bigrams), ["w1", "w2"]).select("_h", "ngram", "logp")
    floor = unigrams.agg(F.ln(F.lit(LAMBDA) / (F.coalesce(F.sum("cnt"), F.lit(0)) + LAMBDA * (F.count(F.lit(1)) + 1))).alias("u0"))
    known = unigram_logprob(unigrams).select(F.col("w").alias("w1"), "logp")
    one = keyed.where("w2 is null").join(known, "w1", "left").crossJoin(F.broadcast(floor)).select("_h", "ngram", F.coalesce("logp", "u0").alias("logp"))
    return two.unionByName(one).groupBy("_h").agg(F.map_from_entries(F.collect_list(F.struct("ngram", "logp"))).alias("scores"))


def questions(line: str) -> list[str]:
    """Lower-case words that ``correct`` may look up in the dictionary."""
    asked: set[str] = set()

    def known(word: str) -> bool:
        asked.add(word.lower())
        return False

    checks = Checks(known)
    for word in re.findall(r"[^\s.,?!-]+", line):
        repaired(word, checks, "", "")
    return sorted(asked)


def restore_misspellings(df: DataFrame, column: str, dictionary: DataFrame, max_words: int = 500_000, unigrams: DataFrame | None = None, bigrams: DataFrame | None = None) -> DataFrame:
    """``column`` corrected with a dictionary.

    A dictionary of up to ``max_words`` words is held by every worker; of a larger one each text gets the
    words it may ask for by joins. With counts of ``unigrams`` (w, cnt) and ``bigrams`` (w1, w2, cnt) the rules also compare
    the scores of old and new form: the n-grams that a text may ask for are joined to it first,
    by a hash of the text (texts of one hash share what they ask, which does no harm).
    """
    if (unigrams is None) != (bigrams is None):
        raise ValueError("n-gram checks need unigrams and bigrams")
    entries = dictionary.select(F.lower(dictionary.columns[0]).alias("w")).where("w is not null").distinct()
    words = [r[0] for r in entries.limit(max_words + 1).collect()]
    held = df.sparkSession.sparkContext.broadcast(frozenset(words)) if len(words) <= max_words else None
    keyed = df.withColumn("_h", F.xxhash64(column))

    def known_by(own):
        words = held.value if held is not None else frozenset(own if own is not None else ())
        return lambda w: w.lower() in words

    if held is None:

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def looks_up(s: pd.Series) -> pd.Series:
            return s.map(lambda t: [] if t is None else questions(t))

        asked = keyed.select("_h", F.explode(looks_up(F.col(column))).alias("w")).distinct().join(entries, "w", "left_semi")
        keyed = keyed.join(asked.groupBy("_h").agg(F.collect_set("w").alias("_known")), "_h", "left")
    else:
        keyed = keyed.withColumn("_known", F.lit(None).cast("array<string>"))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def asks(s: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else MisspellingRestorer(Checks(known_by(k))).asked(t) for t, k in zip(s, own)], dtype=object)

    @F.pandas_udf(T.StringType())
    def check(s: pd.Series, own: pd.Series, scores: pd.Series) -> pd.Series:
        def one(t: str, k, found) -> str:
            of = dict(found) if found is not None else {}
            grams = (of.__getitem__, lambda a, b: of[f"{a} {b}"]) if of else (None, None)
            return MisspellingRestorer(Checks(known_by(k), *grams)).correct(t)

        return pd.Series([None if t is None else one(t, k, f) for t, k, f in zip(s, own, scores)], dtype=object)

    if unigrams is None:
        keyed = keyed.withColumn("_scores", F.lit(None).cast("map<string,double>"))
    else:
        wanted = keyed.select("_h", F.explode(asks(F.col(column), F.col("_known"))).alias("ngram")).distinct()
        keyed = keyed.join(_ngram_scores(wanted, unigrams, bigrams).withColumnRenamed("scores", "_scores"), "_h", "left")
    return keyed.withColumn(column, check(F.col(column), F.col("_known"), F.col("_scores"))).drop("_h", "_known", "_scores")


# --- dictionary -------------------------------------------------------------------------------------


def in_dictionary(words: DataFrame, dictionary: DataFrame, column: str = "word", ignore_case: bool = True) -> DataFrame:
    """``known``: the word or its capitalised form is in the dictionary."""
    from korpusmill.functions.text import capitalize

    entries = dictionary.select(F.col(dictionary.columns[0]).alias("_d")).distinct()
    hit = words.join(entries.withColumn("_a", F.lit(True)), F.col(column) == F.col("_d"), "left").drop("_d")
    if not ignore_case:
        return hit.withColumn("known", F.coalesce("_a", F.lit(False))).drop("_a")
    second = hit.join(entries.withColumn("_b", F.lit(True)), capitalize(F.lower(column)) == F.col("_d"), "left").drop("_d")
    return second.withColumn("known", F.coalesce("_a", "_b", F.lit(False))).drop("_a", "_b")


def suggestions(words: DataFrame, dictionary: DataFrame, column: str = "word", distance: int = 1, top: int = 3) -> DataFrame:
    """(word, rank, suggestion, distance): dictionary words within an edit distance.

    Words meet on deletion keys (every word with up to ``distance`` characters removed), so
    candidates come from equi-joins instead of all pairs.
    """
    from pyspark.sql import Window as W

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def keys(s: pd.Series) -> pd.Series:
        def make(w: str) -> list[str]:
            out = {w}
            for k in range(1, distance + 1):
                out |= {"".join(c for i, c in enumerate(w) if i not in drop) for drop in itertools.combinations(range(len(w)), k)}
            return sorted(out)

        return s.map(make)

    left = words.select(F.lower(column).alias("word")).where(F.col("word").isNotNull()).distinct()
    right = dictionary.select(F.lower(dictionary.columns[0]).alias("suggestion")).distinct()
    pairs = left.withColumn("k", F.explode(keys("word"))).join(right.withColumn("k", F.explode(keys("suggestion"))), "k").select("word", "suggestion").distinct()
    near = pairs.withColumn("distance", F.levenshtein("word", "suggestion")).where(F.col("distance") <= distance)
    w = W.partitionBy("word").orderBy("distance", "suggestion")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("word", "rank", "suggestion", "distance")
