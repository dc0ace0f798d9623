"""Sentence splitting by a scan of end marks and their context, and sequence alignment."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that end a sentence, what may close it, and smileys that belong to it.
ENDS, CLOSERS, SMILEY = ".!?…", "\"'”“»)]", re.compile(r"\s%\w*Smiley")
#: Abbreviations that do not end a sentence (our own list, lower case); single letters and words without vowel are abbreviations anyway.
ABBREVIATIONS = frozenset(
    "abb abs abt allg anm art aufl ausg bd bes bez bspw bzgl ca co d.h dipl doz eigtl einschl engl etc evtl exkl fa ggf inkl insb inst jh kap lj max min mio mo nat nov "
    "okt orig phil prof rel sen sept sog tel trad u.a usf uvm verb verf vol vors wiss z.b zit zus zw".split()
)
VOWELS = frozenset("aeiouyäöüáàâéèêíìîóòôúùû")
SENTENCES = T.ArrayType(T.StructType([T.StructField("sentence", T.StringType()), T.StructField("start", T.IntegerType())]))


def is_abbreviation(word: str) -> bool:
    """Whether a full stop behind the word belongs to it: single letters, words without vowel, listed ones."""
    low = word.lower()
    return low.isalpha() and (len(low) == 1 or not VOWELS & set(low)) or low in ABBREVIATIONS


def _word_before(text: str, at: int) -> str:
    start = at
    while start > 0 and (text[start - 1].isalnum() or text[start - 1] in ".'’" and start > 1 and text[start - 2].isalnum()):
        start -= 1
    return text[start:at]


def _ends_here(text: str, at: int, end: int, closed: bool) -> bool:
    """Whether a single full stop at ``at`` (its closers reach to ``end``) ends a sentence, by the word before and what follows."""
    following = text[end:].lstrip(" \t\"'„“")[:1] if end < len(text) else ""
    if end < len(text) and not text[end].isspace() and not closed and text[end].isalnum():
        return text[end].isupper() and not (len(_word_before(text, at)) == 1 or text[at - 1 : at].isdigit())
    if not following:
        return True
    word = _word_before(text, at)
    if word.isdigit():  # an ordinal number goes on in lower case
        return not following.islower() and not following.isdigit()
    if is_abbreviation(word):
        return False
    return closed or not following.islower()


def sentence_ends(text: str) -> list[int]:
    """Places behind which a sentence ends."""
    out, i, n = [], 0, len(text)
    while i < n:
        char = text[i]
        if char in ENDS:
            j = i
            while j < n and text[j] in ENDS:
                j += 1
            end = j
            while end < n and text[end] in CLOSERS and not (text[end] in "\"'“" and end + 1 < n and text[end + 1].isalnum()):
                end += 1
            single = text[i:j] == "."
            if not single or _ends_here(text, i, end, end > j):
                while smile := SMILEY.match(text, end):
                    end = smile.end()
                out.append(end)
            i = max(end, j)
        elif char == "-" and 0 < i < n - 2 and text[i - 1].isspace() and text[i + 1].isspace():
            word = re.match(r"\s*(\w+)", text[i + 1 :])  # a dash before a short capitalised word opens a sentence
            if word and len(word[1]) <= 3 and word[1][0].isupper() and not word[1].isdigit():
                out.append(i)
            i += 1
        elif char in "rR" and (mark := re.compile(r"rt\s*@\w+:?", re.I).match(text, i)) and (i == 0 or not text[i - 1].isalnum()):
            out.append(mark.end())
            i = mark.end()
        else:
            i += 1
    return out


def split_sentences(text: str) -> list[tuple[str, int]]:
    """(sentence, start) of each sentence that is not blank."""
    out, at = [], 0
    for end in [*sentence_ends(text), len(text)]:
        piece = text[at:end]
        bare = piece.strip()
        if bare:
            out.append((bare, at + len(piece) - len(piece.lstrip())))
        at = end
    return out


def sentences(c: Column) -> Column:
    """Array of (sentence, start) of a text."""

    @F.pandas_udf(SENTENCES)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else [{"sentence": x, "start": i} for x, i in split_sentences(t)])

    return run(c)


# --- alignment -------------------------------------------------------------------------------------


def plain_score(a: str, b: str) -> int:
    """2 for equal words without hash mark and case, else -1."""
    return 2 if a.lstrip("#").lower() == b.lstrip("#").lower() else -1


def _scores(a: Sequence, b: Sequence, same: Callable, gap: int) -> np.ndarray:
    """Last row of the alignment matrix of ``a`` with all prefixes of ``b``."""
    row = np.arange(len(b) + 1, dtype=np.int64) * gap
    for x in a:
        sub = row[:-1] + np.fromiter((same(x, y) for y in b), dtype=np.int64, count=len(b))
        new = np.empty_like(row)
        new[0] = row[0] + gap
        best = np.maximum(sub, row[1:] + gap)
        for j in range(len(b)):
            new[j + 1] = max(best[j], new[j] + gap)
        row = new
    return row


def align(a: Sequence, b: Sequence, same: Callable[[str, str], int] = plain_score, gap: int = -2) -> list[list[int]]:
    """For each element of ``a`` the indices of ``b`` aligned to it (global alignment).

    Ties prefer substitution, then insertion, then deletion; a deleted element has none.
    """
    n, m = len(a), len(b)
    score = np.zeros((n + 1, m + 1), dtype=np.int64)
    score[:, 0], score[0, :] = np.arange(n + 1) * gap, np.arange(m + 1) * gap
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            score[i, j] = max(score[i - 1, j - 1] + same(a[i - 1], b[j - 1]), score[i, j - 1] + gap, score[i - 1, j] + gap)
    out: list[list[int]] = [[] for _ in a]
    i, j = n, m
    while i > 0 or j > 0:
        if i and j and score[i, j] == score[i - 1, j - 1] + same(a[i - 1], b[j - 1]):
            i, j = i - 1, j - 1
            out[i].insert(0, j)
        elif j and score[i, j] == score[i, j - 1] + gap:
            j -= 1
        else:
            i -= 1
    return out


def align_linear(a: Sequence, b: Sequence, same: Callable[[str, str], int] = plain_score, gap: int = -2, cells: int = 250_000) -> list[list[int]]:
    """Alignment in linear space: halves of ``a`` meet where the summed scores are highest."""
    if list(a) == list(b):
        return [[i] for i in range(len(a))]
    if (len(a) + 1) * (len(b) + 1) <= cells or len(a) < 2:
        return align(a, b, same, gap)
    half = len(a) // 2
    left = _scores(a[:half], b, same, gap)
    right = _scores(a[half:][::-1], b[::-1], same, gap)[::-1]
    cut = int(np.argmax(left + right))
    return align_linear(a[:half], b[:cut], same, gap, cells) + [[i + cut for i in ids] for ids in align_linear(a[half:], b[cut:], same, gap, cells)]


def merge_by_alignment(tokens: DataFrame, words: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, idx, word_ids): ids of the stand-off words that each token aligns to, per document.

    ``tokens``: key, idx, form; ``words``: key, word_id, form. One document is one group; its
    alignment takes linear space.
    """
    kind = tokens.schema[key].dataType.simpleString()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("idx"), right.sort_values("word_id")
        ids = right["word_id"].tolist()
        found = align_linear(left["form"].fillna("").tolist(), right["form"].fillna("").tolist())
        return pd.DataFrame({key: left[key].tolist(), "idx": left["idx"].tolist(), "word_ids": [[ids[j] for j in js] for js in found]})

    a, b = tokens.select(key, "idx", "form").groupBy(key), words.select(key, "word_id", "form").groupBy(key)
    return a.cogroup(b).applyInPandas(run, f"{key} {kind}, idx int, word_ids array<int>")
