"""Problem 6: text that was decoded with the wrong character encoding.

The garbled sequence of every target character under every encoding pair is
precomputed and put into one multi-pattern (Aho-Corasick) automaton. Matched
spans are replaced, everything else in the string stays untouched; passes repeat
until nothing matches, which undoes garbling of any depth (every pass shortens the text).
Words are judged one by one, so an odd word does not keep another from being restored.

Two families of pairs are known:

* *multi-byte*: UTF-8 bytes read as a one-byte code page. Their sequences hardly
  occur in clean text and are accepted where the outcome is plausible.
* *one-byte*: Latin-1 bytes read as another one-byte code page. Such a sequence is a
  single character that may stand in clean text too, so the matched spans are only proposals, one per page:
  a proposal wins if the corpus (counts over all tokens) knows the restored word
  better than the written one.

Defined results: null and empty strings are never affected; a string with U+FFFD,
plain or garbled itself, has lost characters and gets the empty string; repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOST = "�"
#: Code pages that UTF-8 bytes are mistaken for.
UTF8_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251")
#: Code pages that Latin-1 bytes are mistaken for: all of these but the two that read its letters right.
LATIN1_AS = tuple(page for page in UTF8_AS if page not in ("cp1252", "latin-1"))
#: Code point ranges whose characters may have been garbled; of equal sequences the earlier range counts.
TARGETS = (
    (0x00A0, 0x017F), (0x0192, 0x0192), (0x0218, 0x021B), (0x02B0, 0x02FF), (0x0300, 0x036F), (0x0370, 0x03FF), (0x0400, 0x045F), (0x1E00, 0x1EFF), (0x200B, 0x2044),
    (0x2060, 0x2060), (0x2070, 0x209C), (0x20A0, 0x20BF), (0x2100, 0x214F), (0x2150, 0x218F), (0x2190, 0x22FF), (0x2300, 0x23FF),
    (0x2500, 0x27BF), (0x3000, 0x3000), (0xF8FF, 0xF8FF), (0xFB00, 0xFB06), (0xFE0F, 0xFE0F), (0xFEFF, 0xFEFF), (0xFF01, 0xFF5E), (0xFFFD, 0xFFFD),
    (0x1F1E6, 0x1F1FF), (0x1F300, 0x1FAFF), (0x0080, 0x009F),
)
#: Letters a one-byte pair may have garbled.
LATIN1_TARGETS = "àáâãäåæçèéêëìíîïñòóôõöøùúûüßÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜ"


def _decode(raw: bytes, page: str) -> str | None:
    """The garbled reading; bytes that a Windows page leaves undefined pass as C1 controls."""
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(page))
        except UnicodeDecodeError:
            if page != "cp1252":
                return None
            out.append(chr(b))
    return "".join(out)


@lru_cache(maxsize=1)
def automaton():
    """Aho-Corasick automaton of all pairs: garbled sequence -> original of the multi-byte pairs, originals by page of the one-byte pairs."""
    import ahocorasick

    found: dict[str, str] = {}
    single: dict[str, dict[str, str]] = {}
    for page in LATIN1_AS:
        for char in LATIN1_TARGETS:
            garbled = _decode(char.encode("latin-1"), page)
            if garbled and garbled != char:
                single.setdefault(garbled, {})[page] = char
    for low, high in TARGETS:
        for point in range(low, high + 1):
            char = chr(point)
            raw = char.encode("utf-8")
            for page in UTF8_AS:
                garbled = _decode(raw, page)
                if garbled and garbled != char:
                    found.setdefault(garbled, char)
    auto = ahocorasick.Automaton()
    for garbled in found.keys() | single.keys():
        auto.add_word(garbled, (len(garbled), found.get(garbled), single.get(garbled, {})))
    auto.make_automaton()
    return auto


def _script(char: str) -> str:
    if not char.isalpha():
        return ""
    point = ord(char)
    if 0x370 <= point <= 0x3FF or 0x1F00 <= point <= 0x1FFF:
        return "G"
    if 0x400 <= point <= 0x52F:
        return "C"
    return "L"


_LETTERS = re.compile(r"[^\W\d_]+")


def _mixed(text: str) -> bool:
    """Whether a run of letters mixes scripts."""
    return any(len({_script(c) for c in run} - {""}) > 1 for run in _LETTERS.findall(text))


def _raised(text: str) -> int:
    """Superscripts in front of a letter."""
    return sum(a in "¹²³" and b.isalpha() for a, b in zip(text, text[1:]))


def _plausible(old: str, new: str) -> bool:
    """No letters of different scripts may stand together after restoring, and no new superscript before a letter."""
    return not _mixed(new) and _raised(new) <= _raised(old)


def replace_spans(text: str, page: str | None = None) -> str:
    """One pass: leftmost-longest garbled spans are replaced, other text is kept.

    Without ``page`` by the multi-byte pairs, else by the one-byte pair of that page.
    """
    best: dict[int, tuple[int, str]] = {}
    for end, (length, char, pages) in automaton().iter(text):
        new = char if page is None else pages.get(page)
        start = end - length + 1
        if new is not None and (start not in best or best[start][0] < length):
            best[start] = (length, new)
    if not best:
        return text
    out, at = [], 0
    for start in sorted(best):
        if start < at:
            continue
        length, char = best[start]
        out += [text[at:start], char]
        at = start + length
    return "".join([*out, text[at:]])


_BLANKS = re.compile(r"([ \t\r\n]+)")


def _restore_word(word: str) -> str:
    if word.isascii():
        return word
    text = word
    while (new := replace_spans(text)) != text:
        text = new
    return text if _plausible(word, text) else word


def restore_multibyte(text: str) -> str:
    """Undo the multi-byte pairs until nothing changes; words with an implausible outcome stay."""
    if text.isascii():
        return text
    return "".join(map(_restore_word, _BLANKS.split(text)))


_WORDISH = re.compile(r"[A-Za-z]")


def proposals(text: str) -> list[tuple[str, str]]:
    """(kind, restored) candidates of one string; ``sure`` needs no further evidence."""
    if not text or text.isascii():
        return []
    if LOST in text:
        return [("sure", "")]
    fixed = restore_multibyte(text)
    if fixed != text:
        return [("sure", "" if LOST in fixed else fixed)]
    if len(text) > 1 and not _WORDISH.search(text):
        return []
    found = {p for _, (length, _, pages) in automaton().iter(text) for p in pages}
    made = {replace_spans(text, page) for page in LATIN1_AS if page in found}
    return [("open", new) for new in sorted(made - {text}) if _plausible(text, new)]


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms, kinds, restored = [], [], []
        for form in batch.column(0).to_pylist():
            for kind, new in proposals(form):
                forms.append(form)
                kinds.append(kind)
                restored.append(new)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (forms, kinds, restored)], ["form", "kind", "restored"])


def _key(col):
    """Spelling key: lower case, runs of a character squeezed to one."""
    return F.regexp_replace(F.lower(col), r"(.)\1+", "$1")


def garbled_forms(words: DataFrame, column: str = "form") -> DataFrame:
    """(form, restored) of each distinct garbled string of ``words[column]``.

    One pass over the column with map-side combining gives the counts of all
    strings; everything after it works on distinct strings. No cap, no sample.
    """
    counts = words.select(F.col(column).alias("form")).where(F.col("form").isNotNull()).groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    suspects = counts.where(F.col("form").rlike(r"[^\x00-\x7F]")).select("form")
    made = suspects.mapInArrow(_propose, "form string, kind string, restored string")
    known = counts.where(~F.col("form").rlike(r"[0-9@#]")).groupBy(_key(F.col("form")).alias("key")).agg(F.sum("n").alias("n"))
    sure = made.where(F.col("kind") == "sure").select("form", "restored")
    open_ = made.where(F.col("kind") != "sure").withColumn("key", _key(F.col("restored"))).withColumn("own", _key(F.col("form")))
    exact = counts.select(F.col("form").alias("restored"), F.col("n").alias("n_exact"))
    judged = (
        open_.join(known.withColumnRenamed("n", "n_new"), "key", "left")
        .join(known.select(F.col("key").alias("own"), F.col("n").alias("n_own")), "own", "left")
        .join(exact, "restored", "left")
        .fillna(0, ["n_new", "n_own", "n_exact"])
        .where(F.col("n_new") > F.col("n_own"))
    )
    chosen = judged.groupBy("form").agg(F.max_by("restored", F.struct("n_exact", "n_new", "restored")).alias("restored"))
    return sure.unionByName(chosen)


def restore_tokens(words: DataFrame, key: str = "tok_id", column: str = "form") -> DataFrame:
    """(key, restored) of each row of ``words`` whose ``column`` is garbled."""
    garbled = garbled_forms(words, column)
    rows = words.where(F.col(column).rlike(r"[^\x00-\x7F]")).select(F.col(key), F.col(column).alias("form"))
    return rows.join(garbled, "form").select(key, "restored")
