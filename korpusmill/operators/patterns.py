"""Rule engines: map replacement, pattern-to-pattern rules, multi-pattern spans, replacement log.

Rules are parsed on the driver and compiled once per Python worker; rows go through
Arrow-batched functions. The syntax of rule files, the order of conflicting matches and the literal
sweep of spans are fixed by the files that use them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPTIONS = re.compile(r"^##!\s*RE_OPTIONS:\s*(.*)$")
FLAGS = {"re.UNICODE": 0, "re.U": 0, "re.IGNORECASE": re.I, "re.I": re.I, "re.LOCALE": 0, "re.L": 0, "re.MULTILINE": re.M, "re.DOTALL": re.S, "re.VERBOSE": re.X}
LOG = T.ArrayType(T.StructType([T.StructField("offset", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("num", T.IntegerType()), T.StructField("orig", T.StringType()), T.StructField("replacement", T.StringType())]))
RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("log", LOG)])


def strip_comment(line: str) -> str:
    return re.sub(r"(^|\s+)#.*$", "", line, count=1).strip()


def upcase_capitalize(new: str, old: str) -> str:
    """Case of the replaced text carried over."""
    if old[:1].isupper():
        if len(old) > 1 and old.isalpha() and old.isupper() and new.isalpha():
            return new.upper()
        return new[:1].upper() + new[1:]
    return new


def adjust_case(new: str, model: str) -> str:
    if model.islower():
        return new.lower()
    if model.isupper() and len(model) > 1:
        return new.upper()
    if model.istitle():
        return new[:1].upper() + new[1:].lower()
    return new


# --- replacement log ------------------------------------------------------------------------


@dataclass
class ReplacementLog:
    """Ordered log of replacements; numbers advance by two per entry."""

    entries: list[dict] = field(default_factory=list)
    _next: int = 0

    def append(self, offset: int, orig: str, replacement: str) -> None:
        self.entries.append({"offset": offset, "length": len(replacement), "num": self._next, "orig": orig, "replacement": replacement})
        self._next += 2

    def update(self, position: int, delta: int) -> None:
        """Shift the entries behind a position by the change of length there."""
        for entry in self.entries:
            if entry["offset"] > position:
                entry["offset"] += delta


def shift_log(log: Column, position: Column, delta: Column) -> Column:
    """Native counterpart of ``ReplacementLog.update`` on an array of entries."""
    return F.transform(log, lambda e: F.struct(F.when(e["offset"] > position, e["offset"] + delta).otherwise(e["offset"]).alias("offset"), e["length"].alias("length"), e["num"].alias("num"), e["orig"].alias("orig"), e["replacement"].alias("replacement")))


# --- maps -----------------------------------------------------------------------------------


def _unquote(text: str) -> str:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == '"':
        text = text[1:-1]
    return text.replace('\\"', '"')


class MapRules:
    """Plain string replacement in one left-to-right pass, longest source first."""

    def __init__(self, pairs: dict[str, str], ignore_case: bool = False, whole_words: bool = False):
        self.pairs = {k.lower(): v for k, v in pairs.items()} if ignore_case else dict(pairs)
        self.ignore_case, self.whole_words = ignore_case, whole_words

    @classmethod
    def parse(cls, lines: Iterable[str]) -> MapRules:
        """``source -> target`` (tab or arrow), quotes optional, options IGNORECASE and WORDS."""
        pairs, ignore, words = {}, False, False
        for line in lines:
            options = OPTIONS.match(line)
            if options:
                ignore, words = ignore or "IGNORECASE" in options[1], words or "WORDS" in options[1]
                continue
            line = strip_comment(line)
            if line:
                source, target = (re.split(r"\s*-+>\s*|\t+", line, maxsplit=1) + [""])[:2]
                pairs[_unquote(source)] = _unquote(target)
        return cls(pairs, ignore, words)

    @property
    def regex(self) -> re.Pattern:
        body = "|".join(re.escape(k) for k in sorted(self.pairs, key=lambda k: (-len(k), k)))
        return re.compile(rf"\b(?:{body})\b(?!-)" if self.whole_words else f"(?:{body})", re.I if self.ignore_case else 0)

    def reverse(self) -> MapRules:
        if len(set(self.pairs.values())) < len(self.pairs):
            raise ValueError("the map is not one to one")
        return MapRules({v: k for k, v in self.pairs.items()}, self.ignore_case, self.whole_words)

    def replace(self, text: str, log: ReplacementLog | None = None) -> str:
        if not self.pairs:
            return text
        out, at, shift = [], 0, 0
        for match in self.regex.finditer(text):
            old = match.group()
            new = self.pairs[old.lower() if self.ignore_case else old]
            if self.ignore_case:
                new = upcase_capitalize(new, old)
            out += [text[at : match.start()], new]
            if log is not None:
                log.update(match.start() + shift, len(new) - len(old))
            shift += len(new) - len(old)
            at = match.end()
        return "".join([*out, text[at:]])

    def column(self, c: Column) -> Column:
        """Native form for maps of single characters to single characters, else the batched function."""
        if not (self.ignore_case or self.whole_words) and all(len(k) == len(v) == 1 for k, v in self.pairs.items()):
            return F.translate(c, "".join(self.pairs), "".join(self.pairs.values()))
        rules = self

        @F.pandas_udf(T.StringType())
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda t: None if t is None else rules.replace(t))

        return run(c)


# --- pattern-to-pattern rules ------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern
    templates: tuple[str, ...]


@dataclass(frozen=True)
class Found:
    """A match with the spans of its capturing groups and its place in the conflict order."""

    rule: int
    match: re.Match
    spans: tuple[tuple[int, int], ...]

    @property
    def rank(self):
        used = [s for s in self.spans if s[0] >= 0]
        first, last = min(s[0] for s in used), max(s[1] for s in used)
        return (first, -last, self.match.start(), -self.match.end(), -sum(b - a for a, b in used), -len(used), self.rule)


def disjoint(a: Iterable[tuple[int, int]], b: Iterable[tuple[int, int]]) -> bool:
    """Whether no group of one match overlaps a group of the other."""
    return all(e1 <= s2 or e2 <= s1 for s1, e1 in a if s1 >= 0 for s2, e2 in b if s2 >= 0)


class PatternRules:
    """Rules ``regex --> "template";; ...``: one template per capturing group.

    All matches of all rules compete; in the order of ``Found.rank`` a match is accepted if
    its groups are disjoint from the accepted ones. Templates may use ``\\1``; code is refused.
    Groups written ``(?d...)`` must capture a word of the dictionary.
    """

    def __init__(self, rules: list[tuple[str, list[str], int]], dictionary: frozenset[str] = frozenset()):
        self.dictionary = dictionary
        self.rules, self.checked = [], []
        for source, templates, flags in rules:
            groups = [m.start() for m in re.finditer(r"(?<!\\)\((?!\?)|\(\?d", source)]
            self.checked.append(frozenset(i + 1 for i, at in enumerate(groups) if source.startswith("(?d", at)))
            pattern = re.compile(source.replace("(?d", "("), flags)
            if len(templates) != pattern.groups:
                raise ValueError(f"{pattern.groups} groups but {len(templates)} replacements: {source}")
            self.rules.append(Rule(pattern, tuple(templates)))

    @classmethod
    def parse(cls, lines: Iterable[str], dictionary: frozenset[str] = frozenset()) -> PatternRules:
        rules, flags = [], 0
        for line in lines:
            options = OPTIONS.match(line)
            if options:
                flags = 0
                for name in re.split(r"[|\s]+", options[1]):
                    flags |= FLAGS.get(name, 0)
                continue
            line = strip_comment(line) if line.lstrip().startswith("#") else line.strip()
            if not line:
                continue
            source, _, rest = line.partition(" --> ")
            templates = [t.strip() for t in rest.split(";;") if t.strip()]
            if not all(len(t) > 1 and t[0] == t[-1] == '"' for t in templates):
                raise ValueError(f"only quoted templates are allowed: {rest}")
            rules.append((source.strip(), [t[1:-1].replace('\\"', '"') for t in templates], flags))
        return cls(rules, dictionary)

    def matches(self, text: str) -> list[Found]:
        pool = []
        for number, rule in enumerate(self.rules):
            for match in rule.pattern.finditer(text):
                spans = tuple(match.span(g + 1) for g in range(rule.pattern.groups))
                if not any(s[0] >= 0 for s in spans):
                    continue
                if any(match.group(g) is not None and match.group(g).lower() not in self.dictionary for g in self.checked[number]):
                    continue
                pool.append(Found(number, match, spans))
        kept: list[Found] = []
        for found in sorted(pool, key=lambda f: f.rank):
            if all(disjoint(found.spans, k.spans) for k in kept if max(s[1] for s in k.spans) > min(s[0] for s in found.spans if s[0] >= 0)):
                kept.append(found)
        return kept

    def sub(self, text: str, log: ReplacementLog | None = None) -> str:
        edits = sorted((span, f.match.expand(self.rules[f.rule].templates[g])) for f in self.matches(text) for g, span in enumerate(f.spans) if span[0] >= 0)
        out, size, at = [], 0, 0
        for (start, end), new in edits:
            old = text[start:end]
            new = upcase_capitalize(new, old)
            out += [text[at:start], new]
            size += start - at
            if log is not None and new != old:
                log.append(size, old, new)
            size += len(new)
            at = end
        return "".join([*out, text[at:]])

    def column(self, c: Column) -> Column:
        """Struct of the new text and the log of replacements, per Arrow batch."""
        rules = self

        @F.pandas_udf(RESULT)
        def run(s: pd.Series) -> pd.DataFrame:
            texts, logs = [], []
            for t in s:
                log = ReplacementLog()
                texts.append(None if t is None else rules.sub(t, log))
                logs.append(log.entries)
            return pd.DataFrame({"text": texts, "log": logs})

        return run(c)


# --- spans of many patterns -----------------------------------------------------------------------


class MultiPattern:
    """Several blocks of patterns; a span is the first non-empty group of a match."""

    def __init__(self, blocks: list[tuple[list[str], int]]):
        self.blocks = [re.compile("|".join(patterns), flags) for patterns, flags in blocks if patterns]

    @classmethod
    def parse(cls, lines: Iterable[str]) -> MultiPattern:
        blocks: list[tuple[list[str], int]] = [([], 0)]
        for line in lines:
            options = OPTIONS.match(line)
            if options:
                flags = 0
                for name in re.split(r"[|\s]+", options[1]):
                    flags |= FLAGS.get(name, 0)
                blocks.append(([], flags))
                continue
            line = line.strip()
            if line and not line.startswith("#"):
                blocks[-1][0].append(line)
        return cls(blocks)

    def spans(self, text: str) -> list[tuple[int, int]]:
        out = []
        for block in self.blocks:
            for match in block.finditer(text):
                groups = [match.span(g + 1) for g in range(block.groups)]
                out.append(next((s for s in groups if s[0] >= 0), match.span()))
        return sorted(out)


def leftmost_longest(spans: list[tuple[int, int]], literal: bool = False) -> list[tuple[int, int]]:
    """Non-overlapping spans, earlier ones first and the longest of equal starts.

    ``literal`` follows the known sweep from the right instead: of equal starts the shortest
    stays, and a chain of overlaps yields only its first span.
    """
    if not literal:
        kept: list[tuple[int, int]] = []
        for start, end in sorted(spans, key=lambda s: (s[0], -s[1])):
            if not kept or start >= kept[-1][1]:
                kept.append((start, end))
        return kept
    kept, held = [], None
    for span in sorted(spans, reverse=True):
        if held is not None and span[1] <= held[0]:
            kept.append(held)
        held = span
    return ([held] if held is not None else []) + kept[::-1]


def not_starting_inside(first: list[tuple[int, int]], second: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of ``first`` whose start lies in no [start, end] of ``second``."""
    return [s for s in first if not any(a <= s[0] <= b for a, b in second)]


def not_starting_inside_column(first: Column, second: Column) -> Column:
    """Native form on arrays of (start, end) structs."""
    return F.filter(first, lambda s: ~F.exists(second, lambda k: (s["start"] >= k["start"]) & (s["start"] <= k["end"])))


def apply_text(df: DataFrame, column: str, f: Callable[[str], str], name: str | None = None) -> DataFrame:
    """A text function per Arrow batch; null stays null."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else f(t))

    return df.withColumn(name or column, run(F.col(column)))
