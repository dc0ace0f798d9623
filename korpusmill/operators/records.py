"""Problem 2: token lines that fail to parse.

A recursive-descent parser reads ``record := field (TAB field)* END`` with quoted and
plain fields. Good lines become typed token records. A bad line is reported with the
first reason that holds and the place of the error; after a broken quote the parser
resumes at the next validated record start (an index, a tab and a full set of fields)
and returns what it recovers there as well.

Defined results: null lines, blank lines and metadata lines (ESC) are no records; lines
of any length are parsed whole; equal lines are judged alike; an integer beyond 64 bits is valid and
is kept as digits in ``too_large`` under the name of its column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("idx", "form", "lemma", "plemma", "pos", "ppos", "feat", "pfeat", "head", "phead", "deprel", "pdeprel", "fillpred", "pred")
INTEGERS = ("idx", "head", "phead")
ESC = "\x1b"
#: A closed vocabulary of tags must stay this small to be sent to the executors.
MAX_TAGS = 10_000

_DIGITS = re.compile(r"[0-9]+\Z")
_ANCHOR = re.compile(r"(?:(?<=[\n\t ])|(?<=_))([0-9]+)\t")


class Broken(Exception):
    """A quoted field that is not closed as it must be."""

    def __init__(self, at: int, field: int):
        self.at, self.field = at, field


@dataclass(frozen=True)
class Grammar:
    """Parser and checks for one tagset."""

    pos_tags: frozenset[str]
    deprel_tags: frozenset[str]

    def quoted(self, text: str, at: int, number: int) -> tuple[str, int]:
        """``"`` (character | ``""``)* ``"`` followed by a tab or the end."""
        out, i = [], at + 1
        while True:
            j = text.find('"', i)
            if j < 0:
                raise Broken(at, number)
            out.append(text[i:j])
            if text.startswith('""', j):
                out.append('"')
                i = j + 2
                continue
            if j + 1 == len(text) or text[j + 1] == "\t":
                return "".join(out), j + 1
            raise Broken(at, number)

    def field(self, text: str, at: int, number: int) -> tuple[str, int]:
        if text.startswith('"', at):
            return self.quoted(text, at, number)
        end = text.find("\t", at)
        return (text[at:], len(text)) if end < 0 else (text[at:end], end)

    def record(self, text: str, at: int = 0) -> list[str]:
        """All fields of a line; the line ends the record."""
        if '"' not in text:
            return text[at:].split("\t")
        fields = []
        while True:
            value, at = self.field(text, at, len(fields) + 1)
            fields.append(value)
            if at >= len(text):
                return fields
            at += 1

    def bad_value(self, fields: list[str]) -> int:
        """Number of the first field with an invalid value, 0 if all are valid."""
        if not (_DIGITS.match(fields[0]) and fields[0].strip("0")):
            return 1
        if not fields[1].strip():
            return 2
        for i, tags in ((4, self.pos_tags), (5, self.pos_tags)):
            if fields[i] != "_" and fields[i] not in tags:
                return i + 1
        for i in (8, 9):
            if fields[i] != "-1" and not _DIGITS.match(fields[i]):
                return i + 1
        for i in (10, 11):
            if fields[i] != "_" and fields[i] not in self.deprel_tags:
                return i + 1
        return 0

    def recovered(self, text: str, at: int) -> tuple[int, list[str]] | None:
        """The next validated record start after ``at`` and its fields."""
        for match in _ANCHOR.finditer(text, at + 1):
            try:
                fields = self.record(text, match.start(1))
            except Broken:
                continue
            if len(fields) == len(COLUMNS) and not self.bad_value(fields):
                return match.start(1), fields
        return None

    def line(self, raw: str) -> dict | None:
        """Verdict on a raw line: None for blank and metadata lines."""
        text = raw.rstrip("\r ")
        if not text or text.startswith(ESC):
            return None
        try:
            fields = self.record(text)
        except Broken as error:
            again = self.recovered(text, error.at)
            return {"reason": "quoting", "field_no": error.field, "char_pos": error.at + 1, "resumed_at": again and again[0] + 1, "fields": again and again[1]}
        if len(fields) != len(COLUMNS):
            return {"reason": "columns", "field_no": len(fields), "char_pos": len(text), "resumed_at": None, "fields": None}
        bad = self.bad_value(fields)
        if bad:
            return {"reason": "value", "field_no": bad, "char_pos": None, "resumed_at": None, "fields": None}
        return {"reason": None, "field_no": None, "char_pos": None, "resumed_at": None, "fields": fields}


_BIG = 2**63 - 1


def _typed(fields: list[str]) -> dict:
    """Fields by name, integers as such; those beyond 64 bits by name in ``too_large``."""
    row = dict(zip(COLUMNS, fields))
    large = {}
    for name in INTEGERS:
        number = int(row[name]) if len(row[name].lstrip("0")) < 20 else _BIG + 1
        if number > _BIG:
            large[name] = row[name]
        row[name] = number if number <= _BIG else None
    return row | {"too_large": list(large.items()) or None}


SCHEMA = pa.schema(
    [("line_id", pa.int64()), ("file_name", pa.string()), ("line_no", pa.int32()), ("reason", pa.string()), ("field_no", pa.int32()), ("char_pos", pa.int32()), ("resumed_at", pa.int32())]
    + [(c, pa.int64() if c in INTEGERS else pa.string()) for c in COLUMNS]
    + [("too_large", pa.map_(pa.string(), pa.string()))]
)
DDL = "line_id bigint, file_name string, line_no int, reason string, field_no int, char_pos int, resumed_at int, " + ", ".join(f"{c} {'bigint' if c in INTEGERS else 'string'}" for c in COLUMNS) + ", too_large map<string,string>"
_NOTHING = dict.fromkeys([*COLUMNS, "too_large"])


def _parse(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for line_id, file_name, line_no, text in zip(*(c.to_pylist() for c in batch.columns)):
                verdict = grammar.line(text)
                if verdict is None:
                    continue
                fields = verdict.pop("fields")
                out.append({"line_id": line_id, "file_name": file_name, "line_no": line_no} | verdict | (_typed(fields) if fields else _NOTHING))
            yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    return run


def grammar_of(tagset: DataFrame) -> Grammar:
    """The grammar's closed vocabularies; refuses a table that is no closed vocabulary."""
    rows = tagset.where(F.col("tag").isNotNull()).select("tag_kind", "tag").distinct().limit(MAX_TAGS + 1).collect()
    if len(rows) > MAX_TAGS:
        raise ValueError(f"more than {MAX_TAGS} tags")
    of = lambda kind: frozenset(r["tag"] for r in rows if r["tag_kind"] == kind)
    return Grammar(of("pos"), of("deprel"))


def parse_lines(lines: DataFrame, tagset: DataFrame) -> DataFrame:
    """One row per token line: typed fields, or ``reason`` with the place of the error.

    A line with reason ``quoting`` may still carry the fields of the record that was
    recovered at ``resumed_at``.
    """
    rows = lines.where(F.col("line_text").isNotNull()).select(F.col("line_id").cast("bigint"), "file_name", F.col("line_no").cast("int"), "line_text")
    return rows.mapInArrow(_parse(grammar_of(tagset)), DDL)


def good_records(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).drop("reason", "field_no", "char_pos", "resumed_at")


def recovered_records(parsed: DataFrame) -> DataFrame:
    """Records found behind a broken quote, at the place where the parser resumed."""
    return parsed.where(F.col("reason").isNotNull() & F.col("resumed_at").isNotNull()).drop("reason", "field_no", "char_pos")


def bad_lines(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select("line_id", "reason")
