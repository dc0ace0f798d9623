"""Problem 4: one consistent spelling for text that looks the same.

The rules run as one embedded DuckDB statement over Arrow batches inside the Spark
partitions: invisible characters are removed (a joiner between emoji stays), odd
blanks become plain ones and are trimmed, full-width letters and digits get ordinary
width, look-alike letters move to the script that most letters of the string belong
to, and accents are composed. Only strings that hold a character outside the
plainly canonical set reach DuckDB; for the others the rules cannot change anything.

Defined results: null stays null and yields no row; an empty string is canonical; a
string of blanks or invisible characters only becomes the empty string; a tie between
scripts goes to Latin; words wholly in one script keep
it; if letters have no look-alike in the script of the majority, the script that all letters
can have is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusmill.llm.mojibake import garbled_forms

#: Strings made of these characters only are canonical already (Java regular expression class).
CANONICAL = r"\A[\x21-\x7EÀ-ÖØ-öø-ÿŒœ“„–]*\z"

#: Look-alike letters: Latin, Cyrillic and Greek columns; a blank means that the script has none.
LOOK_ALIKES = """
A А Α
B В Β
C С
E Е Ε
H Н Η
I І Ι
J Ј
K К Κ
M М Μ
N . Ν
O О Ο
P Р Ρ
S Ѕ
T Т Τ
X Х Χ
Y У Υ
Z . Ζ
a а α
c с
d ԁ
e е
g .
h һ
i і ι
j ј
k . κ
o о ο
p р ρ
q ԛ
s ѕ
u . υ
v ѵ ν
w ԝ
x х χ
y у
è ѐ
ë ё
ï ї
È Ѐ
Ë Ё
Ï Ї
"""

#: Invisible characters and blanks as RE2 classes; the joiner U+200D and the selector U+FE0F are treated apart.
INVISIBLE = r"\x{AD}\x{34F}\x{61C}\x{180B}-\x{180E}\x{200B}\x{200C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FE00}-\x{FE0E}\x{FEFF}\x{FFF9}-\x{FFFB}"
BLANKS = r"\t\n\v\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def look_alike_tables() -> dict[str, tuple[str, str]]:
    """For each target script (L, C, G) the letters to replace and their replacements."""
    rows = [[x if x != "." else "" for x in (line.split() + [".", "."])[:3]] for line in LOOK_ALIKES.strip().splitlines()]
    out = {}
    for target, name in enumerate("LCG"):
        pairs = {row[other]: row[target] for row in rows for other in range(3) if other != target and row[other] and row[target]}
        out[name] = ("".join(pairs), "".join(pairs.values()))
    return out


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canon_sql(source: str = "batch", value: str = "value") -> str:
    """The embedded statement: ``source`` with a column ``canon`` added."""
    wide = "".join(chr(0xFEE0 + ord(c)) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    plain = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    joiner, escape, kept, mark = "‍", "\U000f0000", "\U000f0001", "\U000f0002"
    # marks that a text holds itself are written with an escape mark while the statement uses them
    written = [(escape, escape + "\U000f0004"), (kept, escape + "\U000f0005"), (mark, escape + "\U000f0006")]
    escaped, unescaped = value, "canon"
    for a, b in written:
        escaped = f"replace({escaped}, {_quote(a)}, {_quote(b)})"
    for a, b in reversed(written):
        unescaped = f"replace({unescaped}, {_quote(b)}, {_quote(a)})"
    emoji = r"[\p{So}\x{1F3FB}-\x{1F3FF}\x{FE0F}\x{2640}\x{2642}]"
    to = {k: (_quote(a), _quote(b)) for k, (a, b) in look_alike_tables().items()}
    return rf"""
    WITH bare AS (
      SELECT *, regexp_replace({escaped}, '[{INVISIBLE}]', '', 'g') AS s0 FROM {source}
    ), joined AS (
      SELECT *, regexp_replace(regexp_replace(s0, '({emoji}){joiner}({emoji})', '\1{kept}\2', 'g'), '({emoji}){joiner}({emoji})', '\1{kept}\2', 'g') AS s1 FROM bare
    ), stripped AS (
      SELECT * EXCLUDE (s0, s1), replace(replace(regexp_replace(replace(regexp_replace(s1, '([\p{{So}}#*0-9])\x{{FE0F}}', '\1{mark}', 'g'), {_quote(joiner)}, ''), '\x{{FE0F}}', '', 'g'),
        '{kept}', {_quote(joiner)}), '{mark}', chr(65039)) AS s2 FROM joined
    ), spaced AS (
      SELECT * EXCLUDE (s2), translate(trim(regexp_replace(s2, '[{BLANKS}]', ' ', 'g'), ' '), {_quote(wide)}, {_quote(plain)}) AS s3 FROM stripped
    ), counted AS (
      SELECT *, length(regexp_replace(s3, '[^\p{{Latin}}]', '', 'g')) AS n_l, length(regexp_replace(s3, '[^\p{{Cyrillic}}]', '', 'g')) AS n_c,
        length(regexp_replace(s3, '[^\p{{Greek}}]', '', 'g')) AS n_g, translate(s3, {to["L"][0]}, {to["L"][1]}) AS t_l, translate(s3, {to["C"][0]}, {to["C"][1]}) AS t_c,
        translate(s3, {to["G"][0]}, {to["G"][1]}) AS t_g FROM spaced
    ), pure AS (
      SELECT *, NOT regexp_matches(t_l, '[\p{{Cyrillic}}\p{{Greek}}]') AS p_l, NOT regexp_matches(t_c, '[\p{{Latin}}\p{{Greek}}]') AS p_c,
        NOT regexp_matches(t_g, '[\p{{Latin}}\p{{Cyrillic}}]') AS p_g, n_l >= n_c AND n_l >= n_g AS m_l, n_c >= n_g AS m_c FROM counted
    )
    SELECT * EXCLUDE (canon), {unescaped} AS canon FROM (SELECT * EXCLUDE (s3, n_l, n_c, n_g, t_l, t_c, t_g, p_l, p_c, p_g, m_l, m_c), nfc_normalize(CASE
      WHEN (n_l > 0)::INT + (n_c > 0)::INT + (n_g > 0)::INT < 2 THEN s3
      WHEN m_l AND p_l THEN t_l WHEN NOT m_l AND m_c AND p_c THEN t_c WHEN NOT m_l AND NOT m_c AND p_g THEN t_g
      WHEN p_l THEN t_l WHEN p_c THEN t_c WHEN p_g THEN t_g WHEN m_l THEN t_l WHEN m_c THEN t_c ELSE t_g END) AS canon
    FROM pure)"""


@lru_cache(maxsize=1)
def _duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("SET memory_limit = '300MB'")
    con.execute("SET preserve_insertion_order = true")
    return con


def canon_batches(columns: list[str]):
    """A ``mapInArrow`` function: rows whose ``value`` differs from its canonical spelling."""
    keep = ", ".join(columns)
    sql = f"SELECT {keep}, canon FROM ({canon_sql()}) WHERE canon <> value"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        for record in batches:
            batch = pa.Table.from_batches([record])
            con.register("batch", batch)
            done = con.sql(sql).to_arrow_table()
            con.unregister("batch")
            yield from done.to_batches()

    return run


def canonical_spelling(words: DataFrame, fields: tuple[str, ...] = ("form", "lemma"), key: str = "tok_id") -> DataFrame:
    """(key, field_name, form, canon) of each field that differs from its canonical spelling."""
    odd = [F.col(f).isNotNull() & ~F.col(f).rlike(CANONICAL) for f in fields]
    some = odd[0]
    for cond in odd[1:]:
        some = some | cond
    pairs = F.filter(F.array(*[F.when(c, F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value"))) for f, c in zip(fields, odd)]), lambda x: x.isNotNull())
    rows = words.where(some).select(F.col(key), F.col(fields[0]).alias("form"), F.explode(pairs).alias("x")).select(key, "form", "x.field_name", "x.value")
    kind = words.schema[key].dataType.simpleString()
    return rows.mapInArrow(canon_batches([key, "form", "field_name"]), f"{key} {kind}, form string, field_name string, canon string")


def canonical_tokens(words: DataFrame) -> DataFrame:
    """As ``canonical_spelling`` without the tokens that problem 6 restores."""
    found = canonical_spelling(words)
    return found.join(garbled_forms(words).select("form"), "form", "left_anti").select("tok_id", "field_name", "canon")
