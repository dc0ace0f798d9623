"""Problem 3: several values packed in one field.

The separators of a source (a file of a table) are inferred. The shape of every field is
counted per source; a candidate separator is scored on the pieces that it alone makes:

* *regularity*: the share of pieces whose type is a type that whole fields of the source
  have (a separator that belongs to the values, as the comma of ``3,5``, leaves pieces
  that never stand as a value of their own); where few fields are without the candidate,
  the share of fields whose pieces all have the most frequent type takes its place;
* *consistency*: the share of its rows with the most frequent number of pieces.

Both are drawn towards the whole table by a fixed number of pseudo-rows, so that rare
candidates and small sources need no rule of their own. Fields are then split at the accepted
separators outside quotes and exploded with the position kept. Everything is built-in
expressions; values of a field never leave the JVM.

Defined results: null, empty, ``_`` and ``empty`` fields hold no value; empty values take
no position; a quote that is not closed is an ordinary character; in a span a range
stands for each of its words; pieces of a span that are no word stay as they are; a
separator that is not accepted stays in the values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpusmill.session import checkpoint

#: Candidate separators.
CANDIDATES = ("|", ";", ",", "/", "\t", " ")
#: Score from which on a candidate is accepted, and what regularity and consistency count in it.
LEAST_SCORE, WEIGHTS = 0.6, (0.75, 0.25)
#: Share of a source's fields that makes a shape a type of its values.
LEAST_TYPE = 0.002
#: Pseudo-rows with which the whole table takes part in the judgement on a source.
PRIOR_ROWS = 50
#: Pseudo-rows with which fields of one type of piece count beside the fields without a candidate.
FEW_FREE = 10
#: Rows of (source, separators) that are broadcast; beyond it the planner joins by shuffles.
MOST_BROADCAST = 200_000
QUOTED = r'"(?:[^"]|"")*"'
_QUOTE, _WORD = "\u0002", "\u0003"


def _class(seps: str) -> str:
    return "".join("\\" + c if c in "|/" else c for c in seps)


def holds_values(col: Column) -> Column:
    return col.isNotNull() & ~F.trim(col).isin("", "_", "empty")


def field_shape(value: Column) -> Column:
    """Shape of a field: quoted values, words of a span, words and numbers become one character each."""
    shape = F.regexp_replace(tight_ranges(F.trim(value)), QUOTED, _QUOTE)
    shape = F.regexp_replace(shape, r"(?:word_)?\d+\.\.(?:word_)?\d+|word_\d+", _WORD)
    shape = F.regexp_replace(shape, r"[\d._*-]*[\p{L}][\p{L}\d._*-]*(?:=[\p{L}\d._*-]+)?", "a")
    shape = F.regexp_replace(shape, r"\d[\d.]*", "9")
    return F.regexp_replace(shape, r" *([|;,/\t]) *", "$1")


def _common_types(shapes: DataFrame) -> DataFrame:
    """(src_table, common): shapes of at least LEAST_TYPE of a table's fields, at most 1 / LEAST_TYPE of them, with their share."""
    by_table = shapes.groupBy("src_table", "shape").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("src_table"))
    return by_table.withColumn("share", share).where(F.col("share") >= LEAST_TYPE).groupBy("src_table").agg(F.collect_list(F.struct("shape", "share")).alias("common"))


def separator_scores(fields: DataFrame) -> DataFrame:
    """(src_table, source, sep, n_rows, consistency, regularity, score, accepted) of each candidate that occurs.

    ``fields`` has src_table, source, value. Shapes are counted on the map side, so that a
    hot source shrinks before it is shuffled; the counted shapes are placed by source once.
    """
    source = ["src_table", "source"]
    held = fields.where(holds_values(F.col("value"))).select(*source, field_shape(F.col("value")).alias("shape"))
    shapes = checkpoint(held.groupBy(*source, "shape").agg(F.count(F.lit(1)).alias("n")).repartition(*source))
    counted = shapes.withColumn("n_fields", F.sum("n").over(W.partitionBy(*source)))
    own = counted.groupBy(*source).agg(F.max("n_fields").alias("n_fields"), F.collect_set(F.when(F.col("n") >= F.col("n_fields") * LEAST_TYPE, F.col("shape"))).alias("types"))
    lent = F.filter("common", lambda x: x["share"] * PRIOR_ROWS >= (F.col("n_fields") + PRIOR_ROWS) * LEAST_TYPE)
    known = own.join(F.broadcast(_common_types(shapes)), "src_table").select(*source, "n_fields", F.array_union("types", F.transform(lent, lambda x: x["shape"])).alias("types"))  # one row per table
    seps = F.filter(F.array(*[F.lit(c) for c in CANDIDATES]), lambda c: F.instr(F.col("shape"), c) > 0)
    rows = shapes.join(known.hint("merge"), source).select(*source, "n", "shape", "n_fields", "types", F.explode(seps).alias("sep"))
    pieces = rows.withColumn("pieces", F.filter(F.split(F.col("shape"), F.concat(F.lit("\\Q"), F.col("sep"), F.lit("\\E"))), lambda x: x != ""))
    plain = F.array_distinct(F.filter("pieces", lambda x: x != _QUOTE))
    is_type = lambda x: (x == _QUOTE) | (x == "") | F.array_contains(F.col("types"), x)
    # a piece that holds further candidates is judged by what all of them leave
    of_type = F.size(F.filter("pieces", lambda x: is_type(x) | F.forall(F.split(x, "[" + _class("".join(CANDIDATES)) + "]"), is_type)))
    alike = F.when(F.size(plain) == 1, plain[0]).when(F.size(plain) == 0, _QUOTE)
    one = pieces.select(*source, "sep", "n", "n_fields", F.size("pieces").alias("k"), alike.alias("alike"), (F.col("n") * of_type).alias("of_type"))
    by_count = one.groupBy(*source, "sep", "k").agg(F.sum("n").alias("n"), F.sum("of_type").alias("of_type"), F.max("n_fields").alias("n_fields"))
    counts = by_count.groupBy(*source, "sep").agg(F.sum("n").alias("n_rows"), F.max("n").alias("top"), F.sum(F.col("n") * F.col("k")).alias("all"), F.sum("of_type").alias("of_type"), F.max("n_fields").alias("n_fields"))
    by_type = one.groupBy(*source, "sep", "alike").agg(F.sum("n").alias("n"))
    quoted = F.col("alike") == _QUOTE
    most = lambda cond: F.coalesce(F.max(F.when(cond, F.col("n"))), F.lit(0))
    same = by_type.groupBy(*source, "sep").agg((most(~quoted) + most(quoted)).alias("same"))
    # fields without the candidate show the types; the fewer there are, the more counts how many fields have pieces of one type only
    free = F.col("n_fields") - F.col("n_rows")
    share = (free * F.col("of_type") / F.greatest("all", F.lit(1)) + FEW_FREE * F.col("same") / F.col("n_rows")) / (free + FEW_FREE)
    measured = counts.join(same.hint("merge"), [*source, "sep"]).select(*source, "sep", "n_rows", "top", "all", (share * F.col("all")).alias("good"))
    table = W.partitionBy("src_table", "sep")
    over = lambda a, b: F.sum(a).over(table) / F.sum(b).over(table)
    regularity = (F.col("good") + PRIOR_ROWS * over("good", "all")) / (F.col("all") + PRIOR_ROWS)
    consistency = (F.col("top") + PRIOR_ROWS * over("top", "n_rows")) / (F.col("n_rows") + PRIOR_ROWS)
    scored = measured.select(*source, "sep", "n_rows", F.round(consistency, 6).alias("consistency"), F.round(regularity, 6).alias("regularity"))
    score = F.round(WEIGHTS[0] * F.col("regularity") + WEIGHTS[1] * F.col("consistency"), 6)
    return scored.withColumn("score", score).withColumn("accepted", score >= LEAST_SCORE)


def inferred_separators(fields: DataFrame) -> DataFrame:
    """(src_table, source, seps): the accepted separators of each source as one string."""
    accepted = separator_scores(fields).where("accepted")
    return accepted.groupBy("src_table", "source").agg(F.array_join(F.array_sort(F.collect_set("sep")), "").alias("seps"))


def with_separators(fields: DataFrame) -> DataFrame:
    """``fields`` (src_table, source, value, ...) with the inferred ``seps`` of their source."""
    seps = checkpoint(inferred_separators(fields))
    if seps.count() <= MOST_BROADCAST:
        seps = F.broadcast(seps)
    return fields.join(seps, ["src_table", "source"], "left").withColumn("seps", F.coalesce("seps", F.lit("")))


def pieces_of(value: Column, seps: Column) -> Column:
    """Array of unquoted, non-empty pieces of a field split at the characters of ``seps``."""
    inner = F.regexp_replace(seps, r"([|/\\\]\[^-])", r"\\$1")
    quoted = " *" + QUOTED  # blanks before a quote are padding even where a blank separates nothing
    pattern = F.concat(F.lit(quoted + '|"[^'), inner, F.lit(']*|[^"'), inner, F.lit("][^"), inner, F.lit("]*"))
    raw = F.regexp_extract_all(value, F.when(seps == "", F.lit(quoted + '|[^"].*')).otherwise(pattern), F.lit(0))

    def bare(x: Column) -> Column:
        t = F.trim(x)
        quoted = t.startswith('"') & t.endswith('"') & (F.length(t) >= 2)
        return F.when(quoted, F.trim(F.replace(t.substr(F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"')))).otherwise(t)

    return F.filter(F.transform(raw, bare), lambda x: x != "")


def span_words(pieces: Column) -> Column:
    """Words of a span: ranges are written out, numbers as ``word_<number>``."""

    def expand(p: Column) -> Column:
        low = F.regexp_extract(p, r"^(?:word_)?(\d+)\.\.(?:word_)?(\d+)$", 1).try_cast("int")
        high = F.regexp_extract(p, r"^(?:word_)?(\d+)\.\.(?:word_)?(\d+)$", 2).try_cast("int")
        one = F.regexp_extract(p, r"^word_(\d+)$", 1).try_cast("int")
        return (
            F.when(low.isNotNull() & high.isNotNull(), F.transform(F.sequence(low, high), lambda n: F.concat(F.lit("word_"), n.cast("string"))))
            .when(one.isNotNull(), F.array(F.concat(F.lit("word_"), one.cast("string"))))
            .otherwise(F.array(p))
        )

    return F.flatten(F.transform(pieces, expand))


def tight_ranges(value: Column) -> Column:
    """Ranges of a span written without blanks and with two dots."""
    return F.regexp_replace(value, r"\s*\.{2,}\s*", "..")


def span_numbers(value: Column, seps: Column | None = None) -> Column:
    """Array of word numbers of a span; without separators all candidates separate."""
    pieces = pieces_of(tight_ranges(value), seps if seps is not None else F.lit("".join(sorted(CANDIDATES))))
    word = r"^(?:word_)?(\d+)(?:\.\.(?:word_)?(\d+))?$"
    parts = F.transform(pieces, lambda p: F.struct(F.regexp_extract(p, word, 1).alias("a"), F.regexp_extract(p, word, 2).alias("b"), p.startswith("word_").alias("w")))
    ends = F.transform(parts, lambda x: F.struct(x["a"].try_cast("int").alias("a"), F.when(x["b"] != "", x["b"].try_cast("int")).when(x["w"], x["a"].try_cast("int")).alias("b")))
    numbers = F.flatten(F.transform(F.filter(ends, lambda x: x["a"].isNotNull() & x["b"].isNotNull()), lambda x: F.sequence(x["a"], x["b"])))
    return F.when(holds_values(value), numbers)


def span_fields(markables: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of the rows with a span, its ``source`` and ``numbers``: its word numbers by the separators of its file."""
    fields = markables.where(holds_values(F.col("span"))).select(*columns, F.lit("markables").alias("src_table"), F.coalesce("file_name", F.lit("")).alias("source"), F.col("span").alias("value"))
    rows = with_separators(fields)
    return rows.select(*columns, span_numbers(F.col("value"), F.col("seps")).alias("numbers"))


def split_packed(fields: DataFrame, span_tables: tuple[str, ...] = ("markables",)) -> DataFrame:
    """(src_table, row_key, item_pos, item_value) of ``fields`` (src_table, source, row_key, value)."""
    rows = with_separators(fields.where(holds_values(F.col("value"))))
    is_span = F.col("src_table").isin(*span_tables)
    pieces = pieces_of(F.when(is_span, tight_ranges(F.col("value"))).otherwise(F.col("value")), F.col("seps"))
    items = F.when(is_span, span_words(pieces)).otherwise(pieces)
    return rows.select("src_table", "row_key", F.posexplode(items).alias("p", "item_value")).select("src_table", "row_key", (F.col("p") + 1).alias("item_pos"), "item_value")


def packed_fields(words: DataFrame, markables: DataFrame) -> DataFrame:
    """The packed fields of both tables in one shape; null sources count as one source."""
    a = words.select(F.lit("conll_words").alias("src_table"), F.coalesce("file_name", F.lit("")).alias("source"), F.col("tok_id").alias("row_key"), F.col("feat").alias("value"))
    b = markables.select(F.lit("markables").alias("src_table"), F.coalesce("file_name", F.lit("")).alias("source"), F.col("mk_key").alias("row_key"), F.col("span").alias("value"))
    return a.unionByName(b)
