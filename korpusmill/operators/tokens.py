"""Token tables: positions, offsets, CoNLL columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusmill.functions.text import TOKEN_PATTERN, blank_tokens

EOS = "<sentence />"


def token_table(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, pos, token, start, len) of the plain tokenizer: split at single blanks.

    The start of a token is one past the end of the token before it: a running sum folded
    inside the row, so no shuffle is needed.
    """
    tokens = blank_tokens(F.col(column))
    starts = F.aggregate(tokens, F.array(F.lit(0).cast("bigint")), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(t) + 1)))
    rows = docs.where(F.col(column).isNotNull()).select(key, F.posexplode(F.arrays_zip(tokens.alias("token"), F.slice(starts, F.lit(1), F.size(tokens)).alias("start"))).alias("pos", "t"))
    return rows.select(key, "pos", "t.token", "t.start", F.length("t.token").alias("len"))


def pattern_tokens(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, pos, token) by the token pattern."""
    return docs.where(F.col(column).isNotNull()).select(key, F.posexplode(F.regexp_extract_all(F.col(column), F.lit(TOKEN_PATTERN), F.lit(0))).alias("pos", "token"))


def tagged_to_conll(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_id, idx, form, lemma, tag) to the 14 columns; what is unknown is ``_``."""
    blank = F.lit("_")
    return tokens.select(
        "doc_id", "sent_id", "idx", "form", F.coalesce("lemma", blank).alias("lemma"), F.coalesce("lemma", blank).alias("plemma"), F.coalesce("tag", blank).alias("pos"), F.coalesce("tag", blank).alias("ppos"),
        *[blank.alias(c) for c in ("feat", "pfeat")], F.lit(-1).alias("head"), F.lit(-1).alias("phead"), *[blank.alias(c) for c in ("deprel", "pdeprel", "fillpred", "pred")],
    )
