"""Scalar text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that both the JVM and other engines mean by it.
SPACE = r"[ \t\n\r\f]"
#: Punctuation marks of ASCII.
PUNCT = r"\p{Punct}"
#: A whole string of tags.
XML_TAGS = r"^(?:\s*<(?:[^<>]|\\<|\\>)+>)+\s*$"
#: Strings whose repetitions are legal: handles, Roman numerals, numbers.
LEGAL_REPETITION = r'^(?:"?@.+|[VILXCD]+|[$\d.,]+)\.?$'
#: Reading of the message time stamp without the week day.
TIME_FORMAT = "MMM dd HH:mm:ss Z yyyy"
#: Single characters of the character normaliser and their plain forms (fixed values).
PLAIN_CHARACTERS = {"“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "‘": "'", "’": "'", "‚": "'", "–": "-", "—": "-"}
#: Characters that stand for several plain ones (fixed values).
PLAIN_STRINGS = {"…": "...", "€": "Euro", "ß": "ss"}


def squeeze_space(c: Column) -> Column:
    """Trimmed, each run of white space one blank."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def is_xml_tag(c: Column) -> Column:
    return c.rlike(XML_TAGS)


def xml_tag_name(c: Column) -> Column:
    """Lower-case name of the tag a line consists of, or null."""
    return F.nullif(F.lower(F.regexp_extract(c, r"^\s*</?([A-Za-z][\w:.-]*)[^<>]*>\s*$", 1)), F.lit(""))


def xml_attributes(c: Column) -> Column:
    """Attribute map of a tag line; the last of equal names wins."""
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(r'([\w:.-]+)\s*=\s*"([^"]*)"'), F.lit(1)).alias("k"), F.regexp_extract_all(c, F.lit(r'([\w:.-]+)\s*=\s*"([^"]*)"'), F.lit(2)).alias("v"))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"]))


def skip_comment(c: Column) -> Column:
    """The comment at the end of a rule line removed."""
    return F.trim(F.regexp_replace(c, r"(^|\s+)#.*$", ""))


def plain_characters(c: Column) -> Column:
    """Character normaliser: quotes, dashes, ellipsis, currency sign and sharp s in plain form."""
    out = F.translate(c, "".join(PLAIN_CHARACTERS), "".join(PLAIN_CHARACTERS.values()))
    for odd, plain in PLAIN_STRINGS.items():
        out = F.replace(out, F.lit(odd), F.lit(plain))
    return out


def corpus_line(c: Column) -> Column:
    """Corpus preprocessing: punctuation to blanks, squeezed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"[\p{Punct} \t\n\r\f]+", " ")))


def ngram_key(c: Column) -> Column:
    """Normalised key of a word: punctuation to blanks, squeezed, trimmed, lower case."""
    return corpus_line(c)


def words_of_line(c: Column) -> Column:
    """Words between white space, empty ones left out."""
    return F.filter(F.split(c, SPACE + "+"), lambda w: w != "")


def blank_tokens(c: Column) -> Column:
    """Tokens as the plain tokenizer yields them: split at single blanks, empty strings stay."""
    return F.split(c, " ", -1)


def legal_repetition(c: Column) -> Column:
    return c.rlike(LEGAL_REPETITION)


def squeeze_runs(c: Column) -> Column:
    """Runs of one letter (either case) to its first occurrence."""
    return F.regexp_replace(c, r"(?iu)(\p{L})\1+", "$1")


def is_elongated(c: Column) -> Column:
    """Three equal letters in a row in a string whose repetitions are not legal."""
    return c.rlike(r"(?iu)(\p{L})\1\1") & ~legal_repetition(c)


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(c.substr(1, 1)), c.substr(F.lit(2), F.length(c)))


def upcase_capitalize(new: Column, old: Column) -> Column:
    """Case of ``old`` carried over: Xyz capitalises, XYZ upcases alphabetic words, else unchanged."""
    first_upper = old.rlike(r"^\p{Lu}")
    all_upper = old.rlike(r"^\p{Lu}{2,}$") & new.rlike(r"^\p{L}+$")
    return F.when(all_upper, F.upper(new)).when(first_upper, capitalize(new)).otherwise(new)


def adjust_case(new: Column, model: Column) -> Column:
    """Lower, upper or title case like ``model``."""
    low, up = F.lower(model), F.upper(model)
    title = F.concat(F.upper(model.substr(1, 1)), F.lower(model.substr(F.lit(2), F.length(model))))
    return F.when((model == low), F.lower(new)).when((model == up) & (F.length(model) > 1), F.upper(new)).when(model == title, F.concat(F.upper(new.substr(1, 1)), F.lower(new.substr(F.lit(2), F.length(new))))).otherwise(new)


def normalize_word(c: Column) -> Column:
    """Lower case; a number becomes ``1``."""
    return F.when(c.rlike(r"^[0-9.]*[0-9][0-9.]*$"), F.lit("1")).otherwise(F.lower(c))


def char_class(c: Column) -> Column:
    """Title, Upper, Lower, MixedAlpha, Digit, Alnum, Punct or Mixed."""
    return (
        F.when(
            c.rlike(r"^\p{L}+$"),
            F.when(c.rlike(r"^[\p{Lu}\p{Lt}][^\p{Lu}\p{Lt}]*$"), "Title").when(c.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"), "Upper").when(c.rlike(r"^[^\p{Lu}]*\p{Ll}[^\p{Lu}]*$"), "Lower").otherwise("MixedAlpha"),
        )
        .when(c.rlike(r"^\p{Nd}+$"), "Digit")
        .when(c.rlike(r"^[\p{L}\p{Nd}]+$"), "Alnum")
        .when(c.rlike(r"^\p{Punct}+$"), "Punct")
        .otherwise("Mixed")
    )


def escape_feature(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, r"\s+", "_"), F.lit(":"), F.lit("__COLON__"))


def prefix(c: Column, n: int = 3) -> Column:
    return F.lower(c).substr(1, n)


def suffix(c: Column, n: int = 3) -> Column:
    return F.right(F.lower(c), F.lit(n))


def strip_right(c: Column, characters: str) -> Column:
    return F.rtrim(c, F.lit(characters))


def cap_dots(c: Column) -> Column:
    """More than three dots become three; marks after an exclamation mark go."""
    return F.regexp_replace(F.regexp_replace(c, r"\.{4,}", "..."), r"!([!?]+)", "!")


def replace_mail(c: Column) -> Column:
    return F.regexp_replace(c, r"[A-Za-z0-9][A-Za-z0-9_.+-]*@[A-Za-z0-9_]+(?:[.][A-Za-z0-9_]+)+", "%Mail")


def replace_users(c: Column) -> Column:
    """Handles after white space or at the start become ``%User``."""
    return F.regexp_replace(c, r"(^|[ \t\n\r])@+[A-Za-z0-9_]+", "$1%User")


def replace_links(c: Column) -> Column:
    return F.regexp_replace(c, r"(?:https?://?|www[.])[^ \t\n\r,;]*[^ \t\n\r,.:;!?]", "%Link")


def strip_hash_marks(c: Column) -> Column:
    """Hash marks and underscores before a word removed."""
    return F.regexp_replace(c, r"(^|[ \t\n\r])[#_]+([^#_ \t\n\r])", "$1$2")


def restore_umlauts_simple(c: Column) -> Column:
    """ae, oe, ue to umlauts by context: ue not after a, e, q, @ or before i; ae and oe not after a, e, @."""
    out = c
    for old, new, after, follow in (("ue", "ü", "@AEQÄaeqä", "(?![Ii])"), ("Ue", "Ü", "@AEQÄaeqä", "(?![Ii])"), ("UE", "Ü", "@AEQÄaeqä", "(?![Ii])"), ("ae", "ä", "@AEae", ""), ("Ae", "Ä", "@AEae", ""), ("AE", "Ä", "@AEae", ""), ("oe", "ö", "@AEae", ""), ("Oe", "Ö", "@AEae", ""), ("OE", "Ö", "@AEae", "")):
        out = F.regexp_replace(out, f"(?<![{after}]){old}{follow}", new)
    return out


def unescape_entities(c: Column) -> Column:
    """Named entities except lt and gt; the ampersand becomes a word."""
    for entity, text in (("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&auml;", "ä"), ("&ouml;", "ö"), ("&uuml;", "ü"), ("&Auml;", "Ä"), ("&Ouml;", "Ö"), ("&Uuml;", "Ü"), ("&szlig;", "ß"), ("&euro;", "€"), ("&amp;", " and ")):
        c = F.replace(c, F.lit(entity), F.lit(text))
    return c


def hashtag_set(c: Column) -> Column:
    """Distinct lower-case hashtags of a text, sorted and joined with ``; ``."""
    tags = F.regexp_extract_all(F.lower(c), F.lit(r"#([\p{L}0-9_]+)"), F.lit(1))
    return F.array_join(F.array_sort(F.array_distinct(tags)), "; ")


def message_time(c: Column) -> Column:
    """Timestamp of the message format, null for ``unknown`` and broken values."""
    return F.try_to_timestamp(F.substring(c, 5, 100), F.lit(TIME_FORMAT))


def sentences_simple(c: Column) -> Column:
    """Sentences by end marks followed by white space."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])[ \t\n\r]+"), lambda s: F.trim(s)), lambda s: s != "")


#: Alternatives of the token pattern, first match wins (own rules).
TOKEN_PATTERN = "|".join(
    [
        r"(?:\+?\d{1,3}[ /-])?\(?0\d{2,5}\)?[ /-]\d{3,}",
        r"[<>]?[:;=8xX][-o*']?[)\](\[dDpP/\\}{@|]+(?![\p{L}\d])",
        r"&(?:#\d+|\w+);",
        r"(?:https?://|www\.)[^\s<>\"]*[^\s<>\".,;:!?)]",
        r"[#@][\p{L}\d_]+",
        r"(?:\p{L}\.){2,}",
        r"\d+(?:[.,:]\d+)+",
        r"\d+\.(?=\s+\p{Ll})",
        r"\d+",
        r"\.{2,}",
        r"\p{L}[\p{L}\p{M}\d]*(?:['’-][\p{L}\d]+)*",
        r"[!?]+",
        r"[^\s]",
    ]
)


def tokens_of(c: Column) -> Column:
    """Tokens by the pattern alternation."""
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), F.lit(0))


def spelling_key(c: Column) -> Column:
    return F.lower(squeeze_runs(c))
