"""Token features: templates at offsets, relatives in the tree, atoms and sink formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpusmill.functions.text import char_class, escape_feature, prefix, suffix
from korpusmill.operators.conll import feature_map
from korpusmill.operators.lexicon import polarity_class

BOS, EOS = "__BOS__", "__EOS__"
SENT = ["doc_id", "sent_id"]


def _from_map(m, name: str, bare: tuple[str, ...]):
    """Named value of a feature map, else the first bare value that is set."""
    out = F.try_element_at(m, F.lit(name))
    for value in bare:
        out = F.coalesce(out, F.when(F.map_contains_key(m, value), value))
    return out


def grammatical(tokens: DataFrame, feat: str = "pfeat") -> DataFrame:
    """Columns case, mood, gender, degree, tense, person from the feature bag with fallbacks."""
    m = F.col("_m")
    rows = tokens.withColumn("_m", F.coalesce(feature_map(F.col(feat)), F.create_map().cast("map<string,string>")))
    return rows.withColumns(
        {
            "case": _from_map(m, "case", ("nom", "gen", "dat", "acc")),
            "mood": F.when(F.col("ppos") == "VVIMP", "imp").otherwise(_from_map(m, "mood", ("ind", "subj", "imp"))),
            "gender": _from_map(m, "gender", ("masc", "fem", "neut")),
            "degree": F.when(F.lower("form") == "beste", "sup").otherwise(_from_map(m, "degree", ("pos", "comp", "sup"))),
            "tense": F.coalesce(_from_map(m, "tense", ("pres", "past")), F.when(F.col("ppos") == "VVPP", "perf")),
            "person": _from_map(m, "pers", ("1", "2", "3")),
        }
    ).drop("_m")


def at_offsets(tokens: DataFrame, columns: list[str], offsets: tuple[int, ...] = (-1, 1)) -> DataFrame:
    """Values of columns at offsets within the sentence, e.g. ``pos_m1`` and ``pos_p1``."""
    w = W.partitionBy(*SENT).orderBy("idx")
    name = lambda c, o: f"{c}_{'m' if o < 0 else 'p'}{abs(o)}"
    return tokens.withColumns({name(c, o): (F.lag(c, -o) if o < 0 else F.lead(c, o)).over(w) for c in columns for o in offsets})


def sentence_marks(tokens: DataFrame) -> DataFrame:
    """``mark``: begin for the first token, end for the last; a single token begins only."""
    w = W.partitionBy(*SENT)
    return tokens.withColumn("mark", F.when(F.col("idx") == F.min("idx").over(w), BOS).when(F.col("idx") == F.max("idx").over(w), EOS))


def template_features(tokens: DataFrame, score: str | None = None, signed: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, sent_id, idx, features): the string features of each token, with its columns ``keep``.

    Templates that reach beyond the sentence are skipped. ``score`` names a polarity
    column; with ``signed`` off its absolute value is used, so no class is negative.
    """
    low = F.lower
    rows = grammatical(tokens)
    w = W.partitionBy(*SENT).orderBy("idx")
    rel = escape_feature(F.coalesce("pdeprel", F.lit("_")))
    rows = rows.withColumns({"_r": rel, "_rm": F.lag(rel).over(w), "_rp": F.lead(rel).over(w), "_pi": F.lag("idx").over(w), "_ph": F.lag("phead").over(w)})
    named = [("formInitChar[0]", escape_feature(prefix(F.col("form")))), ("formTrailChar[0]", escape_feature(suffix(F.col("form")))), ("charClass[0]", char_class(F.col("form"))), ("pos[0]", escape_feature(F.col("pos")))]
    named += [(f"{c}[0]", F.col(c)) for c in ("case", "gender", "degree", "mood", "tense", "person")]
    named += [("form[0]", escape_feature(low("form"))), ("lemma[0]", escape_feature(low("plemma")))]
    if score:
        value = F.coalesce(F.col(score), F.lit(0.0))
        named.append(("polScore[0]", polarity_class(value if signed else F.abs(value))))
    named += [("deprel[-1]|deprel[0]", F.when(F.col("_rm").isNotNull(), F.concat_ws("|", "_rm", "_r"))), ("deprel[0]", F.col("_r")), ("deprel[0]|deprel[1]", F.when(F.col("_rp").isNotNull(), F.concat_ws("|", "_r", "_rp")))]
    feats = [F.when(v.isNotNull(), F.concat(F.lit(n + "="), v)) for n, v in named]
    feats.append(F.when(F.col("phead") == F.col("_pi"), "prevWordIsMyParent=True").when(F.col("_ph") == F.col("idx"), "prevWordIsMyChild=True"))
    return rows.select(*SENT, "idx", *keep, F.array_compact(F.array(*feats)).alias("features"))


def target_tag(flags: DataFrame, narrow: bool = False) -> DataFrame:
    """``tag`` by priority of the flags is_target, is_source, is_sentiment, is_emo."""
    main = F.col("is_emo") if narrow else F.col("is_sentiment")
    return flags.withColumn("tag", F.when(F.col("is_target"), "TARGET").when(F.col("is_source"), "SOURCE").when(main, "SENTIMENT").otherwise("O"))


def translate_tag(c):
    """Punctuation tags by name."""
    return F.when(c == "$.", "TPUNCT").when(c == "$,", "TCOMMA").when(c == "$(", "TBRACE").otherwise(c)


def title(c):
    return F.concat(F.upper(c.substr(1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def logic_atoms(tokens: DataFrame, prefix_: str = "W", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, sent_id, idx, atom): Tag, Connector and isX ground atoms of each token, with its columns ``keep``."""
    me = F.concat(F.lit(f'"{prefix_}_'), F.col("sent_id").cast("string"), F.lit("_"), F.col("idx").cast("string"), F.lit('"'))
    parent = F.concat(F.lit(f'"{prefix_}_'), F.col("sent_id").cast("string"), F.lit("_"), F.col("phead").cast("string"), F.lit('"'))
    rel = F.when(F.col("pdeprel") == "--", "CPUNCT").otherwise(F.coalesce("pdeprel", F.lit("_")))
    feats = F.transform(F.map_entries(F.coalesce(feature_map(F.col("pfeat")), F.create_map().cast("map<string,string>"))), lambda e: F.concat(F.lit("is"), title(e["key"]), F.lit("("), me, F.lit(", "), F.upper(F.when(e["value"] == "*", "ANY").otherwise(e["value"])), F.lit(")")))
    base = F.array(F.concat(F.lit("Tag("), me, F.lit(", "), translate_tag(F.coalesce("pos", F.lit("_"))), F.lit(")")), F.concat(F.lit("Connector("), me, F.lit(", "), parent, F.lit(", "), rel, F.lit(")")))
    return tokens.select(*SENT, "idx", *keep, F.explode(F.concat(base, feats)).alias("atom"))


def split_evidence(atoms: DataFrame, hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """(evidence with a closing full stop, query atoms) by predicate."""
    is_query = F.regexp_extract("atom", r"^(\w+)\(", 1).isin(hidden)
    return atoms.where(~is_query).withColumn("atom", F.concat("atom", F.lit("."))), atoms.where(is_query)


def crf_lines(features: DataFrame, tags: DataFrame) -> DataFrame:
    """(doc_id, sent_id, idx, line): tab-separated tag and features of each token."""
    joined = features.join(tags, [*SENT, "idx"])
    return joined.select(*SENT, "idx", F.concat_ws("\t", "tag", "features").alias("line"))


def arff_header(relation: str, attributes: list[tuple[str, str]]) -> str:
    rows = [f"@attribute {name} {kind}" for name, kind in attributes]
    return "\n".join([f"@relation {relation}", "", *rows, "", "@data"])


def arff_row(*values):
    """Comma-separated quoted values; missing ones are ``?``."""
    quote = lambda v: F.coalesce(F.concat(F.lit("'"), F.replace(v.cast("string"), F.lit("'"), F.lit("\\'")), F.lit("'")), F.lit("?"))
    return F.concat_ws(",", *map(quote, values))
