"""Token tables in CoNLL columns: scan of raw lines, current rows, feature bags, trees."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpusmill.operators.scans import prefix_sums

ESC = "\x1b"
#: Bare feature values and the feature they are values of (fixed values).
VALUE_OF = {
    "nom": "case", "gen": "case", "dat": "case", "acc": "case",
    "fem": "gender", "masc": "gender", "neut": "gender",
    "sg": "num", "pl": "num",
    "1": "pers", "2": "pers", "3": "pers",
    "ind": "mood", "imp": "mood", "subj": "mood",
    "pres": "tense", "past": "tense",
}


def current_tokens(words: DataFrame) -> DataFrame:
    """One row per (doc_id, sent_id, idx): the first delivered.

    One shuffle and one sort by sentence, which later windows and groupings of the sentence
    reuse; columns that nothing asks for are not read. A position is delivered a few times
    at most, so no group is large.
    """
    w = W.partitionBy("doc_id", "sent_id", "idx").orderBy("tok_id")
    placed = words.repartition("doc_id", "sent_id").withColumn("_r", F.row_number().over(w))
    return placed.where("_r = 1").drop("_r")


def empty_to_null(c):
    return F.when(c == "_", None).otherwise(c)


def feature_map(c):
    """Feature bag ``a=b|nom`` as a map; the last of equal names wins, ``_`` is the empty map."""
    values = F.create_map(*[x for v, n in VALUE_OF.items() for x in (F.lit(v), F.lit(n))])
    parts = F.filter(F.split(c, r"\|"), lambda p: ~F.trim(p).isin("", "_"))

    def pair(p):
        p = F.trim(p)
        at = F.instr(p, "=")
        low = F.lower(p)
        name = F.coalesce(F.try_element_at(values, low), low)
        return F.struct(
            F.when(at > 0, p.substr(F.lit(1), at - 1)).otherwise(name).alias("k"),
            F.when(at > 0, p.substr(at + 1, F.length(p))).when(F.try_element_at(values, low).isNotNull(), low).otherwise("True").alias("v"),
        )

    pairs = F.transform(parts, pair)
    names = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
    return F.when(c.isNotNull(), F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda x: x["k"] == n), -1)["v"])))


def metadata_rows(lines: DataFrame) -> DataFrame:
    """(file_name, line_no, kind, value) of lines that begin with the ESC byte."""
    parts = F.split("line_text", "\t")
    rows = lines.where(F.col("line_text").startswith(ESC))
    return rows.select("file_name", "line_no", F.get(parts, F.lit(1)).alias("kind"), F.array_join(F.slice(parts, 3, 1_000_000), "\t").alias("value"))


def sentence_numbers(lines: DataFrame) -> DataFrame:
    """(line_id, file_name, line_no, msg_no, sent_no): message and sentence of each token line of a file.

    A message starts at an ``id`` metadata line, a sentence at a blank or metadata line.
    The running sums go per file, and a large file may spread over many tasks.
    """
    text = F.rtrim(F.regexp_replace("line_text", r"[\r ]+$", ""))
    is_id = F.col("line_text").startswith(ESC + "\tid\t").cast("int")
    is_break = (F.col("line_text").startswith(ESC) | (text == "")).cast("int")
    marked = lines.where(F.col("line_text").isNotNull()).select("line_id", "file_name", "line_no", "line_text", is_id.alias("is_id"), is_break.alias("is_break"))
    numbered = prefix_sums(marked, ["file_name"], ["line_no", "line_id"], {"msg_no": F.col("is_id"), "block": F.col("is_break")})
    tokens = numbered.where("is_break = 0")
    return tokens.withColumn("sent_no", F.dense_rank().over(W.partitionBy("file_name", "msg_no").orderBy("block")) - 1).select("line_id", "file_name", "line_no", "msg_no", "sent_no")


def with_relatives(tokens: DataFrame, head: str = "phead") -> DataFrame:
    """Tokens with their parent and grandparent (structs, null at the root): one shuffle per join, both on the sentence."""
    key = ["doc_id", "sent_id"]
    info = F.struct("idx", "form", "lemma", "pos", F.col(head).alias("head"))
    near = tokens.select(*key, F.col("idx").alias("_i"), info.alias("parent"))
    same = lambda a, b: (F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")) & (F.col(f"{a}.sent_id") == F.col(f"{b}.sent_id"))
    one = tokens.alias("t").join(near.alias("p"), same("t", "p") & (F.col(f"t.{head}") == F.col("p._i")), "left").select("t.*", "p.parent")
    two = one.alias("t").join(near.withColumnRenamed("parent", "grandparent").alias("g"), same("t", "g") & (F.col("t.parent.head") == F.col("g._i")), "left")
    return two.select("t.*", "g.grandparent")


def children(tokens: DataFrame, head: str = "phead") -> DataFrame:
    """(doc_id, sent_id, idx, kids): the dependents of each token that has any, in order."""
    kid = F.struct(F.col("idx").alias("i"), "form", "lemma", "pos", "pdeprel")
    return tokens.where(F.col(head) > 0).groupBy("doc_id", "sent_id", F.col(head).alias("idx")).agg(F.array_sort(F.collect_list(kid)).alias("kids"))


def tree_depths(tokens: DataFrame, head: str = "phead") -> DataFrame:
    """(doc_id, sent_id, idx, depth): distance from the root, leaves-first order is by falling depth.

    A token whose head is missing is a root; a token on or below a loop has a null depth.
    """
    rows = tokens.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.coalesce(head, F.lit(0)).alias("h")))).alias("ts"))

    @F.pandas_udf("array<int>")
    def depths(s: pd.Series) -> pd.Series:
        def run(ts):
            heads = {t["idx"]: t["h"] for t in ts}
            known: dict[int, int | None] = {}
            for start in heads:
                path, at = [], start
                while at in heads and at not in known and at not in path:
                    path.append(at)
                    at = heads[at]
                base = known.get(at) if at in known else None if at in path else -1
                for node in reversed(path):
                    base = None if base is None else base + 1
                    known[node] = base
            return [known[t["idx"]] for t in ts]

        return s.map(run)

    zipped = rows.select("doc_id", "sent_id", F.explode(F.arrays_zip(F.col("ts").alias("t"), depths("ts").alias("d"))).alias("x"))
    return zipped.select("doc_id", "sent_id", F.col("x.t.idx").alias("idx"), F.col("x.d").alias("depth"))


def tree_dot(tokens: DataFrame, head: str = "phead") -> DataFrame:
    """(doc_id, sent_id, dot): the dependency tree of a sentence as graph description."""
    quote = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    node = F.concat(F.lit('  n'), F.col("idx").cast("string"), F.lit(' [label="'), quote(F.coalesce("form", F.lit(""))), F.lit('"];'))
    edge = F.when(F.col(head) > 0, F.concat(F.lit("  n"), F.col(head).cast("string"), F.lit(" -> n"), F.col("idx").cast("string"), F.lit(' [label="'), quote(F.coalesce("pdeprel", F.lit(""))), F.lit('"];')))
    line = F.struct(F.col("idx").alias("i"), F.concat_ws("\n", node, edge).alias("s"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["s"])
    return tokens.groupBy("doc_id", "sent_id").agg(F.concat(F.lit("digraph {\n"), F.array_join(lines, "\n"), F.lit("\n}")).alias("dot"))
