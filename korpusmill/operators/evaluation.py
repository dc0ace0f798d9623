"""Evaluation: span scores, confusion counts, agreement, feature set comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What replaces a zero denominator in the summary of triples (fixed value).
NO_DENOMINATOR = 1e6


def plain_tag(c):
    """A tag without the mark of a span's beginning."""
    return F.when(c.startswith("B") & (F.length(c) > 1), c.substr(F.lit(2), F.length(c))).otherwise(c)


def islands(tags: DataFrame, by: list[str], order: list[str], tag: str, name: str) -> DataFrame:
    """``name``: running number of the run of equal tags a token belongs to, within ``by``."""
    w = W.partitionBy(*by).orderBy(*order)
    change = F.when(F.lag(tag).over(w).eqNullSafe(F.col(tag)), 0).otherwise(1)
    return tags.withColumn(name, F.sum(change).over(w))


def _spans(tags: DataFrame, by: list[str], order: list[str], tag: str) -> DataFrame:
    """(by, tag, n, matched, last) of each span."""
    marked = islands(tags, by, order, tag, "_span")
    return marked.groupBy(*by, "_span", F.col(tag).alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("gold") == F.col("pred")).cast("int")).alias("matched"), F.max(F.struct(*order)).alias("last"))


def _prf(gold: DataFrame, pred: DataFrame) -> DataFrame:
    joined = gold.join(pred, "tag", "full")
    precision = F.when(F.coalesce("n_pred", F.lit(0)) > 0, 100 * F.col("pred_score") / F.col("n_pred")).otherwise(0.0)
    recall = F.when(F.coalesce("n_gold", F.lit(0)) > 0, 100 * F.col("gold_score") / F.col("n_gold")).otherwise(0.0)
    rows = joined.select("tag", F.coalesce("n_gold", F.lit(0)).alias("n_gold"), F.coalesce("n_pred", F.lit(0)).alias("n_pred"), precision.alias("p"), recall.alias("r"))
    f = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return rows.select("tag", "n_gold", "n_pred", F.round("p", 6).alias("prec"), F.round("r", 6).alias("recall"), F.round(f, 6).alias("f1"))


def span_scores(tags: DataFrame, by: list[str], order: list[str], mode: str = "binary", punct: str | None = None) -> DataFrame:
    """Precision, recall and F per tag over spans of equal tags.

    ``tags`` has gold and pred; tokens flagged by column ``punct`` are left out. A span
    scores 1 if a token agrees (binary) or its share of agreeing tokens (proportional);
    exact counts spans of equal tag and length that end together.
    """
    if mode not in ("binary", "proportional", "exact"):
        raise ValueError("mode must be binary, proportional or exact")
    rows = tags.where(~F.col(punct)) if punct else tags
    rows = rows.select(*by, *order, plain_tag(F.col("gold")).alias("gold"), plain_tag(F.col("pred")).alias("pred"))
    gold, pred = _spans(rows, by, order, "gold"), _spans(rows, by, order, "pred")
    if mode == "exact":
        key = [*by, "tag", "n", "last"]
        hits = gold.select(*key).intersect(pred.select(*key)).groupBy("tag").agg(F.count(F.lit(1)).alias("hits"))
        g = gold.groupBy("tag").agg(F.count(F.lit(1)).alias("n_gold")).join(hits, "tag", "left").select("tag", "n_gold", F.coalesce("hits", F.lit(0)).alias("gold_score"))
        p = pred.groupBy("tag").agg(F.count(F.lit(1)).alias("n_pred")).join(hits, "tag", "left").select("tag", "n_pred", F.coalesce("hits", F.lit(0)).alias("pred_score"))
        return _prf(g, p)
    score = F.col("matched") / F.col("n") if mode == "proportional" else (F.col("matched") > 0).cast("int")
    return _prf(gold.groupBy("tag").agg(F.count(F.lit(1)).alias("n_gold"), F.sum(score).alias("gold_score")), pred.groupBy("tag").agg(F.count(F.lit(1)).alias("n_pred"), F.sum(score).alias("pred_score")))


def macro_f1(tags: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row: mean of the proportional F over the tags."""
    return span_scores(tags, by, order, "proportional").agg(F.round(F.avg("f1") / 100, 6).alias("macro_f1"))


def confusion_counts(gold: DataFrame, predicted: DataFrame, key: list[str], klass: str) -> DataFrame:
    """(class, tp, fp, fn): set membership of distinct rows."""
    a = gold.select(*key, klass).distinct().withColumn("_g", F.lit(1))
    b = predicted.select(*key, klass).distinct().withColumn("_p", F.lit(1))
    joined = a.join(b, [*key, klass], "full")
    both = F.col("_g").isNotNull() & F.col("_p").isNotNull()
    return joined.groupBy(klass).agg(F.sum(both.cast("int")).alias("tp"), F.sum(F.col("_g").isNull().cast("int")).alias("fp"), F.sum(F.col("_p").isNull().cast("int")).alias("fn"))


def prf_summary(triples: DataFrame, klass: str) -> DataFrame:
    """Precision, recall and F of summed triples; a zero denominator counts as a very large one."""
    sums = triples.groupBy(klass).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    safe = lambda x: F.when(x == 0, F.lit(NO_DENOMINATOR)).otherwise(x)
    p, r = F.col("tp") / safe(F.col("tp") + F.col("fp")), F.col("tp") / safe(F.col("tp") + F.col("fn"))
    return sums.select(klass, "tp", "fp", "fn", F.round(p, 6).alias("prec"), F.round(r, 6).alias("recall"), F.round(2 * p * r / safe(p + r), 6).alias("f1"))


def kappa(n, marked1, overlap1, marked2, overlap2):
    """Cohen's kappa from the tokens both could mark; 0 where it is undefined.

    Agreement is the share of tokens that none or both marked; chance comes from the margins.
    """
    agreed = (n - marked1 + overlap1 - marked2 + overlap2) / n
    chance = (marked1 / n) * (marked2 / n) + (1 - marked1 / n) * (1 - marked2 / n)
    return F.when((n == 0) | (chance == 1), 0.0).otherwise((agreed - chance) / (1 - chance))


def annotator_agreement(marks: DataFrame, totals: DataFrame, scheme: str = "proportional") -> DataFrame:
    """Counts and kappa per file and level, per level, for two annotators.

    ``marks`` has file, level, annotator (1 or 2), span_id, word; ``totals`` the number of
    words per file. Schemes: proportional (distinct words both marked), binary (all words
    of spans that overlap one of the other), exact (words of identical spans).
    """
    key = ["file", "level"]
    words = marks.select(*key, "annotator", "word").distinct()
    per_word = words.groupBy(*key, "word").agg(F.max((F.col("annotator") == 1).cast("int")).alias("m1"), F.max((F.col("annotator") == 2).cast("int")).alias("m2"))
    if scheme == "proportional":
        counts = per_word.groupBy(*key).agg(F.sum("m1").alias("marked1"), F.sum("m2").alias("marked2"), F.sum(F.col("m1") * F.col("m2")).alias("overlap1"), F.sum(F.col("m1") * F.col("m2")).alias("overlap2"))
    else:
        if scheme == "binary":
            flagged = marks.join(per_word, [*key, "word"]).withColumn("_hit", F.col("m1") * F.col("m2"))
            good = flagged.groupBy(*key, "annotator", "span_id").agg(F.max("_hit").alias("good")).where("good = 1")
        elif scheme == "exact":
            spans = marks.groupBy(*key, "annotator", "span_id").agg(F.array_sort(F.collect_set("word")).alias("ws"))
            shared = spans.groupBy(*key, "ws").agg(F.count_distinct("annotator").alias("k")).where("k = 2").drop("k")
            good = spans.join(shared, [*key, "ws"], "left_semi")
        else:
            raise ValueError("scheme must be proportional, binary or exact")
        hit = marks.join(good.select(*key, "annotator", "span_id"), [*key, "annotator", "span_id"], "left_semi").select(*key, "annotator", "word").distinct().withColumn("_h", F.lit(1))
        joined = words.join(hit, [*key, "annotator", "word"], "left")
        one = lambda a, c: F.sum(F.when(F.col("annotator") == a, c).otherwise(0))
        counts = joined.groupBy(*key).agg(one(1, 1).alias("marked1"), one(2, 1).alias("marked2"), one(1, F.coalesce("_h", F.lit(0))).alias("overlap1"), one(2, F.coalesce("_h", F.lit(0))).alias("overlap2"))
    full = counts.join(totals, "file")
    sums = [F.sum(c).alias(c) for c in ("n", "marked1", "overlap1", "marked2", "overlap2")]
    rolled = full.groupingSets([[F.col("file"), F.col("level")], [F.col("level")]], F.col("file"), F.col("level")).agg(*sums)
    k = kappa(F.col("n"), F.col("marked1"), F.col("overlap1"), F.col("marked2"), F.col("overlap2"))
    return rolled.select("file", "level", "n", "marked1", "overlap1", "marked2", "overlap2", F.round(k, 6).alias("kappa"))


def message_agreement(marked: DataFrame, by: str | None = None) -> DataFrame:
    """Kappa, precision, recall and F for messages flagged by two annotators (m1, m2 in 0/1).

    One row over all; with ``by`` also one for each of its values, which are not null.
    """
    c = (marked.rollup(by) if by else marked.groupBy()).agg(F.count(F.lit(1)).alias("n"), F.sum("m1").alias("a"), F.sum("m2").alias("b"), F.sum(F.col("m1") * F.col("m2")).alias("n_both"))
    k = kappa(F.col("n"), F.col("a"), F.col("n_both"), F.col("b"), F.col("n_both"))
    p, r = F.try_divide("n_both", "b"), F.try_divide("n_both", "a")
    return c.select(*([by] if by else []), "n", "a", "b", "n_both", F.round(k, 6).alias("kappa"), F.round(F.coalesce(p, F.lit(0.0)), 6).alias("prec"), F.round(F.coalesce(r, F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def compare_feature_sets(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: sizes of two feature sets, of their intersection and union.

    One pass: each feature is grouped once with flags of the sets it occurs in.
    """
    tagged = first.select("feature", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(second.select("feature", F.lit(0).alias("a"), F.lit(1).alias("b")))
    flags = tagged.groupBy("feature").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return flags.agg(total(F.col("a")).alias("n_first"), total(F.col("b")).alias("n_second"), total(F.col("a") * F.col("b")).alias("n_both"), F.count(F.lit(1)).alias("n_union"))


def tag_confusion(rows: DataFrame, first: str, second: str, same: list[tuple[str, str]] | None = None, top: int = 10) -> DataFrame:
    """(rank, tag1, tag2, n): most frequent differing pairs; pairs in ``same`` count as equal."""
    low = rows.where(F.col(first).isNotNull() & F.col(second).isNotNull() & (F.col(first) != F.col(second)))
    for a, b in same or []:
        low = low.where(~((F.col(first).isin(a, b)) & (F.col(second).isin(a, b))))
    counts = low.groupBy(F.col(first).alias("tag1"), F.col(second).alias("tag2")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.desc("n"), "tag1", "tag2").limit(top)
    return best.select(F.row_number().over(W.orderBy(F.desc("n"), "tag1", "tag2")).alias("rank"), "tag1", "tag2", "n")


def error_messages(tokens: DataFrame, doc: str, gold: str, pred: str) -> DataFrame:
    """Tokens of the messages that hold any token whose tags differ."""
    wrong = tokens.groupBy(doc).agg(F.bool_or(~F.col(gold).eqNullSafe(F.col(pred))).alias("_w")).where("_w").select(doc)
    return tokens.join(wrong, doc, "left_semi")
