"""Problem 5: references to records that do not exist.

Direct orphans come from equi-joins of the references with the aggregated targets; the
words of spans meet their targets by blocks of 64 word numbers, a row per block.
Children of orphaned records are indirectly orphaned: a fixpoint iterates semi-joins
down the reference graph, a level of the graph per step, until no new record is found.
The edges are partitioned by target once; a step moves only the records found last.

Defined results: null, empty and ``empty`` references refer to nothing; referring rows
with ``deleted_at`` are not reported; re-delivered rows are targets once; a cycle of
references ends because a record is orphaned at most once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusmill.operators.packed import span_fields
from korpusmill.session import checkpoint

#: Levels that an emo_expression_ref without a level may mean, under one name.
EMO_LEVELS = ("emo-expression", "intensifier")
EMO_ANY = "~emo"
KEY = ["file_name", "annotator", "anno_level", "markable_id"]
#: Words of a file are handled in blocks of 2 to this power.
BLOCK_BITS = 6


def _state(rows: DataFrame, key: list[str]) -> DataFrame:
    """Per target: first arrival and whether all of its rows are deleted."""
    return rows.groupBy(*key).agg(F.min("loaded_at").alias("first_loaded"), F.bool_and(F.col("deleted_at").isNotNull()).alias("all_deleted"))


def markable_targets(markables: DataFrame) -> DataFrame:
    """Targets by key; emo-expression and intensifier also under their common name."""
    rows = markables.select(*KEY, "loaded_at", "deleted_at")
    levels = F.when(F.col("anno_level").isin(*EMO_LEVELS), F.array(F.col("anno_level"), F.lit(EMO_ANY))).otherwise(F.array("anno_level"))
    return _state(rows.withColumn("anno_level", F.explode(levels)), KEY)


def references(markables: DataFrame) -> DataFrame:
    """One row per reference of a live markable: its own key and the key of its target."""
    live = markables.where(F.col("deleted_at").isNull())
    pair = lambda field, default: F.struct(F.lit(field).alias("ref_field"), F.regexp_replace(field, r"[\s ]+", "").alias("ref"), F.lit(default).alias("default"))
    exploded = live.select("mk_key", *KEY, "loaded_at", F.explode(F.array(pair("sentiment_ref", "sentiment"), pair("emo_expression_ref", EMO_ANY))).alias("r"))
    held = exploded.where(F.col("r.ref").isNotNull() & ~F.col("r.ref").isin("", "empty"))
    at = F.instr(F.col("r.ref"), ":")
    return held.select(
        "mk_key", "file_name", "annotator", F.col("anno_level").alias("own_level"), F.col("markable_id").alias("own_id"), "loaded_at", F.col("r.ref_field").alias("ref_field"),
        F.when(at > 0, F.col("r.ref").substr(F.lit(1), at - 1)).otherwise(F.col("r.default")).alias("anno_level"),
        F.when(at > 0, F.col("r.ref").substr(at + 1, F.length("r.ref"))).otherwise(F.col("r.ref")).alias("markable_id"),
    )


def _kind():
    return F.when(F.col("first_loaded").isNull() & F.col("all_deleted").isNull(), "missing").when(F.col("all_deleted"), "deleted").when(F.col("first_loaded") > F.col("loaded_at"), "late")


def word_blocks(words: DataFrame) -> DataFrame:
    """(file_name, block, words): states of up to 64 words by number; repeated rows of a word combine before they move."""
    state = _state(words.where("word_id is not null").select("file_name", "word_id", "loaded_at", "deleted_at"), ["file_name", "word_id"])
    placed = state.groupBy("file_name", F.shiftright("word_id", BLOCK_BITS).alias("block"))
    return placed.agg(F.map_from_entries(F.collect_list(F.struct("word_id", F.struct("first_loaded", "all_deleted")))).alias("words"))


def span_orphans(live: DataFrame, words: DataFrame) -> DataFrame:
    """Rows of ``live`` with a kind for each way in which words of their span fail."""
    numbers = span_fields(live, "mk_key", "file_name", "annotator", "anno_level", "markable_id", "loaded_at")
    block = lambda n: F.shiftright(n, BLOCK_BITS)
    places = F.explode(F.array_distinct(F.transform("numbers", block))).alias("block")
    cut = numbers.select("mk_key", "file_name", "annotator", F.col("anno_level").alias("own_level"), F.col("markable_id").alias("own_id"), "loaded_at", "numbers", places)
    cut = cut.withColumn("numbers", F.filter("numbers", lambda n: block(n) == F.col("block")))
    met = cut.join(word_blocks(words), ["file_name", "block"], "left")

    def kind(n):
        word = F.try_element_at("words", n)
        return F.when(word.isNull(), "missing").when(word["all_deleted"], "deleted").when(word["first_loaded"] > F.col("loaded_at"), "late")

    kinds = F.filter(F.array_distinct(F.transform("numbers", kind)), lambda k: k.isNotNull())
    shown = ["mk_key", "file_name", "annotator", "own_level", "own_id", "loaded_at"]
    return met.select(*shown, F.lit("span").alias("ref_field"), F.explode(kinds).alias("orphan_kind")).distinct()


def direct_orphans(markables: DataFrame, words: DataFrame) -> DataFrame:
    """(mk_key, file_name, annotator, own_level, own_id, loaded_at, ref_field, orphan_kind)."""
    shown = ["mk_key", "file_name", "annotator", "own_level", "own_id", "loaded_at", "ref_field", "orphan_kind"]
    by_ref = references(markables).join(markable_targets(markables), KEY, "left").withColumn("orphan_kind", _kind())
    return by_ref.where(F.col("orphan_kind").isNotNull()).select(*shown).unionByName(span_orphans(markables.where(F.col("deleted_at").isNull()), words))


def orphan_cascade(markables: DataFrame, words: DataFrame, max_depth: int = 1000) -> DataFrame:
    """Direct orphans (generation 0) and inherited ones (generation 1, 2, ...; kind ``inherited``).

    The reference graph is bounded in depth by its data; ``max_depth`` only guards
    against a damaged one and raises when it is reached.
    """
    direct = checkpoint(direct_orphans(markables, words).withColumn("generation", F.lit(0)))
    refs = references(markables)
    levels = F.when(F.col("anno_level") == EMO_ANY, F.array(*[F.lit(x) for x in EMO_LEVELS])).otherwise(F.array("anno_level"))
    edges = refs.select("mk_key", "file_name", "annotator", "own_level", "own_id", "loaded_at", "ref_field", F.explode(levels).alias("anno_level"), "markable_id")
    edges = checkpoint(edges.repartition(*KEY))
    done, fresh = direct, direct
    reached = direct.select("mk_key").distinct()
    for generation in range(1, max_depth + 1):
        frontier = fresh.select("file_name", "annotator", F.col("own_level").alias("anno_level"), F.col("own_id").alias("markable_id")).distinct()
        children = edges.join(frontier, KEY, "left_semi").join(reached, "mk_key", "left_anti")
        shown = children.select("mk_key", "file_name", "annotator", "own_level", "own_id", "loaded_at", "ref_field", F.lit("inherited").alias("orphan_kind"), F.lit(generation).alias("generation"))
        fresh = checkpoint(shown.distinct())
        if fresh.isEmpty():
            return done
        done = done.unionByName(fresh)
        reached = reached.unionByName(fresh.select("mk_key").distinct())
    raise ValueError(f"references nest deeper than {max_depth}")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per level, field, kind and loading month of the referring record."""
    month = F.date_format("loaded_at", "yyyy-MM").alias("load_month")
    return orphans.groupBy(F.col("own_level").alias("anno_level"), "ref_field", month, "orphan_kind").agg(
        F.count(F.lit(1)).alias("n_references"), F.count_distinct("mk_key").alias("n_records"), F.sum(F.when(F.col("generation") > 0, 1).otherwise(0)).alias("n_inherited")
    )
