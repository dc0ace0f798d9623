"""Reply threads: edges, closure, totals, samples.

Pointer doubling finds the root and depth of every message: after k rounds a message
knows its ancestor 2^k steps up, so deep threads need few rounds and every round is two
equi-joins. Cycles never reach a root and are reported with a null root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusmill.session import checkpoint


def reply_edges(messages: DataFrame) -> DataFrame:
    """(id, parent): distinct messages; a re-delivered message counts once."""
    return messages.where(F.col("id").isNotNull()).groupBy(F.col("id").cast("string").alias("id")).agg(F.max(F.col("in_reply_to_status_id").cast("string")).alias("parent"))


def with_missing_parents(edges: DataFrame) -> DataFrame:
    """Edges with the unseen parents of replies added as roots."""
    unseen = edges.where("parent is not null").select(F.col("parent").alias("id")).distinct().join(edges.select("id"), "id", "left_anti")
    return edges.unionByName(unseen.withColumn("parent", F.lit(None).cast("string")))


def thread_roots(messages: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(id, parent, root, depth): depth 0 for roots; root and depth null inside a cycle."""
    edges = checkpoint(with_missing_parents(reply_edges(messages)))
    state = edges.select("id", "parent", F.coalesce("parent", "id").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"))
    n_open = None
    for _ in range(max_rounds):
        above = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        state = checkpoint(state.join(above, "up").select("id", "parent", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth")))
        roots = edges.where("parent is null").select(F.col("id").alias("up"))
        left = state.join(roots, "up", "left_anti").count()
        if left == 0 or left == n_open and _ > 1 and _cyclic_only(state, edges):
            break
        n_open = left
    is_root = edges.where("parent is null").select(F.col("id").alias("up"), F.lit(True).alias("is_root"))
    done = state.join(is_root, "up", "left")
    return done.select("id", "parent", F.when(F.col("is_root"), F.col("up")).alias("root"), F.when(F.col("is_root"), F.col("depth")).alias("depth"))


def _cyclic_only(state: DataFrame, edges: DataFrame) -> bool:
    """Whether all messages without a root hang on a cycle (their depth exceeds the number of messages)."""
    n = edges.count()
    open_ = state.join(edges.where("parent is null").select(F.col("id").alias("up")), "up", "left_anti")
    return open_.where(F.col("depth") <= n).isEmpty()


def thread_totals(closure: DataFrame) -> DataFrame:
    """(root, n_replies, max_depth) of each thread."""
    return closure.where("root is not null").groupBy("root").agg(F.sum((F.col("depth") > 0).cast("int")).alias("n_replies"), F.max("depth").alias("max_depth"))


def top_threads(totals: DataFrame, n: int = 10) -> DataFrame:
    return totals.orderBy(F.desc("n_replies"), "root").limit(n)


def singles_ratio(closure: DataFrame) -> DataFrame:
    """One row: singles, replies and their percentage."""
    sizes = closure.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    singles = F.sum((F.col("n") == 1).cast("bigint"))
    return sizes.agg(singles.alias("n_singles"), F.sum("n").alias("n_messages"), F.round(100 * singles / F.sum("n"), 6).alias("pct_singles"))


def print_thread_rows(closure: DataFrame, messages: DataFrame) -> DataFrame:
    """(root, path, line): tab-indented lines of each thread in depth-first order.

    The order key of a message is its path of ids from the root, built by walking up; it
    only needs the ancestors of each message, one level per round.
    """
    texts = messages.groupBy(F.col("id").cast("string").alias("id")).agg(F.min("text").alias("text"))
    rows = closure.where("root is not null").select("id", "root", "depth", F.col("id").alias("path"), F.col("parent").alias("up"))
    parents = closure.select(F.col("id").alias("up"), F.col("parent").alias("next"))
    while not rows.where("up is not null").isEmpty():
        stepped = rows.join(parents, "up", "left").select("id", "root", "depth", F.when(F.col("up").isNotNull(), F.concat_ws("/", "up", "path")).otherwise(F.col("path")).alias("path"), F.col("next").alias("up"))
        rows = checkpoint(stepped)
    joined = rows.join(texts, "id", "left")
    return joined.select("root", "path", F.concat(F.repeat(F.lit("\t"), F.col("depth")), F.col("id"), F.lit("\t"), F.coalesce("text", F.lit("unknown"))).alias("line"))


def sample_threads(closure: DataFrame, messages: DataFrame, n: int, least: int = 2, most: int = 10, seed: str = "0") -> DataFrame:
    """n threads of ``least`` to ``most`` messages without unknown text, chosen by seeded hash."""
    texts = messages.groupBy(F.col("id").cast("string").alias("id")).agg(F.max("text").alias("text"))
    sized = closure.join(texts, "id", "left").where("root is not null").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("text").isNull().cast("int")).alias("unknown"))
    fit = sized.where((F.col("n") >= least) & (F.col("n") <= most) & (F.col("unknown") == 0))
    return fit.withColumn("h", F.md5(F.concat("root", F.lit(seed)))).orderBy("h", "root").limit(n).select("root", "n")
