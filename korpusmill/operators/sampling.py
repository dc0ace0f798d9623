"""Selections: percentage ranges, splits, quality filter, deduplication, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpusmill.operators.scans import ranked

#: Word separators of the message quality filter.
QUALITY_SPLIT = r"[-\]\s:;,.?!(){}\[]+"
#: Function words of which a message must hold one (a short list of our own).
FUNCTION_WORDS = ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "in", "den", "mit", "auf", "für", "von", "im", "es", "ich", "sich", "auch")


def percentage_range(rows: DataFrame, order: list[str], start: int, end: int, by: list[str] | None = None) -> DataFrame:
    """Rows [start n / 100, end n / 100) of the sorted rows, by integer division; groups may be of any size."""
    n, i = F.col("_n"), F.col("_i")
    return ranked(rows, by or [], order, "_i", "_n").where((i >= F.floor(n * start / 100)) & (i < F.floor(n * end / 100))).drop("_i", "_n")


def split_name(i, n):
    """train, dev or test of a rank: 70, 10 and 20 per cent."""
    return F.when(i < F.floor(n * 70 / 100), "train").when(i < F.floor(n * 80 / 100), "dev").otherwise("test")


def split_70_10_20(rows: DataFrame, order: list[str]) -> DataFrame:
    return ranked(rows, [], order, "_i", "_n").withColumn("split", split_name(F.col("_i"), F.col("_n"))).drop("_i", "_n")


def is_good_message(text, function_words: tuple[str, ...] = FUNCTION_WORDS):
    """More than four informative words, one of them a function word (callers bring their own list)."""
    words = F.filter(F.split(F.lower(text), QUALITY_SPLIT), lambda w: w.rlike(r"^[\p{L}0-9_][\p{L}0-9_']+[\p{L}0-9_.$]$") & ~w.rlike(r"^(?:[@#]|www|http)"))
    return (F.size(words) > 4) & F.arrays_overlap(words, F.array(*map(F.lit, function_words)))


def dedupe_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``: an aggregate with map-side combining, no sort per key."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return best.select(key, *[F.col("_r")[c].alias(c) for c in others])


def skip_ids(rows: DataFrame, skipped: DataFrame, key: str) -> DataFrame:
    return rows.join(skipped.select(key), key, "left_anti")


def hash_sample(rows: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """n rows chosen by seeded hash of the key: the same on every engine and partitioning."""
    return rows.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))).orderBy("_h", key).limit(n).drop("_h")


def quotas(sizes: dict[str, int], total: int) -> dict[str, int]:
    """Equal quotas per group; what a small group lacks is spread over the others until nothing is left."""
    out = {g: 0 for g in sizes}
    open_, left = sorted(sizes), min(total, sum(sizes.values()))
    while left and open_:
        share, extra = divmod(left, len(open_))
        given = 0
        for i, g in enumerate(open_):
            take = min(sizes[g] - out[g], share + (i < extra))
            out[g] += take
            given += take
        left -= given
        open_ = [g for g in open_ if out[g] < sizes[g]]
    return out


def stratified_sample(rows: DataFrame, group: str, key: str, total: int, max_groups: int = 1000) -> DataFrame:
    """``total`` rows spread evenly over the groups (a closed set), deficits redistributed."""
    sizes = {r[0]: r[1] for r in rows.groupBy(group).count().limit(max_groups + 1).collect()}
    if len(sizes) > max_groups:
        raise ValueError(f"more than {max_groups} groups")
    wanted = quotas(sizes, total)
    quota = F.create_map(*[x for g, q in wanted.items() for x in (F.lit(g), F.lit(q))]) if wanted else F.create_map().cast("map<string,int>")
    w = W.partitionBy(group).orderBy(F.md5(F.col(key).cast("string")), key)
    most = max(wanted.values(), default=0)  # a literal bound lets every task keep only its best rows before the shuffle
    best = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return best.where(F.col("_r") <= F.try_element_at(quota, F.col(group))).drop("_r")


def balance_classes(rows: DataFrame, klass: str, key: str) -> DataFrame:
    """Rows of smaller classes repeated until every class is as large as the largest."""
    top = rows.groupBy(klass).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("_m"))
    placed = ranked(rows.withColumn("_h", F.md5(F.col(key).cast("string"))), [klass], ["_h", key], "_r", "_n")
    joined = placed.crossJoin(F.broadcast(top))  # one row
    times = F.floor(F.col("_m") / F.col("_n")) + F.when(F.col("_r") < F.col("_m") % F.col("_n"), 1).otherwise(0)
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), times.cast("int")))).drop("_n", "_m", "_r", "_h")


def holdout(rows: DataFrame, key: str, percent: int = 10, seed: str = "0") -> DataFrame:
    """``part``: dev for about ``percent`` per cent of the keys by seeded hash, train for the others; no shuffle."""
    share = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(100))
    return rows.withColumn("part", F.when(share < percent, "dev").otherwise("train"))


def half_resample(rows: DataFrame, key: str, turn: int) -> DataFrame:
    """Another half of the rows in each turn, by seeded hash."""
    return rows.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(turn)), F.lit(2)) == 0)


def time_bounds(rows: DataFrame, time: str) -> DataFrame:
    return rows.agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"))
