"""Running sums and ranks within groups of any size.

A window partitioned by a hot group sorts the whole group in one task. Here rows are
range-partitioned by group and order, so a hot group spreads over many tasks; each task
sums its own part, and the totals of the parts before it (one row per group and task) are
joined on. The placing is checkpointed, so that both branches see the same parts even if
executors are lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpusmill.session import checkpoint


def prefix_sums(df: DataFrame, by: list[str], order: list[str], values: dict[str, Column], inclusive: bool = True, totals: bool = False) -> DataFrame:
    """``df`` with a running sum per name in ``values`` within ``by``, ordered by ``order``.

    Without ``inclusive`` a row's own value is left out. With ``totals`` the sum over the
    whole group is added as ``<name>_total``. The order must not have ties that matter.
    """
    valued = df.withColumns({f"_v_{n}": c.cast("bigint") for n, c in values.items()})
    placed = checkpoint(valued.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    inside = W.partitionBy(*by, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    local = placed.withColumns({f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in values})
    parts = placed.groupBy(*by, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))  # rows here: one per group and task
    before = parts.select(
        *[F.col(c).alias(f"_g_{c}") for c in by], F.col("_part").alias("_g_part"),
        *[F.coalesce(F.sum(f"_s_{n}").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"_b_{n}") for n in values],
        *([F.sum(f"_s_{n}").over(group).alias(f"{n}_total") for n in values] if totals else []),
    )
    same = F.col("_part") == F.col("_g_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    joined = local.join(before, same)
    done = joined.withColumns({n: F.col(f"_l_{n}") + F.col(f"_b_{n}") for n in values})
    return done.select(*df.columns, *values, *([f"{n}_total" for n in values] if totals else []))


def ranked(df: DataFrame, by: list[str], order: list[str], name: str = "rank0", size: str = "size") -> DataFrame:
    """Zero-based rank of each row within ``by`` and the size of its group."""
    rows = prefix_sums(df, by, order, {"_one": F.lit(1)}, inclusive=False, totals=True)
    return rows.withColumnsRenamed({"_one": name, "_one_total": size})
