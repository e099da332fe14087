"""Ranks, representatives and pages; every order is total, so results do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mid_rank(rows: DataFrame, cohort: list[str], score: str, least: int = 30, out: str = "mid_rank") -> DataFrame:
    """(rows below + half the rows equal) / rows of the cohort; 0.5 in cohorts under `least` rows and for a null score.

    Counts come from the cohort's distinct scores (aggregated before any sort), so a cohort with a third of all rows sorts
    its distinct scores only.
    """
    by = rows.where(F.col(score).isNotNull()).groupBy(*cohort, score).agg(F.count(F.lit(1)).alias("_eq"))
    w = Window.partitionBy(*cohort)
    below = F.sum("_eq").over(w.orderBy(score).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_eq")
    ranked = by.withColumn("_n", F.sum("_eq").over(w)).withColumn("_r", (below + F.col("_eq") / 2) / F.col("_n"))
    joined = rows.join(ranked.drop("_eq"), [*cohort, score], "left")
    return joined.withColumn(out, F.when(F.col("_n") >= least, F.col("_r")).otherwise(0.5)).drop("_n", "_r")


def rescaled(rank: Column, n: Column) -> Column:
    """A mid-rank spread over 0 to 1: 0.5 + (r - 0.5) n / (n - 1); 0.5 for fewer than two rows or null."""
    return F.when((n >= 2) & rank.isNotNull(), 0.5 + (rank - 0.5) * n / (n - 1)).otherwise(0.5)


def first_per_key(rows: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first `n` rows of each key by a total order; the plan stops sorting groups beyond n (window group limit)."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def round_robin(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """`n` rows taken in turns: every key's first, then every key's second, and so on."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("turn", turn).orderBy("turn", key, *order).limit(n)


def pages(rows: DataFrame, order: list[Column], size: int = 50) -> DataFrame:
    """Rows with a number and a page, by a total order, without bringing all rows into one task: rows are sorted by range,
    partitions are counted, and each partition's numbers begin behind those before it."""
    from .materialize import materialize

    ordered = rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    kept = materialize(ordered)
    counts = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    numbered = kept.withColumn("_i", inside).join(F.broadcast(before.select("_part", "_before")), "_part").withColumn("row_no", F.col("_before") + F.col("_i"))
    return numbered.withColumn("page", F.ceil(F.col("row_no") / size)).drop("_part", "_at", "_i", "_before")
