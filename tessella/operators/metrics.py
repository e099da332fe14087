"""Aggregates over run logs: summaries by stage, pivots by document, rollups, windows of days and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_runs(runs: DataFrame) -> DataFrame:
    """One row an id: logs are delivered again with the same id. The partial distinct runs before the shuffle."""
    return runs.dropDuplicates(["id"])


def stage_summary(stages: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts, failures, duration (mean, median, 95th percentile, seconds) and token rate of each stage.

    The test for a finished run stands in the join condition, so a stage without runs stays, with count 0 and nulls.
    ok null is no failure. A stage without time or tokens has a null rate.
    """
    r = runs.where(F.col("ended_at").isNotNull()).select(F.col("stage").alias("r_stage"), "id", "ok", "ms", "n_tokens", "ended_at")
    seconds = lambda c: F.round(c / 1000.0, 2)
    by = r.groupBy("r_stage").agg(
        F.count("id").alias("runs"), F.count_if(F.col("ok") == F.lit(False)).alias("failures"), seconds(F.avg("ms")).alias("mean_s"),
        seconds(F.expr("percentile_cont(0.5) within group (order by ms)")).alias("median_s"), seconds(F.expr("percentile_cont(0.95) within group (order by ms)")).alias("p95_s"),
        F.sum("n_tokens").cast("long").alias("tokens"), F.sum("ms").cast("long").alias("total_ms"), F.max("ended_at").alias("last_at"),
    )
    rate = F.when((F.col("total_ms") > 0) & (F.col("tokens") > 0), F.round(F.col("tokens") * 1000.0 / F.col("total_ms"), 3))
    joined = stages.join(by, stages.stage == by.r_stage, "left").withColumn("tokens_per_s", rate)
    return joined.select("stage", "ord", F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("failures", F.lit(0)).alias("failures"), "mean_s", "median_s", "p95_s", "tokens", "tokens_per_s", "last_at")


def journey(runs: DataFrame, key: str, stage: str, value: str, stages: list[str]) -> DataFrame:
    """A row a key: the sum of `value` in each stage (null where it has none), how many stages it saw, whether all went well."""
    sums = [F.sum(F.when(F.col(stage) == s, F.col(value))).cast("long").alias(f"{s}_ms") for s in stages]
    return runs.where(F.col(key).isNotNull()).groupBy(key).agg(*sums, F.countDistinct(stage).alias("stages"), F.bool_and(F.coalesce("ok", F.lit(True))).alias("all_ok"))


def share_change(facts: DataFrame, key: str, day: str, until: Column, days: int = 7) -> DataFrame:
    """Per key the events of the last `days` days up to `until` and of the `days` before, and the change of its share of all
    events in percent; null without a share before. Later rows are in neither window."""
    age = F.datediff(until, F.col(day))
    marked = facts.withColumn("now", age.between(0, days - 1).cast("int")).withColumn("ago", age.between(days, 2 * days - 1).cast("int"))
    by = marked.groupBy(key).agg(F.sum("now").cast("long").alias("now"), F.sum("ago").cast("long").alias("ago"))
    total = by.agg(F.sum("now").alias("all_now"), F.sum("ago").alias("all_ago"))
    a, b = F.col("now") / F.nullif("all_now", F.lit(0)), F.col("ago") / F.nullif("all_ago", F.lit(0))
    return by.crossJoin(F.broadcast(total)).select(key, "now", "ago", F.when(F.col("ago") > 0, F.round((a - b) * 100.0 / b, 1)).alias("share_change"))  # the broadcast has one row


def settled_day(facts: DataFrame, day: str, back: int = 30) -> DataFrame:
    """The latest day with at least half the (discrete) median of the daily counts of the trailing `back` days; one row."""
    daily = facts.where(F.col(day).isNotNull()).groupBy(F.to_date(day).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    newest = daily.agg(F.max("d").alias("newest"))
    recent = daily.crossJoin(F.broadcast(newest)).where(F.col("d") > F.date_sub("newest", back))
    half = recent.agg(F.expr("percentile_disc(0.5) within group (order by n)").alias("m"))
    return recent.crossJoin(F.broadcast(half)).where(F.col("n") >= F.expr("cast(m as long) div 2")).agg(F.max("d").alias("settled_day"), F.max(F.col("m").cast("long")).alias("median_n"))


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Upper median of each key by ranks, without a list: a hot key is sorted with spilling, never held in memory."""
    w = Window.partitionBy(key)
    ranked = rows.where(F.col(value).isNotNull()).withColumn("rn", F.row_number().over(w.orderBy(value))).withColumn("n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("rn") == F.floor(F.col("n") / 2) + 1).select(key, F.col(value).alias("upper_median"))
