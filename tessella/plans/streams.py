"""Queries that run a stream over a table once, and batch forms of the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.materialize import shared_folder
from ..sources.tables import table
from ..streaming import pipelines as P
from .registry import query


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, d: str) -> DataFrame:
    static = table(spark, d, "events")
    return P.read(spark, f"{d}/events.parquet", static)


@query("SELECT date_trunc('hour', ts) AS from_at, event_type, count(*) AS n, count(*) FILTER (WHERE value > 10) AS failed FROM events GROUP BY ALL")
def stream_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    """Complete mode: all windows after the last batch."""
    stream = _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = P.run_once(P.windowed_counts(stream, "ts", ["event_type"], "1 hour", "3 days", F.col("value") > 10), _folder(spark), "complete")
    return out.withColumn("from_at", F.col("from_at").cast("timestamp_ntz"))


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_without_repeats(spark: SparkSession, d: str) -> DataFrame:
    stream = _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return P.run_once(P.without_repeats(stream.select("event_id", "user_id", "event_type", "ts"), ["event_id"], "ts", "3 days"), _folder(spark)).select("event_id", "user_id", "event_type")


@query()
def stream_breaker(spark: SparkSession, d: str) -> DataFrame:
    """Hosts that failed three times in a row."""
    stream = P.read(spark, f"{d}/stage_run.parquet", table(spark, d, "stage_run"))
    rows = stream.select(F.lower(F.trim("host")).alias("host"), F.col("started_at").cast("timestamp").alias("at"), "ok").where("host is not null")
    return P.run_once(P.breaker(rows, "host", "at", "ok", 3, 3600), _folder(spark))


@query("""
WITH r AS (SELECT DISTINCT id, lower(trim(host)) AS host, started_at, ok FROM stage_run WHERE ok IS NOT NULL AND host IS NOT NULL), g AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY started_at, id) AS island FROM r)
SELECT host, min(started_at) AS from_at, count(*) AS failures FROM g WHERE NOT ok GROUP BY host, island HAVING count(*) >= 3""")
def failure_islands(spark: SparkSession, d: str) -> DataFrame:
    """Gaps and islands: runs of three or more failures in a row."""
    rows = table(spark, d, "stage_run", "id", F.lower(F.trim("host")).alias("host"), "started_at", "ok").where("ok is not null and host is not null").distinct()
    island = F.sum(F.col("ok").cast("int")).over(Window.partitionBy("host").orderBy("started_at", "id"))
    by = rows.withColumn("island", island).where("not ok").groupBy("host", "island").agg(F.min("started_at").alias("from_at"), F.count(F.lit(1)).alias("failures"))
    return by.where("failures >= 3").drop("island")
