"""Queries over run logs and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources.tables import table
from .registry import query

_RUNS = "(SELECT DISTINCT ON (id) * FROM stage_run ORDER BY id, started_at, host)"
_STAGES = ["fetch", "gate", "segment", "values", "extract", "resolve", "score", "serve", "archive"]


def _runs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "stage_run", *columns)


@query("""
SELECT s.stage, s.ord, count(r.id) AS runs, count(*) FILTER (WHERE r.ok IS FALSE) AS failures, round(avg(r.ms) / 1000.0, 2) AS mean_s,
  round(percentile_cont(0.5) WITHIN GROUP (ORDER BY r.ms) / 1000.0, 2) AS median_s, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY r.ms) / 1000.0, 2) AS p95_s,
  CAST(sum(r.n_tokens) AS BIGINT) AS tokens, CASE WHEN sum(r.ms) > 0 AND sum(r.n_tokens) > 0 THEN round(sum(r.n_tokens) * 1000.0 / sum(r.ms), 3) END AS tokens_per_s, max(r.ended_at) AS last_at
FROM stage_order s LEFT JOIN stage_run r ON r.stage = s.stage AND r.ended_at IS NOT NULL GROUP BY s.stage, s.ord""")
def stage_summary(spark: SparkSession, d: str) -> DataFrame:
    return M.stage_summary(table(spark, d, "stage_order", "stage", "ord"), _runs(spark, d, "id", "stage", "ok", "ms", "n_tokens", "ended_at"))


@query("SELECT doc_id, " + ", ".join(f"CAST(sum(CASE WHEN stage = '{s}' THEN ms END) AS BIGINT) AS {s}_ms" for s in _STAGES) + ", count(DISTINCT stage) AS stages, bool_and(coalesce(ok, true)) AS all_ok FROM stage_run WHERE doc_id IS NOT NULL GROUP BY doc_id")
def doc_journey_pivot(spark: SparkSession, d: str) -> DataFrame:
    return M.journey(_runs(spark, d, "doc_id", "stage", "ms", "ok"), "doc_id", "stage", "ms", _STAGES)


@query("""
SELECT run_id, min(started_at) AS first_at, max(ended_at) AS last_at, count(*) AS n, count(*) FILTER (WHERE ok IS FALSE) AS failed, count(DISTINCT doc_id) AS docs,
  string_agg(DISTINCT stage, ',' ORDER BY stage) AS stages FROM stage_run GROUP BY run_id""")
def run_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, "run_id", "started_at", "ended_at", "ok", "doc_id", "stage").groupBy("run_id").agg(
        F.min("started_at").alias("first_at"), F.max("ended_at").alias("last_at"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("ok") == F.lit(False)).alias("failed"),
        F.countDistinct("doc_id").alias("docs"), F.array_join(F.sort_array(F.collect_set("stage")), ",").alias("stages"),
    )


@query("""
WITH t AS (SELECT max(started_at) AS now FROM stage_run)
SELECT stage, CAST(round(avg(ms)) AS BIGINT) AS avg_ms, CAST(max(ms) AS BIGINT) AS max_ms, CAST(sum(CAST(NOT ok AS INT)) AS BIGINT) AS failed FROM stage_run, t WHERE started_at > now - INTERVAL 24 HOUR GROUP BY stage""")
def last_day_stages(spark: SparkSession, d: str) -> DataFrame:
    runs = _runs(spark, d, "stage", "started_at", "ms", "ok")
    now = runs.agg(F.max("started_at").alias("now"))
    return runs.crossJoin(F.broadcast(now)).where(F.col("started_at") > F.expr("now - interval 24 hours")).groupBy("stage").agg(
        F.round(F.avg("ms")).cast("long").alias("avg_ms"), F.max("ms").cast("long").alias("max_ms"), F.sum((~F.col("ok")).cast("int")).cast("long").alias("failed")
    )


@query("SELECT stage, coalesce(CAST(ok AS VARCHAR), 'open') AS state, count(*) AS n FROM stage_run GROUP BY ALL")
def group_counts(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, "stage", "ok").groupBy("stage", F.coalesce(F.col("ok").cast("string"), F.lit("open")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE stage IN ('fetch', 'gate')) AS early, max(ended_at) AS last_at FROM stage_run")
def global_counts(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, "stage", "ended_at").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("stage").isin("fetch", "gate")).alias("early"), F.max("ended_at").alias("last_at"))


@query("""
WITH e AS (SELECT *, CAST(ts AS DATE) AS d FROM events), t AS (SELECT max(d) AS until FROM e),
by_user AS (SELECT user_id, CAST(sum(CASE WHEN until - d BETWEEN 0 AND 6 THEN 1 ELSE 0 END) AS BIGINT) AS now, CAST(sum(CASE WHEN until - d BETWEEN 7 AND 13 THEN 1 ELSE 0 END) AS BIGINT) AS ago FROM e, t GROUP BY user_id),
a AS (SELECT sum(now) AS all_now, sum(ago) AS all_ago FROM by_user)
SELECT user_id, now, ago, CASE WHEN ago > 0 THEN round((now * 1.0 / nullif(all_now, 0) - ago * 1.0 / nullif(all_ago, 0)) * 100.0 / (ago * 1.0 / nullif(all_ago, 0)), 1) END AS share_change FROM by_user, a""")
def window_share_change(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events", "user_id", "ts")
    until = events.agg(F.max(F.to_date("ts")).alias("until"))
    return M.share_change(events.crossJoin(F.broadcast(until)).withColumn("day", F.to_date("ts")), "user_id", "day", F.col("until"))


@query("""
WITH daily AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1), recent AS (SELECT * FROM daily WHERE d > (SELECT max(d) FROM daily) - 30),
m AS (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY n) AS m FROM recent)
SELECT max(d) AS settled_day, CAST(max(m) AS BIGINT) AS median_n FROM recent, m WHERE n >= m // 2""")
def settled_day_watermark(spark: SparkSession, d: str) -> DataFrame:
    return M.settled_day(table(spark, d, "events", "ts"), "ts")


@query("SELECT l_returnflag, upper_median FROM (SELECT l_returnflag, l_extendedprice AS upper_median, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE rn = n // 2 + 1")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return M.upper_median(table(spark, d, "lineitem", "l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice")


@query("SELECT event_type, user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY ALL")
def events_json_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_type", "user_id", "props").groupBy("event_type", "user_id", F.expr("try_cast(get_json_object(props, '$.k') as int)").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT stage, host_name, count(*) AS n, CAST(sum(n_items) AS BIGINT) AS items, grouping_id(stage, host_name) AS level FROM (SELECT *, lower(trim(host)) AS host_name FROM stage_run) GROUP BY CUBE (stage, host_name)")
def extension_cube(spark: SparkSession, d: str) -> DataFrame:
    """Beyond parity: all combinations of two dimensions at once."""
    return _runs(spark, d, "stage", "host", "n_items").withColumn("host_name", F.lower(F.trim("host"))).cube("stage", "host_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_items").cast("long").alias("items"), F.grouping_id("stage", "host_name").cast("long").alias("level")
    )


@query("""
WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM m)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, session""")
def extension_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Beyond parity: gaps and islands; a session ends after more than 30 minutes without an event."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, d, "events", "user_id", "ts", "event_id")
    opens = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 30 minutes"), 0).otherwise(1)
    return events.withColumn("opens", opens).withColumn("session", F.sum("opens").over(w)).groupBy("user_id", "session").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")
    ).drop("session")


@query("""
SELECT r.run_id, m.n AS n_runs, m.total_ms, m.tokens FROM extraction_run r LEFT JOIN (SELECT run_id, count(*) AS n, CAST(sum(ms) AS BIGINT) AS total_ms, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM stage_run GROUP BY run_id) m ON r.run_id = m.run_id""".replace("m.n AS n_runs", "coalesce(m.n, 0) AS n_runs"))
def scalar_decorrelated(spark: SparkSession, d: str) -> DataFrame:
    """Correlated counts and sums as one aggregate and a left join: a count becomes 0, a sum stays null."""
    by = _runs(spark, d, "run_id", "ms", "n_tokens").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").cast("long").alias("total_ms"), F.sum("n_tokens").cast("long").alias("tokens"))
    return table(spark, d, "extraction_run", "run_id").join(by, "run_id", "left").select("run_id", F.coalesce("n", F.lit(0)).alias("n_runs"), "total_ms", "tokens")


@query("SELECT id, stage, CAST(epoch_us(ended_at) - epoch_us(started_at) AS BIGINT) // 100000 / 10.0 AS took_s FROM stage_run WHERE ended_at IS NOT NULL")
def epoch_differences(spark: SparkSession, d: str) -> DataFrame:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    tenths = F.floor((micros("ended_at") - micros("started_at")) / 100000)
    return _runs(spark, d, "id", "stage", "started_at", "ended_at").where(F.col("ended_at").isNotNull()).select("id", "stage", (tenths / 10.0).alias("took_s"))
