"""Queries on joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins as J
from ..sources.tables import table
from .registry import query


@query("SELECT document_id, source_id FROM extracted_document d WHERE NOT EXISTS (SELECT 1 FROM stage_run r WHERE r.doc_id = d.document_id AND r.stage = 'extract' AND r.ok) AND NOT EXISTS (SELECT 1 FROM serving_patent p WHERE p.pub_no = d.document_id)")
def anti_unprocessed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "extracted_document", "document_id", "source_id")
    done = table(spark, d, "stage_run", F.col("doc_id").alias("document_id"), "stage", "ok").where("document_id is not null and stage = 'extract' and ok").select("document_id")
    return docs.join(done, "document_id", "left_anti").join(table(spark, d, "serving_patent", F.col("pub_no").alias("document_id")), "document_id", "left_anti")


@query("SELECT document_id, language FROM extracted_document d WHERE EXISTS (SELECT 1 FROM stage_run r WHERE r.doc_id = d.document_id AND r.stage = 'extract' AND r.ok)")
def semi_active(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "stage_run", F.col("doc_id").alias("document_id"), "stage", "ok").where("stage = 'extract' and ok")
    return table(spark, d, "extracted_document", "document_id", "language").join(done, "document_id", "left_semi")


@query("SELECT e.entity_id, e.entity_type, count(a.alias_id) AS n_aliases, CAST(coalesce(sum(a.n_mentions), 0) AS BIGINT) AS mentions FROM extracted_entity e LEFT JOIN (SELECT DISTINCT * FROM extracted_entity_alias) a ON a.entity_id = e.entity_id AND a.alias_kind = 'name' GROUP BY ALL")
def left_optional(spark: SparkSession, d: str) -> DataFrame:
    """The filter stands in the join condition and keeps entities without a match."""
    a = table(spark, d, "extracted_entity_alias").distinct().where("alias_kind = 'name'").groupBy("entity_id").agg(F.count("alias_id").alias("n_aliases"), F.sum("n_mentions").cast("long").alias("mentions"))
    return table(spark, d, "extracted_entity", "entity_id", "entity_type").join(a, "entity_id", "left").fillna(0, ["n_aliases", "mentions"])


@query("SELECT d.language, a.lang, count(*) AS n FROM extracted_document d JOIN stage_run r ON r.doc_id = d.document_id JOIN extraction_run x USING (run_id) LEFT JOIN (SELECT code AS lang, code FROM language_ref) a ON a.code = d.language GROUP BY ALL")
def inner_three_way(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "stage_run", F.col("doc_id").alias("document_id"), "run_id").join(table(spark, d, "extraction_run", "run_id"), "run_id", "left_semi")
    per_doc = runs.groupBy("document_id").agg(F.count(F.lit(1)).alias("k"))  # before the join, so a hot document sends one row
    docs = table(spark, d, "extracted_document", "document_id", "language").join(per_doc, "document_id")
    ref = table(spark, d, "language_ref", F.col("code").alias("language"), F.col("code").alias("lang"))
    return docs.join(ref, "language", "left").groupBy("language", "lang").agg(F.sum("k").cast("long").alias("n"))


@query("WITH r AS (SELECT doc_id, count(*) AS n FROM stage_run WHERE stage = 'values' GROUP BY doc_id) SELECT document_id, n_sentences, n FROM extracted_document JOIN r ON doc_id = document_id WHERE n <> n_sentences")
def drift_check(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "stage_run", F.col("doc_id").alias("document_id"), "stage").where("stage = 'values'").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "extracted_document", "document_id", "n_sentences").join(r, "document_id").where("n != n_sentences")


@query("""
WITH a AS (SELECT run_id, min(started_at) AS first_at, max(ended_at) AS last_at, count(*) AS n FROM stage_run GROUP BY run_id), b AS (SELECT run_id, started_at AS first_at, started_at AS last_at, 1 AS n FROM extraction_run)
SELECT coalesce(a.run_id, b.run_id) AS run_id, least(a.first_at, b.first_at) AS first_at, greatest(a.last_at, b.last_at) AS last_at, coalesce(a.n, 0) + coalesce(b.n, 0) AS n FROM a FULL JOIN b ON a.run_id = b.run_id""")
def full_outer_run_merge(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "stage_run", "run_id", "started_at", "ended_at").groupBy("run_id").agg(F.min("started_at").alias("first_at"), F.max("ended_at").alias("last_at"), F.count(F.lit(1)).alias("n"))
    b = table(spark, d, "extraction_run", "run_id", F.col("started_at").alias("first_at"), F.col("started_at").alias("last_at"), F.lit(1).cast("long").alias("n"))
    return J.merge_full(a, b, "run_id", ["first_at"], ["last_at"], ["n"])


_SPANS = "SELECT id AS {0}id, coalesce(doc_id, run_id) AS k, CAST(epoch_ms(started_at) // 1000 AS BIGINT) AS {0}s, CAST(epoch_ms(started_at) // 1000 AS BIGINT) + 1 + ms // 1000 AS {0}e FROM (SELECT DISTINCT id, doc_id, run_id, started_at, ms, stage FROM stage_run) WHERE ms IS NOT NULL AND stage {1} 'extract'"


def _spans(spark: SparkSession, d: str, p: str, extract: bool) -> DataFrame:
    rows = table(spark, d, "stage_run", "id", "doc_id", "run_id", "started_at", "ms", "stage").distinct().where("ms is not null and stage " + ("= 'extract'" if extract else "!= 'extract'"))
    s = F.floor(F.unix_millis(F.col("started_at").cast("timestamp")) / 1000)
    return rows.select(F.col("id").alias(f"{p}id"), F.coalesce("doc_id", "run_id").alias("k"), s.alias(f"{p}s"), (s + 1 + F.expr("ms div 1000")).alias(f"{p}e"))


@query(f"SELECT a.k, lid, rid FROM ({_SPANS.format('l', '=')}) a JOIN ({_SPANS.format('r', '<>')}) b ON a.k = b.k AND ls - 43200 < re AND le + 43200 > rs")
def span_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Runs that overlap with half a day around an extraction of the same document."""
    wide = _spans(spark, d, "l", True).withColumns({"ls": F.col("ls") - 43200, "le": F.col("le") + 43200})
    return J.overlap_join(wide, _spans(spark, d, "r", False), ["k"], ("ls", "le"), ("rs", "re"), 3600).select("k", "lid", "rid")


@query(f"SELECT a.k, lid, rid FROM ({_SPANS.format('l', '=')}) a JOIN ({_SPANS.format('r', '<>')}) b ON a.k = b.k AND rs >= ls - 86400 AND re <= le + 86400")
def span_containment(spark: SparkSession, d: str) -> DataFrame:
    """Runs within a day around an extraction of the same document."""
    wide = _spans(spark, d, "l", True).withColumns({"ls": F.col("ls") - 86400, "le": F.col("le") + 86400})
    return J.containment_join(wide, _spans(spark, d, "r", False), ["k"], ("ls", "le"), ("rs", "re"), 86400).select("k", "lid", "rid")


@query(f"SELECT a.k, lid, rid, abs(ls - rs) AS apart FROM ({_SPANS.format('l', '=')}) a JOIN ({_SPANS.format('r', '<>')}) b ON a.k = b.k AND abs(ls - rs) <= 7200")
def proximity_pairs(spark: SparkSession, d: str) -> DataFrame:
    near = J.near_join(_spans(spark, d, "l", True), _spans(spark, d, "r", False), ["k"], "ls", "rs", 7200)
    return near.select("k", "lid", "rid", F.abs(F.col("ls") - F.col("rs")).alias("apart"))


@query("""
SELECT event_id, user_id, ts, c_ts_as_of, value FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN (SELECT user_id, ts AS c_ts_as_of, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL) c USING (user_id) """.replace("USING (user_id)", "ON e.user_id = c.user_id AND e.ts >= c.c_ts_as_of").replace("SELECT event_id, user_id, ts, c_ts", "SELECT event_id, e.user_id, ts, c_ts"))
def as_of_last_click(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events", "event_id", "user_id", "ts", "event_type", "value")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("ts").alias("c_ts"), "value")
    return J.as_of(events.where("event_type = 'error'").select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", "c_ts", ["value"])


@query("""
WITH c AS (SELECT DISTINCT substring(p_type, 1, 3) AS p, substring(p_type, 1, 3) AS v FROM part UNION SELECT DISTINCT substring(p_type, 1, 6), substring(p_type, 1, 6) FROM part WHERE p_size > 25)
SELECT p_partkey, p_type, (SELECT max_by(v, length(p)) FROM c WHERE starts_with(p_type, p)) AS category FROM part""")
def longest_prefix_category(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part", "p_partkey", "p_type", "p_size")
    codes = part.select(F.substring("p_type", 1, 3).alias("p")).union(part.where("p_size > 25").select(F.substring("p_type", 1, 6))).distinct().withColumn("category", F.col("p"))
    return J.longest_prefix(part.drop("p_size"), "p_type", codes, "p", "category", ["p_partkey"])


@query("""
WITH u AS (SELECT stage, count(*) AS n FROM stage_run GROUP BY stage), m AS (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY n) AS m FROM u) SELECT stage, n, CAST(m AS BIGINT) AS m FROM u, m WHERE n >= m // 2""")
def cross_one_row(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "stage_run", "stage").groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    m = u.agg(F.expr("percentile_disc(0.5) within group (order by n)").cast("long").alias("m"))
    return u.crossJoin(F.broadcast(m)).where("n >= m div 2")  # one row


@query("""
WITH p AS (SELECT comp_id, trim(x, '"') AS partner FROM (SELECT comp_id, unnest(CAST(json_extract(partners, '$[*]') AS VARCHAR[])) AS x FROM serving_competitors WHERE partners IS NOT NULL))
SELECT partner, count(DISTINCT comp_id) AS rivals, string_agg(DISTINCT comp_id, ',' ORDER BY comp_id) AS who FROM p GROUP BY partner HAVING count(DISTINCT comp_id) > 1""")
def shared_partner_index(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "serving_competitors", "comp_id", "partners").withColumn("partner", F.explode(F.from_json("partners", "array<string>"))).distinct()
    by = rows.groupBy("partner").agg(F.count(F.lit(1)).alias("rivals"), F.array_join(F.sort_array(F.collect_set("comp_id")), ",").alias("who"))
    return by.where("rivals > 1")
