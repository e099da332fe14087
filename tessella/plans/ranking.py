"""Queries on ranks, representatives, pages and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranking as R
from ..sources.tables import table
from .registry import query


@query("""
SELECT doc_id, lang, CASE WHEN n_chars IS NOT NULL AND n >= 30 THEN (below + eq / 2.0) / n ELSE 0.5 END AS mid_rank FROM (
  SELECT d.doc_id, d.lang, d.n_chars, c.n, c.below, c.eq FROM documents d LEFT JOIN (SELECT lang, n_chars, eq, sum(eq) OVER (PARTITION BY lang) AS n, sum(eq) OVER (PARTITION BY lang ORDER BY n_chars) - eq AS below FROM (SELECT lang, n_chars, count(*) AS eq FROM documents WHERE n_chars IS NOT NULL GROUP BY ALL)) c ON c.lang = d.lang AND c.n_chars = d.n_chars)""")
def midrank_by_cohort(spark: SparkSession, d: str) -> DataFrame:
    return R.mid_rank(table(spark, d, "documents", "doc_id", "lang", "n_chars"), ["lang"], "n_chars").select("doc_id", "lang", "mid_rank")


@query("""
WITH c AS (SELECT source, n_chars, count(*) AS eq FROM documents WHERE n_chars IS NOT NULL AND source IS NOT NULL GROUP BY ALL), r AS (SELECT source, n_chars, sum(eq) OVER (PARTITION BY source) AS n, (sum(eq) OVER (PARTITION BY source ORDER BY n_chars) - eq + eq / 2.0) / sum(eq) OVER (PARTITION BY source) AS r FROM c)
SELECT source, n_chars, CASE WHEN n >= 2 THEN round(0.5 + (r - 0.5) * n / (n - 1), 6) ELSE 0.5 END AS spread FROM r""")
def rescaled_midrank(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "documents", "source", "n_chars").where("n_chars is not null and source is not null").groupBy("source", "n_chars").agg(F.count(F.lit(1)).alias("eq"))
    w = Window.partitionBy("source")
    n = F.sum("eq").over(w)
    r = (F.sum("eq").over(w.orderBy("n_chars").rowsBetween(Window.unboundedPreceding, 0)) - F.col("eq") + F.col("eq") / 2) / n
    return by.select("source", "n_chars", F.round(R.rescaled(r, n), 6).alias("spread"))


@query("SELECT stage, id, ms FROM (SELECT stage, id, ms, row_number() OVER (PARTITION BY stage ORDER BY ms DESC NULLS LAST, id) AS rn FROM (SELECT DISTINCT stage, id, ms FROM stage_run)) WHERE rn <= 5")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    return R.first_per_key(table(spark, d, "stage_run", "stage", "id", "ms").distinct(), ["stage"], [F.col("ms").desc_nulls_last(), F.col("id")], 5)


@query("SELECT url, document_id, first_seen FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY first_seen, document_id) AS rn FROM extracted_document WHERE url IS NOT NULL) WHERE rn = 1")
def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_document", "url", "document_id", "first_seen").where("url is not null")
    return R.first_per_key(rows, ["url"], [F.col("first_seen"), F.col("document_id")])


@query("SELECT source_id, document_id, turn FROM (SELECT source_id, document_id, row_number() OVER (PARTITION BY source_id ORDER BY first_seen DESC, document_id) AS turn, first_seen FROM extracted_document) ORDER BY turn, source_id, first_seen DESC, document_id LIMIT 100")
def round_robin_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_document", "source_id", "document_id", "first_seen")
    return R.round_robin(rows, "source_id", [F.col("first_seen").desc(), F.col("document_id")], 100).select("source_id", "document_id", F.col("turn").cast("long").alias("turn"))


@query("SELECT document_id, rn AS row_no, CAST(ceil(rn / 50.0) AS BIGINT) AS page FROM (SELECT document_id, row_number() OVER (ORDER BY first_seen DESC, document_id) AS rn FROM extracted_document)")
def feed_pages(spark: SparkSession, d: str) -> DataFrame:
    return R.pages(table(spark, d, "extracted_document", "document_id", "first_seen"), [F.col("first_seen").desc(), F.col("document_id")]).select("document_id", "row_no", "page")


@query("SELECT entity_id, surface FROM (SELECT entity_id, surface, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, length(surface) DESC, surface) AS rn FROM (SELECT entity_id, surface, sum(n_mentions) AS n FROM (SELECT DISTINCT * FROM extracted_entity_alias) WHERE entity_id IS NOT NULL GROUP BY ALL)) WHERE rn = 1")
def canonical_by_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Most mentions first, then the longer spelling, then the alphabet: one aggregate, no window."""
    by = table(spark, d, "extracted_entity_alias").distinct().where("entity_id is not null").groupBy("entity_id", "surface").agg(F.sum("n_mentions").alias("n"))
    return by.groupBy("entity_id").agg(F.expr("min_by(surface, struct(-n, -char_length(surface), surface))").alias("surface"))


@query("SELECT source, lpad(CAST(row_number() OVER (ORDER BY n DESC, source) AS VARCHAR), 2, '0') AS no, n FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source)")
def renumbered(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "documents", "source").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    no = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "source"))  # a row a source
    return by.select("source", F.lpad(no.cast("string"), 2, "0").alias("no"), "n")


@query("SELECT text_hash, min(document_id) AS kept, count(*) AS copies FROM (SELECT sha256(text) AS text_hash, document_id FROM extracted_document WHERE text IS NOT NULL) GROUP BY text_hash")
def exact_dup_bodies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_document", "text", "document_id").where("text is not null")
    return rows.groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.min("document_id").alias("kept"), F.count(F.lit(1)).alias("copies"))


@query("SELECT doc_id, buyer, title_key FROM (SELECT doc_id, source AS buyer, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS title_key, row_number() OVER (PARTITION BY source, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) ORDER BY doc_id) AS rn FROM documents WHERE title IS NOT NULL) WHERE rn = 1 OR title_key = ''")
def dedupe_by_title(spark: SparkSession, d: str) -> DataFrame:
    """First of each (buyer, normalised title); empty titles are never folded."""
    rows = table(spark, d, "documents", "doc_id", F.col("source").alias("buyer"), "title").where("title is not null")
    keyed = rows.withColumn("title_key", F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " "))).drop("title")
    rn = F.row_number().over(Window.partitionBy("buyer", "title_key").orderBy("doc_id"))
    return keyed.withColumn("rn", rn).where("rn = 1 or title_key = ''").drop("rn")


@query("SELECT doc_id AS id FROM documents WHERE source = 'wire_general' UNION SELECT event_id FROM events WHERE event_type = 'error'")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents", F.col("doc_id").alias("id"), "source").where("source = 'wire_general'").select("id")
    return a.union(table(spark, d, "events", "event_id", "event_type").where("event_type = 'error'").select("event_id")).distinct()


@query("SELECT stage FROM stage_order EXCEPT SELECT stage FROM stage_run")
def stages_without_runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stage_order", "stage").exceptAll(table(spark, d, "stage_run", "stage").distinct())


@query("SELECT 'run' AS kind, run_id AS ref, started_at AS at, NULL AS detail FROM extraction_run UNION ALL SELECT 'stage', run_id, started_at, stage FROM stage_run WHERE ok IS FALSE")
def union_timeline(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "extraction_run", F.lit("run").alias("kind"), F.col("run_id").alias("ref"), F.col("started_at").alias("at"))
    b = table(spark, d, "stage_run", F.lit("stage").alias("kind"), F.col("run_id").alias("ref"), F.col("started_at").alias("at"), F.col("stage").alias("detail"), "ok").where("ok = false").drop("ok")
    return a.unionByName(b, allowMissingColumns=True)
