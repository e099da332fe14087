"""Queries on scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, measures, text
from ..sources.tables import table
from .registry import query


@query("SELECT document_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www[.]', '') AS host FROM extracted_document WHERE url IS NOT NULL")
def url_hosts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_document", "document_id", "url").where("url is not null").select("document_id", text.host(F.col("url")).alias("host"))


@query("""
SELECT document_id, concat_ws('/', regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www[.]', ''),
  array_to_string(list_filter(string_split(lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '/'), lambda p: p <> '' AND NOT regexp_full_match(p, '[a-z]{2}(-[a-z]{2})?')), '/')) AS url_key FROM extracted_document WHERE url IS NOT NULL""")
def url_identity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_document", "document_id", "url").where("url is not null").select("document_id", text.url_key(F.col("url")).alias("url_key"))


@query("""
SELECT document_id, TRY_CAST(nullif(regexp_extract(url, '/((?:19|20)[0-9]{2})/([0-9]{1,2})/', 1), '') AS INT) AS y, TRY_CAST(nullif(regexp_extract(url, '/((?:19|20)[0-9]{2})/([0-9]{1,2})/', 2), '') AS INT) AS m FROM extracted_document WHERE url IS NOT NULL""")
def url_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_document", "document_id", "url").where("url is not null").withColumn("x", dates.url_date(F.col("url")))
    return rows.select("document_id", F.col("x.y").alias("y"), F.col("x.m").alias("m"))


@query("""
WITH f AS (SELECT pub_no, ord, filed, regexp_extract(filed, '([0-9]{4})-([0-9]{2})-([0-9]{2})', ['y', 'm', 'd']) AS i FROM serving_patent WHERE regexp_matches(filed, '[0-9]{4}-[0-9]{2}-[0-9]{2}'))
SELECT pub_no, ord, CAST(i.y AS INT) AS y, CAST(i.m AS INT) AS m, CAST(i.d AS INT) AS d FROM f""")
def printed_iso_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "serving_patent", "pub_no", "ord", "filed").where(F.col("filed").rlike(r"\d{4}-\d{2}-\d{2}")).withColumn("x", dates.printed_date(F.col("filed")))
    return rows.select("pub_no", "ord", "x.y", "x.m", "x.d")


@query()
def printed_dates(spark: SparkSession, d: str) -> DataFrame:
    """All printed forms, with labels as far as a date is known."""
    rows = table(spark, d, "serving_patent", "pub_no", "ord", "filed", "granted").withColumns({"a": dates.printed_date(F.col("filed")), "b": dates.printed_date(F.col("granted"))})
    return rows.select("pub_no", "ord", dates.label(F.col("a")).alias("filed_on"), dates.label(F.col("b")).alias("granted_on"))


@query()
def trusted_dates(spark: SparkSession, d: str) -> DataFrame:
    """The metadata's date before the URL's; the latter may only add a day."""
    rows = table(spark, d, "extracted_document", "document_id", "url", "meta", "first_seen")
    meta = dates.printed_date(F.get_json_object("meta", "$.fetched_at"))
    folded = dates.first_trusted(F.array_compact(F.array(meta, dates.url_date(F.col("url")))), F.to_date("first_seen"))
    return rows.select("document_id", dates.label(folded).alias("printed"))


@query("SELECT comp_id, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS slug, CASE WHEN length(name) > 20 THEN rtrim(substring(name, 1, 19)) || '…' ELSE name END AS short FROM serving_competitors WHERE name IS NOT NULL")
def slugs_and_clips(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "serving_competitors", "comp_id", "name").where("name is not null")
    return rows.select("comp_id", text.slug(F.col("name")).alias("slug"), text.clip(F.col("name"), 20).alias("short"))


@query()
def company_keys(spark: SparkSession, d: str) -> DataFrame:
    """Folded names without legal form, their script set and initialism."""
    rows = table(spark, d, "serving_competitors", "comp_id", "name")
    folded = text.unicode_fold(F.col("name"))
    return rows.select("comp_id", text.company_key(folded).alias("key"), text.scripts(F.col("name")).alias("scripts"), text.initialism(F.col("name")).alias("initials"))


@query("SELECT document_id, CASE WHEN substring(regexp_replace(lower(coalesce(language, '')), '[^a-z]', '', 'g'), 1, 2) IN ('en','de','fr','es','pt','it','nl','pl','tr','ru','uk','ar','fa','hi','zh','ja','ko','th') THEN substring(regexp_replace(lower(coalesce(language, '')), '[^a-z]', '', 'g'), 1, 2) ELSE 'en' END AS code FROM extracted_document")
def language_codes(spark: SparkSession, d: str) -> DataFrame:
    known = "en de fr es pt it nl pl tr ru uk ar fa hi zh ja ko th".split()
    return table(spark, d, "extracted_document", "document_id", "language").select("document_id", text.language_code(F.col("language"), known).alias("code"))


@query("SELECT doc_id, count(*) AS n, round(max(v), 3) AS top FROM (SELECT doc_id, CAST(replace(regexp_extract(x, '^([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), ',', '') AS DOUBLE) * CASE WHEN lower(x) LIKE '%tonnes' THEN 1000 ELSE 1 END AS v FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\b([0-9][0-9,]*(?:\\.[0-9]+)? ?(?:tonnes|percent|hours))\\b', 1)) AS x FROM documents)) GROUP BY doc_id")
def text_quantities(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(F.filter(measures.quantities(F.col("text")), lambda q: q["unit"].isin("tonnes", "percent", "hours"))).alias("q"))
    base = measures.to_base(F.col("q.value"), F.col("q.unit"))
    return rows.withColumn("v", base["value"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("v"), 3).alias("top"))


@query("""
WITH r AS (SELECT p_partkey, p_retailprice, CAST(p_size AS DOUBLE) AS lo, p_size * 1.25 + 1 AS hi, 24.0 AS lo_b, 30.0 AS hi_b FROM part),
 g AS (SELECT *, CASE WHEN lo > hi_b THEN lo - hi_b WHEN lo_b > hi THEN lo_b - hi ELSE 0 END AS gap, CASE WHEN lo > hi_b THEN (lo + hi_b) / 2 ELSE (hi + lo_b) / 2 END AS mean FROM r)
SELECT p_partkey, CASE WHEN gap = 0 OR gap < 0.03 * mean THEN 0 WHEN lo > hi_b THEN 1 ELSE -1 END AS decides, CAST(floor(p_retailprice + 0.5) AS BIGINT) AS up FROM g""")
def range_decisions(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    rows = table(spark, d, "part", "p_partkey", "p_size", "p_retailprice")
    return rows.select("p_partkey", measures.ranges_decide(size, size * 1.25 + 1, F.lit(24.0), F.lit(30.0)).alias("decides"), measures.js_round(F.col("p_retailprice")).alias("up"))


@query("SELECT l_suppkey, n, w, round(50 + (100.0 * w / n - 50) * n / (n + 1), 6) AS edge FROM (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'R') AS w FROM lineitem GROUP BY l_suppkey)")
def edge_index(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "lineitem", "l_suppkey", "l_returnflag").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("w"))
    return by.select("l_suppkey", "n", "w", F.round(measures.shrunk_index(F.col("w"), F.col("n") - F.col("w")), 6).alias("edge"))
