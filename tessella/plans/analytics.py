"""Queries on evidence, facets, threads and nested results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evidence as V
from ..sources.tables import table
from .registry import query

_HOST = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"
TIERS = {"official": ["ministry.example", "gov.example"], "registry": ["registry.example"]}


@query(f"SELECT {_HOST} AS host, CASE WHEN {_HOST} = 'registry.example' OR {_HOST} LIKE '%.registry.example' THEN 'registry' WHEN {_HOST} IN ('ministry.example', 'gov.example') OR {_HOST} LIKE '%.ministry.example' OR {_HOST} LIKE '%.gov.example' THEN 'official' ELSE 'news' END AS tier, count(*) AS n FROM serving_patent WHERE url IS NOT NULL GROUP BY ALL")
def source_tiers(spark: SparkSession, d: str) -> DataFrame:
    h = text.host(F.col("url"))
    return table(spark, d, "serving_patent", "url").where("url is not null").groupBy(h.alias("host"), V.tier(h, TIERS).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_partkey, v AS value, count(DISTINCT l_suppkey) AS sources, count(*) AS readings FROM (SELECT l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS v FROM lineitem) GROUP BY l_partkey, v HAVING count(DISTINCT l_suppkey) >= 2")
def consensus_two_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("value"))
    return V.consensus(rows, ["l_partkey"], "value", "l_suppkey")


@query("""
SELECT value, count(*) AS n FROM (SELECT DISTINCT pub_no, ord, x AS value FROM (SELECT pub_no, ord, unnest(CAST(json_extract_string(ipc, '$[*]') AS VARCHAR[])) AS x FROM serving_patent WHERE ipc IS NOT NULL) WHERE trim(x) <> '') GROUP BY value""")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "serving_patent", "pub_no", "ord", "ipc").distinct().withColumn("codes", F.from_json("ipc", "array<string>"))
    return V.facet(rows, "codes")


@query("SELECT key, spelling, n FROM (SELECT key, spelling, sum(k) OVER (PARTITION BY key) AS n, row_number() OVER (PARTITION BY key ORDER BY k DESC, spelling) AS rn FROM (SELECT lower(trim(country)) AS key, country AS spelling, count(*) AS k FROM serving_competitors WHERE country IS NOT NULL GROUP BY ALL)) WHERE rn = 1".replace("sum(k) OVER (PARTITION BY key) AS n", "CAST(sum(k) OVER (PARTITION BY key) AS BIGINT) AS n"))
def canonical_spelling(spark: SparkSession, d: str) -> DataFrame:
    return V.canonical_spelling(table(spark, d, "serving_competitors", "country"), "country", F.lower(F.trim("country")))


@query("SELECT count(DISTINCT name) AS names, count(DISTINCT lower(trim(country))) AS countries, count(*) FILTER (WHERE starting_year BETWEEN 1500 AND 2026) AS dated, count(*) FILTER (WHERE starting_year IS NULL) AS undated, CAST(sum(CASE WHEN starting_year BETWEEN 1500 AND 2026 THEN starting_year END) AS BIGINT) AS total FROM serving_competitors")
def kpi_tiles(spark: SparkSession, d: str) -> DataFrame:
    y = F.col("starting_year")
    return table(spark, d, "serving_competitors", "name", "country", "starting_year").agg(
        F.countDistinct("name").alias("names"), F.countDistinct(F.lower(F.trim("country"))).alias("countries"), F.count_if(y.between(1500, 2026)).alias("dated"),
        F.count_if(y.isNull()).alias("undated"), F.sum(F.when(y.between(1500, 2026), y)).cast("long").alias("total"),
    )


@query("SELECT o_orderpriority AS value, 'priority' AS facet, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT o_orderstatus, 'status', count(*) FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def cascading_facets(spark: SparkSession, d: str) -> DataFrame:
    """Each facet counted with the other's filter: one scan, two conditional groups by grouping sets."""
    o = table(spark, d, "orders", "o_orderpriority", "o_orderstatus")
    by = o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("k"))
    a = by.where("o_orderstatus = 'F'").groupBy(F.col("o_orderpriority").alias("value")).agg(F.sum("k").cast("long").alias("n")).withColumn("facet", F.lit("priority"))
    b = by.where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_orderstatus").alias("value")).agg(F.sum("k").cast("long").alias("n")).withColumn("facet", F.lit("status"))
    return a.unionByName(b).select("value", "facet", "n")


@query("SELECT r_name, string_agg(n_name, '|' ORDER BY n_nationkey) AS nations, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def nested_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Rows grouped into ordered lists, flattened here for comparison."""
    j = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    by = j.groupBy("r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"), F.count(F.lit(1)).alias("n"))
    return by.select("r_name", F.array_join(F.transform("x", lambda s: s["n_name"]), "|").alias("nations"), "n")


@query()
def thread_links(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a source in order of time as one thread."""
    rows = table(spark, d, "extracted_document", "source_id", "first_seen", "document_id")
    return V.threads(rows, "source_id", "first_seen", "document_id")


@query()
def near_dup_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_document", "document_id", "title", "source_id")
    return V.near_titles(rows, "document_id", "title", "source_id")


@query("SELECT document_id FROM extracted_document d WHERE text IS NULL OR NOT EXISTS (SELECT 1 FROM stage_run r WHERE r.doc_id = d.document_id AND r.ok)")
def alarm_unfinished(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "extracted_document", "document_id", F.col("text").isNull().alias("bare"))
    ok = table(spark, d, "stage_run", F.col("doc_id").alias("document_id"), "ok").where("ok").select("document_id", F.lit(True).alias("done")).distinct()
    return docs.join(ok, "document_id", "left").where("bare or done is null").select("document_id")


@query("SELECT count(*) FILTER (WHERE NOT regexp_full_match(published_at, '[0-9]{4}-[0-9]{2}-[0-9]{2}T.*')) AS odd, count(*) FILTER (WHERE published_at IS NULL) AS missing, count(*) AS n FROM documents")
def alarm_timestamp_format(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("published_at")
    return table(spark, d, "documents", "published_at").agg(F.count_if(~p.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T")).alias("odd"), F.count_if(p.isNull()).alias("missing"), F.count(F.lit(1)).alias("n"))
